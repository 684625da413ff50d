"""A count-min sketch of 64-bit hashes, built in parts and merged.

Each input task counts the cells of its hashes and sends them by blocks of cells:
a byte for the low bits of each cell, and the number of cells of each 256. A merging
task owns whole blocks and adds the parts' counts, up to 255. The merged counts
overestimate: the least count of a hash's cells is never below its number of
occurrences (or 255). For a prefilter, only whether a count reaches a limit is
needed, and that is one bit a cell.

The sketch's size follows the input up to `max_bits`; beyond, more hashes pass
as repeated, and what relies on it works more but loses nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import partitions

#: 2 rows of 2**28 cells: 64 MiB of bits, the most that is ever broadcast.
MAX_BITS, ROWS = 28, 2
_BLOCK_BITS = 22
_ROW_MULT = [np.uint64(1), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)]
_PART = "block int, cells binary"


def bits_for(expected: int, load: float = 0.25, max_bits: int = MAX_BITS) -> int:
    """Bits such that a row is filled to `load` by so many different hashes, within 16..max_bits."""
    return int(min(max(16, np.ceil(np.log2(max(1, expected) / load))), max_bits))


def cell(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Keys are often least hashes, which are small; mixed again, they spread evenly."""
    return tk.mix(h * _ROW_MULT[row]) >> np.uint64(64 - bits)


def pack_cells(cells: np.ndarray, block_bits: int) -> bytes:
    """Sorted cells of a block, with repeats: each different one and its number. Few cells are listed as they are."""
    fresh = np.r_[True, cells[1:] != cells[:-1]]
    at = np.flatnonzero(fresh)
    number = np.diff(np.r_[at, len(cells)])
    several = np.flatnonzero(number > 1).astype(np.uint32)
    cells = cells[at] & np.uint64((1 << block_bits) - 1)
    if 3 * len(cells) < 1 << (block_bits - 8):
        return pickle.dumps((cells.astype(np.uint32), None, several, np.minimum(number[several], 255).astype(np.uint8)), protocol=5)
    per = np.bincount((cells >> np.uint64(8)).astype(np.int64), minlength=1 << (block_bits - 8))
    per = per.astype(np.uint8 if per.max() < 256 else np.uint16)
    return pickle.dumps((cells.astype(np.uint8), per, several, np.minimum(number[several], 255).astype(np.uint8)), protocol=5)


def unpack_cells(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Different cells of a block and their numbers."""
    low, per, several, number = pickle.loads(blob)
    cells = low.astype(np.int64) if per is None else np.repeat(np.arange(len(per), dtype=np.int64) << 8, per) | low
    count = np.ones(len(cells), np.uint16)
    count[several] = number
    return cells, count


def build(docs: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], slices: Callable, bits: int, flush: int = 1_500_000, least: int | None = 2) -> DataFrame:
    """Merged blocks (block, cells) of the hashes that `hashes` yields for the slices of `docs`.

    cells: a byte for the count of each cell, or, with `least`, a bit for each cell that counts so many.
    """
    block_bits = min(bits, _BLOCK_BITS)
    blocks = 1 << (bits - block_bits)

    def parts(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(held)
        for row in range(ROWS):
            c = cell(h, row, bits)
            c.sort()
            cuts = np.searchsorted(c, np.arange(blocks + 1, dtype=np.uint64) << np.uint64(block_bits))
            rows = [(b, pack_cells(c[i:j], block_bits)) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([row * blocks + b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in slices(batches):
            h = hashes(part)
            held.append(h)
            n += len(h)
            if n >= flush:
                yield from parts(held)
                held, n = [], 0
        if n:
            yield from parts(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = -1, np.zeros(0, np.uint8)

        def out() -> pa.RecordBatch:
            cells = counts if least is None else np.packbits(counts >= least)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["block", "cells"])

        for batch in batches:
            for b, blob in zip(batch.column("block").to_pylist(), batch.column("cells"), strict=True):
                if b != now:
                    if now >= 0:
                        yield out()
                    now, counts = b, np.zeros(1 << block_bits, np.uint8)
                at, number = unpack_cells(blob.as_py())
                counts[at] = np.minimum(counts[at] + number, 255)
        if now >= 0:
            yield out()

    sent = docs.mapInArrow(run, _PART)
    n = min(partitions(docs.sparkSession), ROWS * blocks)
    return sent.repartition(n, "block").sortWithinPartitions("block").mapInArrow(merge, _PART)


class Repeated:
    """The merged sketch's bits; at most ROWS * 2**MAX_BITS, so they are broadcast."""

    def __init__(self, merged: DataFrame, bits: int):
        self.bits = bits
        row_bytes = (1 << bits) // 8
        table = np.zeros(ROWS * row_bytes, np.uint8)
        size = (1 << min(bits, _BLOCK_BITS)) // 8
        for r in merged.toLocalIterator():  # a partition at a time
            table[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["cells"], np.uint8)
        self.table = merged.sparkSession.sparkContext.broadcast(table.tobytes())
        del table
        tk.released()

    def __getstate__(self):
        return {"bits": self.bits, "table": self.table}

    def drop(self) -> None:
        """Free the bits in driver and executors, when all that reads them is written."""
        self.table.destroy()

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Hashes whose estimated number reaches the limit: all that do, and some others."""
        table = np.frombuffer(self.table.value, np.uint8)
        out = np.ones(len(h), bool)
        at = np.arange(len(h))
        for row in range(ROWS):
            c = cell(h[at], row, self.bits)
            byte = table[(c >> np.uint64(3)).astype(np.int64) + row * (1 << self.bits) // 8]
            hit = (byte >> (np.uint8(7) - (c & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0
            out[at[~hit]] = False
            at = at[hit]
        return out


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(f"`{text_col}`")), F.lit(0))).first()[0]
