"""Removal spans that tasks send to documents, and their application to the texts."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk

#: A row of a document: its id and a hash of its text, so that ids that repeat with other texts stay apart.
SPANS = "_id bigint, _th bigint, starts array<int>, ends array<int>"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _th and text of each row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(text).alias("_th"), text.alias("text"))


def span_rows(ids: np.ndarray, hashes: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One Arrow row for each document `row` (an index of ids and hashes), with merged spans."""
    start, end, row = tk.merged(start, end, row)
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    off = pa.array(np.r_[at, len(row)].astype(np.int32), pa.int32())
    lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32), pa.int32())) for x in (start, end)]
    return pa.RecordBatch.from_arrays([pa.array(ids[row[at]], pa.int64()), pa.array(hashes[row[at]], pa.int64()), *lists], names=["_id", "_th", "starts", "ends"])


def sent(ids: np.ndarray, hashes: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> pa.RecordBatch:
    """The spans of documents `row` as one packed row for each of n destinations (column `owner`)."""
    start, end, row = tk.merged(start, end, row)
    to = (tk.mix(ids[row].view(np.uint64) ^ hashes[row].view(np.uint64)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    start, end, row, to = start[order], end[order], row[order], to[order]
    at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    blobs = []
    for i, j in zip(at, np.r_[at[1:], len(to)], strict=True):
        used, index = np.unique(row[i:j], return_inverse=True)
        narrow = np.uint16 if len(used) < 65536 else np.uint32
        size = np.uint16 if int(end[i:j].max()) < 65536 else np.uint32
        blobs.append(pickle.dumps((ids[used], hashes[used], index.astype(narrow), start[i:j].astype(size), (end[i:j] - start[i:j]).astype(size)), protocol=5))
    return pa.RecordBatch.from_arrays([pa.array(to[at], pa.int32()), pa.array(blobs, pa.binary())], names=["owner", "spans"])


SENT = "owner int, spans binary"


def collected(packed: DataFrame, n: int) -> DataFrame:
    """SPANS rows, one for each document, of what sent() has dealt to n destinations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        base = 0
        for batch in batches:
            for blob in batch.column("spans"):
                ids, hashes, index, start, size = pickle.loads(blob.as_py())
                start = start.astype(np.int64)
                for held, new in zip(cols, (ids, hashes, index.astype(np.int64) + base, start, start + size), strict=True):
                    held.append(new)
                base += len(ids)
        if base:
            ids, hashes, index, start, end = (np.concatenate(c) for c in cols)
            order = np.lexsort((hashes, ids))
            fresh = np.r_[True, (ids[order][1:] != ids[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])]
            number = np.empty(len(ids), np.int64)
            number[order] = np.cumsum(fresh) - 1
            first = order[fresh]
            yield span_rows(ids[first], hashes[first], number[index], start, end)

    return packed.repartitionById(n, F.col("owner")).mapInArrow(run, SPANS)


def gathered(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`docs` (as keyed() gives them) with the spans of each (one row a document); empty where there are none."""
    none = F.expr("cast(array() as array<int>)")
    out = docs.join(spans, ["_id", "_th"], "left")
    return out.withColumns({"starts": F.coalesce("starts", none), "ends": F.coalesce("ends", none)})


def pack_hashes(h: np.ndarray) -> tuple:
    """The upper 48 bits of sorted hashes, as differences of 32 bits where they fit."""
    top = h >> np.uint64(16)
    d = np.diff(top)
    return (int(top[0]), d.astype(np.uint32)) if not len(d) or int(d.max()) < 1 << 32 else (None, top)


def unpack_hashes(packed: tuple) -> np.ndarray:
    base, rest = packed
    return rest if base is None else np.cumsum(np.r_[np.uint64(base), rest.astype(np.uint64)])


def lists_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of all spans of a chunk."""
    n = part.column("starts").value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(part.num_rows), n)
    flat = [part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("starts", "ends")]
    return flat[0], flat[1], doc


def gather_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of data[start:end] of each piece, one after the other."""
    n = end - start
    if not len(n) or not n.sum():
        return np.zeros(0, np.uint8)
    out = np.cumsum(n)
    return data[np.repeat(start - np.r_[0, out[:-1]], n) + np.arange(out[-1])]


def applied(docs: DataFrame, work: Callable, schema: T.StructType | str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.chunks(batches, "text"):
            yield work(part)

    return docs.mapInArrow(run, schema)
