"""Byte-level BPE with a segment tree, and decoding.

A text is cut by the tokenizer's pattern; each match is encoded by itself. A
match's bytes are the leaves of a segment tree that stores the rank of the pair
at each live byte position and, in inner nodes, the least rank with the leftmost
position. A merge takes the root, joins the pair, and updates the pairs of the
two live neighbours: logarithmic point updates, so a match of n bytes costs
O(n log n) even where it is a whole long document.

Matches repeat, so each worker keeps the ids of recent ones in a bounded table.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textkernel as tk
from .shared import tune

_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of `piece` after all merges: least rank first, leftmost among equals."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    # A node's value is rank * size + position: its minimum is the leftmost pair of least rank.
    get = ranks.get
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))  # a live token at i covers piece[i:end[i]]
    left = list(range(-1, n))  # the live token before the one that starts at i
    mask = size - 1
    while tree[1] < _NONE:
        i = tree[1] & mask
        gone = end[i]
        stop = end[gone]
        end[i] = stop
        left[stop] = i
        # point updates: the pair that is gone, the one that begins here, the one before
        updates = [(gone, _NONE)]
        r = get(piece[i : end[stop]]) if stop < n else None
        updates.append((i, _NONE if r is None else r * size + i))
        before = left[i]
        if before >= 0:
            r = get(piece[before:stop])
            updates.append((before, _NONE if r is None else r * size + before))
        for at, value in updates:
            at += size
            if tree[at] != value:
                tree[at] = value
                while at > 1:
                    other = tree[at ^ 1]
                    at >>= 1
                    if other < value:
                        value = other
                    if tree[at] == value:
                        break
                    tree[at] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts as the rank file's own library does without special tokens."""

    def __init__(self, path: str, pattern: str, remember: int = 250_000, longest: int = 64):
        import regex

        self.ranks, self.split, self.remember, self.longest = load_ranks(path), regex.compile(pattern).findall, remember, longest
        # two generations: what the older one is asked for moves to the younger
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def piece(self, match: str) -> tuple[int, ...]:
        ids = self.older.get(match)
        if ids is None:
            raw = match.encode()
            whole = self.ranks.get(raw)
            ids = (whole,) if whole is not None else tuple(merge(raw, self.ranks))
        if len(match) <= self.longest:
            self.known[match] = ids
        return ids

    def encode(self, text: str, out: array) -> None:
        """Append the ids of `text` to `out`."""
        if len(self.known) >= self.remember:
            self.known, self.older = {}, self.known
        get, piece, extend = self.known.get, self.piece, out.extend
        for match in self.split(text):
            extend(get(match) or piece(match))


def merged_length(piece: bytes, ranks: dict[bytes, int]) -> int:
    """How many ids merge() gives, for short pieces: the pairs' ranks are in a list whose least one, the leftmost, is looked for anew after each merge."""
    get, n = ranks.get, len(piece)
    cuts = list(range(n + 1))  # a token is piece[cuts[i]:cuts[i + 1]]
    pairs = [get(piece[i : i + 2], _NONE) for i in range(n - 1)]
    while pairs and (least := min(pairs)) < _NONE:
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i:
            pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], _NONE)
        if i < len(pairs):
            pairs[i] = get(piece[cuts[i] : cuts[i + 2]], _NONE)
    return len(cuts) - 1


class Lengths(dict):
    """Numbers of ids of matches, kept for recent ones. No ids are made, and short matches need no tree."""

    def __init__(self, path: str, pattern: str, remember: int = 500_000, longest: int = 64):
        import regex

        super().__init__()
        self.ranks, self.split, self.remember, self.longest = load_ranks(path), regex.compile(pattern).findall, remember, longest

    def __missing__(self, match: str) -> int:
        raw = match.encode()
        n = 1 if raw in self.ranks else merged_length(raw, self.ranks) if len(raw) <= self.longest else len(merge(raw, self.ranks))
        if len(match) <= self.longest:
            self[match] = n
        return n

    def of(self, text: str) -> int:
        if len(self) >= self.remember:
            self.clear()
        return sum(map(self.__getitem__, self.split(text)))


_encoders: dict[tuple[str, str], Encoder] = {}
_lengths: dict[tuple[str, str], Lengths] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    key = (path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(path, pattern)
    return _encoders[key]


def lengths(path: str, pattern: str) -> Lengths:
    """One table of lengths for each worker process."""
    key = (path, pattern)
    if key not in _lengths:
        _lengths[key] = Lengths(path, pattern)
    return _lengths[key]


def _appended(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name in df.columns:
        raise ValueError(f"column {name!r} exists already")
    return T.StructType([*df.schema.fields, T.StructField(name, kind, False)])


def _ids(enc: Encoder, texts: pa.Array) -> pa.ListArray:
    flat, ends = array("i"), [0]
    for text in texts.to_pylist():
        if text:
            enc.encode(text, flat)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))


def _id_bytes(path: str) -> pa.Array:
    """The bytes of each id, in order."""
    by_id = {b: a for a, b in load_ranks(path).items()}
    if set(by_id) != set(range(len(by_id))):
        raise ValueError("ids of the rank file are not 0..n-1")
    return pa.array([by_id[i] for i in range(len(by_id))], pa.binary())


def _bytes(table: pa.Array, lists: pa.ListArray) -> pa.Array:
    """The ids' bytes, one after the other, of each list."""
    counts = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
    taken = table.take(lists.flatten())
    off = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
    data = taken.buffers()[2] if len(taken) else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(off[counts].astype(np.int32).tobytes()), data])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """`docs` with the ids of each whole text as array<int>. Null and empty texts have no ids.

    Narrow: no shuffle. `out_col` must not be a column of `docs`; others are kept whatever their names.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for part in tk.chunks(batches, text_col):
            yield _appended(part, out_col, _ids(enc, part.column(text_col)))

    return docs.mapInArrow(run, _with(docs, out_col, T.ArrayType(T.IntegerType(), False)))


def decode(tokens: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """`tokens` with the bytes that the ids stand for. A null list gives no bytes; an unknown id is an error."""
    tune(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _id_bytes(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _appended(part, out_col, _bytes(table, part.column(ids_col)))

    return tokens.mapInArrow(run, _with(tokens, out_col, T.BinaryType()))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """decode(encode(docs)) in one pass, without `text_col`: the ids leave the worker once."""
    tune(docs.sparkSession)
    rest = [f for f in docs.schema.fields if f.name != text_col]
    if {ids_col, out_col} & {f.name for f in rest}:
        raise ValueError("a column of the result exists already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = encoder(path, pattern), _id_bytes(path)
        for part in tk.chunks(batches, text_col):
            ids = _ids(enc, part.column(text_col))
            keep = [(f.name, c) for f, c in zip(part.schema, part.columns, strict=True) if f.name != text_col]
            yield pa.RecordBatch.from_arrays([*(c for _, c in keep), ids, _bytes(table, ids)], names=[*(n for n, _ in keep), ids_col, out_col])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False), T.StructField(out_col, T.BinaryType(), False)]))


def count(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """`docs` with the number of ids of each whole text, without shipping the ids."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lengths(path, pattern).of
        for part in tk.chunks(batches, text_col):
            n = [of(text) if text else 0 for text in part.column(text_col).to_pylist()]
            yield _appended(part, out_col, pa.array(n, pa.int64()))

    return docs.mapInArrow(run, _with(docs, out_col, T.LongType()))
