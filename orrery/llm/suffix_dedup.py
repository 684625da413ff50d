"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Whole texts' suffixes can't be moved, and needn't be: only those that can share
their first `length` bytes with a suffix of another document are.

1. Anchors. In each window of `length` bytes, the q-gram of least hash is its anchor
   (q = 20). Equal windows have equal anchors at equal offsets, so a window repeats only
   where its anchor does. A merged sketch of the anchors tells those that occur once.
2. An anchor that may repeat is sent, with the bytes around it, to the owner of its hash. Of equal surroundings, byte
   by byte, in a task only that of the smallest id goes on; the others are known repeats in whole.
3. The owner sorts the suffixes that begin at each place of its surroundings. Their initial buckets are by
   their first byte. A bucket is refined by the bucket pointers of the suffixes that begin one
   byte later. Places are taken from the last one to the first, so those pointers are refined already, and suffixes that are
   dealt to their buckets in the order of these pointers are sorted by all bytes that follow: one stable pass refines all buckets of a place.
4. Neighbours in this order that share their first `length` bytes, compared byte by byte, are equal strings. One that starts
   in a document of a larger id than another one is removed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch, spans
from . import textkernel as tk
from .shared import partitions, tune

#: Bytes of an anchor, and anchors that a task holds before it sends them.
Q, FLUSH = 20, 200_000
#: Bytes of text whose anchors are looked for at once: their hashes stay in a core's cache.
SLICE = 1 << 17
#: Surroundings that are refined at once; more are split by the anchor's hash. One anchor's are together: some 200 bytes each.
REFINED = 20_000
#: Least length of strings.
LEAST = Q + 8


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and documents of the q-grams that are least in some `length` bytes of one document."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none
    h = tk.gram_hashes(data, q)
    w = length - q + 1
    low = tk.sliding(h, w, np.minimum)
    # windows that cross a document's end have no anchor
    inside = np.zeros(len(data) + 1, np.int32)
    starts = offsets[:-1][np.diff(offsets) >= length]
    stops = offsets[1:][np.diff(offsets) >= length] - length + 1
    np.add.at(inside, starts, 1)
    np.add.at(inside, stops, -1)
    low = np.where(np.cumsum(inside)[: len(low)] > 0, low, np.uint64(0))
    padded = np.r_[np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]
    at = np.flatnonzero(tk.sliding(padded, w, np.maximum)[: len(h)] == h)
    doc = np.searchsorted(offsets, at, side="right") - 1
    return at, tk.mix(h[at]), doc  # least hashes are small ones; mixed again, they spread evenly


def surroundings(data: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """A row of bytes for each anchor: `reach` before it, its own, and `reach` after it."""
    padded = np.r_[np.zeros(reach, np.uint8), data, np.zeros(reach, np.uint8)]
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + Q)[at]


_VEC = tk.powers(0x2545F4914F6CDD1D, 4096)


def _words(rows: np.ndarray) -> np.ndarray:
    """The rows' bytes, eight at a time, filled up with zeros."""
    return np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view("<u8")


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes."""
    wide = _words(rows)
    out = np.zeros(len(rows), np.uint64)
    for i in range(wide.shape[1]):
        out = tk.mix((out ^ wide[:, i]) * _VEC[1] + np.uint64(i))
    return out


def refine(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each place, from the last to the first, the order of the suffixes that begin there, by all bytes to the row's end.

    rows: surroundings of equal width. The order of a place holds its suffixes by their pointers; dealt in this order, stably, to the
    buckets of the place before, by one byte each, they are refined there.
    """
    letters = np.ascontiguousarray(rows.T)
    order = np.arange(len(rows))
    for c in range(len(letters) - 1, -1, -1):
        order = order[np.argsort(letters[c][order], kind="stable")]  # of bytes: a radix sort, linear
        yield c, order


def _merge_equal(anchor: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (surrounding, id) and, in that order, the index of the leader of each equal surrounding."""
    h = _row_hash(rows) + tk.mix(anchor) + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.lexsort((ids, h))
    s = h[order]
    fresh = np.r_[True, s[1:] != s[:-1]]
    lead = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    wide = _words(rows)
    same = (anchor[order] == anchor[lead]) & (wide[order] == wide[lead]).all(axis=1) & (left[order] == left[lead]) & (right[order] == right[lead])
    return order, np.where(same, lead, order)  # hashes that collide lead themselves


def repeated_spans(docs: DataFrame, length: int, max_bits: int = sketch.MAX_BITS, flush: int = FLUSH, refined: int = REFINED) -> DataFrame:
    """Byte spans (spans.SPANS) of the strings that also start in a document of a smaller id."""
    reach = length - Q
    n_ranges = partitions(docs.sparkSession)
    bits = sketch.bits_for(sketch.text_bytes(docs, "text") * 2 // (reach + 2), load=0.5, max_bits=max_bits)
    slices = lambda batches: tk.chunks(batches, "text", SLICE)

    def hashes(part: pa.RecordBatch) -> np.ndarray:
        data, off = tk.column(part, "text")
        _, h, doc = anchors(data, off, length)
        if not len(h):
            return h
        order = np.lexsort((doc, h))  # a document's own repeats don't count
        h, doc = h[order], doc[order]
        return h[np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]]

    repeated = sketch.Repeated(sketch.build(docs, hashes, slices, bits), bits)

    def whole(pos: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All strings of `length` bytes around an anchor."""
        return pos - left, pos + Q + right

    def send(held: list[tuple], ids: np.ndarray, ths: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
        h, rows, left, right, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order, lead = _merge_equal(h, rows, left, right, ids[doc])
        after = ids[doc[order]] > ids[doc[lead]]
        rest = order[after]
        out = []
        if len(rest):
            start, end = whole(pos[rest].astype(np.int64), left[rest].astype(np.int64), right[rest].astype(np.int64))
            start, end, row = tk.merged(start, end, doc[rest])
            out.append((turn % n_ranges, pickle.dumps(("done", ids, ths, row.astype(np.int32), start.astype(np.int32), end.astype(np.int32)), protocol=5)))
        # leaders, and places of the leader's own document
        at = order[~after]
        at = at[np.argsort(h[at], kind="stable")]
        owner = (h[at] >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)
        cuts = np.searchsorted(owner, np.arange(n_ranges + 1, dtype=np.uint64))
        for r, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if j > i:
                own = at[i:j]
                used, index = np.unique(doc[own], return_inverse=True)
                narrow = np.uint16 if len(used) < 65536 else np.uint32
                text = pa.Codec("zstd", compression_level=3).compress(rows[own].tobytes(), asbytes=True)
                x = (spans.pack_hashes(h[own]), text, left[own], right[own], ids[used], ths[used], index.astype(narrow), pos[own])
                out.append((r, pickle.dumps(("open", *x), protocol=5)))
        for r, blob in out:
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([blob], pa.binary())], names=["owner", "anchors"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, ths, n, docs_n, turn = [], [], [], 0, 0, 0
        for part in slices(batches):
            data, off = tk.column(part, "text")
            id_, valid = tk.ids(part, "_id")
            ids.append(id_)
            ths.append(tk.ids(part, "_th")[0])
            if not turn:
                turn = int(ths[0][0] & 0x7FFFFFFF)
            at, h, doc = anchors(data, off, length)
            some = np.flatnonzero(repeated.maybe(h) & valid[doc]) if len(h) else at
            if len(some):
                at, h, doc = at[some], h[some], doc[some]
                left = np.minimum(at - off[doc], reach).astype(np.uint8 if reach < 256 else np.uint32)
                right = np.minimum(off[doc + 1] - at - Q, reach).astype(left.dtype)
                rows = surroundings(data, at, reach)
                # bytes of neighbouring documents are no part of a surrounding
                col = np.arange(2 * reach + Q)
                odd = np.flatnonzero((left < reach) | (right < reach))
                rows[odd] *= (col >= (reach - left[odd].astype(np.int64))[:, None]) & (col < (reach + Q + right[odd].astype(np.int64))[:, None])
                held.append((h, rows, left, right, (doc + docs_n).astype(np.int32), (at - off[doc]).astype(np.uint32)))
                n += len(at)
            docs_n += part.num_rows
            if n >= flush:
                yield from send(held, np.concatenate(ids), np.concatenate(ths), turn)
                held, ids, ths, n, docs_n, turn = [], [], [], 0, 0, turn + 1
        if n:
            yield from send(held, np.concatenate(ids), np.concatenate(ths), turn)

    def resolve(rows, left, right, ids) -> np.ndarray:
        """For each surrounding the places (columns) at which a removed string starts."""
        m, n = len(rows), reach + 1
        out = np.zeros((m, n), bool)
        none = np.iinfo(np.int64).max
        for c, order in refine(rows):
            if c >= n:
                continue
            # a string at c starts reach - c bytes before the anchor and ends length - that after
            here = np.ascontiguousarray(rows[order, c : c + length])
            fresh = np.r_[True, (here[1:] != here[:-1]).any(axis=1)]
            inside = (c >= reach - left[order].astype(np.int64)) & (c <= right[order])
            least = np.minimum.reduceat(np.where(inside, ids[order], none), np.flatnonzero(fresh))
            out[order, c] = inside & (ids[order] > least[np.cumsum(fresh) - 1])
        return out

    def solve(h, rows, left, right, doc, pos, ids) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Starts, ends and documents of the spans of anchors of some q-grams' hashes, with all of each hash."""
        order = np.argsort(h, kind="stable")
        s, d = h[order], ids[doc[order]]
        fresh = np.r_[True, s[1:] != s[:-1]]
        at = np.flatnonzero(fresh)
        several = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
        some = order[np.repeat(several, np.diff(np.r_[at, len(s)]))]
        if not len(some):
            return
        h, rows, left, right, doc, pos = (x[some] for x in (h, rows, left, right, doc, pos.astype(np.int64)))
        order, lead = _merge_equal(h, rows, left, right, ids[doc])
        after = ids[doc[order]] > ids[doc[lead]]
        rest = order[after]
        if len(rest):
            start, end = whole(pos[rest], left[rest].astype(np.int64), right[rest].astype(np.int64))
            yield tk.merged(start, end, doc[rest])
        # what is left: one surrounding of each kind, and places in the leader's own document
        own = np.unique(lead)
        mark = resolve(rows[own], left[own], right[own], ids[doc[own]])
        back = np.full(len(rows), -1, np.int64)
        back[own] = np.arange(len(own))
        mine = order[~after]
        m = mark[back[lead[~after]]]
        r, c = np.nonzero(m)
        if len(r):
            start = pos[mine[r]] - reach + c
            yield tk.merged(start, start + length, doc[mine[r]])

    def group(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in range(8)]
        base = 0
        for blob in blobs:
            kind, *x = pickle.loads(blob)
            if kind == "done":
                yield spans.sent(x[0], x[1], x[2].astype(np.int64), x[3].astype(np.int64), x[4].astype(np.int64), n_ranges)
                continue
            packed, text, left, right, ids, ths, doc, pos = x
            h = spans.unpack_hashes(packed)
            rows = np.frombuffer(pa.decompress(text, decompressed_size=len(h) * (2 * reach + Q), codec="zstd"), np.uint8).reshape(len(h), 2 * reach + Q)
            for held, new in zip(cols, (h, rows, left, right, doc.astype(np.int64) + base, pos, ids, ths), strict=True):
                held.append(new)
            base += len(ids)
        if not base:
            return
        h, rows, left, right, doc, pos, ids, ths = (np.concatenate(c) for c in cols)
        parts = -(-len(h) // refined)
        lot = (tk.mix(h.astype(np.uint64)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
        order = np.argsort(lot, kind="stable")
        cuts = np.searchsorted(lot[order], np.arange(parts + 1))
        found, size = [], 0
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            i = order[a:z]
            for runs in solve(h[i], rows[i], left[i], right[i], doc[i], pos[i], ids) if len(i) else ():
                found.append(runs)
                size += len(runs[0])
            if found and (size >= FLUSH or z == len(order)):
                start, end, row = (np.concatenate(x) for x in zip(*found, strict=True))
                yield spans.sent(ids, ths, row, start, end, n_ranges)
                found, size = [], 0

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for r, blob in zip(batch.column("owner").to_pylist(), batch.column("anchors"), strict=True):
                if r != now and blobs:
                    yield from group(blobs)
                    blobs = []
                now = r
                blobs.append(blob.as_py())
        if blobs:
            yield from group(blobs)

    sent = docs.mapInArrow(candidates, "owner int, anchors binary")
    return spans.collected(sent.repartitionById(n_ranges, F.col("owner")).mapInArrow(owners, spans.SENT), n_ranges)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, max_bits: int = sketch.MAX_BITS, flush: int = FLUSH, refined: int = REFINED) -> DataFrame:
    """id, n_bytes, removed array<struct<start, end>> (maximal runs, in bytes) and kept (binary) of each row.

    A byte goes when a string of `length` bytes that covers it also starts in a document of a smaller id.
    Strings are of the input's UTF-8 bytes and don't cross documents. Null text is empty. Rows without an id
    lose nothing and make no other row lose anything; rows that repeat an id are one document's.
    Other columns of `docs` aren't read.
    """
    if length < LEAST:
        raise ValueError(f"length must be {LEAST} or more")
    tune(docs.sparkSession)
    rows = spans.keyed(docs, id_col, text_col)
    full = spans.gathered(rows, repeated_spans(rows, length, max_bits, flush, refined))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        data, off = tk.column(part, "text")
        start, end, doc = spans.lists_of(part)
        start, end, doc = tk.merged(start, end, doc)
        n = part.num_rows
        # kept pieces lie between the runs
        runs = np.bincount(doc, minlength=n)
        first = np.r_[0, np.cumsum(runs)]
        piece_start = np.insert(off[doc] + end, first[:-1], off[:-1])
        piece_end = np.insert(off[doc] + start, first[1:], off[1:])
        text = spans.gather_bytes(data, piece_start, piece_end)
        gone = np.bincount(doc, weights=end - start, minlength=n).astype(np.int64)
        ends = np.r_[0, np.cumsum(np.diff(off) - gone)].astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(text.tobytes())])
        pairs = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["start", "end"])
        removed = pa.ListArray.from_arrays(pa.array(first.astype(np.int32), pa.int32()), pairs).cast(span)
        return pa.RecordBatch.from_arrays([part.column("_id"), pa.array(np.diff(off), pa.int64()), removed, kept], names=[id_col, "n_bytes", "removed", "kept"])

    return spans.applied(full, cut, f"`{id_col}` bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
