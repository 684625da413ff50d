"""Removal of repeated windows of words, with a count-min prefilter.

1. Each input task sketches its windows' hashes with their counts; merging adds the partitions' sketches, so
   that an estimate is never below the true count.
2. A second pass keeps the windows estimated repeated: none that repeats is lost.
   Of equal ones in a task only the first goes on; the others are known repeats.
3. Owners of hash ranges group the windows by 112 bits, 64 of them from cryptographic digests of their words, and keep
   the first by (document, place); each other one is removed.
4. Removed windows go back to their documents, where their words are cut.

Windows travel in packed arrays of a range each. A window that a third of all
documents share travels once a task.
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

#: Windows that a task holds before it sends them.
FLUSH = 1_000_000


def _windows(part: pa.RecordBatch, k: int) -> tuple[tk.Words, np.ndarray, np.ndarray]:
    """Words, their hashes, and the words at which windows start."""
    data, off = tk.column(part, "text")
    words = tk.Words(data, off, tk.NOT_SPACE)
    at = words.runs(k)
    return words, words.hashes() if len(at) else np.zeros(0, np.uint64), at


def _ties(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """keys: hash, check, id, place. Their order, and in that order a mask of the earliest of each (hash, check):
    one, or several rows that repeat an id and a place and so are no earlier than each other."""
    order = np.lexsort(tuple(reversed(keys)))
    h, c, i, p = (x[order] for x in keys)
    if not len(h):
        return order, np.zeros(0, bool)
    first = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    return order, (i == i[lead]) & (p == p[lead])


def repeated_spans(docs: DataFrame, k: int, flush: int = FLUSH, max_bits: int = sketch.MAX_BITS) -> DataFrame:
    """Word spans (spans.SPANS) of windows whose words also start earlier."""
    n_ranges = partitions(docs.sparkSession)
    bits = sketch.bits_for(sketch.text_bytes(docs, "text") // 6, max_bits=max_bits)  # words of 6 bytes
    slices = lambda batches: tk.chunks(batches, "text")

    def hashes(part: pa.RecordBatch) -> np.ndarray:
        _, h, at = _windows(part, k)
        return tk.windows(h, k)[at] if len(at) else np.zeros(0, np.uint64)

    repeated = sketch.Repeated(sketch.build(docs, hashes, slices, bits), bits)

    def send(held: list[tuple], ids: np.ndarray, ths: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
        h, chk, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order, first = _ties([h, chk, ids[doc], pos])
        rest = order[~first]
        rows = []
        if len(rest):
            start, end, row = tk.merged(pos[rest].astype(np.int64), pos[rest].astype(np.int64) + k, doc[rest])
            rows.append((turn % n_ranges, pickle.dumps(("done", ids, ths, row.astype(np.int32), start.astype(np.int32), end.astype(np.int32)), protocol=5)))
        at = order[first]
        owner = (h[at] >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)
        cuts = np.searchsorted(owner, np.arange(n_ranges + 1, dtype=np.uint64))
        for r, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if j > i:
                own = at[i:j]
                used, index = np.unique(doc[own], return_inverse=True)
                narrow = np.uint16 if len(used) < 65536 else np.uint32
                place = pos[own].astype(np.uint16 if int(pos[own].max()) < 65536 else np.uint32)
                hashes_ = (spans.pack_hashes(h[own]), chk[own])
                rows.append((r, pickle.dumps(("open", *hashes_, ids[used], ths[used], index.astype(narrow), place), protocol=5)))
        for r, blob in rows:
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([blob], pa.binary())], names=["owner", "windows"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, ths, n, docs_n, turn = [], [], [], 0, 0, 0
        for part in slices(batches):
            words, h, at = _windows(part, k)
            id_, valid = tk.ids(part, "_id")
            ids.append(id_)
            ths.append(tk.ids(part, "_th")[0])
            if not turn:
                turn = int(ths[0][0] & 0x7FFFFFFF)  # where a task begins to deal is as good as random
            if len(at):
                keys = tk.windows(h, k)[at]
                some = repeated.maybe(keys) & valid[words.doc[at]]
                p, keys = at[some], keys[some]
                d = words.doc[p]
                check = tk.windows(words.digests(), k, seed=1)[p] if len(p) else keys
                held.append((keys, check, (d + docs_n).astype(np.int32), (p - words.first[d]).astype(np.uint32)))
                n += len(p)
            docs_n += part.num_rows
            if n >= flush:
                yield from send(held, np.concatenate(ids), np.concatenate(ths), turn)
                held, ids, ths, n, docs_n, turn = [], [], [], 0, 0, turn + 1
        if n:
            yield from send(held, np.concatenate(ids), np.concatenate(ths), turn)

    def group(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, chk, ids, ths, doc, pos, base = [], [], [], [], [], [], 0
        for blob in blobs:
            kind, *x = pickle.loads(blob)
            if kind == "done":
                yield spans.sent(x[0], x[1], x[2].astype(np.int64), x[3].astype(np.int64), x[4].astype(np.int64), n_ranges)
                continue
            h.append(spans.unpack_hashes(x[0]))
            chk.append(x[1])
            ids.append(x[2])
            ths.append(x[3])
            doc.append(x[4].astype(np.int32) + np.int32(base))
            pos.append(x[5].astype(np.int32))
            base += len(x[2])
        if not h:
            return
        h, chk, ids, ths, doc, pos = (np.concatenate(x) for x in (h, chk, ids, ths, doc, pos))
        order, first = _ties([h, chk, ids[doc], pos])
        rest = order[~first]
        if len(rest):
            start = pos[rest].astype(np.int64)
            yield spans.sent(ids, ths, doc[rest].astype(np.int64), start, start + k, n_ranges)

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for r, blob in zip(batch.column("owner").to_pylist(), batch.column("windows"), strict=True):
                if r != now and blobs:
                    yield from group(blobs)
                    blobs = []
                now = r
                blobs.append(blob.as_py())
        if blobs:
            yield from group(blobs)

    sent = docs.mapInArrow(candidates, "owner int, windows binary")
    return spans.collected(sent.repartitionById(n_ranges, F.col("owner")).mapInArrow(owners, spans.SENT), n_ranges)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, max_bits: int = sketch.MAX_BITS, flush: int = FLUSH) -> DataFrame:
    """id, n_words, n_removed and kept_text (the kept words, joined by one space) of each row.

    Words are runs without ASCII white space. A word goes when a window of `window` words that covers it
    also starts earlier: in a document of a smaller id, or in the same one before. Null text has no words.
    Rows without an id lose nothing and make no other row lose anything; rows that repeat an id with
    another text count as places of the same document, and a row that repeats id and text is treated as
    its double is. Other columns of `docs` aren't read.
    """
    tune(docs.sparkSession)
    rows = spans.keyed(docs, id_col, text_col)
    full = spans.gathered(rows, repeated_spans(rows, window, flush, max_bits))

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        data, off = tk.column(part, "text")
        words = tk.Words(data, off, tk.NOT_SPACE)
        start, end, doc = spans.lists_of(part)
        n = len(words.start)
        kept = np.flatnonzero(~tk.covered(words.first[doc] + start, words.first[doc] + end, n)) if n else np.zeros(0, np.int64)
        d = words.doc[kept]
        last = np.r_[d[1:] != d[:-1], True] if len(d) else np.zeros(0, bool)
        stop = words.end[kept] + ~last  # a byte more, for the space
        text = spans.gather_bytes(np.r_[data, np.uint8(32)], words.start[kept], stop)
        size = np.cumsum(stop - words.start[kept]) if len(kept) else np.zeros(0, np.int64)
        text[(size - 1)[~last]] = 32
        per = np.bincount(d, minlength=part.num_rows)
        ends = np.r_[0, np.cumsum(np.bincount(d, weights=stop - words.start[kept], minlength=part.num_rows))].astype(np.int32)
        out = pa.Array.from_buffers(pa.string(), part.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(text.tobytes())])
        counts = words.counts()
        return pa.RecordBatch.from_arrays([part.column("_id"), pa.array(counts, pa.int64()), pa.array(counts - per, pa.int64()), out], names=[id_col, "n_words", "n_removed", "kept_text"])

    return spans.applied(full, cut, f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept_text string")
