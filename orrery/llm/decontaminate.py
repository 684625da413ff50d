"""Benchmark decontamination by winnowing.

Words are hashed, k-grams of words are fingerprints, and of each `w` consecutive
k-grams the least is kept. A shared span of k + w - 1 words or more shares a
kept fingerprint, in a document and in the benchmark alike; with k + w - 1 equal
to the window, no window is missed. An item of fewer words is one fingerprint of its own length.

1. The kept fingerprints of both tables are made with the words around them: as many as a window that
   contains the fingerprint can reach. A merged sketch of the benchmark's fingerprints stops most of the documents'.
2. Documents' and benchmark's fingerprints are joined.
3. Each hit is extended: the words around both sides are compared, to the left and to the right of the fingerprint. Equal
   words that reach a window's length are hit words of the document, by that item.

The benchmark may be of any size: its fingerprints are a table like the documents'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketch, spans
from . import textkernel as tk
from .shared import dropped, shared_table, tune

#: Texts with hits that are broadcast to the documents at most; beyond, documents are shuffled to them.
NARROW = 1 << 20


def fingerprints(h: np.ndarray, words: tk.Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are least in some w consecutive ones of a document."""
    grams = tk.windows(h, k)
    _, at = tk.window_minima(grams, words.doc, k, w)
    return at, grams[at]


def _around(words: tk.Words, place: np.ndarray, length: int, reach: int) -> list[pa.Array]:
    """For each fingerprint, up to `reach` words before it (nearest first), its own, and those after it: lists of binary."""
    first, last = words.first[words.doc[place]], words.first[words.doc[place] + 1]
    out = []
    for start, size, step in (
        (place - 1, np.minimum(place - first, reach), -1),
        (place, np.full(len(place), length), 1),
        (place + length, np.minimum(last - place - length, reach), 1),
    ):
        off = np.r_[0, np.cumsum(size)]
        index = np.repeat(start - step * off[:-1], size) + step * np.arange(off[-1])
        ends = np.r_[0, np.cumsum(words.end[index] - words.start[index])].astype(np.int32)
        text = spans.gather_bytes(words.data, words.start[index], words.end[index])
        flat = pa.Array.from_buffers(pa.binary(), len(index), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(text.tobytes())])
        out.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32), pa.int32()), flat))
    return out


#: A fingerprint: its hash, 0 for a k-gram or the number of words of a whole short item, and words before, own and after.
_PRINT = "fp bigint, size int, before array<binary>, own array<binary>, after array<binary>"


def _batch(words: tk.Words, place: np.ndarray, prints: np.ndarray, size: int, k: int, window: int, named: dict[str, pa.Array]) -> pa.RecordBatch:
    around = _around(words, place, size or k, 0 if size else window - k)
    columns = named | {"fp": pa.array(prints.view(np.int64), pa.int64()), "size": pa.array(np.full(len(place), size), pa.int32())} | dict(zip(("before", "own", "after"), around, strict=True))
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def benchmark_prints(items: DataFrame, window: int, k: int) -> DataFrame:
    """item and the fingerprints of `items` (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.chunks(batches, "text"):
            words = tk.Words(*tk.column(part, "text"), tk.ALNUM, lower=True)
            h, counts = words.hashes(), words.counts()
            found = []
            if len(words.runs(window)):
                found.append((0, *fingerprints(h, words, k, window - k + 1)))
            for n in sorted(set(counts[(counts > 0) & (counts < window)].tolist())):
                at = words.first[:-1][counts == n]
                found.append((n, at, tk.windows(h, n, seed=n)[at]))
            for size, place, prints in found:
                if len(place):
                    yield _batch(words, place, prints, size, k, window, {"item": part.column("item").take(pa.array(words.doc[place]))})

    return items.mapInArrow(run, "item string, " + _PRINT)


def _key(prints: np.ndarray, size: int) -> np.ndarray:
    return tk.mix(prints + np.uint64(size) * np.uint64(0x9E3779B97F4A7C15))


def document_prints(rows: DataFrame, known: sketch.Repeated, sizes: list[int], window: int, k: int) -> DataFrame:
    """_id, _th, place and the fingerprints of `rows` (_id, _th, text) that the benchmark may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.chunks(batches, "text"):
            words = tk.Words(*tk.column(part, "text"), tk.ALNUM, lower=True)
            h = words.hashes()
            for size in sizes:
                if size:
                    place = words.runs(size)
                    prints = tk.windows(h, size, seed=size)[place] if len(place) else np.zeros(0, np.uint64)
                else:
                    place, prints = fingerprints(h, words, k, window - k + 1) if len(h) >= window else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                some = known.maybe(_key(prints, size))
                place, prints = place[some], prints[some]
                if len(place):
                    doc = words.doc[place]
                    named = {c: part.column(c).take(pa.array(doc)) for c in ("_id", "_th")} | {"place": pa.array(place - words.first[doc], pa.int64())}
                    yield _batch(words, place, prints, size, k, window, named)

    return rows.mapInArrow(run, "_id bigint, _th bigint, place bigint, " + _PRINT)


def _alike(a: Column, b: Column) -> Column:
    """Number of equal words at the beginnings of two lists."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same).cast("long"))


def extended(hits: DataFrame, window: int, k: int) -> DataFrame:
    """_id, _th, item, start, end of the hit words of joined fingerprints (before, own, after; b_before, b_own, b_after)."""
    left, right, size = _alike(F.col("before"), F.col("b_before")), _alike(F.col("after"), F.col("b_after")), F.col("size")
    rows = hits.where(F.col("own") == F.col("b_own")).withColumns({"left": left, "right": right})
    rows = rows.where((size > 0) | (F.col("left") + k + F.col("right") >= window))
    length = F.when(size > 0, size.cast("long")).otherwise(F.lit(k) + F.col("right"))
    return rows.select("_id", "_th", "item", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + length).alias("end"))


def hit_texts(rows: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """A written table _id, _th, spans array<struct<start, end>> and items array<string> of the `rows` (_id, _th, text) with hits."""
    bench = shared_table(benchmark_prints(items, window, k), "benchmark")
    facts = bench.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("size")).alias("sizes")).first()  # at most `window` sizes
    bits = sketch.bits_for(facts["n"], load=0.02)

    def keys(part: pa.RecordBatch) -> np.ndarray:
        size = part.column("size").to_numpy(zero_copy_only=False).astype(np.uint64)
        return tk.mix(part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64) + size * np.uint64(0x9E3779B97F4A7C15))

    known = sketch.Repeated(sketch.build(bench.select("fp", "size"), keys, lambda batches: (b for b in batches if b.num_rows), bits, least=1), bits)
    asked = document_prints(rows, known, list(facts["sizes"]), window, k)
    names = {c: f"b_{c}" for c in ("before", "own", "after")}
    hits = asked.join(bench.withColumnsRenamed(names), ["fp", "size"])
    found = extended(hits, window, k).groupBy("_id", "_th").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.collect_set("item").alias("items"))  # of one text
    found = shared_table(found, "hits")
    dropped(bench)
    return found


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_NEW = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPAN), T.StructField("hit_items", T.ArrayType(T.StringType()))]
_SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 5,
) -> DataFrame:
    """`docs` with n_words, hit_spans (maximal runs of hit words) and hit_items (ids as strings, sorted).

    A window is `window` consecutive words of an item; an item with fewer words is one window. Null and
    empty texts have no words; null items and null item ids count for nothing. Items of equal text are
    all reported. Rows that repeat an id have their own text's hits. The result's columns must not be columns of
    `docs`; other names don't matter.
    """
    if {"n_words", "hit_spans", "hit_items"} & set(docs.columns):
        raise ValueError("a column of the result exists already")
    tune(docs.sparkSession)
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("text")).where("item is not null and text is not null")
    found = hit_texts(spans.keyed(docs, id_col, text_col), items, window, k)
    hit = found.select(F.col("_id").alias("h_id"), F.col("_th").alias("h_th"), "spans", "items")
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    named = docs.toDF(*names)
    key = (F.col(names[docs.columns.index(id_col)]).cast("long").eqNullSafe(F.col("h_id"))) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("h_th"))
    full = named.join(F.broadcast(hit) if hit.count() <= NARROW else hit, key, "left").select(*names, "spans", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.chunks(batches, text):
            words = tk.Words(*tk.column(part, text), tk.ALNUM, lower=True)
            merged: list[list] = [[] for _ in range(part.num_rows)]
            some = part.column("spans")
            if some.null_count < part.num_rows:
                row = np.repeat(np.arange(part.num_rows), some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                start, end = (some.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
                for a, b, d in zip(*(x.tolist() for x in tk.merged(start, end, row)), strict=True):
                    merged[d].append({"start": a, "end": b})
            items_ = [sorted(x) if x else [] for x in part.column("items").to_pylist()]
            columns = [part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(words.counts(), pa.int64()), pa.array(merged, _SPAN_ARROW), pa.array(items_, pa.list_(pa.string()))], names=[*names, "n_words", "hit_spans", "hit_items"]
            )

    schema = T.StructType([*(T.StructField(c, f.dataType, f.nullable) for c, f in zip(names, docs.schema.fields, strict=True)), *_NEW])
    return full.mapInArrow(run, schema).toDF(*docs.columns, "n_words", "hit_spans", "hit_items")
