"""Ranked lexical search by three phases of uniform thresholds (TPUT) over term-partitioned postings.

The index has a row for each term and block of documents: the documents' places in the block and their impacts, highest
first. Rows are partitioned by term, those of a term over several partitions. A score is the sum of weight times impact over the query's terms.

1. The k highest impacts of each list give partial scores; the k-th highest partial score of a query is a lower bound of its k-th score.
2. That bound, divided evenly by the number of the query's lists, is one threshold for all of them: every entry at or above it is
   fetched. A document that none of them has can't reach the bound. Partial sums rise, and so does the bound; what a
   document can still get from lists that weren't read to their end bounds its score from above.
3. Documents whose upper bound reaches the new lower bound are candidates: their entries below the threshold are looked up.

Entries that several queries ask for travel once, to a task for each block of documents and group of queries.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import dropped, partitions, shared_table, tune

#: Bytes of text in a block of documents, and documents: places are 16-bit numbers.
BLOCK_BYTES = 24 << 20
BLOCK_DOCS = 1 << 16
#: A term's blocks are dealt to so many partitions.
SPLIT = 64
#: Queries in a group.
ASKS = 1024

_TERM_BYTES = bytes(int(tk.LOWER[c]) if tk.ALNUM[tk.LOWER[c]] else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and bytes beyond ASCII; only A-Z are lower-cased. Null has none."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


@dataclass
class Index:
    """postings: (term, block, top, bottom, places, impacts), with the highest and the lowest impact; directory: (block, ids), the documents of a block."""

    postings: DataFrame
    directory: DataFrame
    n_docs: int
    n_terms: int
    table: DataFrame

    def drop(self) -> None:
        dropped(self.table)


def _lengths(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.chunks(batches, text_col):
            n = [len(terms(t)) for t in part.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["docs", "terms"])

    r = docs.select(text_col).mapInArrow(run, "docs bigint, terms bigint").agg(F.sum("docs"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 20 * m), m = 50 + (50 * n * N) div L."""
    m = 50 + 50 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _lists(texts: list[str | None], n_docs: int, n_terms: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a block, bounds of their lists, places and impacts, highest first."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    flat, n = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = terms(text)
        n[i] = len(words)
        if words:
            flat.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) << 16 | i)
    key, tf = np.unique(np.concatenate(flat) if flat else np.zeros(0, np.int64), return_counts=True)
    term, place = key >> 16, key & 0xFFFF
    u = impact(tf, n[place], n_docs, n_terms) if len(key) else tf
    order = np.lexsort((place, -u, term))
    return list(numbers), np.searchsorted(term, np.arange(len(numbers) + 1)), place[order], u[order]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of up to BLOCK_BYTES of text and BLOCK_DOCS documents; a longer text is a block of its own."""
    hold, size, rows = [], 0, 0
    for part in tk.chunks(batches, "text", BLOCK_BYTES):
        for at in range(0, part.num_rows, BLOCK_DOCS):
            some = part.slice(at, BLOCK_DOCS)
            more = int(tk.column(some, "text")[1][-1])
            if hold and (size + more > BLOCK_BYTES or rows + some.num_rows > BLOCK_DOCS):
                yield pa.concat_batches(hold)
                hold, size, rows = [], 0, 0
            hold.append(some)
            size, rows = size + more, rows + some.num_rows
    if hold:
        yield pa.concat_batches(hold)


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The postings of every term of every whole text, written to the shared folder.

    Each row is a document by itself, also where ids repeat or are null; null and empty texts are in no list.
    Two passes over the texts: impacts need the corpus's totals.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    n_docs, n_terms = _lengths(docs, "text")
    schema = "term binary, block bigint, top int, bottom int, places binary, impacts binary, ids array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for number, part in enumerate(_blocks(batches)):
            words, bounds, place, u = _lists(part.column("text").to_pylist(), n_docs, n_terms)
            many, none = len(words), pa.nulls(1, pa.binary())
            ends = [pa.array(np.r_[u[bounds[:-1]], 0].astype(np.int32)), pa.array(np.r_[u[bounds[1:] - 1], 0].astype(np.int32))]
            places, impacts = pa.concat_arrays([_packed(place.astype(np.uint16), bounds), none]), pa.concat_arrays([_packed(u.astype(np.int32), bounds), none])
            ids = pa.concat_arrays([pa.nulls(many, pa.list_(pa.int64())), pa.array([part.column("id").to_pylist()], pa.list_(pa.int64()))])
            block = pa.array(np.full(many + 1, (TaskContext.get().partitionId() << 32) + number, np.int64))
            out = pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(words, pa.binary()), none]), block, *ends, places, impacts, ids], names=["term", "block", "top", "bottom", "places", "impacts", "ids"])
            for at in range(0, out.num_rows, 20_000):
                yield out.slice(at, 20_000)

    rows = docs.mapInArrow(run, schema).repartition(partitions(spark), "term", F.expr(f"block % {SPLIT}"))
    table = shared_table(rows.sortWithinPartitions("term", "block"), "postings")
    return Index(table.where("term is not null").drop("ids"), table.where("term is null").select("block", "ids"), n_docs, n_terms, table)


def _highest(rows: DataFrame, k: int, by: str, *order) -> DataFrame:
    """The k rows of the highest `order` for each `by`, without the others."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_place") <= k)


def _bound(partial: DataFrame, k: int) -> DataFrame:
    """(item, bound): each item's k-th highest `low`; 0 where it has fewer than k."""
    low = _highest(partial, k, "item", F.desc("low")).groupBy("item").agg(F.count("*").alias("_n"), F.min("low").alias("_low"))
    return low.select("item", F.when(F.col("_n") >= k, F.col("_low")).otherwise(0).cast("long").alias("bound"))


def _heads(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = [np.frombuffer(x, np.int32)[:k] for x in batch.column("impacts").to_pylist()]
            place = [np.frombuffer(x, np.uint16)[:k] for x in batch.column("places").to_pylist()]
            row = np.repeat(np.arange(batch.num_rows), [len(x) for x in u])
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("term").take(pa.array(row)), batch.column("block").take(pa.array(row)), pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(u).astype(np.int64))], names=["term", "block", "place", "u"]
                )

    return run


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each list, the entries that any of the asking queries fetches."""
    for batch in batches:
        places, impacts, rows = [], [], []
        for i, (p, u, asks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("places", "impacts", "asks")), strict=True)):
            values = np.frombuffer(u, np.int32)
            n = len(values) - int(np.searchsorted(values[::-1], min(a["least"] for a in asks)))
            if n:
                rows.append(i)
                places.append(p[: 2 * n])
                impacts.append(u[: 4 * n])
        keep = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("some", "block", "asks")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(places, pa.binary()), pa.array(impacts, pa.binary())], names=["some", "block", "asks", "places", "impacts"])


def _bounded(k: int):
    """A row for each query and block: the k highest lower bounds, and place, lower and upper bound of the documents that may reach the query's bound and the k-th of the block."""

    def of_block(block: int, queries: list[dict], lists: list[dict]) -> Iterator[tuple[np.ndarray, ...]]:
        asked = defaultdict(list)
        for x in lists:
            place, u = np.frombuffer(x["places"], np.uint16), np.frombuffer(x["impacts"], np.int32).astype(np.int64)
            for a in x["asks"]:
                n = len(u) - int(np.searchsorted(u[::-1], a["least"]))
                if n:
                    asked[a["item"]].append((place[:n], u[:n] * a["w"], np.full(n, a["room"])))
        for q in queries:
            if q["item"] not in asked:
                continue
            place, score, room = map(np.concatenate, zip(*asked.pop(q["item"]), strict=True))
            low = np.bincount(place, score).astype(np.int64)
            high = low + q["total"] - np.bincount(place, room).astype(np.int64)
            bound = max(q["bound"], 1)
            if len(low) > k:
                bound = max(bound, int(np.partition(low, len(low) - k)[len(low) - k]))
            at = np.flatnonzero((low > 0) & (high >= bound))
            best = low[at] if len(at) <= k else np.partition(low[at], len(at) - k)[len(at) - k :]
            yield q["item"], block, best.tolist(), at.astype(np.uint16).tobytes(), low[at].tobytes(), high[at].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, queries, lists = (batch.column(c)[i].as_py() for c in ("block", "queries", "lists"))
                out = list(zip(*of_block(block, queries, lists), strict=True))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(out, kinds, strict=True)], names=["item", "block", "leaders", "places", "lows", "highs"])

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, block, place, low, high) of the documents whose upper bound reaches the query's new lower bound."""
    for batch in batches:
        out = []
        for item, block, bound, *packed in zip(*(batch.column(c).to_pylist() for c in ("item", "block", "bound", "places", "lows", "highs")), strict=True):
            place, low, high = (np.frombuffer(x, t) for x, t in zip(packed, (np.uint16, np.int64, np.int64), strict=True))
            at = high >= bound
            out.append((np.full(int(at.sum()), item), np.full(int(at.sum()), block), place[at], low[at], high[at]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64) if out else np.zeros(0, np.int64)) for c in (zip(*out, strict=True) if out else [[]] * 5)], names=["item", "block", "place", "low", "high"])


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, block, place, more): entries of candidates below their query's least impact."""
    at = np.full(BLOCK_DOCS, -1, np.int64)
    for batch in batches:
        out = []
        for block, places, impacts, asks in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "impacts", "asks")), strict=True):
            place, u = np.frombuffer(places, np.uint16), np.frombuffer(impacts, np.int32).astype(np.int64)
            at[place] = np.arange(len(place))
            for a in asks:
                wanted = np.array(a["wanted"], np.int64)
                found = at[wanted]
                keep = (found >= 0) & (u[found] < a["least"])
                out.append((np.full(int(keep.sum()), a["item"]), np.full(int(keep.sum()), block), wanted[keep], u[found[keep]] * a["w"]))
            at[place] = -1
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64) if out else np.zeros(0, np.int64)) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["item", "block", "place", "more"])


def search(ix: Index, queries: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_col bigint, rank int, doc_id bigint, score bigint): each query's k documents of the highest scores above 0.

    Equal scores are by ascending id, null ids last. A term's weight is floor(1000 * ln((2 * N + 2) / (2 * df + 1))).
    Each term of a query counts once; rows that repeat an item id are one query of all their terms; a query without id, text or a
    term of the corpus has no row, and neither has an empty table.
    """
    tune(queries.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t) for i, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True) for t in set(terms(text))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["item", "term"])

    asked = queries.select(F.col(item_col).cast("bigint").alias("item"), F.col(text_col).alias("text")).where("item is not null").mapInArrow(cut, "item bigint, term binary").distinct()
    asked = shared_table(asked, "asked")  # small, as its files' sizes tell: Spark broadcasts it then, and joins by shuffle else
    lists = ix.postings.select("term", "top", "bottom", "places").join(asked.select("term").distinct(), "term", "left_semi")
    lists = lists.groupBy("term").agg(F.sum(F.expr("octet_length(places) div 2")).alias("df"), F.max("top").cast("long").alias("top"), F.min("bottom").cast("long").alias("bottom"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * ix.n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = shared_table(asked.join(lists, "term").select("item", "term", weight.cast("long").alias("w"), "top", "bottom").where("w * top > 0"), "weighed")
    wanted = weighed.select("term").distinct()

    # 1: heads of the lists
    heads = ix.postings.join(wanted, "term", "left_semi").select("term", "block", "places", "impacts").mapInArrow(_heads(k), "term binary, block bigint, place int, u bigint")
    heads = _highest(heads, k, "term", F.desc("u"), "block", "place")
    partial = heads.join(weighed, "term").groupBy("item", "block", "place").agg(F.sum(F.col("w") * F.col("u")).alias("low"))
    first = _bound(partial, k)

    # 2: one threshold for all lists of a query
    n_lists = Window.partitionBy("item")
    least = weighed.join(first, "item").withColumn("_lists", F.count("*").over(n_lists)).withColumn("share", F.expr("(bound + _lists - 1) div _lists"))
    least = least.withColumn("least", F.expr("(share + w - 1) div w"))
    room = F.when(F.col("bottom") >= F.col("least"), 0).otherwise(F.least(F.col("w") * F.col("top"), F.greatest(F.col("share") - 1, F.lit(0))))
    least = least.withColumn("room", room).withColumn("total", F.sum("room").over(n_lists))
    plan = shared_table(least.select("item", "term", "w", "top", "bound", "room", "least", "total"), "thresholds")
    groups = 1 + plan.select("item").distinct().count() // ASKS
    plan = plan.withColumn("some", F.expr(f"pmod(hash(item), {groups})"))
    asks = shared_table(plan.where("least <= top").groupBy("some", "term").agg(F.collect_list(F.struct("item", "w", "least", "room")).alias("asks")), "asks")
    members = shared_table(plan.select("some", "item", "bound", "total").distinct().groupBy("some").agg(F.collect_list(F.struct("item", "bound", "total")).alias("queries")), "members")
    fetched = ix.postings.join(asks, "term").select("some", "block", "places", "impacts", "asks").mapInArrow(_fetched, "some int, block bigint, asks array<struct<item bigint, w bigint, least bigint, room bigint>>, places binary, impacts binary")
    packed = fetched.groupBy("some", "block").agg(F.collect_list(F.struct("asks", "places", "impacts")).alias("lists")).join(members, "some")
    some = shared_table(packed.select("block", "queries", "lists").mapInArrow(_bounded(k), "item bigint, block bigint, leaders array<bigint>, places binary, lows binary, highs binary"), "partial")

    # 3: candidates and what is missing of them
    second = _bound(some.select("item", F.explode("leaders").alias("low")), k)
    candidates = some.join(second, "item").select("item", "block", "bound", "places", "lows", "highs").mapInArrow(_candidates, "item bigint, block bigint, place bigint, low bigint, high bigint")
    candidates = shared_table(candidates, "candidates")
    open_ = candidates.where("high > low").groupBy("item", "block").agg(F.collect_list("place").alias("wanted"))
    looked = open_.join(plan.where("room > 0").select("item", "term", "w", "least"), "item").groupBy("term", "block").agg(F.collect_list(F.struct("item", "w", "least", "wanted")).alias("asks"))
    looked = shared_table(looked, "lookups")
    deepest = shared_table(plan.where("room > 0").groupBy("term").agg(F.max("least").alias("_least")), "open-terms")
    tails = ix.postings.join(deepest, "term").where("bottom < _least")
    more = tails.join(looked, ["term", "block"]).select("block", "places", "impacts", "asks").mapInArrow(_looked_up, "item bigint, block bigint, place bigint, more bigint")
    scored = candidates.select("item", "block", "place", F.col("low").alias("score")).unionByName(more.withColumnRenamed("more", "score"))
    scored = shared_table(scored.groupBy("item", "block", "place").agg(F.sum("score").alias("score")), "scored")
    named = ix.directory.join(scored, "block").select("item", "block", "place", "score", F.expr("ids[int(place)]").alias("doc_id"))
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place")
    return _highest(named, k, "item", *order).select(F.col("item").alias(item_col), F.col("_place").alias("rank"), "doc_id", "score")
