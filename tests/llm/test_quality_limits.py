"""Shares of good, poor and toxic documents that the quality filter keeps, and its limits."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import quality, queries


@pytest.fixture(scope="module")
def mixed(spark):
    """Good, poor and toxic texts whose words overlap, so that some are hard to tell."""
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(3000):
        poor, toxic = i % 8 == 1, i % 8 == 2
        words = [f"w{rng.integers(0, 400)}" for _ in range(30)]
        for j in rng.choice(30, rng.integers(2, 7), replace=False) if poor or toxic else rng.choice(30, rng.integers(0, 2), replace=False):
            words[j] = f"{'poor' if poor or (not toxic and i % 2) else 'toxic'}{rng.integers(0, 6)}"
        rows.append((i, " ".join(words), "en", "site", 200))
        labels.append((i, int(not poor), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs, spark.createDataFrame(labels, "doc_id bigint, good int, toxic int")


def test_toxic_and_poor_rows_outside_of_the_fit_are_rejected(mixed):
    docs, labels = mixed
    told = labels.where("doc_id < 2000")
    model = quality.train(docs, told, labelled=1200, pool=600)
    assert set(model.models) == {"good", "clean"}
    got = quality.classify(docs, model).where("doc_id >= 2000").select("doc_id", "quality_keep").toPandas()
    kind = got.doc_id % 8
    assert got[kind == 1].quality_keep.mean() < 0.1
    assert got[kind == 2].quality_keep.mean() < 0.1
    assert got[(kind != 1) & (kind != 2)].quality_keep.mean() > 0.9


def test_limits_are_the_same_by_shuffle(mixed, monkeypatch):
    docs, labels = mixed
    limits = []
    for narrow in (quality.NARROW, 10):
        monkeypatch.setattr(quality, "NARROW", narrow)
        limits.append({t: m.limit for t, m in quality.train(docs, labels, labelled=800, pool=200, rounds=1).models.items()})
    assert limits[0] == limits[1] and all(x != 0.5 for x in limits[0].values())


def test_limit_weighs_both_classes_alike():
    n = np.zeros((2, quality.BINS), np.int64)
    n[0, 1000], n[0, 20000], n[1, 10000], n[1, 60000] = 90, 10, 100, 9900  # 1 % of right rows under 10 % of wrong ones
    assert 20000 / quality.BINS < quality._limit(n) <= 60000 / quality.BINS
    assert quality._limit(np.zeros_like(n)) == 0.5  # nothing is known
    n[:] = 0
    n[0, 40000], n[1, 50000] = 3, 3
    assert 0.5 <= quality._limit(n) <= 50000 / quality.BINS  # few rows move it little


def test_rejected_shares_of_the_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = queries.judged(queries.table(spark, sf_dir, "labels")).toPandas()
    got = queries.op10_quality(spark, sf_dir).toPandas().merge(labels, on="doc_id")
    assert got[(got.good == 1) & (got.toxic == 0)].quality_keep.mean() > 0.95
    assert got[got.toxic == 1].quality_keep.mean() < 0.05
    assert got[got.good == 0].quality_keep.mean() < 0.05


def test_statistics_are_of_all_rows(spark, mixed):
    """Counts of words by class, over all labelled rows, and of shapes, over all rows, as plain Python has them."""
    docs, labels = mixed
    told = labels.where("doc_id < 2000")
    known = quality._known(told.unionByName(told.limit(5)), "doc_id")  # labels that repeat
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(known, "_id", "left")
    got = quality.statistics(rows.select("text", "good", "clean").repartition(5), flush=1000).toPandas()
    want: dict[str, Counter] = {}
    by = {r["_id"]: r for r in rows.collect()}
    for r in by.values():
        for w in set(re.findall(r"[a-z0-9]+", r["text"])):
            c = want.setdefault(w, Counter())
            c.update({"n1": r["good"] == 1, "n2": r["good"] == 0, "n3": r["clean"] == 1, "n4": r["clean"] == 0})
    columns = ["n1", "n2", "n3", "n4"]
    count = lambda rows: sorted(map(tuple, rows))
    assert count(got[(got.kind == 0)][columns].values.tolist()) == count([c[k] for k in columns] for c in want.values() if sum(c.values()))
    assert (got[got.kind == 1].groupby(got.key // 65536).n1.sum() == 3000).all()
    assert got[got.kind == 2][columns].values.tolist() == [[sum(r["good"] == 1 for r in by.values()), sum(r["good"] == 0 for r in by.values()), sum(r["clean"] == 1 for r in by.values()), sum(r["clean"] == 0 for r in by.values())]]


def test_pseudo_labels_come_from_the_whole_pool(spark, mixed):
    """A round by hand: all sure rows of each view, the least by hash, with the other view's features."""
    docs, labels = mixed
    known = quality.shared_table(quality._known(labels.where("doc_id < 1000"), "doc_id"), "labels")
    text = docs.select(F.col("doc_id").alias("_id"), "text", quality._meta(docs, ["source", "lang"]).alias("meta"))
    text = text.join(known, "_id", "left")
    frame = quality._frame(quality.statistics(text.select("text", "good", "clean")), 200)
    rows = quality.shared_table(quality.feature_rows(text.unionByName(text.limit(7)), frame), "features")
    assert rows.count() == 3000  # one row an id
    rng = np.random.default_rng(1)
    model = quality.Model([(rng.normal(0, 1, w), 0.1) for w in frame.widths], [(1.0, 0.0), (2.0, 0.1)], (np.zeros(2), 0.0))
    free = rows.where("_id >= 1000")
    got = quality._pseudo_labelled(free, model, frame, 40, 0.8)
    table = free.withColumn("h", F.xxhash64("_id", F.lit(78))).toArrow().sort_by([("h", "ascending"), ("_id", "ascending")])
    x = quality._unpacked(table, frame.widths)
    for v in (0, 1):
        p = 1 / (1 + np.exp(-(model.scale[1 - v][0] * (x[1 - v] @ model.fitted[1 - v][0] + 0.1) + model.scale[1 - v][1])))
        take = np.r_[np.flatnonzero(p >= 0.8)[:40], np.flatnonzero(p <= 0.2)[:40]]
        assert len(got[v][1]) == len(take) and got[v][1].sum() == min(40, (p >= 0.8).sum())
        assert sorted(map(bytes, got[v][0].astype(np.uint8))) == sorted(map(bytes, x[v][take].astype(np.uint8)))


def test_ids_that_repeat_and_columns_of_clashing_names(spark, mixed):
    docs, labels = mixed
    one = spark.range(6000).selectExpr("cast(0 as bigint) doc_id", "'w1 w2 w3' text", "'en' lang", "'site' source", "cast(8 as bigint) n_chars")
    model = quality.train(docs.unionByName(one), labels, labelled=1200, pool=300)
    assert set(model.models) == {"good", "clean"}
    wide = docs.limit(20).withColumns({c: F.lit(c) for c in ("_meta", "meta", "_id", "x0", "c0")}).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumns({c: F.lit(None).cast("string") for c in ("_meta", "meta", "_id", "x0", "c0")}))
    got = quality.classify(wide, model)
    assert got.columns[: len(wide.columns)] == wide.columns and got.count() == 21
    assert {r["_meta"] for r in got.collect()} == {"_meta", None}
