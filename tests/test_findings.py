"""Cases of reviews: inputs on which a query was wrong or took too much."""

from collections import Counter
from datetime import datetime
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orrery.operators import clones, clustering, drift, graph, overlaps, views
from orrery.plans import catalog


def test_a_delta_rounded_to_zero_has_its_axes(spark, tmp_path):
    rows = [(3, 0, "edit", 0.0, datetime(2024, 1, 1)), (6, 0, "edit", 0.0, datetime(2024, 1, 2))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    (r,) = catalog.queries()["change_analysis"](spark, str(tmp_path)).collect()
    assert (r["change_type"], r["severity"], r["deltas"]) == ("lexical", "low", 2)
    assert r["first_likely_causes"] == r["last_likely_causes"] == "lexical: 0.60 of the movement"


def _near_copies(n):
    """Files that differ in one word of their own, two texts that two files each have, and a lone one."""
    body = " ".join(f"word{i} ( a , b ) ;" for i in range(12))
    rows = [(f"/n{i:03d}.js", f"own{i} {body}") for i in range(n)]
    return [*rows, ("/c1.js", body), ("/c2.js", body), ("/d1.js", body[:60]), ("/d2.js", body[:60]), ("/l.js", "nothing like these at all here"), ("/e.js", "")]


def test_clones_of_files_that_differ_in_own_words_are_counted_without_their_links(spark):
    files = spark.createDataFrame(_near_copies(60), "file_path string, content string")
    sets, classes = clones.fingerprint_sets(files)
    fps = {r["cls"]: set(r["fps"]) for r in classes.collect()}
    of = {r["file_path"]: fps[r["cls"]] for r in sets.collect()}
    want = {(a, b): len(of[a] & of[b]) / len(of[a] | of[b]) for a, b in combinations(sorted(of), 2)}
    want = {k: s for k, s in want.items() if s >= clones.SIMILAR}
    assert len(want) > 1700
    got = {(r["file_a"], r["file_b"]): r["similarity"] for r in clones.clone_pairs(files).collect()}
    assert got == want
    assert {r["file_path"]: r["clones"] for r in clones.file_clone_counts(files).collect()} == Counter(f for pair in want for f in pair)
    kinds = {k: [s for s in want.values() if k == ("exact" if s > 0.95 else "parameterized" if s > 0.7 else "near-miss")] for k in ("exact", "parameterized", "near-miss")}
    summed = {r["clone_type"]: (r["clones"], round(r["similarity"], 9)) for r in clones.clone_summary(files).collect()}
    assert summed == {k: (len(s), round(sum(s) / len(s), 9)) for k, s in kinds.items() if s}
    of_one = {(r["file_a"], r["file_b"]): r["similarity"] for r in clones.clone_pairs(files, path="/c1.js").collect()}
    assert of_one == {k: s for k, s in want.items() if "/c1.js" in k}
    _, each = clones.cores(classes, clones.SIMILAR)
    assert each.count() < 20  # 62 classes


def test_shared_items_of_blocks_go_on_beyond_one_step_of_items(monkeypatch):
    monkeypatch.setattr(overlaps, "ITEMS", 7)
    rng = np.random.default_rng(1)
    a, b = ([rng.choice(60, size=n, replace=False) for n in rng.integers(1, 40, k)] for k in (9, 13))
    assert overlaps.shared(a, b).tolist() == [[len(set(x) & set(y)) for y in b] for x in a]
    assert overlaps.shared([np.array([1])], [np.array([2])]).tolist() == [[0]]


def test_sets_meet_by_blocks_once_and_none_is_lost(spark):
    rng = np.random.default_rng(2)
    sets = {f"s{i}": sorted(rng.choice(40, size=n, replace=False).tolist(), reverse=True) for i, n in enumerate(rng.integers(1, 9, 50))}
    rows = spark.createDataFrame([(k, s, len(s)) for k, s in sets.items()], "key string, items array<long>, keep int")

    def listed(a, b, n, same):
        i, j = np.nonzero(np.triu(n, 1) if same else n)
        return pd.DataFrame({"a": a["key"].to_numpy()[i], "b": b["key"].to_numpy()[j], "n": n[i, j]})

    got = overlaps.products(rows, listed, "a string, b string, n long", block=4).collect()
    want = {frozenset((a, b)): len(set(sets[a]) & set(sets[b])) for a, b in combinations(sets, 2)}
    assert {frozenset((r["a"], r["b"])): r["n"] for r in got} == {k: n for k, n in want.items() if n} and len(got) == sum(n > 0 for n in want.values())


def _few_points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"/p{i % 11}.py" if i < 12 else f"/q{i}.py", rng.normal(size=4).tolist(), rng.normal(size=2).tolist(), [1.0]) for i in range(23)]
    return rows, spark.createDataFrame(rows, "id long, file_path string, lexical array<double>, structural array<double>, semantic array<double>")


def test_matrix_by_blocks_has_every_cell_and_its_summary_needs_none(spark):
    rows, points = _few_points(spark)
    ends = [(1, 2, 0.5), (2, 1, 0.7), (3, 4, 0.9), (0, 11, 0.2), (11, 5, 0.3), (0, 5, 0.4), (6, 6, 0.8)]
    contracts = spark.createDataFrame([(f"{a}:{b}", a, b, w) for a, b, w in ends], "id string, caller_id long, callee_id long, baseline_distance double")
    got = views.matrix(points, contracts, block=5).collect()
    assert len(got) == 23 * 23
    path = {r[0]: r[1] for r in rows}
    ways = {}
    for a, b, w in ends:
        ways[path[a], path[b]] = max(w, ways.get((path[a], path[b]), 0))
    unit = {r[0]: np.array(r[2] + r[3] + r[4]) / np.linalg.norm(r[2] + r[3] + r[4]) for r in rows}
    far = lambda p, q: 0 if p == q else ways.get((p, q), 0 if (q, p) in ways else None)
    want = sorted((path[a], path[b], round(float(1 - unit[a] @ unit[b]) if far(path[a], path[b]) is None else far(path[a], path[b]), 9), path[a] != path[b] and (path[a], path[b]) in ways) for a in path for b in path)
    assert sorted((r["row_path"], r["col_path"], round(r["value"], 9), r["is_dependency"]) for r in got) == want
    (s,) = views.matrix_summary(points, contracts).collect()
    assert tuple(s) == (len(set(path.values())), sum(r["is_dependency"] for r in got), sum(r["is_bidirectional"] for r in got) // 2)


def test_silhouette_is_the_same_by_any_blocks(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 2)
    _, points = _few_points(spark)
    rows = clustering.matrix(points.withColumn("dominant_domain", F.lit("a"))).withColumn("cluster", (F.col("id") % 3).cast("int"))
    p = {r["id"]: (r["cluster"], np.array(r["p"])) for r in rows.collect()}
    want = {}
    for i, (c, x) in p.items():
        mean = {k: np.mean([np.linalg.norm(x - y) for d, y in p.values() if d == k]) for k in range(3)}
        a, b = mean[c], min(m for k, m in mean.items() if k != c)
        want[i] = (b - a) / max(a, b)
    for block in (4, 100):
        got = {r["id"]: r["silhouette"] for r in clustering.silhouette(rows, block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_small_domains_have_no_more_pivots_than_blocks(spark):
    _, points = _few_points(spark)
    _, ball = drift.balls(points.withColumn("dominant_domain", F.lit("a")))
    assert ball.count() == 1


def test_betweenness_takes_larger_batches_where_sources_reach_little(spark, monkeypatch):
    nodes = spark.range(40).select("id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(39) if i % 4 != 3], "src long, dst long")  # ten paths of four
    batches, walk = [], graph._from_sources
    monkeypatch.setattr(graph, "_from_sources", lambda s, e: batches.append(walk(s, e)) or batches[-1])
    got = {r["id"]: r["betweenness"] * 39 * 38 for r in graph.betweenness(nodes, edges, rows=160).collect()}
    assert sum(n for _, n, _ in batches) == 40 and len(batches) <= 4  # ten, if each source reached all nodes
    assert all(abs(got[i] - (2 if i % 4 in (1, 2) else 0)) < 1e-9 for i in range(40))


def _shuffled(spark, df):
    """Rows of `df`, and the bytes that its tasks wrote to their disks for others."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    was = total()
    rows = df().collect()
    return rows, total() - was


def test_more_blocks_of_the_matrix_copy_no_points(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"/m{i}.py", rng.normal(size=40).tolist(), rng.normal(size=20).tolist(), [1.0]) for i in range(300)]
    points = spark.createDataFrame(rows, "id long, file_path string, lexical array<double>, structural array<double>, semantic array<double>")
    contracts = spark.createDataFrame([("1:2", 1, 2, 0.5)], "id string, caller_id long, callee_id long, baseline_distance double")
    one, few = _shuffled(spark, lambda: views.matrix(points, contracts, block=300))
    all_, many = _shuffled(spark, lambda: views.matrix(points, contracts, block=10))
    key = lambda r: (r["row_path"], r["col_path"], round(r["value"], 9), r["is_dependency"], r["is_bidirectional"])
    assert len(one) == 300 * 300 and sorted(map(key, one)) == sorted(map(key, all_))
    assert many < 3 * few  # thirty blocks against one: points went to each other block, as often as there are blocks


def test_more_blocks_of_drift_copy_no_points(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"/d{i}.py", "db", rng.normal(size=40).tolist(), rng.normal(size=20).tolist()) for i in range(300)]
    points = spark.createDataFrame(rows, "id long, file_path string, dominant_domain string, lexical array<double>, structural array<double>")
    one, few = _shuffled(spark, lambda: drift.semantic_drift(points, block=300))
    all_, many = _shuffled(spark, lambda: drift.semantic_drift(points, block=10))
    key = lambda r: (r["file_a"], r["file_b"], round(r["current_distance"], 9), r["severity"])
    assert len(one) > 40000 and all(r["file_a"] < r["file_b"] for r in one) and sorted(map(key, one)) == sorted(map(key, all_))
    assert many < 3 * few  # some thirty blocks against one
