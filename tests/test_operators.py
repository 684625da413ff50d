"""Code-space operators on small hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import temporal
from orrery.operators import changes, clones, clustering, contracts, debt, drift, graph, index, search, smells, surface, views, waves
from orrery.sources import files as src

def now():
    return F.to_timestamp(F.lit("2024-02-01 00:00:00"))


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def nodes(spark, n, domain="api"):
    return spark.createDataFrame([(i, f"/p/d{i % 2}/f{i}.py", domain) for i in range(n)], "id bigint, file_path string, domain string")


def code(spark):
    return spark.createDataFrame(
        [
            ("/r/pkg/a.py", "from pkg.b import f\nfrom . import c\nimport os\n"),
            ("/r/pkg/b.py", "def f():\n    pass\n"),
            ("/r/pkg/__init__.py", "__all__ = ['x', \"y\"]\n"),
            ("/r/web/app.js", "import { x } from './lib'\nconst y = require('../web/util.js')\nimport z from 'react'\nimport './app.js'\n"),
            ("/r/web/lib/index.js", "export default 1\nexport { p, q as r }\nexport const s = 1\nexports.t = 2\n"),
            ("/r/web/util.js", "module.exports = {}\n"),
        ],
        "file_path string, content string",
    )


def test_imports_are_resolved(spark):
    f = code(spark)
    found = f.select(F.col("file_path").alias("caller"), F.explode(contracts.imports(F.col("content"), F.col("file_path"))).alias("target"))
    got = {(r["caller"], r["target"]): r["callee"] for r in contracts.resolve(found, f).collect()}
    assert got == {
        ("/r/pkg/a.py", "pkg.b"): "/r/pkg/b.py",
        ("/r/pkg/a.py", "."): "/r/pkg/__init__.py",
        ("/r/web/app.js", "./lib"): "/r/web/lib/index.js",
        ("/r/web/app.js", "../web/util.js"): "/r/web/util.js",
        ("/r/web/app.js", "./app.js"): "/r/web/app.js",
    }
    points = index.code_points(f, now())
    c = contracts.detect(f, points, now())
    assert c.count() == 4  # without the edge to itself
    kept, left = index.prune(points, c, f.where("file_path <> '/r/web/util.js'"))
    assert kept.count() == 5 and left.count() == 3


def test_exports(spark):
    s = surface.analyze(code(spark), spark.createDataFrame([], "id string, caller_id string, callee_id string"), index.code_points(code(spark), now()))
    got = {r["file_name"]: [(x["type"], x["name"]) for x in r["exports"]] for r in s.collect()}
    assert got["__init__.py"] == [("explicit", "x"), ("explicit", "y")]
    assert got["index.js"] == [("constant", "s"), ("default", "default"), ("re-export", "p"), ("re-export", "q"), ("commonjs", "t")]
    assert got["b.py"] == [("function", "f")]
    assert surface.summary(s).first()["total_modules"] == 6


def test_upsert_keeps_birth(spark):
    f = code(spark)
    old = index.code_points(f, now())
    new = index.code_points(f.limit(2).withColumn("content", F.lit("x = 1")), F.to_timestamp(F.lit("2025-01-01")))
    rows = index.upsert(old, new).collect()
    assert len(rows) == 6
    assert {str(r["created_at"]) for r in rows} == {"2024-02-01 00:00:00"}
    assert sum(r["line_count"] == 1 for r in rows) == 2


@pytest.mark.parametrize("step", [3, 10])
def test_pagerank_and_hits(spark, step):
    n, e = nodes(spark, 4), edges(spark, [(1, 0), (2, 0), (3, 2), (0, 3)])
    r = {x["id"]: x["pagerank"] for x in graph.pagerank(n, e, most=40, step=step).collect()}
    rank = [0.25] * 4
    for _ in range(40):
        got = [0.0] * 4
        for s, d in [(1, 0), (2, 0), (3, 2), (0, 3)]:
            got[d] += rank[s]
        rank = [0.15 / 4 + 0.85 * g for g in got]
    assert sum(r.values()) == pytest.approx(1)
    assert [r[i] for i in range(4)] == pytest.approx([x / sum(rank) for x in rank], abs=1e-5)
    h = {x["id"]: x for x in graph.hits(n, e, most=10, tolerance=0.0, step=step).collect()}
    hub, authority = [1.0] * 4, [1.0] * 4
    for _ in range(10):
        new_hub, new_authority = [0.0] * 4, [0.0] * 4
        for s, d in [(1, 0), (2, 0), (3, 2), (0, 3)]:
            new_hub[s] += authority[d]
            new_authority[d] += hub[s]
        hub, authority = ([x / sum(y * y for y in v) ** 0.5 for x in v] for v in (new_hub, new_authority))
    assert [h[i]["hub_score"] for i in range(4)] == pytest.approx(hub)
    assert [h[i]["authority_score"] for i in range(4)] == pytest.approx(authority)


def test_pagerank_and_hits_without_nodes_or_edges(spark):
    n, none = nodes(spark, 3), edges(spark, [(0, 1)]).limit(0)
    assert [r["pagerank"] for r in graph.pagerank(n, none).collect()] == pytest.approx([1 / 3] * 3)
    assert {(r["hub_score"], r["authority_score"]) for r in graph.hits(n, none).collect()} == {(0.0, 0.0)}
    assert graph.pagerank(n.limit(0), none).count() == graph.hits(n.limit(0), none).count() == 0


@pytest.mark.parametrize("most", [100, 1])
def test_betweenness(spark, most):
    n, e = nodes(spark, 5), edges(spark, [(0, 1), (1, 2), (0, 3), (3, 2), (2, 4)])
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(n, e, rows=most).collect()}
    assert got == pytest.approx({0: 0, 1: 1 / 12, 2: 3 / 12, 3: 1 / 12, 4: 0})


def test_wave_takes_the_strongest_parent_and_stops(spark):
    n = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "a"), (4, "a")], "id bigint, domain string")
    e = edges(spark, [(1, 0), (2, 0), (3, 1), (3, 2), (4, 3)])
    w = {r["id"]: r for r in waves.simulate(n, e, spark.createDataFrame([(0,)], "id bigint")).collect()}
    assert w[1]["wave_intensity"] == pytest.approx(0.6) and w[2]["wave_intensity"] == pytest.approx(0.3)
    assert w[3]["wave_intensity"] == pytest.approx(0.36) and list(w[3]["reached_via"]) == [0, 1, 3]
    assert w[4]["is_boundary"] and not w[3]["is_boundary"]
    assert waves.predict(waves.simulate(n, e, spark.createDataFrame([(0,)], "id bigint")), spark.createDataFrame([(0,), (4,)], "id bigint")).count() == 2


def test_adaptive_thresholds(spark):
    rows = [(f"a{i}", "a", 0.1, i) for i in range(25)] + [("b1", "b", 0.4, 1), ("b2", "b", 0.4, 2)] + [(f"c{i}", "c", 0.9, i) for i in range(3)]
    d = spark.createDataFrame(rows, "id string, code_point_id string, movement_magnitude double, t int").withColumn("created_at", F.timestamp_seconds("t"))
    got = {r["code_point_id"]: (r["samples"], round(r["threshold"], 6)) for r in changes.adaptive_thresholds(d).collect()}
    assert got == {"a": (20, 0.1), "b": (2, 0.15), "c": (3, 0.5)}


def test_temporal_defaults_and_limits(spark):
    c = spark.createDataFrame([("/f", "h1", "2023-11-03 00:00:00", "x"), ("/f", "h2", "2023-11-02 23:59:59", "y")], "file_path string, hash string, ts string, author string").withColumn("ts", F.to_timestamp("ts"))
    f = spark.createDataFrame([("/f",), ("/g",)], "file_path string")
    got = {r["file_path"]: r for r in temporal.with_features(f, c, now()).collect()}
    assert [got["/g"][n] for n in temporal.NAMES] == temporal.NO_HISTORY
    assert got["/f"]["change_frequency"] == pytest.approx(1 / 30)
    assert got["/f"]["author_diversity"] == pytest.approx(0.2)
    assert got["/f"]["file_age"] == pytest.approx(90 / 365)


def python_fingerprints(text):
    import hashlib
    import re

    toks = re.findall(r"[a-zA-Z_]\w*|[^\s\w]", re.sub(r"\b\d+\.?\d*\b", "NUM", text).lower())
    h = [int(hashlib.md5(" ".join(toks[i : i + 5]).encode()).hexdigest()[:8], 16) for i in range(len(toks) - 4)]
    return set(h) if len(h) < 4 else {min(h[i : i + 4]) for i in range(len(h) - 3)}


def test_clones(spark):
    texts = {"a": "a b c d e f g h", "b": "a b c d e f g h", "c": "a b c d e f g x", "d": "one two", "e": "q w e r t", "f": ""}
    f = spark.createDataFrame([(k, t) for k, t in texts.items()], "file_path string, content string")
    sets = {}
    for r in clones.fingerprints(f).collect():
        sets.setdefault(r["file_path"], set()).add(r["fp"])
    assert sets == {k: s for k, t in texts.items() if (s := python_fingerprints(t))}
    expected = {}
    for a in sets:
        for b in sets:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if a < b and j >= 0.3:
                expected[a, b] = j
    got = {(r["file_a"], r["file_b"]): r["similarity"] for r in clones.clone_pairs(f).collect()}
    assert got == pytest.approx(expected)
    counts = {}
    for pair in expected:
        for x in pair:
            counts[x] = counts.get(x, 0) + 1
    assert {r["file_path"]: r["clones"] for r in clones.file_clone_counts(f).collect()} == counts


def test_smells(spark):
    n = 24
    e = [(i, 0) for i in range(1, 10)] + [(20, i) for i in range(16)] + [(1, 2), (2, 1)]
    rows = [(i, f"/p/m/f{i}.py", 600 if i == 0 else 10, 0.1, 0.2 if i == 0 else 0.01, 0.0) for i in range(n)]
    x = spark.createDataFrame(rows, "id bigint, file_path string, line_count int, complexity double, pagerank double, hub_score double")
    g = edges(spark, e)
    m = x.join(graph.degrees(x, g), "id")
    got = {(r["smell_type"], r["file_name"]): r["severity"] for r in smells.detect(m, g, None, now()).collect()}
    assert got["god_file", "f0.py"] == "high"
    assert got["hub_overload", "f20.py"] == "medium"
    assert got["feature_envy", "f20.py"] == "medium"
    assert got["circular_dependency", "f1.py <-> f2.py"] == "high"
    assert got["orphan", "f23.py"] == "medium" and ("dead_code_candidate", "f23.py") in got


def test_debt_weights_and_grades(spark):
    assert sum(debt.WEIGHTS.values()) == pytest.approx(1)
    p = spark.createDataFrame([("/a", 600, [0.0] * 16), ("/b", 0, [])], "file_path string, line_count int, structural array<double>")
    one = spark.createDataFrame([("/a", 5)], "file_path string, n int")
    t = spark.createDataFrame([("/a", 1.0)], "file_path string, days_since_change double")
    got = {r["file_path"]: r for r in debt.files(p, one, one, one, t).collect()}
    a = got["/a"]
    assert (a["size"], a["duplication"], a["smells"], a["tensions"], a["staleness"], a["documentation"]) == (60, 100, 100, 100, 0, 50)
    assert a["score"] == pytest.approx(60 * 0.1 + 15 + 15 + 10 + 2.5) and a["grade"] == "C"
    assert debt.summary(debt.files(p, one, one, one, t)).first()["total_files"] == 2


def test_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = []
    for i in range(30):
        c = [10.0 * (i % 3), 0.0]
        rows.append((i, f"/f{i}", "api", [float(x) for x in rng.normal(c, 0.1)], [0.0], [0.0]))
    p = spark.createDataFrame(rows, "id bigint, file_path string, dominant_domain string, lexical array<double>, structural array<double>, semantic array<double>")
    a, c = clustering.cluster(p, 3)
    groups = {}
    for r in a.collect():
        groups.setdefault(r["cluster"], set()).add(r["id"] % 3)
    assert sorted(map(tuple, groups.values())) == [(0,), (1,), (2,)]
    assert clustering.summary(a, c).count() == 3
    s = clustering.silhouette(a, block=8)
    assert s.count() == 30 and min(r["silhouette"] for r in s.collect()) > 0.9
    assert clustering.cluster(p.limit(2))[0].count() == 0


def test_kmeans_equals_plain_turns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)).round(3)
    x[:5] = x[5]  # equal points
    p = spark.createDataFrame([(i, f"/f{i}", "api", r.tolist(), [], []) for i, r in enumerate(x)], "id bigint, file_path string, dominant_domain string, lexical array<double>, structural array<double>, semantic array<double>").repartition(3)
    rows = clustering.matrix(p)

    def plain(k, turns):
        c = x[:1]
        while len(c) < k:
            c = np.vstack([c, x[np.argmax(((x[:, None] - c) ** 2).sum(2).min(1))]])
        for _ in range(turns):
            d = ((x[:, None] - c) ** 2).sum(2)
            near, new = d.argmin(1), c.copy()
            for i in set(near):
                new[i] = x[near == i].mean(0)
            moved, c = np.linalg.norm(new - c), new
            if moved < clustering.TOLERANCE:
                break
        return c, d.min(1).sum()

    each = clustering.kmeans_each(rows, [2, 3, 5], 8)
    for k, (c, inertia) in each.items():
        want, sse = plain(k, 8)
        assert np.allclose(c, want) and inertia == pytest.approx(sse)


def test_outliers_and_misclassified(spark):
    xs = [1.0] * 9 + [10.0, 100.0, 101.0]
    p = spark.createDataFrame([(i, f"/d/f{i}", "api", [x], [], []) for i, x in enumerate(xs)], "id bigint, file_path string, dominant_domain string, lexical array<double>, structural array<double>, semantic array<double>")
    rows = clustering.assigned(clustering.matrix(p), np.array([[0.0], [100.0]]))
    assert {r["id"]: r["cluster"] for r in rows.collect()} == {**{i: 0 for i in range(10)}, 10: 1, 11: 1}
    far = clustering.outliers(rows).collect()
    near = np.array(xs[:10])
    assert [(r["id"], r["name"], r["cluster"]) for r in far] == [(9, "f9", 0)] and far[0]["threshold"] == pytest.approx(near.mean() + 2 * near.std())
    assert clustering.misclassified(rows).count() == 0  # every point is at its nearest centroid
    wrong = rows.withColumn("cluster", F.when(F.col("id") == 10, 0).otherwise(F.col("cluster"))).withColumn("distance", F.element_at("distances", F.col("cluster") + 1))
    hit = clustering.misclassified(wrong).collect()
    assert [(r["id"], r["current_cluster"], r["suggested_cluster"], r["current_distance"], r["suggested_distance"]) for r in hit] == [(10, 0, 1, 100.0, 0.0)]


def test_matching_and_cluster_drift(spark):
    from itertools import permutations

    rng = np.random.default_rng(2)
    assert clustering.matched([[0]]) == [0]
    for k in (2, 3, 5):
        for _ in range(20):
            w = rng.integers(0, 4, (k, k)).tolist()
            want = min(permutations(range(k)), key=lambda q: (-sum(w[i][j] for i, j in enumerate(q)), q))
            assert clustering.matched(w) == list(want)
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "id bigint, cluster int")
    b = spark.createDataFrame([(i, (i + 1) % 3 if i else 0) for i in range(30)], "id bigint, cluster int")
    assert [r["id"] for r in clustering.cluster_drift(a, b).where("drifted").collect()] == [0]
    assert clustering.cluster_drift(a.limit(0), b).count() == 0


def test_far_pairs_skip_blocks_and_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    directions = np.eye(6)[[0, 0, 1, 2]] + 0.15 * np.eye(6)[[3, 4, 5, 3]]
    x = np.vstack([d + rng.normal(scale=0.02, size=(25, 6)) for d in directions] + [np.zeros((3, 6))])
    rows = [(i, f"/f{i}", "api" if i % 5 else "db", r[:4].tolist(), r[4:].tolist()) for i, r in enumerate(x)]
    p = spark.createDataFrame(rows, "id bigint, file_path string, dominant_domain string, lexical array<double>, structural array<double>")
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    d = 1 - u @ u.T
    want = {tuple(sorted((f"/f{i}", f"/f{j}"))): d[i, j] for i in range(len(x)) for j in range(i) if rows[i][2] == rows[j][2] and d[i, j] > drift.SEMANTIC}
    for block in (4, 512):
        got = drift.semantic_drift(p, block=block, pivots=12).collect()
        assert {(r["file_a"], r["file_b"]) for r in got} == set(want) and len(got) == len(want)
        assert all(r["current_distance"] == pytest.approx(want[r["file_a"], r["file_b"]]) for r in got)
        counts = {r["severity"]: r["drifts"] for r in drift.semantic_counts(p, block=block, pivots=12).collect()}
        assert counts == {s: sum(r["severity"] == s for r in got) for s in {r["severity"] for r in got}}
    placed, ball = drift.balls(p, 4, 12)
    pairs = drift.ball_pairs(ball).collect()
    assert sum(r["pairs"] for r in pairs) == sum(n * (n - 1) // 2 for n in (sum(r[2] == k for r in rows) for k in ("api", "db")))
    skipped = sum(r["most"] <= drift.SEMANTIC for r in pairs)
    surely = sum(r["least"] > drift.SEMANTIC + 0.3 for r in pairs)
    assert skipped > len(pairs) / 10 and surely > len(pairs) / 10
    assert drift.semantic_drift(p.limit(0)).count() == 0 and drift.semantic_counts(p.limit(0)).count() == 0


def test_searches(spark):
    rows = [(i, f"/f{i}", "api", [float(i), 1.0], [1.0], [0.0], 10 * i) for i in range(6)]
    p = spark.createDataFrame(rows, "id bigint, file_path string, dominant_domain string, lexical array<double>, structural array<double>, semantic array<double>, line_count int")
    near = search.find_similar(p, "/f3", 2).collect()
    assert [r["file_path"] for r in near] == ["/f4", "/f2"] or [r["file_path"] for r in near] == ["/f4", "/f5"]
    last = search.find_by_criteria(p, similar_to="/f3").collect()[-1]
    assert last["file_path"] == "/f3" and last["distance"] is None
    assert search.export_3d(p.limit(1)).first()["x"] == 0


def test_principal_axes_equal_singular_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5)) * [3.0, 2.0, 1.0, 0.1, 0.1] + 100
    rows = [(i, f"/f{i}", "api", r[:2].tolist(), r[2:].tolist(), [], 1) for i, r in enumerate(x)]
    p = spark.createDataFrame(rows, "id bigint, file_path string, dominant_domain string, lexical array<double>, structural array<double>, semantic array<double>, line_count int").repartition(3)
    got = np.array([[r["x"], r["y"], r["z"]] for r in search.export_3d(p).orderBy("id").collect()])
    c = x - x.mean(0)
    _, _, axes = np.linalg.svd(c, full_matrices=False)
    axes = [a * np.sign(a[np.argmax(np.abs(a))]) for a in axes[:3]]
    assert np.allclose(got, c @ np.array(axes).T, atol=1e-8)
    assert search.export_3d(p.limit(0)).count() == 0


def test_paths_by_ending(spark):
    paths = ["/r/pkg/b.py", "/q/mypkg/b.py", "/z/pkg/sub/b.py", "/r/pkg/__init__.py", "b.py", "/a//b.py", "/r/ä/b.py"]
    asked = ["pkg/b.py", "mypkg/b.py", "g/b.py", "pkg/sub/b.py", "r/pkg/__init__.py", "no/b.py", "xpkg/b.py", "ä/b.py", "/b.py", "pkg//b.py"]
    got = contracts.by_ending(spark.createDataFrame([(a,) for a in asked * 2], "suffix string"), spark.createDataFrame([(x,) for x in paths], "callee string"))
    want = {a: min(x for x in paths if x.endswith(a)) for a in asked if any(x.endswith(a) for x in paths)}
    assert {r["suffix"]: r["callee"] for r in got.collect()} == want and got.count() == len(want)


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "x.py").write_text("x = 1")
    (tmp_path / "a" / "y.txt").write_text("no")
    (tmp_path / "node_modules" / "z.js").write_text("no")
    (tmp_path / ".orrery.json").write_text('{"domains": {"d": ["k"]}}')
    got = src.directory(spark, str(tmp_path)).collect()
    assert [(r["file_path"], r["content"]) for r in got] == [(str(tmp_path / "a" / "x.py"), "x = 1")]
    assert src.domain_config(str(tmp_path / "a")) == {"d": ["k"]}
    assert src.by_suffix(spark.createDataFrame([("/a/b",), ("/b",)], "file_path string"), "/b").first()[0] == "/b"
    assert "<table" in views.page("t", {"rows": spark.range(2)}) or "createElement" in views.page("t", {"rows": spark.range(2)})
