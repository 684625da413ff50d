"""Clusters of code points: k-means over padded positions, and what the clusters say.

Centroids are k vectors on the driver; points stay in the cluster. A turn is one pass for all numbers of clusters that
still move: tasks get the centroids as data, multiply Arrow batches and give a sum for each cluster, and the sums return.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as tx
from orrery.functions import vectors as v
from orrery.operators.index import position
from orrery.plans.store import kept

TURNS, TOLERANCE, ELBOW_TURNS, BLOCK = 100, 1e-4, 50, 512
#: 1-based place of the complexity estimate in a position.
COMPLEXITY = 72


def matrix(points: DataFrame) -> DataFrame:
    """id, file_path, dominant_domain and `p`: positions padded to the widest."""
    rows = points.select("id", "file_path", "dominant_domain", position().alias("p"))
    wide = rows.agg(F.coalesce(F.max(F.size("p")), F.lit(0))).first()[0]
    return kept(rows.withColumn("p", v.padded(F.col("p"), F.lit(wide))), "points")


def _array(x: np.ndarray) -> Column:
    return F.array(*[F.lit(float(a)) for a in x])


def _distances(centroids: np.ndarray, p: Column) -> Column:
    return F.array(*[v.euclidean(p, _array(c)) for c in centroids])


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`rows` with cluster (the first nearest centroid), distance, and distances to all."""
    d = rows.withColumn("distances", _distances(centroids, F.col("p")))
    return d.select("*", (F.array_position("distances", F.array_min("distances")) - 1).cast("int").alias("cluster"), F.array_min("distances").alias("distance"))


def _vectors(batch: pa.RecordBatch, wide: int) -> np.ndarray:
    return batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centroids."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def farthest_first(rows: DataFrame, k: int) -> np.ndarray:
    """Centres by turns: the point of the least id, then always the point farthest from those there are (the least id of such).

    Each task gives its own farthest point, so a turn is a pass and a choice among as many rows as there are tasks. The first
    centres don't depend on `k`.
    """
    first = rows.orderBy("id").limit(1).select("p").first()
    if first is None:
        return np.zeros((0, 0))
    centres = [np.array(first["p"])]
    kind = dict(rows.dtypes)["id"]
    while len(centres) < k:
        there = np.array(centres)

        def farthest(batches, there=there):
            best = None
            for b in batches:
                if not b.num_rows:
                    continue
                d = _squares(_vectors(b, there.shape[1]), there).min(axis=1)
                ids = b.column("id").to_pylist()
                at = min(np.flatnonzero(d == d.max()), key=lambda i: ids[i])
                if best is None or (-d[at], ids[at]) < best[0]:
                    best = (-d[at], ids[at]), b.slice(at, 1), d[at]
            if best is not None:
                yield pa.RecordBatch.from_arrays([*best[1].columns, pa.array([best[2]])], ["id", "p", "d"])

        far = rows.select("id", "p").mapInArrow(farthest, f"id {kind}, p array<double>, d double").orderBy(F.desc("d"), "id").limit(1).first()
        centres.append(np.array(far["p"]))
    return np.array(centres)


def turn(rows: DataFrame, sets: dict[int, np.ndarray]) -> DataFrame:
    """(k, cluster, size, inertia, total) for each set of centroids: points by their first nearest one, in one pass over `rows`.

    A cluster without points has no row. Tasks add up their batches, so what is shuffled is a row a task and centroid.
    """

    def sums(batches):
        got = {k: [np.zeros(len(c)), np.zeros(len(c)), np.zeros_like(c)] for k, c in sets.items()}
        for b in batches:
            for k, c in sets.items():
                x = _vectors(b, c.shape[1])
                d = _squares(x, c)
                near = d.argmin(axis=1)
                n, s, t = got[k]
                n += np.bincount(near, minlength=len(c))
                s += np.bincount(near, d.min(axis=1), len(c))
                np.add.at(t, near, x)
        out = [(k, i, n[i], s[i], t[i]) for k, (n, s, t) in got.items() for i in range(len(n)) if n[i]]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["k", "cluster", "n", "s", "t"])

    part = rows.select("p").mapInArrow(sums, "k int, cluster int, n double, s double, t array<double>")
    return part.groupBy("k", "cluster").agg(F.sum("n").cast("long").alias("size"), F.sum("s").alias("inertia"), Summarizer.sum(array_to_vector("t")).alias("total"))


def kmeans_each(rows: DataFrame, ks: list[int], turns: int = TURNS, tolerance: float = TOLERANCE) -> dict[int, tuple[np.ndarray, float]]:
    """Centroids and inertia for each number of clusters, all in the same turns. A cluster that loses all its points keeps its centroid."""
    seeds = farthest_first(rows, max(ks))
    now = {k: seeds[:k] for k in ks}
    inertia, moving = dict.fromkeys(ks, 0.0), list(ks)
    for _ in range(turns):
        got = turn(rows, {k: now[k] for k in moving}).collect()  # a row a centroid
        new = {k: now[k].copy() for k in moving}
        for r in got:
            new[r["k"]][r["cluster"]] = r["total"].toArray() / r["size"]
        for k in moving:
            inertia[k] = float(sum(r["inertia"] for r in got if r["k"] == k))
        still = [k for k in moving if np.linalg.norm(new[k] - now[k]) >= tolerance]
        now.update(new)
        moving = still
        if not moving:
            break
    return {k: (now[k], inertia[k]) for k in ks}


def kmeans(rows: DataFrame, k: int, turns: int = TURNS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Centroids and inertia."""
    return kmeans_each(rows, [k], turns, tolerance)[k]


def elbow(rows: DataFrame, n: int, most: int = 10, turns: int = ELBOW_TURNS) -> int:
    """The number of clusters at the sharpest bend of the inertia."""
    ks = list(range(2, min(most, n - 1) + 1))
    if len(ks) < 3:
        return 2
    each = kmeans_each(rows, ks, turns)
    return int(np.argmax(np.abs(np.diff([each[k][1] for k in ks], 2)))) + 2


def cluster(points: DataFrame, k: int | None = None, most: int = 10) -> tuple[DataFrame, np.ndarray]:
    """Assigned points and centroids; no row with fewer than three points."""
    rows = matrix(points)
    n = rows.count()
    if n < 3:
        return assigned(rows.limit(0), np.zeros((1, 1))), np.zeros((0, 0))
    k = elbow(rows, n, most) if k is None else k
    c, _ = kmeans(rows, max(2, min(k, n - 1)))
    return kept(assigned(rows, c), "clusters"), c


def summary(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """A row for each cluster: size, mean distance, dominant domain and its share, name, characteristics."""
    by = rows.groupBy("cluster", "dominant_domain").agg(F.count("*").alias("n"), F.sum("distance").alias("d"))
    agg = by.groupBy("cluster").agg(
        F.sum("n").alias("size"),
        (F.sum("d") / F.sum("n")).alias("avg_distance"),
        F.min_by("dominant_domain", F.struct(-F.col("n"), F.col("dominant_domain"))).alias("dominant_domain"),
        (F.max("n") / F.sum("n")).alias("share"),
        F.count("*").alias("domains"),
        F.array_sort(F.collect_list("dominant_domain")).alias("names"),
    )
    mixed = F.concat(F.col("names")[0], F.lit("/"), F.coalesce(F.get("names", F.lit(1)), F.lit("")), F.lit(" Mixed"))
    name = F.when(F.col("share") > 0.7, F.concat(F.upper("dominant_domain"), F.lit(" Cluster"))).when(F.col("domains") <= 2, mixed).otherwise(F.lit("General Cluster"))
    values = [float(c[COMPLEXITY - 1]) if len(c) >= COMPLEXITY else math.nan for c in centroids]
    at = F.array(*[F.lit(x) for x in values])[F.col("cluster")] if len(values) else F.lit(math.nan)
    note = F.when(~F.isnan(at) & (at > 0.5), F.lit("complex files")).when(~F.isnan(at) & (at < 0.2), F.lit("simple files"))
    return agg.select("cluster", "size", "avg_distance", "dominant_domain", "share", name.alias("name"), F.array_compact(F.array(note)).alias("characteristics"))


def outliers(rows: DataFrame, factor: float = 2.0) -> DataFrame:
    """Points farther from their centroid than the cluster's mean and `factor` deviations."""
    by = rows.groupBy("cluster").agg(F.avg("distance").alias("m"), F.stddev_pop("distance").alias("s"))
    far = rows.join(F.broadcast(by), "cluster").withColumn("threshold", F.col("m") + factor * F.col("s"))  # k rows
    return far.where(F.col("distance") > F.col("threshold")).select("id", tx.base_name(F.col("file_path")).alias("name"), "file_path", "cluster", "distance", "threshold")


def misclassified(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """Points with another centroid much nearer; the first such one."""
    near = F.filter(F.transform("distances", lambda d, i: F.struct(i.alias("i"), d.alias("d"))), lambda x: (x["d"] < F.col("distance") * share) & (x["i"] != F.col("cluster")))
    hit = rows.withColumn("o", F.get(near, F.lit(0))).where("o is not null")
    return hit.select("id", "file_path", F.col("cluster").alias("current_cluster"), F.col("o.i").alias("suggested_cluster"), F.col("distance").alias("current_distance"), F.col("o.d").alias("suggested_distance"))


#: Points of a block of the silhouette, and rows of it that are multiplied at once.
WIDE = 4096


def silhouette(rows: DataFrame, block: int = WIDE, with_self: bool = True) -> DataFrame:
    """(id, silhouette) by mean euclidean distances to each cluster; one's own mean counts oneself too unless told not to.

    Points are dealt to blocks; each two blocks meet once, for the sums of both, and are multiplied by BLOCK rows. A block goes to
    as many tasks as there are blocks, so what is shuffled falls with their size; no task holds all points.
    """
    import pandas as pd

    blocks = max(1, -(-rows.count() // block))
    dealt = rows.select("id", "cluster", "p", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    dealt = dealt.select("id", "cluster", "p", "b", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))
    kind = dict(rows.dtypes)["id"]

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        a, b = pdf[pdf["b"] == x], pdf[pdf["b"] == y]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": pdf["id"].iloc[:0], "other": np.zeros(0, np.int32), "s": np.zeros(0)})
        pa_, pb = np.stack(a["p"].to_numpy()), np.stack(b["p"].to_numpy())
        (ka, ca), (kb, cb) = (np.unique(t["cluster"], return_inverse=True) for t in (a, b))
        to_b, to_a = np.zeros((len(a), len(kb))), np.zeros((len(b), len(ka)))
        in_a, in_b = np.eye(len(ka))[ca], np.eye(len(kb))[cb]
        for i in range(0, len(a), BLOCK):
            q = pa_[i : i + BLOCK]
            d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (pb**2).sum(1)[None, :] - 2 * q @ pb.T, 0))
            to_b[i : i + BLOCK] = d @ in_b
            to_a += d.T @ in_a[i : i + BLOCK]
        found = [(a, kb, to_b)] if x == y else [(a, kb, to_b), (b, ka, to_a)]
        return pd.concat([pd.DataFrame({"id": np.repeat(t["id"].to_numpy(), len(k)), "other": np.tile(k, len(t)).astype(np.int32), "s": s.ravel()}) for t, k, s in found])

    got = dealt.groupBy("x", "y").applyInPandas(sums, f"id {kind}, other int, s double")
    got = got.groupBy("id", "other").agg(F.sum("s").alias("s"))
    size = rows.groupBy("cluster").agg(F.count("*").alias("k"))
    means = got.join(F.broadcast(size), F.col("other") == F.col("cluster")).select("id", "other", "s", "k").join(rows.select("id", "cluster"), "id")
    own = F.col("other") == F.col("cluster")
    a = F.max(F.when(own & (F.col("k") > 1), F.col("s") / (F.col("k") - (0 if with_self else 1))))
    b = F.min(F.when(~own, F.col("s") / F.col("k")))
    ab = means.groupBy("id").agg(F.coalesce(a, F.lit(0.0)).alias("a"), F.coalesce(b, F.lit(0.0)).alias("b"))
    most = F.greatest("a", "b")
    return ab.select("id", F.when(most > 0, (F.col("b") - F.col("a")) / most).otherwise(F.lit(0.0)).alias("silhouette"))


def matched(overlap: list[list[int]]) -> list[int]:
    """The column of each row in the matching of most overlap; of several such, the first in the order of columns.

    Shortest augmenting paths over whole numbers; the order is a part of each weight too small to outweigh an overlap of one.
    """
    k = len(overlap)
    unit = k**k
    cost = [[j * k ** (k - 1 - i) - overlap[i][j] * unit for j in range(k)] for i in range(k)]
    by_row, by_column, owner = [0] * k, [0] * k, [-1] * k
    for row in range(k):
        gap, before, seen = [None] * k, [-1] * k, set()
        here, column = row, -1
        while True:
            for j in set(range(k)) - seen:
                slack = cost[here][j] - by_row[here] - by_column[j]
                if gap[j] is None or slack < gap[j]:
                    gap[j], before[j] = slack, column
            nearest = min(set(range(k)) - seen, key=lambda j: gap[j])
            step = gap[nearest]
            by_row[row] += step
            for j in seen:
                by_row[owner[j]] += step
                by_column[j] -= step
            for j in set(range(k)) - seen:
                gap[j] -= step
            seen.add(nearest)
            column = nearest
            if owner[nearest] < 0:
                break
            here = owner[nearest]
        while column >= 0:
            last = before[column]
            owner[column] = owner[last] if last >= 0 else row
            column = last
    out = [0] * k
    for j, i in enumerate(owner):
        out[i] = j
    return out


def cluster_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, was, now, expected, drifted) for the points in both clusterings (id, cluster).

    Clusters of the two are matched by their common points; `expected` is the match of a point's old cluster, so a new numbering
    alone is no drift. One join on id; the driver sees the table of overlaps, a row for each pair of clusters.
    """
    both = kept(before.select("id", F.col("cluster").alias("was")).join(after.select("id", F.col("cluster").alias("now")), "id"), "clusterings")
    table = both.groupBy("was", "now").count().collect()
    k = 1 + max([max(r["was"], r["now"]) for r in table], default=0)
    overlap = [[0] * k for _ in range(k)]
    for r in table:
        overlap[r["was"]][r["now"]] = r["count"]
    expected = F.get(F.lit(matched(overlap)).cast("array<int>"), F.col("was"))
    return both.select("id", "was", "now", expected.alias("expected"), (expected != F.col("now")).alias("drifted"))
