"""Drift: files of a domain that part, contracts that left their baseline, dependents that went stale."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import temporal as tm
from orrery.functions import vectors as v
from orrery.operators import blocks
from orrery.operators.changes import deviation
from orrery.operators.contracts import with_paths, with_positions
from orrery.operators.smells import rank
from orrery.plans.store import kept

#: Limits of the three kinds.
SEMANTIC, CONTRACT, RECENT, STALE = 0.4, 0.3, 0.7, 0.3
#: Amounts above which drift within a domain is of the next severity.
GRAVER = {"medium": 0.15, "high": 0.3}
#: Points of a block of the pairwise product, pivots of a domain at most, and what bounds of angles are widened by.
BLOCK, PIVOTS, SLACK = 512, 64, 1e-6


def _rows(rows: DataFrame, kind: str, severity: Column, current: Column, expected: Column, amount: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("drift_type"), severity.alias("severity"), "file_a", "file_b", current.alias("current_distance"), expected.alias("expected_distance"), amount.alias("drift_amount"))


def balls(points: DataFrame, block: int = BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Unit vectors in blocks about pivots, and the blocks' balls.

    The first table has (dominant_domain, file_path, u, b), the second (dominant_domain, b, centre, radius, n). A domain's pivots
    are `pivots` of its points, by a hash, or as many as it fills blocks, if fewer: what is broadcast has a bound, and blocks aren't all but empty. A point goes to its nearest pivot, and a pivot's points to
    as many blocks of some `block` points as they need. Vectors of zeros have no direction: blocks of their own, without a centre.
    """
    import numpy as np

    unit = points.select("dominant_domain", "file_path", v.normalised(F.concat("lexical", "structural")).alias("u"))
    some = Window.partitionBy("dominant_domain").orderBy(F.xxhash64("file_path"), "file_path")
    full = points.groupBy("dominant_domain").agg(F.ceil(F.count("*") / block).alias("full"))
    chosen = unit.where(v.norm(F.col("u")) > 0).withColumn("k", F.row_number().over(some)).where(F.col("k") <= pivots)  # `pivots` a domain
    chosen = chosen.join(full, "dominant_domain").where(F.col("k") <= F.col("full")).select("dominant_domain", "file_path", "u", "k").collect()
    centres: dict[str, list] = {}
    for r in sorted(chosen, key=lambda r: r["k"]):
        centres.setdefault(r["dominant_domain"], []).append(r["u"])

    def nearest(frames):
        for pdf in frames:
            cell, angle = np.full(len(pdf), -1), np.zeros(len(pdf))
            for domain, at in pdf.groupby("dominant_domain", dropna=False).indices.items():
                if domain not in centres:
                    continue
                u = np.stack(pdf["u"].to_numpy()[at])
                close = u @ np.array(centres[domain]).T
                best = close.argmax(axis=1)
                some = (u**2).sum(axis=1) > 0
                cell[at[some]] = best[some]
                angle[at] = np.arccos(np.clip(close[np.arange(len(at)), best], -1, 1))
            yield pdf.assign(cell=cell.astype(np.int64), angle=angle)

    placed = kept(unit.where("dominant_domain is not null").mapInPandas(nearest, "dominant_domain string, file_path string, u array<double>, cell long, angle double"), "cells")
    size = placed.groupBy("dominant_domain", "cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = placed.join(size, ["dominant_domain", "cell"]).withColumn("b", F.shiftleft("cell", 32) + F.pmod(F.xxhash64("file_path"), F.col("blocks")))
    placed = kept(placed.select("dominant_domain", "file_path", "u", "cell", "angle", "b"), "blocks")
    about = points.sparkSession.createDataFrame([(d, i, c) for d, cs in centres.items() for i, c in enumerate(cs)], "dominant_domain string, cell long, centre array<double>")
    ball = placed.groupBy("dominant_domain", "cell", "b").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).join(F.broadcast(about), ["dominant_domain", "cell"], "left")
    return placed.select("dominant_domain", "file_path", "u", "b"), kept(ball.select("dominant_domain", "b", "centre", "radius", "n"), "balls")


def ball_pairs(ball: DataFrame) -> DataFrame:
    """(dominant_domain, x, y, pairs, least, most): each two blocks of a domain, x <= y, their pairs of points and bounds of these' cosine distance.

    Angles between unit vectors are a metric: two points are as far apart as the centres, give or take both radii. A vector of zeros is 1 from all.
    """
    salts = int(ball.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # one domain may have most blocks
    a = ball.select("dominant_domain", F.col("b").alias("x"), F.col("centre").alias("cx"), F.col("radius").alias("rx"), F.col("n").alias("nx"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    b = ball.select("dominant_domain", F.col("b").alias("y"), F.col("centre").alias("cy"), F.col("radius").alias("ry"), F.col("n").alias("ny"), F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int").alias("salt"))
    both = a.join(b, ["dominant_domain", "salt"]).where("x <= y")
    apart = F.when(F.col("x") == F.col("y"), F.lit(0.0)).otherwise(F.acos(F.greatest(F.least(v.dot(F.col("cx"), F.col("cy")), F.lit(1.0)), F.lit(-1.0))))
    wide = F.col("rx") + F.col("ry") + SLACK
    known = F.col("cx").isNotNull() & F.col("cy").isNotNull()
    bound = lambda angle: F.when(known, 1 - F.cos(F.greatest(F.least(angle, F.lit(math.pi)), F.lit(0.0)))).otherwise(F.lit(1.0))
    pairs = F.when(F.col("x") == F.col("y"), F.expr("nx * (nx - 1) div 2")).otherwise(F.col("nx") * F.col("ny"))
    return both.select("dominant_domain", "x", "y", pairs.alias("pairs"), bound(apart - wide).alias("least"), bound(apart + wide).alias("most"))


def _opened(placed: DataFrame, pairs: DataFrame, work, schema: str) -> DataFrame:
    """`work(left, right, distances, same)` for the paths of two blocks of `pairs` at a time: blocks meet as a product, and no point is copied through a shuffle."""
    whole = blocks.gathered(placed, "dominant_domain", "b")
    partners = pairs.groupBy("dominant_domain", F.col("x").alias("b")).agg(F.collect_list("y").alias("ys"))
    left = whole.join(partners, ["dominant_domain", "b"]).select(F.col("dominant_domain").alias("dx"), F.col("b").alias("x"), "ys", F.col("rows").alias("l"))
    right = whole.select(F.col("dominant_domain").alias("dy"), F.col("b").alias("y"), F.col("rows").alias("r"))
    both = blocks.met(left, right, (F.xxhash64("dx", "x"), F.xxhash64("dy", "y")), whole.count(), (F.col("dx") == F.col("dy")) & F.array_contains("ys", F.col("y")))

    def product(batches):
        for batch in batches:
            for x, y, left, right in zip(batch["x"], batch["y"], batch["l"], batch["r"], strict=True):
                a, b = blocks.columns(left), blocks.columns(right)
                yield work(a["file_path"], b["file_path"], 1.0 - blocks.vectors(a["u"]) @ blocks.vectors(b["u"]).T, x == y)

    return both.select("x", "y", "l", "r").mapInArrow(product, schema)


def _graveness(amount: Column) -> Column:
    return F.when(amount > GRAVER["high"], F.lit("high")).when(amount > GRAVER["medium"], F.lit("medium")).otherwise(F.lit("low"))


def semantic_drift(points: DataFrame, limit: float = SEMANTIC, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Pairs of one domain whose lexical and structural vectors are more than `limit` apart.

    Two blocks of points are multiplied as matrices unless their balls say that no pair of them is that far apart. Points
    without a domain pair with none; paths are taken to be unique.
    """
    import numpy as np
    import pyarrow as pa

    placed, ball = balls(points, block, pivots)

    def far(left, right, d, same):
        i, j = np.nonzero(np.triu(d > limit, 1) if same else d > limit)
        paths = pa.concat_arrays([left, right])
        rank = np.empty(len(paths), np.int64)
        rank[np.argsort(paths.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(paths))
        at = np.stack([i, len(left) + j])
        swap = rank[at[0]] > rank[at[1]]
        a, b = (paths.take(pa.array(np.where(swap, *ends))) for ends in (at[::-1], at))
        return pa.RecordBatch.from_arrays([a, b, pa.array(d[i, j])], ["file_a", "file_b", "d"])

    found = _opened(placed, ball_pairs(ball).where(F.col("most") > limit), far, "file_a string, file_b string, d double")
    amount = F.col("d") - limit
    return _rows(found, "semantic", _graveness(amount), F.col("d"), F.lit(limit), amount)


def semantic_counts(points: DataFrame, limit: float = SEMANTIC, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(drift_type, severity, drifts) of semantic_drift() without its pairs.

    Two blocks whose bounds lie within one severity count as a product of sizes; the others are opened and counted in their task.
    """
    import numpy as np
    import pyarrow as pa

    placed, ball = balls(points, block, pivots)
    pairs = kept(ball_pairs(ball).where(F.col("most") > limit), "pairs")
    between = [limit, *(limit + a for a in GRAVER.values())]
    open_ = reduce(lambda a, b: a | b, [(F.col("least") <= e + SLACK) & (F.col("most") > e - SLACK) for e in between])
    whole = pairs.where(~open_).select(_graveness(F.col("least") - limit).alias("severity"), F.col("pairs").alias("drifts"))

    def counted(left, right, d, same):
        amount = d - limit
        keep = np.triu(d > limit, 1) if same else d > limit
        high, medium = amount > GRAVER["high"], amount > GRAVER["medium"]
        n = [int((keep & high).sum()), int((keep & medium & ~high).sum()), int((keep & ~medium).sum())]
        return pa.RecordBatch.from_pydict({"severity": ["high", "medium", "low"], "drifts": n})

    some = _opened(placed, pairs.where(open_), counted, "severity string, drifts long")
    total = whole.unionByName(some).groupBy("severity").agg(F.sum("drifts").alias("drifts")).where("drifts > 0")
    return total.select(F.lit("semantic").alias("drift_type"), "severity", "drifts")


def contract_drift(contracts: DataFrame, points: DataFrame, limit: float = CONTRACT, metric: str = "mixed") -> DataFrame:
    rows = with_positions(contracts, points)
    now = v.distance(*v.aligned(F.col("caller_pos"), F.col("callee_pos")), "cosine" if metric == "mixed" else "euclidean")
    rows = rows.select(F.col("caller_path").alias("file_a"), F.col("callee_path").alias("file_b"), "baseline_distance", now.alias("now"))
    amount = deviation(F.col("now"), F.col("baseline_distance"))
    rows = rows.withColumn("amount", F.when(F.col("baseline_distance") > 0, amount).otherwise(F.col("now"))).where(F.col("amount") > limit)
    a = F.col("amount")
    return _rows(rows, "contract", F.when(a > 0.5, F.lit("high")).when(a > 0.35, F.lit("medium")).otherwise(F.lit("low")), F.col("now"), F.col("baseline_distance"), a)


def temporal_drift(contracts: DataFrame, points: DataFrame, commits: DataFrame, now: Column) -> DataFrame:
    """Contracts whose callee changed of late while the caller is stale."""
    recent = tm.with_features(points.select("file_path"), commits, now).select("file_path", F.col("days_since_change").alias("r"))
    ends = with_paths(contracts, points)
    rows = ends.join(recent.select(F.col("file_path").alias("caller_path"), F.col("r").alias("ra")), "caller_path")
    rows = rows.join(recent.select(F.col("file_path").alias("callee_path"), F.col("r").alias("rb")), "callee_path").where((F.col("rb") > RECENT) & (F.col("ra") < STALE))
    rows = rows.select(F.col("caller_path").alias("file_a"), F.col("callee_path").alias("file_b"), (F.col("rb") - F.col("ra")).alias("amount"))
    return _rows(rows, "temporal", F.lit("medium"), F.col("amount"), F.lit(0.0), F.col("amount"))


def detect(contracts: DataFrame, points: DataFrame, commits: DataFrame, now: Column) -> DataFrame:
    """All three kinds."""
    return semantic_drift(points).unionByName(contract_drift(contracts, points)).unionByName(temporal_drift(contracts, points, commits, now))


def top(drifts: DataFrame, limit: int = 30) -> DataFrame:
    return drifts.orderBy(rank(F.col("severity")), "drift_type", "file_a", "file_b").limit(limit)


def counts(contracts: DataFrame, points: DataFrame, commits: DataFrame, now: Column) -> DataFrame:
    """summary() of detect(), without listing the pairs of a domain."""
    listed = contract_drift(contracts, points).unionByName(temporal_drift(contracts, points, commits, now))
    return summary(listed).unionByName(semantic_counts(points))


def summary(drifts: DataFrame) -> DataFrame:
    return drifts.groupBy("drift_type", "severity").agg(F.count("*").alias("drifts"))


