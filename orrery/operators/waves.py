"""Waves of change: how far a change of a file reaches its dependents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.store import kept

#: Share that passes a hop, share that passes between domains, and the least that spreads on.
ATTENUATION, OTHER_DOMAIN, LEAST = 0.6, 0.5, 0.05


def simulate(nodes: DataFrame, edges: DataFrame, sources: DataFrame, intensity: float = 1.0, attenuation: float = ATTENUATION) -> DataFrame:
    """(source, id, distance, wave_intensity, reached_via, is_boundary, domain) of each file that a wave reaches.

    nodes: (id, domain); edges: (src, dst), src depends on dst; sources: (id). All waves run at once, a
    hop a turn. Among several parents the strongest wave counts, then the smallest id. A file is a
    boundary if its wave is too weak to spread, or if nothing depends on it.
    """
    attenuation = attenuation or ATTENUATION
    callers = edges.select(F.col("dst").alias("at"), F.col("src").alias("next")).distinct()
    kinds = nodes.select("id", "domain")
    front = sources.join(kinds, "id").select(F.col("id").alias("source"), "id", F.lit(0).alias("distance"), F.lit(float(intensity)).alias("wave_intensity"), F.array("id").alias("reached_via"), "domain")
    front = kept(front, "wave")
    levels, seen = [], front.select("source", "id")
    while True:
        strong = front.where(F.col("wave_intensity") >= LEAST)
        step = strong.join(callers, F.col("id") == F.col("at")).select("source", F.col("next").alias("id"), F.col("id").alias("parent"), "distance", "wave_intensity", "reached_via", F.col("domain").alias("from_domain"))
        step = step.join(kinds, "id")
        passed = F.col("wave_intensity") * F.lit(attenuation) * F.when(F.col("domain") != F.col("from_domain"), F.lit(OTHER_DOMAIN)).otherwise(F.lit(1.0))
        step = step.withColumn("i", passed).join(seen, ["source", "id"], "left_anti")
        best = step.groupBy("source", "id", "domain").agg(F.min_by(F.struct("i", "distance", "reached_via"), F.struct(-F.col("i"), F.col("parent"))).alias("b"))
        front = best.select("source", "id", (F.col("b.distance") + 1).alias("distance"), F.col("b.i").alias("wave_intensity"), F.concat("b.reached_via", F.array("id")).alias("reached_via"), "domain")
        front = kept(front, "wave")
        if front.isEmpty():
            break
        levels.append(front)
        seen = kept(seen.unionByName(front.select("source", "id")), "seen")
    if not levels:
        levels = [front]
    reached = levels[0]
    for level in levels[1:]:
        reached = reached.unionByName(level)
    used = callers.select(F.col("at").alias("id")).distinct().withColumn("_used", F.lit(True))
    out = reached.join(used, "id", "left")
    return out.select("source", "id", "distance", "wave_intensity", "reached_via", ((F.col("wave_intensity") < LEAST) | F.col("_used").isNull()).alias("is_boundary"), "domain")


def review_order(wave: DataFrame, limit: int | None = None) -> DataFrame:
    """The files of each wave, strongest first, with their rank."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("wave_intensity"), "distance", "id"))
    out = wave.withColumn("priority", rank)
    return out if limit is None else out.where(F.col("priority") <= limit)


def combined(wave: DataFrame) -> DataFrame:
    """Over all waves: the strongest intensity, least distance and number of waves of each file."""
    return wave.groupBy("id").agg(F.max("wave_intensity").alias("max_intensity"), F.min("distance").alias("min_distance"), F.count_distinct("source").alias("n_waves"))


def predict(wave: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each source: files reached, strong and middling ones, depth, risk and advice."""
    i = F.col("wave_intensity")
    agg = wave.groupBy("source").agg(
        F.count("*").alias("total_affected"),
        F.count_if(i > 0.5).alias("high_impact_files"),
        F.count_if((i > 0.2) & (i <= 0.5)).alias("medium_impact_files"),
        F.max("distance").alias("max_depth"),
        F.count_if("is_boundary").alias("boundaries"),
    )
    rows = sources.select(F.col("id").alias("source")).join(agg, "source", "left").na.fill(0)
    n, high = F.col("total_affected"), F.col("high_impact_files")
    risk = F.when((high > 5) | (n > 10), F.lit("high")).when((high > 2) | (n > 5), F.lit("medium")).otherwise(F.lit("low"))
    advice = {"high": "Split the change into smaller ones", "medium": "Ask for another review of the files it reaches", "low": "The usual review will do"}
    return rows.select("*", risk.alias("risk_level"), F.create_map(*[F.lit(x) for p in advice.items() for x in p])[risk].alias("recommendation"))
