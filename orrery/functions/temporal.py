"""Temporal features of files from a table of commits (file_path, hash, ts, author)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as tx

NAMES = ["file_age", "change_frequency", "author_diversity", "days_since_change", "stability_score"]
#: Of a file without history.
NO_HISTORY = [0.0, 0.0, 0.0, 0.0, 1.0]


def _days(now: Column, ts: Column) -> Column:
    """Whole days that have passed."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400)


def features(commits: DataFrame, now: Column) -> DataFrame:
    """file_path and the five features. One aggregation; authors are counted exactly."""
    ts = F.col("ts").cast("timestamp")
    found = commits.groupBy("file_path").agg(
        F.min(ts).alias("first"),
        F.max(ts).alias("last"),
        F.count_if(ts >= now - F.expr("INTERVAL 90 DAYS")).alias("recent"),
        F.count_distinct("author").alias("authors"),
    )
    often = F.least(F.col("recent") / 30.0, F.lit(1.0))
    return found.select(
        "file_path",
        F.least(_days(now, F.col("first")) / 365.0, F.lit(1.0)).alias("file_age"),
        often.alias("change_frequency"),
        F.least(F.col("authors") / 10.0, F.lit(1.0)).alias("author_diversity"),
        F.greatest(F.lit(0.0), 1.0 - _days(now, F.col("last")) / 90.0).alias("days_since_change"),
        (1.0 - often).alias("stability_score"),
    )


def with_features(files: DataFrame, commits: DataFrame, now: Column) -> DataFrame:
    """`files` (with file_path) with the features; defaults where a file has no history."""
    joined = files.join(features(commits, now), "file_path", "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in zip(NAMES, NO_HISTORY, strict=True)})


def hot_files(temporal: DataFrame, at_least: float = 0.5) -> DataFrame:
    return temporal.where(F.col("change_frequency") >= at_least).orderBy(F.desc("change_frequency"), "file_path")


def stale_files(temporal: DataFrame, at_most: float = 0.2) -> DataFrame:
    return temporal.where(F.col("days_since_change") <= at_most).orderBy("days_since_change", "file_path")


def interpretation() -> Column:
    """The limits that a file's history passes."""
    rules = [
        tx.beyond("change_frequency", F.col("change_frequency"), over=0.5),
        tx.beyond("days_since_change", F.col("days_since_change"), under=0.2),
        tx.beyond("author_diversity", F.col("author_diversity"), over=0.5),
        tx.beyond("stability_score", F.col("stability_score"), over=0.8),
    ]
    return tx.notes(rules, "no limit passed")
