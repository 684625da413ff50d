"""Code points: a row for each file with its feature vectors; upserts and pruning.

A code point has id, file_path, function_name, lexical, structural, semantic (array<double>),
content_hash, line_count, dominant_domain, created_at, updated_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import lexical, semantic, structural
from orrery.functions import text as tx


def point_id(path: Column, function: Column | None = None) -> Column:
    key = path if function is None else F.when(function.isNull(), path).otherwise(F.concat_ws("::", path, function))
    return F.substring(F.md5(key), 1, 12)


def pair_id(a: Column, b: Column) -> Column:
    """Of contracts (caller, callee), deltas (point, time) and tensions (contract, delta)."""
    return F.substring(F.md5(F.concat(a, F.lit(":"), b)), 1, 12)


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def position(p: str = "") -> Column:
    c = lambda n: F.col(f"{p}.{n}" if p else n)
    return F.concat(c("lexical"), c("structural"), c("semantic"))


def code_points(files: DataFrame, now: Column, domains: dict[str, list[str]] | None = None, id_: Column | None = None) -> DataFrame:
    """Points of `files` (file_path, content): one projection, no shuffle. `now` may be of their columns, and so may `id_`, where they have the point's id."""
    content = F.col("content")
    vectors = files.select(
        (point_id(F.col("file_path")) if id_ is None else id_).alias("id"),
        "file_path",
        F.lit(None).cast("string").alias("function_name"),
        lexical.features(content).alias("lexical"),
        structural.features(content).alias("structural"),
        semantic.features(content, domains).alias("semantic"),
        content_hash(content).alias("content_hash"),
        F.size(tx.lines(content)).alias("line_count"),
        now.alias("created_at"),
    )
    dominant = semantic.dominant_domain(F.col("semantic"), domains).alias("dominant_domain")
    return vectors.select(*[c for c in vectors.columns if c != "created_at"], dominant, "created_at", F.col("created_at").alias("updated_at"))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """`old` with the rows of `new` in place of those of equal keys; created_at is kept."""
    born = old.select(*keys, F.col("created_at").alias("_born"))
    fresh = new.join(born, list(keys), "left").withColumn("created_at", F.coalesce("_born", "created_at")).drop("_born")
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(fresh.select(*old.columns))


def stale(points: DataFrame, present: DataFrame) -> DataFrame:
    """Points of which the file isn't in `present` (file_path)."""
    return points.join(present.select("file_path").distinct(), "file_path", "left_anti")


def prune(points: DataFrame, contracts: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points whose file exists, and contracts of which both ends remain."""
    kept = points.join(present.select("file_path").distinct(), "file_path", "left_semi")
    return kept, cascade(contracts, kept)


def cascade(contracts: DataFrame, points: DataFrame) -> DataFrame:
    ids = points.select("id")
    for end in ("caller_id", "callee_id"):
        contracts = contracts.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return contracts


def statistics(points: DataFrame) -> DataFrame:
    """A row for each domain, with the totals of all."""
    by = points.groupBy("dominant_domain").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))
    all_ = points.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"))
    return by.crossJoin(F.broadcast(all_))  # one row
