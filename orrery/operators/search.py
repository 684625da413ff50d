"""Searches over code points: lookups, nearest neighbours, filters, comparison, exports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text as tx
from orrery.functions import vectors as v
from orrery.operators.index import position

AXES = ("lexical", "structural", "semantic")


def get_position(points: DataFrame, path: str) -> DataFrame:
    return points.where(F.col("file_path") == path).select("id", "file_path", "dominant_domain", "content_hash", *AXES)


def _against(points: DataFrame, path: str) -> DataFrame:
    """All points beside the one of `path` (file_path is unique, so one row is broadcast)."""
    ref = points.where(F.col("file_path") == path).limit(1)
    ref = ref.select(F.col("file_path").alias("_path"), *[F.col(a).alias(f"_{a}") for a in AXES])
    return points.crossJoin(F.broadcast(ref))


def _pair(axis: str | None) -> tuple[Column, Column]:
    if axis is None:
        return position(), F.concat(*[F.col(f"_{a}") for a in AXES])
    if axis not in AXES:
        raise ValueError(f"unknown axis: {axis}")
    return F.col(axis), F.col(f"_{axis}")


def find_similar(points: DataFrame, path: str, limit: int = 5, axis: str | None = None, method: str = "cosine") -> DataFrame:
    """The nearest other points by distance in an axis, or in all; similarity is always of whole positions."""
    rows = _against(points, path).where(F.col("file_path") != F.col("_path"))
    whole = v.cosine_similarity(*v.aligned(*_pair(None)))
    found = rows.select("id", "file_path", "dominant_domain", v.distance(*v.aligned(*_pair(axis)), method).alias("distance"), whole.alias("similarity"))
    return found.orderBy("distance", "file_path").limit(limit)


def search_by_domain(points: DataFrame, domain: str, limit: int = 10) -> DataFrame:
    return points.where(F.col("dominant_domain") == domain).orderBy(F.desc("created_at"), "file_path").limit(limit).select("id", "file_path", "line_count", "created_at")


def list_points(points: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return points.orderBy(F.desc("created_at"), "file_path").offset(offset).limit(limit).select("id", "file_path", "dominant_domain", "line_count", "created_at")


def find_by_criteria(points: DataFrame, domain: str | None = None, min_lines: int = 0, max_lines: int = 0, similar_to: str | None = None, limit: int = 20) -> DataFrame:
    """Points that meet all criteria that are set (0 and None are unset): nearest first, else longest first.

    The point of `similar_to` itself has no distance and comes last.
    """
    rows = points if similar_to is None else _against(points, similar_to)
    if domain:
        rows = rows.where(F.col("dominant_domain") == domain)
    if min_lines:
        rows = rows.where(F.col("line_count") >= min_lines)
    if max_lines:
        rows = rows.where(F.col("line_count") <= max_lines)
    distance = F.lit(None).cast("double")
    if similar_to is not None:
        distance = F.when(F.col("file_path") != F.col("_path"), v.cosine_distance(*v.aligned(*_pair(None))))
    out = rows.select("id", "file_path", "dominant_domain", "line_count", distance.alias("distance"))
    order = [F.desc("line_count")] if similar_to is None else [F.col("distance").asc_nulls_last()]
    return out.orderBy(*order, "file_path").limit(limit)


def compare(points: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row: distances in all axes, similarity, the axes that differ most and least, insights."""
    a = points.where(F.col("file_path") == path_a).limit(1).select(F.col("file_path").alias("file_a"), *[F.col(x).alias(f"a_{x}") for x in AXES])
    b = points.where(F.col("file_path") == path_b).limit(1).select(F.col("file_path").alias("file_b"), *[F.col(x).alias(f"b_{x}") for x in AXES])
    whole = v.aligned(F.concat(*[F.col(f"a_{x}") for x in AXES]), F.concat(*[F.col(f"b_{x}") for x in AXES]))
    row = a.crossJoin(F.broadcast(b)).select(
        "file_a",
        "file_b",
        v.cosine_distance(*whole).alias("total_distance"),
        v.cosine_similarity(*whole).alias("similarity"),
        *[v.cosine_distance(*v.aligned(F.col(f"a_{x}"), F.col(f"b_{x}"))).alias(f"{x}_distance") for x in AXES],
    )
    d = F.array(*[F.col(f"{x}_distance") for x in AXES])
    names = F.array(*[F.lit(x) for x in AXES])
    at = lambda f: F.element_at(names, F.array_position(d, f(d)).cast("int"))
    limits = {"lexical": (0.5, 1.5), "structural": (0.3, 0.8), "semantic": (0.2, 0.5)}
    insights = F.array_compact(F.array(*[tx.beyond(f"{x} distance", F.col(f"{x}_distance"), under=low, over=high) for x, (low, high) in limits.items()]))
    return row.select("*", at(F.array_max).alias("most_different_axis"), at(F.array_min).alias("most_similar_axis"), insights.alias("insights"))


def export_positions(points: DataFrame, features: bool = False) -> DataFrame:
    """A row for each point with the mean of each axis, for JSON or CSV."""
    rest = list(AXES) if features else []
    means = [v.mean(F.col(a)).alias(f"{a}_mean") for a in AXES]
    return points.select("id", tx.base_name(F.col("file_path")).alias("name"), F.col("file_path").alias("path"), F.col("dominant_domain").alias("domain"), F.col("line_count").alias("lines"), *means, *rest)


def moments(vectors: DataFrame, column: str) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, mean and covariance of a column of arrays, all as wide as the widest (zeros are appended).

    Each task multiplies its Arrow batches as matrices, about one vector for all, and gives the rows of one small
    matrix; the rows' sums are an ordinary aggregation, so the driver gets a row for each place of a vector, whatever the input's size.
    """
    wide = vectors.agg(F.max(F.size(column))).first()[0] or 0
    origin = vectors.select(v.padded(F.col(column), F.lit(wide)).alias("p")).limit(1).first()
    if origin is None or not wide:
        return 0.0, np.zeros(0), np.zeros((0, 0))
    origin = np.array(origin["p"])

    def products(batches):
        total = np.zeros((wide + 1, wide + 1))
        for b in batches:
            flat, starts = b.column(0).flatten().to_numpy(zero_copy_only=False), b.column(0).value_lengths().to_numpy(zero_copy_only=False)
            ones = np.ones((len(starts), wide + 1))
            inside = np.arange(wide) < starts[:, None]
            ones[:, 1:] = 0.0
            ones[:, 1:][inside] = flat
            ones[:, 1:] -= origin
            total += ones.T @ ones
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(wide + 1), pa.int32()), "row": pa.array(list(total))})

    rows = vectors.select(column).where(F.col(column).isNotNull()).mapInArrow(products, "place int, row array<double>")
    got = rows.groupBy("place").agg(Summarizer.sum(array_to_vector("row")).alias("s")).collect()  # a row for each place
    g = np.zeros((wide + 1, wide + 1))
    for r in got:
        g[r["place"]] = r["s"].toArray()
    n, shift = g[0, 0], g[0, 1:] / max(g[0, 0], 1.0)
    return n, shift + origin, (g[1:, 1:] - n * np.outer(shift, shift)) / max(n - 1, 1.0)


def export_3d(points: DataFrame) -> DataFrame:
    """x, y, z: the first three principal components of the centred positions.

    The moments are one aggregation; each axis' sign makes the largest loading positive. Axes that the
    points don't span are 0; so is a single point.
    """
    placed = points.withColumn("_p", position())
    n, mean, cov = moments(placed, "_p")
    axes = np.zeros((0, 0))
    if n > 1:
        value, vector = np.linalg.eigh(cov)
        best = [i for i in np.argsort(value)[::-1][:3] if value[i] > 1e-12]
        axes = np.array([vector[:, i] * np.sign(vector[np.argmax(np.abs(vector[:, i])), i]) for i in best])
    shifted = F.zip_with(v.padded(F.col("_p"), F.lit(len(mean))), F.lit(mean.tolist()).cast("array<double>"), lambda x, m: x - m)
    cols = [(v.dot(shifted, F.lit(axes[i].tolist())) if i < len(axes) else F.lit(0.0)).alias(name) for i, name in enumerate("xyz")]
    return placed.select("id", F.col("file_path").alias("path"), F.col("dominant_domain").alias("domain"), F.col("line_count").alias("lines"), *cols)


def write_csv(positions: DataFrame, path: str) -> None:
    """export_positions() as CSV with a header; a file for each partition. Replaces what is there."""
    positions.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
