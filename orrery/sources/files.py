"""Sources of files: directories, single texts, listings, domain configuration."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns that are read by default, and folders that are passed over.
PATTERNS = ["*.js", "*.jsx", "*.ts", "*.tsx", "*.py", "*.go", "*.java"]
SKIPPED = ["node_modules", ".git", ".next", "__pycache__", ".venv", "venv", "dist", "build", ".cache", "coverage"]
CONFIG_NAME = ".orrery.json"


def not_skipped(path: Column, skipped: list[str] | None = None) -> Column:
    """True unless a part of the path is a skipped folder."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(s) for s in (SKIPPED if skipped is None else skipped)]))


def one_file(spark: SparkSession, path: str, content: str) -> DataFrame:
    return spark.createDataFrame([(path, content)], "file_path string, content string")


def directory(spark: SparkSession, root: str, patterns: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """(file_path, content, modified) of the files below `root`. Files that aren't UTF-8 are left out.

    One glob of alternatives lists the folder once; contents are read by the tasks.
    """
    glob = "{" + ",".join(PATTERNS if patterns is None else patterns) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace("path", r"^file:(?://)?(?=/)", "")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    rows = raw.where(not_skipped(path) & valid)
    return rows.select(path.alias("file_path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """file_path of every file below `root`, without contents."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return raw.select(F.regexp_replace("path", r"^file:(?://)?(?=/)", "").alias("file_path"))


def by_path(rows: DataFrame, path: str, column: str = "file_path") -> DataFrame:
    return rows.where(F.col(column) == path).limit(1)


def by_suffix(rows: DataFrame, path: str, column: str = "file_path") -> DataFrame:
    """The row of an equal path, else of the smallest path that ends with it."""
    c = F.col(column)
    return rows.where((c == path) | c.endswith(path)).orderBy(F.desc(c == path), c).limit(1)


def domain_config(start: str, name: str = CONFIG_NAME) -> dict[str, list[str]] | None:
    """{domain: keywords} of the nearest configuration at or above `start`; None without a usable one."""
    here = Path(start).resolve()
    found = next((d / name for d in [here, *here.parents] if (d / name).is_file()), None)
    if found is None:
        return None
    try:
        domains = json.loads(found.read_text(encoding="utf-8")).get("domains")
    except (OSError, ValueError, AttributeError):
        return None
    if not isinstance(domains, dict) or not domains:
        return None
    return {str(d): [str(w) for w in words] for d, words in domains.items()}


def unioned(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
