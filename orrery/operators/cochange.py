"""Files that change together, and shotgun surgery: a file whose changes keep reaching into many others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import overlaps
from orrery.plans.store import kept

#: Change sets that two files share at least; share of a file's change sets that the other one is in; partners of a smell.
SUPPORT, CONFIDENCE, PARTNERS = 3, 0.5, 3


def pairs(commits: DataFrame, by: list[str], support: int = SUPPORT) -> DataFrame:
    """(file_a, file_b, together, changes_a, changes_b, confidence) with file_a < file_b, of files that share `support` change sets.

    A change set is the commits (file_path, ...) that agree in the columns `by`; nulls make none. Files of fewer
    change sets are dropped before pairs are made, and so are change sets that hold one file then. confidence is the share of the rarer file's change sets
    that hold both. Files are multiplied in blocks (overlaps.products()): what two files share is counted where they meet, no
    row is made of a change set and a pair.
    """
    items = commits.select("file_path", F.sha2(F.to_json(F.struct(*by)), 256).alias("_set")).where(" and ".join(["file_path is not null", *(f"`{c}` is not null" for c in by)])).distinct()
    items = kept(items, "items")
    often = items.groupBy("file_path").agg(F.count("*").alias("changes")).where(F.col("changes") >= support)
    left = kept(items.join(often, "file_path"), "frequent")
    several = left.groupBy("_set").agg(F.count("*").alias("n")).where("n > 1")
    several = kept(several.withColumn("item", F.monotonically_increasing_id()), "several")  # a number for each set, for good once it is written
    sets = left.join(several, "_set").groupBy("file_path", "changes").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("o"))  # a file's change sets, rare ones first
    sets = sets.select(F.col("file_path").alias("key"), "changes", F.col("o.item").alias("items"), (F.size("o") - support + 1).alias("keep"))

    def together(a: pd.DataFrame, b: pd.DataFrame, both: np.ndarray, same: bool) -> pd.DataFrame:
        i, j = np.nonzero(np.triu(both >= support, 1) if same else both >= support)
        pa, pb, na, nb = a["key"].to_numpy()[i], b["key"].to_numpy()[j], a["changes"].to_numpy()[i], b["changes"].to_numpy()[j]
        low = pa < pb
        return pd.DataFrame({"file_a": np.where(low, pa, pb), "file_b": np.where(low, pb, pa), "together": both[i, j], "changes_a": np.where(low, na, nb), "changes_b": np.where(low, nb, na)})

    met = overlaps.products(sets, together, "file_a string, file_b string, together long, changes_a long, changes_b long")
    return met.select("file_a", "file_b", "together", "changes_a", "changes_b", (F.col("together") / F.least("changes_a", "changes_b")).alias("confidence"))


def shotgun_surgery(found: DataFrame, confidence: float = CONFIDENCE, partners: int = PARTNERS) -> DataFrame:
    """(smell_type, severity, file_path, partners, together) of the files that change with `partners` others, each time in at least `confidence` of their own change sets."""
    ends = F.array(*[F.struct(F.col(a).alias("file_path"), (F.col("together") / F.col(n)).alias("share")) for a, n in (("file_a", "changes_a"), ("file_b", "changes_b"))])
    rows = found.select("together", F.explode(ends).alias("x")).where(F.col("x.share") >= confidence)
    rows = rows.groupBy(F.col("x.file_path").alias("file_path")).agg(F.count("*").alias("partners"), F.sum("together").alias("together")).where(F.col("partners") >= partners)
    level = F.when(F.col("partners") >= 4 * partners, F.lit("critical")).when(F.col("partners") >= 2 * partners, F.lit("high")).otherwise(F.lit("medium"))
    return rows.select(F.lit("shotgun_surgery").alias("smell_type"), level.alias("severity"), "file_path", "partners", "together")
