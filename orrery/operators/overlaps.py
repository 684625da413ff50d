"""Overlaps of sets, two blocks of sets at a time: products of matrices that say which item is in which set."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.store import kept

#: Sets of a block, and items that are multiplied at once.
BLOCK, ITEMS = 512, 4096


def _places(sets: list[np.ndarray], items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of what the sets have of the sorted `items`."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(items, flat), len(items) - 1)
    known = items[at] == flat
    return row[known], at[known]


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many items each two sets have in common; no more than ITEMS columns are held at once."""
    total = np.zeros((len(left), len(right)), np.float32)  # whole numbers, exact below 2^24
    items = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if not len(items):
        return total.astype(np.int64)
    (ra, pa), (rb, pb) = _places(left, items), _places(right, items)
    for lo in range(0, len(items), ITEMS):
        parts = []
        for n, row, at in ((len(left), ra, pa), (len(right), rb, pb)):
            here = (at >= lo) & (at < lo + ITEMS)
            x = np.zeros((n, min(ITEMS, len(items) - lo)), np.float32)
            x[row[here], at[here] - lo] = 1
            parts.append(x)
        total += parts[0] @ parts[1].T
    return total.astype(np.int64)


def products(sets: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, bool], pd.DataFrame], schema: str, block: int = BLOCK) -> DataFrame:
    """`work(left, right, shared, same)` for two blocks of `sets` (key, items, keep, ...) at a time, each two once.

    items are distinct numbers in one order for all sets; two sets that count have an item in common among the first `keep` of
    both, so blocks whose first items are apart never meet. Sets of one last item, which is the most frequent one where rare
    items come first, are in the same blocks. A task holds two blocks.
    """
    sets = kept(sets.where((F.col("keep") > 0) & (F.size("items") > 0)), "sets")
    cells = max(1, -(-sets.count() // block))
    placed = sets.withColumn("cell", F.pmod(F.xxhash64(F.element_at("items", -1)), F.lit(cells)))
    size = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    placed = placed.join(F.broadcast(size), "cell").withColumn("b", F.shiftleft("cell", 24) + F.pmod(F.xxhash64("key"), F.col("parts"))).drop("cell", "parts")  # a row for each `block` sets at most
    placed = kept(placed, "placed")
    first = placed.select("b", F.explode(F.slice("items", F.lit(1), F.least("keep", F.size("items")))).alias("item")).distinct()
    met = first.select("item", F.col("b").alias("x")).join(first.select("item", F.col("b").alias("y")), "item").where("x <= y").select("x", "y").distinct()
    ends = kept(met, "met").select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("b"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        left, right = pdf[pdf["b"] == x], pdf[pdf["b"] == y]
        return work(left, right, shared(list(left["items"]), list(right["items"])), x == y)

    return placed.join(ends, "b").groupBy("x", "y").applyInPandas(product, schema)
