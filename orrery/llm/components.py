"""Connected components of an edge table, by alternating large and small stars.

Each turn joins an edge table with the least neighbour of each node; edges only
move towards smaller ids, and the turns that a component needs grow with the
logarithm of its size. The edges stay in the cluster; each turn is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import dropped, shared_table


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for each node of the edges (u, v bigint)."""
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = shared_table(e, "edges")
    state = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        seen = Observation()  # counted while the table is written: no second job a turn
        turned = small.select("x.u", "x.v").where("u <> v").distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        last, e = e, shared_table(turned, "edges")
        dropped(last)
        now = (seen.get["n"], seen.get["h"])
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components: no end")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
