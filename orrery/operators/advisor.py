"""Refactoring advice from smells, clusters, graph and tensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import text as tx
from orrery.operators.smells import rank

# Action, priority, impact, effort of each source; a critical god file has high priority.
FROM_SMELL = {
    "god_file": ("split", "medium", "high", "high"),
    "circular_dependency": ("decouple", "high", "medium", "medium"),
    "feature_envy": ("move", "low", "low", "low"),
    "dead_code_candidate": ("remove", "low", "low", "low"),
    "unstable_interface": ("stabilize", "high", "high", "medium"),
    "hub_overload": ("split", "medium", "medium", "medium"),
}
BRIDGE, TENSE, TENSIONS = 0.15, 0.25, 20

#: How each action is carried out and how to see that it worked.
STEPS = {
    "split": ["Cut along the groups of callers that use the same exports", "Done when no part is a god file or a hub any more"],
    "decouple": ["Turn one of the two imports into a parameter", "Done when the pair is no cycle any more"],
    "move": ["Rename it into the folder that most of its imports name", "Done when its nearest cluster is that folder's"],
    "remove": ["Delete it in a commit of its own, which is easy to take back", "Done when no import fails to resolve"],
    "stabilize": ["Export less: what nobody imports can go", "Done when its tension stays below the adaptive threshold for some commits"],
    "merge": ["Append it to its most similar file", "Done when no cluster has a single file"],
    "extract": ["Give the two sides that meet here a path of their own", "Done when its betweenness is below the limit"],
}


def _of(rows: DataFrame, source: int, action: Column, priority: Column, impact: Column, effort: Column, targets: Column, why: Column) -> DataFrame:
    return rows.select(F.lit(source).alias("source"), action.alias("action"), priority.alias("priority"), impact.alias("impact"), effort.alias("effort"), targets.alias("target_files"), why.alias("rationale"))


def suggest(smells: DataFrame, misclassified: DataFrame, clusters: DataFrame, measured: DataFrame, tensions: DataFrame) -> DataFrame:
    """Suggestions, one for each action and set of targets; of several, the first source's.

    smells; misclassified (file_path, ...); clusters (file_path, cluster); measured (file_path, betweenness);
    tensions (caller_path, callee_path, tension_percent, tension_magnitude, status).
    """
    table = F.create_map(*[x for k, v in FROM_SMELL.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    s = smells.where(F.col("smell_type").isin(list(FROM_SMELL))).withColumn("m", table[F.col("smell_type")])
    urgent = F.when((F.col("smell_type") == "god_file") & (F.col("severity") == "critical"), F.lit("high")).otherwise(F.col("m")[1])
    parts = [_of(s, 0, F.col("m")[0], urgent, F.col("m")[2], F.col("m")[3], F.array("file_name"), F.col("description"))]
    low, mid, high = F.lit("low"), F.lit("medium"), F.lit("high")
    name = tx.base_name(F.col("file_path"))
    parts.append(_of(misclassified, 1, F.lit("move"), low, low, low, F.array(name), F.lit("Another cluster is much nearer")))
    single = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.min("file_path").alias("file_path")).where("n = 1")
    parts.append(_of(single, 1, F.lit("merge"), low, low, low, F.array(name), F.lit("It is a cluster by itself")))
    parts.append(_of(measured.where(F.col("betweenness") > BRIDGE), 2, F.lit("extract"), mid, high, high, F.array(name), F.format_string("A bridge (betweenness %.2f)", F.col("betweenness"))))
    worst = tensions.where(F.col("status") == "detected").orderBy(F.desc("tension_magnitude"), F.desc("id")).limit(TENSIONS).where(F.col("tension_percent") > TENSE)
    ends = F.array(tx.base_name(F.col("callee_path")), tx.base_name(F.col("caller_path")))
    parts.append(_of(worst, 3, F.lit("stabilize"), high, high, mid, ends, F.concat(F.lit("It moved by "), tx.percent(F.col("tension_percent")))))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    first = Window.partitionBy("action", F.array_sort("target_files")).orderBy("source", "priority", F.array_join("target_files", ","), "rationale")
    kept = every.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "source")
    steps = F.create_map(*[x for k, v in STEPS.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    return kept.withColumn("steps", steps[F.col("action")])


def ordered(suggestions: DataFrame) -> DataFrame:
    return suggestions.orderBy(rank(F.col("priority")), "action", F.array_join("target_files", ","))


def summary(suggestions: DataFrame) -> DataFrame:
    return suggestions.groupBy("action", "priority").agg(F.count("*").alias("suggestions"))


