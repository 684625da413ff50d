"""Deltas (movements of points), adaptive thresholds, tensions (contracts that moved), and advice on changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import text as tx
from orrery.functions import vectors as v
from orrery.operators.contracts import with_paths
from orrery.operators.index import pair_id, position

SIGNIFICANT, UNCHANGED = 0.1, 0.01
#: Of the adaptive threshold: latest deltas, least samples, default, deviations, limits.
LATEST, LEAST, DEFAULT, DEVIATIONS, LOW, HIGH = 20, 3, 0.15, 2.0, 0.05, 0.50
STATUSES = ("detected", "reviewed", "resolved", "ignored")


AXES = ("lexical", "structural", "semantic")


def movement(old: str, new: str) -> dict[str, Column]:
    """A delta's positions, magnitude, changes of axes and the axis of the largest one, of a row with the axes of both points: their names begin with `old` and `new`."""
    a, b = ([F.col(f"{p}{x}") for x in AXES] for p in (old, new))
    was, now = F.concat(*a), F.concat(*b)
    changes = {f"{x}_change": v.euclidean(*v.aligned(p, q)) for x, p, q in zip(AXES, a, b, strict=True)}
    return {"old_position": was, "new_position": now, "movement_magnitude": v.euclidean(*v.aligned(was, now)), **changes}


def dominant() -> Column:
    """The first axis of the largest change."""
    return v.argmax_name(list(AXES), F.array(*[F.col(f"{x}_change") for x in AXES]))


def deltas(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """A delta for each point of both snapshots: how far it moved, in all and by axis."""
    a = old.select("id", *[F.col(x).alias(f"_{x}") for x in AXES])
    rows = a.join(new.select("id", *AXES), "id").select(F.col("id").alias("code_point_id"), *[c.alias(n) for n, c in movement("_", "").items()], now.alias("created_at"))
    return rows.select(pair_id(F.col("code_point_id"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("id"), "*", dominant().alias("dominant_change"))


def changed(rows: DataFrame) -> DataFrame:
    """Deltas that count; smaller ones leave the point as it was."""
    return rows.where(F.col("movement_magnitude") >= UNCHANGED)


def recent_deltas(rows: DataFrame, points: DataFrame, point: str | None = None, limit: int = 20) -> DataFrame:
    """The latest deltas, of one point or of all, with their paths."""
    if point is not None:
        rows = rows.where(F.col("code_point_id") == point)
    named = rows.join(points.select(F.col("id").alias("code_point_id"), "file_path"), "code_point_id")
    return named.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def significant_deltas(rows: DataFrame, points: DataFrame, threshold: float = SIGNIFICANT, limit: int = 20) -> DataFrame:
    named = rows.where(F.col("movement_magnitude") > threshold).join(points.select(F.col("id").alias("code_point_id"), "file_path"), "code_point_id")
    return named.orderBy(F.desc("movement_magnitude"), F.desc("id")).limit(limit)


def adaptive_thresholds(rows: DataFrame) -> DataFrame:
    """(code_point_id, samples, threshold): mean and deviations of the latest magnitudes, within limits.

    The rank limit is pushed below the shuffle, so a point with a long history sends 20 rows a task.
    """
    latest = Window.partitionBy("code_point_id").orderBy(F.desc("created_at"), F.desc("id"))
    kept = rows.select("code_point_id", "id", "created_at", "movement_magnitude").withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= LATEST)
    m = F.col("movement_magnitude")
    agg = kept.groupBy("code_point_id").agg(F.count("*").alias("samples"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("dev"))
    limit = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col("mean") + DEVIATIONS * F.coalesce("dev", F.lit(0.0))))
    return agg.select("code_point_id", "samples", F.when(F.col("samples") < LEAST, F.lit(DEFAULT)).otherwise(limit).alias("threshold"))


def deviation(current: Column, baseline: Column) -> Column:
    """Relative to the baseline; as it is where that is 0."""
    d = F.abs(current - baseline)
    return F.when(baseline > 0, d / baseline).otherwise(d)


def detect_tensions(moved: DataFrame, history: DataFrame | None, contracts: DataFrame, points: DataFrame, now: Column, metric: str = "mixed", limits: DataFrame | None = None) -> DataFrame:
    """Tensions of the contracts whose callee is in `moved` (deltas). `points` are after the change; `history`
    holds all deltas, those of `moved` too. Each point's threshold is computed once, or given in `limits` (code_point_id, threshold)."""
    p = points.select("id", "file_path", position().alias("pos"))
    caller = p.select(F.col("id").alias("caller_id"), F.col("file_path").alias("caller_path"), F.col("pos").alias("_a"))
    callee = p.select(F.col("id").alias("callee_id"), F.col("file_path").alias("callee_path"), F.col("pos").alias("_b"))
    d = moved.select(F.col("id").alias("delta_id"), F.col("code_point_id").alias("callee_id"), "dominant_change")
    limits = adaptive_thresholds(history) if limits is None else limits
    limits = limits.select(F.col("code_point_id").alias("callee_id"), "threshold")
    rows = contracts.select(F.col("id").alias("contract_id"), "caller_id", "callee_id", "baseline_distance")
    rows = rows.join(d, "callee_id").join(caller, "caller_id").join(callee, "callee_id").join(limits, "callee_id", "left")
    current = v.distance(*v.aligned(F.col("_a"), F.col("_b")), "cosine" if metric == "mixed" else "euclidean")
    rows = rows.withColumn("current_distance", current)
    share = deviation(F.col("current_distance"), F.col("baseline_distance"))
    found = rows.withColumn("tension_percent", share).where(F.col("tension_percent") >= F.coalesce("threshold", F.lit(DEFAULT)))
    return found.select(
        pair_id(F.col("contract_id"), F.col("delta_id")).alias("id"),
        "contract_id",
        "delta_id",
        "caller_path",
        "callee_path",
        "baseline_distance",
        "current_distance",
        F.abs(F.col("current_distance") - F.col("baseline_distance")).alias("tension_magnitude"),
        "tension_percent",
        severity(F.col("tension_percent")).alias("severity"),
        F.lit("detected").alias("status"),
        suggested_action(F.col("dominant_change"), F.col("tension_percent"), F.col("caller_path"), F.col("callee_path")).alias("suggested_action"),
        now.alias("created_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def severity(percent: Column) -> Column:
    return F.when(percent > 0.25, F.lit("high")).when(percent > 0.15, F.lit("medium")).otherwise(F.lit("low"))


def suggested_action(dominant: Column, percent: Column, caller: Column, callee: Column) -> Column:
    what = (
        F.when(dominant == "structural", F.lit("its structure changed; compare signatures and exports"))
        .when(dominant == "semantic", F.lit("its purpose changed; see whether it still fits its role"))
        .otherwise(F.lit("its terms changed; compare names"))
    )
    return F.concat(F.lit("Review "), tx.base_name(caller), F.lit(" after "), tx.base_name(callee), F.lit(": "), what, F.lit(" (+"), tx.percent(percent), F.lit(")"))


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """`old` with the rows of `new` whose id it lacks."""
    return old.unionByName(new.join(old.select("id"), "id", "left_anti").select(*old.columns))


def get_tensions(tensions: DataFrame, contracts: DataFrame, points: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """Of a status, the largest; without one, the latest. The current distance is taken from the baseline."""
    ends = with_paths(contracts, points).select(F.col("id").alias("contract_id"), "caller_path", "callee_path", "baseline_distance")
    rows = tensions.select("id", "contract_id", "delta_id", "tension_magnitude", "status", "created_at")
    rows = (rows if status is None else rows.where(F.col("status") == status)).join(ends, "contract_id")
    base, size = F.col("baseline_distance"), F.col("tension_magnitude")
    rows = rows.withColumn("current_distance", base + size).withColumn("tension_percent", F.when(base > 0, size / base).otherwise(size))
    order = F.desc("created_at") if status is None else F.desc("tension_magnitude")
    return rows.orderBy(order, F.desc("id")).limit(limit)


def resolve_tension(tensions: DataFrame, tension_id: str, now: Column, status: str = "resolved") -> DataFrame:
    """The table with a tension's status set; resolved_at is set for "resolved" and cleared for others."""
    if status not in STATUSES:
        raise ValueError(f"unknown status: {status}")
    hit = F.col("id") == tension_id
    at = now if status == "resolved" else F.lit(None).cast("timestamp")
    return tensions.withColumns({"status": F.when(hit, F.lit(status)).otherwise(F.col("status")), "resolved_at": F.when(hit, at).otherwise(F.col("resolved_at"))})


def tension_statistics(tensions: DataFrame) -> DataFrame:
    """A row for each status, with mean and largest magnitude of the detected ones."""
    open_ = F.when(F.col("status") == "detected", F.col("tension_magnitude"))
    by = tensions.groupBy("status").agg(F.count("*").alias("tensions"))
    all_ = tensions.agg(F.coalesce(F.avg(open_), F.lit(0.0)).alias("avg_detected"), F.coalesce(F.max(open_), F.lit(0.0)).alias("max_detected"))
    return by.crossJoin(F.broadcast(all_))  # one row


#: An axis with this share of a movement is named as one that made it.
NOTABLE = 0.25
#: What to look at, by axis.
LOOK = {
    "lexical": "Search its callers for terms that it no longer has",
    "structural": "Hold its callers' calls against its present functions",
    "semantic": "Compare its folder with the domain it is now nearest to",
}


def change_analysis(rows: DataFrame) -> DataFrame:
    """Deltas with change_type, severity, description, likely_causes, suggested_actions and warnings.

    All are read off the delta: the axes' shares of its movement, and its size.
    """
    m = F.col("movement_magnitude")
    kind = F.when(F.col("dominant_change").isin(*LOOK), F.col("dominant_change")).otherwise(F.lit("mixed"))
    total = sum((F.col(f"{a}_change") for a in LOOK), F.lit(0.0))
    share = {a: F.when(total > 0, F.col(f"{a}_change") / total).otherwise(F.lit(0.0)) for a in LOOK}
    size = F.coalesce(*[F.when(kind == a, F.col(f"{a}_change")) for a in LOOK], m)
    large = m > 1.0
    made = F.array_compact(F.array(*[F.when(x >= NOTABLE, F.format_string("%s: %.2f of the movement", F.lit(a), x)) for a, x in share.items()]))
    return rows.select(
        "*",
        kind.alias("change_type"),
        F.when(large, F.lit("high")).when(m > 0.5, F.lit("medium")).otherwise(F.lit("low")).alias("severity"),
        F.format_string("%s change of %.3f", kind, size).alias("description"),
        made.alias("likely_causes"),
        F.array_compact(F.array(F.when(large, F.lit("Index its callers again before judging their distances")), *[F.when(share[a] >= NOTABLE, F.lit(said)) for a, said in LOOK.items()])).alias("suggested_actions"),
        F.array_compact(F.array(F.when(large, F.lit("It moved further than unrelated files are apart")), F.when(F.size(made) > 1, F.lit("More than one axis moved")))).alias("warnings"),
    )


# Lines that are snippets, by kind; the first pattern that fits counts.
SNIPPETS = {
    "imports": [r"^import\s+.+", r"^const\s+\w+\s*=\s*require\(.+\)", r"^from\s+\S+\s+import", r"^import\s+\w+"],
    "exports": [r"^export\s+(default\s+)?(function|class|const|let|var)", r"^export\s+\{", r"^module\.exports\s*=", r"^exports\.\w+\s*="],
    "functions": [
        r"^(async\s+)?function\s+(\w+)\s*\([^)]*\)",
        r"^(export\s+)?(async\s+)?function\s+(\w+)",
        r"^const\s+(\w+)\s*=\s*(async\s+)?\([^)]*\)\s*=>",
        r"^def\s+(\w+)\s*\([^)]*\)",
        r"^\s*(async\s+)?(\w+)\s*\([^)]*\)\s*\{",
    ],
    "classes": [r"^(export\s+)?class\s+(\w+)", r"^class\s+(\w+)"],
}


def snippets(files: DataFrame, max_lines: int = 50, width: int = 100) -> DataFrame:
    """file_path, total_lines, a list of (line, code) for each kind, and the text or its beginning."""
    lines = tx.lines(F.col("content"))
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("code")))

    def of(kind: str) -> Column:
        any_ = "|".join(f"(?:{p})" for p in SNIPPETS[kind])
        fits = lambda x: x["code"].rlike(any_)
        cut = width if kind != "imports" else 1 << 30
        return F.transform(F.filter(numbered, fits), lambda x: F.struct(x["line"].alias("line"), F.substring(x["code"], 1, cut).alias("code")))

    n = F.size(lines)
    head = F.concat(F.array_join(F.slice(lines, 1, max_lines), "\n"), F.format_string("\n... (%d more lines)", n - max_lines))
    return files.select(
        "file_path", n.alias("total_lines"), *[of(k).alias(k) for k in SNIPPETS], F.when(n <= max_lines, F.col("content")).otherwise(head).alias("content"), (n <= max_lines).alias("complete")
    )


def fix_context(tensions: DataFrame, rows: DataFrame, contracts: DataFrame, points: DataFrame, files: DataFrame, tension_id: str | None = None, file_path: str | None = None) -> DataFrame:
    """What is needed to mend a tension, or a file's dependents: change, advice, snippets of both ends.

    Of a file, its latest delta and all callers are given.
    """
    if (tension_id is None) == (file_path is None):
        raise ValueError("give a tension_id or a file_path")
    ends = with_paths(contracts, points).select(F.col("id").alias("contract_id"), "caller_path", "callee_path", "callee_id", "baseline_distance")
    if tension_id is not None:
        at = tensions.where(F.col("id") == tension_id).select(F.col("id").alias("tension_id"), "contract_id", "delta_id", "tension_magnitude").join(ends, "contract_id")
    else:
        latest = rows.groupBy("code_point_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("delta_id"))
        at = ends.where(F.col("callee_path") == file_path).join(latest.withColumnRenamed("code_point_id", "callee_id"), "callee_id", "left")
        at = at.select(F.lit(None).cast("string").alias("tension_id"), "contract_id", "delta_id", F.lit(None).cast("double").alias("tension_magnitude"), "caller_path", "callee_path", "baseline_distance")
    advice = change_analysis(rows).select(F.col("id").alias("delta_id"), "change_type", "severity", "description", "likely_causes", "suggested_actions", "warnings")
    shown = snippets(files)
    caller = shown.select(F.col("file_path").alias("caller_path"), F.struct(*SNIPPETS, "content").alias("caller"))
    callee = shown.select(F.col("file_path").alias("callee_path"), F.struct(*SNIPPETS, "content").alias("callee"))
    out = at.join(advice, "delta_id", "left").join(caller, "caller_path", "left").join(callee, "callee_path", "left")
    steps = F.array(
        F.concat(F.lit("Open "), tx.base_name(F.col("caller_path")), F.lit(" beside "), tx.base_name(F.col("callee_path"))),
        F.format_string("Follow its %d import lines to what the other one exports in %d", F.coalesce(F.size("caller.imports"), F.lit(0)), F.coalesce(F.size("callee.exports"), F.lit(0))),
    )
    out = out.withColumn("steps", steps)
    names = ["tension_id", "caller_path", "callee_path", "baseline_distance", "tension_magnitude", "change_type", "severity", "description", "likely_causes", "suggested_actions", "steps", "warnings", "caller", "callee"]
    return out.select(*names).orderBy("caller_path")
