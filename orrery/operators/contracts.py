"""Contracts: import edges between files, from their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as tx
from orrery.functions import vectors as v
from orrery.operators.index import pair_id, position
from orrery.plans.store import kept

# Languages of extensions, import patterns, and endings that are tried, in order.
LANGUAGES = {
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".py": "python",
    ".go": "go",
    ".java": "java",
}
SCRIPT_IMPORTS = [
    r"""import\s+(?:[\w{},\s*]+\s+from\s+)?['"]([^'"]+)['"]""",
    r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""",
    r"""import\s*\(\s*['"]([^'"]+)['"]\s*\)""",
]
PYTHON_IMPORTS = [r"from\s+([\w.]+)\s+import", r"(?m)^import\s+([\w.]+)"]
ENDINGS = ["", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", "/index.js", "/index.ts", "/index.jsx", "/index.tsx", "/__init__.py"]


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(table[tx.extension(path)], F.lit("unknown"))


def imports(content: Column, path: Column) -> Column:
    """Distinct imported names of a file, by its language; all patterns where that has none of its own."""
    script = F.concat(*[tx.extract(content, p) for p in SCRIPT_IMPORTS])
    python = F.concat(*[tx.extract(content, p) for p in PYTHON_IMPORTS])
    kind = language(path)
    return F.array_distinct(F.when(kind.isin("javascript", "typescript"), script).when(kind == "python", python).otherwise(F.concat(script, python)))


def resolved(path: Column) -> Column:
    """An absolute path without `.` and `..` parts."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    empty = F.expr("cast(array() as array<string>)")
    kept = F.aggregate(parts, empty, lambda acc, x: F.when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def by_ending(endings: DataFrame, paths: DataFrame) -> DataFrame:
    """(suffix, callee): the smallest of `paths` (callee) that ends with each of `endings` (suffix, with a slash after its first part).

    An ending's parts are whole but the first, which may begin within a part of the path. So paths are read as a trie of their
    parts from the end: a node is (part, rest), and keeps its smallest path. Only nodes whose rest is asked for are kept, and only
    first parts of the lengths that are asked for with that rest are compared: rows grow with paths times folders, not letters.
    """
    slash = F.instr("suffix", "/")
    asked = endings.distinct().select("suffix", F.expr("left(suffix, instr(suffix, '/') - 1)").alias("first"), F.expr("substring(suffix, instr(suffix, '/'))").alias("rest")).where(slash > 0)
    lengths = asked.groupBy("rest").agg(F.collect_set(F.length("first")).alias("lengths"))  # as many as a name is long at most
    parts = F.split("callee", "/")
    node = F.transform(F.sequence(F.lit(2), F.size("parts")), lambda i: F.struct(F.element_at("parts", i - 1).alias("part"), F.concat(F.lit("/"), F.array_join(F.slice("parts", i, F.size("parts")), "/")).alias("rest")))
    nodes = paths.select("callee", parts.alias("parts")).where(F.size("parts") > 1).select("callee", F.explode(node).alias("n")).select("callee", "n.part", "n.rest")
    met = nodes.join(lengths, "rest").groupBy("rest", "part").agg(F.min("callee").alias("callee"), F.any_value("lengths").alias("lengths"))
    ends = met.select("rest", "part", "callee", F.explode(F.filter("lengths", lambda n: n <= F.length("part"))).alias("n"))
    least = ends.groupBy("rest", F.right("part", "n").alias("first")).agg(F.min("callee").alias("callee"))
    return asked.join(least, ["rest", "first"]).select("suffix", "callee")


def resolve(found: DataFrame, files: DataFrame) -> DataFrame:
    """(caller, target, callee) for `found` (caller, target) that name one of `files` (file_path).

    Dotted modules of Python files match the smallest path that ends with them (by_ending()). Relative and absolute paths take the first ending that exists.
    """
    caller, target = F.col("caller"), F.col("target")
    dotted = (tx.extension(caller) == ".py") & target.contains(".") & ~target.startswith(".")
    paths = files.select(F.col("file_path").alias("callee")).distinct()

    module = F.translate(target, ".", "/")
    wanted = found.where(dotted).select("caller", "target", F.explode(F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py")))).alias("suffix"))
    modules = wanted.join(by_ending(wanted.select("suffix"), paths.where(F.col("callee").endswith(".py"))), "suffix").groupBy("caller", "target").agg(F.min("callee").alias("callee"))

    base = F.when(target.startswith("."), F.concat_ws("/", tx.parent_path(caller), target)).otherwise(target)
    tried = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("ending")) for i, e in enumerate(ENDINGS)])
    local = found.where(~dotted & (target.startswith(".") | target.startswith("/")))
    local = local.select("caller", "target", resolved(base).alias("base"), F.explode(tried).alias("t"))
    local = local.select("caller", "target", F.concat("base", "t.ending").alias("callee"), "t.rank").join(paths, "callee")
    return modules.unionByName(local.groupBy("caller", "target").agg(F.min_by("callee", "rank").alias("callee")))


def detect(files: DataFrame, points: DataFrame, now: Column) -> DataFrame:
    """Contracts of `files` (file_path, content) between `points`; the baseline is the euclidean distance."""
    found = kept(files.select(F.col("file_path").alias("caller"), F.explode(imports(F.col("content"), F.col("file_path"))).alias("target")), "imports")
    edges = resolve(found, files).where("caller <> callee").select("caller", "callee").distinct()
    p = points.select("file_path", "id", position().alias("pos"))
    a = p.select(F.col("file_path").alias("caller"), F.col("id").alias("caller_id"), F.col("pos").alias("_a"))
    b = p.select(F.col("file_path").alias("callee"), F.col("id").alias("callee_id"), F.col("pos").alias("_b"))
    rows = edges.join(a, "caller").join(b, "callee")
    return rows.select(
        pair_id(F.col("caller_id"), F.col("callee_id")).alias("id"),
        "caller_id",
        "callee_id",
        F.lit("import").alias("contract_type"),
        v.euclidean(F.col("_a"), F.col("_b")).alias("baseline_distance"),
        now.alias("created_at"),
    )


def with_paths(contracts: DataFrame, points: DataFrame) -> DataFrame:
    """Contracts with caller_path and callee_path."""
    p = points.select("id", "file_path")
    a = p.select(F.col("id").alias("caller_id"), F.col("file_path").alias("caller_path"))
    b = p.select(F.col("id").alias("callee_id"), F.col("file_path").alias("callee_path"))
    return contracts.join(a, "caller_id").join(b, "callee_id")


def get_contracts(contracts: DataFrame, points: DataFrame, path: str | None = None, direction: str = "both", limit: int = 100) -> DataFrame:
    """Contracts of a file, in a direction; without a file the latest `limit`."""
    rows = with_paths(contracts, points)
    if path is None:
        return rows.orderBy(F.desc("created_at"), "id").limit(limit)
    out, into = F.col("caller_path") == path, F.col("callee_path") == path
    return rows.where({"outgoing": out, "incoming": into, "both": out | into}[direction])


def statistics(contracts: DataFrame) -> DataFrame:
    """A row for each type, with count, mean, least and largest baseline."""
    d = F.col("baseline_distance")
    zero = F.lit(0.0)
    return contracts.groupBy("contract_type").agg(
        F.count("*").alias("contracts"), F.coalesce(F.avg(d), zero).alias("avg_baseline"), F.coalesce(F.min(d), zero).alias("min_baseline"), F.coalesce(F.max(d), zero).alias("max_baseline")
    )


def with_positions(contracts: DataFrame, points: DataFrame) -> DataFrame:
    p = points.select("id", "file_path", position().alias("pos"))
    a = p.select(F.col("id").alias("caller_id"), F.col("file_path").alias("caller_path"), F.col("pos").alias("caller_pos"))
    b = p.select(F.col("id").alias("callee_id"), F.col("file_path").alias("callee_path"), F.col("pos").alias("callee_pos"))
    return contracts.join(a, "caller_id").join(b, "callee_id")


def analyze_impact(contracts: DataFrame, points: DataFrame, path: str, metric: str = "mixed") -> DataFrame:
    """Callers of a file, with the distance now against the baseline.

    metric "mixed" compares a cosine distance with the euclidean baseline; "euclidean" compares like with like.
    """
    rows = with_positions(contracts, points).where(F.col("callee_path") == path)
    now = v.distance(*v.aligned(F.col("caller_pos"), F.col("callee_pos")), "cosine" if metric == "mixed" else "euclidean")
    return rows.select("caller_path", "baseline_distance", now.alias("current_distance"), (now - F.col("baseline_distance")).alias("distance_delta"))
