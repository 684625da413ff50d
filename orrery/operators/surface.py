"""API surface: what modules export and how much they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as tx
from orrery.operators.contracts import with_paths

# Export patterns and the types they give.
SCRIPT = [
    (r"export\s+(?:async\s+)?function\s+(\w+)", "function"),
    (r"export\s+class\s+(\w+)", "class"),
    (r"export\s+(?:const|let|var)\s+(\w+)", "constant"),
]
DEFAULT, LIST, LISTED = r"export\s+default", r"export\s*\{([^}]+)\}", r"(\w+)(?:\s+as\s+\w+)?"
MODULE, MEMBER = r"module\.exports\s*=", r"exports\.(\w+)\s*="
ALL, QUOTED = r"__all__\s*=\s*\[([\s\S]*?)\]", r"[\"'](\w+)[\"']"
PYTHON = [(r"(?m)^def\s+([a-zA-Z]\w*)\s*\(", "function"), (r"(?m)^class\s+([a-zA-Z]\w*)", "class")]
SCRIPTS = [".js", ".ts", ".jsx", ".tsx", ".mjs"]


def _symbols(names: Column, kind: str) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type")))


def script_exports(content: Column) -> Column:
    none = F.expr("cast(array() as array<string>)")
    once = lambda p, n: F.when(tx.count(content, p) > 0, F.array(F.lit(n))).otherwise(none)
    listed = F.flatten(F.transform(tx.extract(content, LIST), lambda x: F.regexp_extract_all(x, F.lit(LISTED), 1)))
    return F.concat(
        *[_symbols(tx.extract(content, p), kind) for p, kind in SCRIPT],
        _symbols(once(DEFAULT, "default"), "default"),
        _symbols(listed, "re-export"),
        _symbols(once(MODULE, "module.exports"), "commonjs"),
        _symbols(tx.extract(content, MEMBER), "commonjs"),
    )


def python_exports(content: Column) -> Column:
    """The names of the first __all__; without one, public functions and classes of the top level."""
    named = F.regexp_extract_all(F.regexp_extract(content, ALL, 1), F.lit(QUOTED), 1)
    defined = F.concat(*[_symbols(tx.extract(content, p), kind) for p, kind in PYTHON])
    return F.when(content.rlike(ALL), _symbols(named, "explicit")).otherwise(defined)


def exports(content: Column, path: Column) -> Column:
    """array<struct<name, type>>, by the path's ending."""
    kind = tx.extension(path)
    none = F.expr("cast(array() as array<struct<name:string,type:string>>)")
    return F.when(kind.isin(SCRIPTS), script_exports(content)).when(kind == ".py", python_exports(content)).otherwise(none)


def analyze(files: DataFrame, contracts: DataFrame, points: DataFrame) -> DataFrame:
    """A row for each file: exports, importers, surface area (0 to 1) and stability risk."""
    out = files.select("file_path", exports(F.col("content"), F.col("file_path")).alias("exports"))
    ends = with_paths(contracts, points)
    used = ends.groupBy(F.col("callee_path").alias("file_path")).agg(F.count("*").alias("import_count"), F.array_sort(F.collect_list("caller_path")).alias("imported_by"))
    rows = out.join(used, "file_path", "left").select(
        "file_path",
        "exports",
        F.size("exports").cast("long").alias("export_count"),
        F.coalesce("imported_by", F.expr("cast(array() as array<string>)")).alias("imported_by"),
        F.coalesce("import_count", F.lit(0)).alias("import_count"),
    )
    most = rows.agg(F.greatest(F.max("export_count"), F.lit(1)).alias("me"), F.greatest(F.max("import_count"), F.lit(1)).alias("mi"))
    e, i = F.col("export_count"), F.col("import_count")
    risk = F.when((i > 5) & (e > 5), F.lit("high")).when((i > 2) | (e > 3), F.lit("medium")).otherwise(F.lit("low"))
    rows = rows.crossJoin(F.broadcast(most))  # one row
    return rows.select(
        "file_path", tx.base_name(F.col("file_path")).alias("file_name"), "exports", "export_count", "imported_by", "import_count", ((e / F.col("me") + i / F.col("mi")) / 2).alias("surface_area"), (e > 0).alias("is_public"), risk.alias("stability_risk")
    )


def summary(surface: DataFrame) -> DataFrame:
    n = F.count("*")
    total = F.coalesce(F.sum("export_count"), F.lit(0))
    return surface.agg(
        n.alias("total_modules"),
        F.count_if("is_public").alias("public_modules"),
        (n - F.count_if("is_public")).alias("private_modules"),
        total.alias("total_exports"),
        F.when(n > 0, F.round(total / n, 1)).otherwise(F.lit(0.0)).alias("avg_exports"),
        F.count_if(F.col("stability_risk") == "high").alias("high_risk_modules"),
    )


def top(surface: DataFrame, limit: int = 10) -> DataFrame:
    return surface.orderBy(F.desc("surface_area"), "file_path").limit(limit)


def of_module(surface: DataFrame, name: str) -> DataFrame:
    """The module whose path ends with `name`; of several, the one of the least path."""
    return surface.where(F.col("file_path").endswith(name)).orderBy("file_path").limit(1)
