"""Version history as tables: changes of files, and commits under the names that files have now."""

from __future__ import annotations

import subprocess
import threading
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans.store import folder, kept


class HistoryError(RuntimeError):
    """A history that couldn't be read, or not in time."""


def repository_root(path: str) -> str | None:
    """The nearest folder at or above `path` that holds a repository."""
    here = Path(path).resolve()
    return next((str(d) for d in [here, *here.parents] if (d / ".git").exists()), None)


def _copied(spark: SparkSession, command: list[str], timeout: float) -> str:
    """What `command` prints, numbered block by block, as one file in the shared folder; the driver holds a part at a time."""
    path = folder(spark, "history")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    late = threading.Event()
    try:
        with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
            clock = threading.Timer(timeout, lambda: (late.set(), run.kill()))
            clock.start()
            block = 0
            while part := run.stdout.read(1 << 20):
                first, *rest = part.split(b"\x01")
                numbered = [first]
                for b in rest:
                    numbered.append(b"\x01%d|%s" % (block, b))
                    block += 1
                out.write(bytearray(b"".join(numbered)))
            clock.cancel()
            said = run.stderr.read().decode(errors="replace").strip()
        if late.is_set() or run.returncode:
            raise HistoryError(f"no history within {timeout:g} s" if late.is_set() else said)
    except OSError as e:
        raise HistoryError(str(e)) from e
    finally:
        out.close()
    return path


def changes(spark: SparkSession, root: str, limit: int | None = None, timeout: float = 3600.0) -> DataFrame:
    """(seq, hash, ts, author, old_path, file_path) of each file in each commit of a repository; old_path only for a renamed one.

    `seq` rises with the history. Time zones are cut, not converted; merges have no files. Tasks parse the commits. Raises HistoryError.
    """
    command = ["git", "-C", root, "-c", "core.quotePath=false", "log", "-M", "--name-status", "--format=%x01%H|%aI|%an"] + ([f"-n{limit}"] if limit else [])
    blocks = spark.read.option("lineSep", "\x01").text(_copied(spark, command, timeout)).where("value <> ''")
    line = F.split(F.rtrim(F.col("value")), "\n")
    head = F.split(line[0], r"\|", 4)
    rows = blocks.select(head.alias("h"), F.explode(F.filter(line, lambda x: x.contains("\t"))).alias("line")).select("h", F.split("line", "\t").alias("n"))
    named = lambda i: F.concat(F.lit(f"{root.rstrip('/')}/"), F.get("n", F.lit(i)))
    renamed = F.col("n")[0].startswith("R")
    return rows.select(
        (-F.col("h")[0].cast("long")).alias("seq"),
        F.col("h")[1].alias("hash"),
        F.substring(F.col("h")[2], 1, 19).cast("timestamp_ntz").alias("ts"),
        F.col("h")[3].alias("author"),
        F.when(renamed, named(1)).alias("old_path"),
        F.when(renamed, named(2)).otherwise(named(1)).alias("file_path"),
    )


def _next(rows: DataFrame, away: DataFrame, path: str, after: str) -> DataFrame:
    """`rows` with `next`: the first renaming (s, new) of `path` after `after`, or null."""
    a = away.withColumnRenamed("old", path)
    return rows.join(a, path, "left").withColumn("next", F.get(F.filter("away", lambda x: x["s"] > F.col(after)), F.lit(0))).drop("away")


def followed(changed: DataFrame) -> DataFrame:
    """`changed` (seq, old_path, file_path, ...) with `now_path`: the name that the file of each row has in the end.

    A name may be given up and used again, so a row belongs to the first renaming of its name after it. Renamings point to the next
    one of their file; each turn doubles how far they point, so turns grow with the logarithm of the longest chain. Only
    renamings take part in turns; the changes are joined once. One name's renamings are one row.
    """
    r = kept(changed.where("old_path <> file_path").select(F.col("old_path").alias("old"), F.col("seq").alias("s"), F.col("file_path").alias("new")).distinct(), "renamings")
    away = kept(r.groupBy("old").agg(F.array_sort(F.collect_list(F.struct("s", "new"))).alias("away")), "names")
    # (old, s): the file is `new` until `until`; null if for good
    ends = kept(_next(r, away, "new", "s").select("old", "s", "new", F.col("next.s").alias("until")), "ends")
    while ends.where("until is not null").limit(1).count():
        on = ends.select(F.col("old").alias("new"), F.col("s").alias("until"), F.col("new").alias("_new"), F.col("until").alias("_until"), F.lit(True).alias("_met"))
        further = ends.join(on, ["new", "until"], "left")
        moved: Column = F.when(F.col("_met"), F.col("_until"))
        ends = kept(further.select("old", "s", F.coalesce("_new", "new").alias("new"), moved.alias("until")), "ends")
    last = ends.select(F.col("old").alias("file_path"), F.col("s").alias("_s"), F.col("new").alias("_end"))
    rows = _next(changed, away, "file_path", "seq").withColumn("_s", F.col("next.s")).drop("next")
    return rows.join(last, ["file_path", "_s"], "left").withColumn("now_path", F.coalesce("_end", "file_path")).select(*changed.columns, "now_path")


def commits(spark: SparkSession, root: str, limit: int | None = None, timeout: float = 3600.0, follow: bool = False) -> DataFrame:
    """(file_path, hash, ts, author): the commits of each file of a repository, by one call for all files.

    With `follow` a file has the commits of its earlier names too. A history that can't be read, or not within `timeout`
    seconds, raises HistoryError.
    """
    rows = changes(spark, root, limit, timeout)
    if follow:
        rows = followed(rows).withColumn("file_path", F.col("now_path"))
    return rows.select("file_path", "hash", "ts", "author")
