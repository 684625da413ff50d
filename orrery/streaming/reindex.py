"""Incremental re-indexing: batches or a stream of file versions keep points, deltas and tensions up to date.

Points lie in buckets of their id; a batch reads the buckets that its files are in and writes those in which a point is new or
moved, each as a partition of its own, so that no other bucket's files are read or written. Each point carries the latest
magnitudes of its movements, from which its adaptive threshold follows: no history is read. Deltas and tensions are only appended, a
partition for each batch. A batch reads what earlier batches wrote and overwrites nothing but its own partitions, so
one that is run again, or was lost halfway, gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.operators import changes, index
from orrery.plans.store import dealt, kept

EMPTY = {
    "points": "id string, file_path string, function_name string, lexical array<double>, structural array<double>, semantic array<double>, content_hash string, line_count int, dominant_domain string, created_at timestamp, updated_at timestamp, recent array<double>",
    "deltas": "id string, code_point_id string, old_position array<double>, new_position array<double>, movement_magnitude double, lexical_change double, structural_change double, semantic_change double, created_at timestamp, dominant_change string",
    "tensions": "id string, contract_id string, delta_id string, caller_path string, callee_path string, baseline_distance double, current_distance double, tension_magnitude double, tension_percent double, severity string, status string, suggested_action string, created_at timestamp, resolved_at timestamp",
}


def latest(files: DataFrame) -> DataFrame:
    """Of several versions of a file (file_path, content, updated_at), the latest. They are dealt by `id`, the point's, to all cores: their texts are worked on next."""
    last = Window.partitionBy("id", "file_path").orderBy(F.desc("updated_at"), F.desc("content"))
    named = dealt(files.where("file_path is not null").withColumn("id", index.point_id(F.col("file_path"))), "id")
    return named.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def threshold(recent: Column) -> Column:
    """Of the latest magnitudes, the newest last: mean and deviations within limits; the default for few."""
    n = F.size(recent)
    mean = F.aggregate(recent, F.lit(0.0), lambda s, x: s + x) / n
    dev = F.sqrt(F.aggregate(F.transform(recent, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / (n - 1))
    return F.when(n < changes.LEAST, F.lit(changes.DEFAULT)).otherwise(F.greatest(F.lit(changes.LOW), F.least(F.lit(changes.HIGH), mean + changes.DEVIATIONS * dev)))


def movements(files: DataFrame, points: DataFrame, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """The points of `files` (from latest()) with `known` (a point of `points` has the id), and for those the delta's columns.

    What is new has no delta. `recent` holds the magnitudes up to and with this one. Points that moved less than 0.01 are left out: they stay as they were, and so does their content hash.
    """
    new = index.code_points(files, F.col("updated_at").cast("timestamp"), domains, F.col("id"))
    old = points.select("id", F.col("created_at").alias("_born"), F.col("recent").alias("_recent"), *[F.col(x).alias(f"_{x}") for x in changes.AXES])
    rows = new.join(old, "id", "left").withColumn("known", F.col("_born").isNotNull())
    rows = rows.withColumns({n: F.when(F.col("known"), c) for n, c in changes.movement("_", "").items()})
    rows = rows.withColumn("dominant_change", F.when(F.col("known"), changes.dominant())).drop("new_position", *[f"_{x}" for x in changes.AXES])  # it is in the axes
    rows = rows.where(~F.col("known") | (F.col("movement_magnitude") >= changes.UNCHANGED))
    grown = F.concat(F.col("_recent"), F.array("movement_magnitude"))
    recent = F.when(F.col("known"), F.slice(grown, F.greatest(F.lit(1), F.size(grown) - changes.LATEST + 1), F.lit(changes.LATEST))).otherwise(F.array().cast("array<double>"))
    return rows.withColumns({"recent": recent, "created_at": F.coalesce("_born", "created_at")}).drop("_born", "_recent")


def deltas_of(moved: DataFrame) -> DataFrame:
    """Delta rows of movements()."""
    stamp = F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    names = ["old_position", index.position().alias("new_position"), "movement_magnitude", "lexical_change", "structural_change", "semantic_change"]
    return moved.where("known").select(index.pair_id(F.col("id"), stamp).alias("id"), F.col("id").alias("code_point_id"), *names, F.col("updated_at").alias("created_at"), "dominant_change")


def tensions_of(moved: DataFrame, contracts: DataFrame, points: DataFrame) -> DataFrame:
    """Tensions of the contracts whose callee moved, by the callee's own threshold. `points` are after the change."""
    d = deltas_of(moved)
    limits = moved.where("known").select(F.col("id").alias("code_point_id"), threshold(F.col("recent")).alias("threshold"))
    found = changes.detect_tensions(d, None, contracts, points, F.lit(None).cast("timestamp"), limits=limits).drop("created_at")
    return found.join(d.select(F.col("id").alias("delta_id"), "created_at"), "delta_id")


class Store:
    """The three tables below a folder that all executors reach: points by bucket and batch, deltas and tensions by batch."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def bucket(self, id_: Column) -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(self.buckets)).cast("int")

    def _partitions(self, pattern: str) -> list[dict[str, int]]:
        """Values in the names of the partitions' folders."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return [{k: int(v) for k, v in (p.split("=") for p in s.getPath().toString().split("/") if "=" in p)} for s in found]

    def points(self, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """Each bucket's points as its latest batch left them; of some buckets only, where given."""
        newest: dict[int, int] = {}
        for p in self._partitions("points/bucket=*/batch=*"):
            if (before is None or p["batch"] < before) and (buckets is None or p["bucket"] in buckets):
                newest[p["bucket"]] = max(p["batch"], newest.get(p["bucket"], -1))
        if not newest:
            return self.spark.createDataFrame([], EMPTY["points"])
        paths = [f"{self.root}/points/bucket={k}/batch={b}" for k, b in sorted(newest.items())]
        return self.spark.read.schema(EMPTY["points"]).parquet(*paths)

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """A table: as it is, or as it was before a batch."""
        if name == "points":
            return self.points(before)
        batches = sorted({p["batch"] for p in self._partitions(f"{name}/batch=*") if before is None or p["batch"] < before})
        paths = [f"{self.root}/{name}/batch={b}" for b in batches]
        return self.spark.read.schema(EMPTY[name]).parquet(*paths) if paths else self.spark.createDataFrame([], EMPTY[name])

    def _write(self, name: str, rows: DataFrame, by: list[str]) -> None:
        """Replaces the partitions that `rows` have, and no others."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.root}/{name}")

    def _buckets_of(self, ids: DataFrame) -> set[int]:
        return {r[0] for r in ids.select(self.bucket(F.col("id"))).distinct().collect()}  # at most `buckets` numbers

    def _rewrite(self, batch: int, gone: DataFrame | None, rows: DataFrame | None) -> None:
        """New content of buckets: those of `gone` (id) without these points, or those of `rows` with these in place of what had their ids."""
        ids = gone if rows is None else rows.select("id")
        touched = self._buckets_of(ids)
        if touched:
            names = self.spark.createDataFrame([], EMPTY["points"]).columns
            after = self.points(batch, touched).join(ids, "id", "left_anti").select(*names)
            empty = touched - self._buckets_of(after) if rows is None else set()  # where a point is put, a bucket has it
            after = after if rows is None else after.unionByName(rows.select(*names))
            placed = after.withColumns({"bucket": self.bucket(F.col("id")), "batch": F.lit(batch)})
            self._write("points", placed.repartition(4 * self.buckets, "bucket"), ["bucket", "batch"])  # so many that few tasks have two buckets
            for b in empty:  # all of its points went: an empty partition says so
                self.spark.createDataFrame([], EMPTY["points"]).write.mode("overwrite").parquet(f"{self.root}/points/bucket={b}/batch={batch}")

    def apply(self, files: DataFrame, batch: int, contracts: DataFrame, domains: dict[str, list[str]] | None = None) -> None:
        """Index `files` (file_path, content, updated_at) as batch number `batch`: numbers rise from batch to batch.

        A new file is indexed; one that moved less than 0.01 stays as it was; else its delta is appended,
        tensions are looked for, and its point is replaced. Null paths count for nothing.
        """
        new = latest(files)
        ids = files.where("file_path is not null").select(index.point_id(F.col("file_path")).alias("id"))
        moved = kept(movements(new, self.points(batch, self._buckets_of(ids)), domains), "moved")
        self._write("deltas", deltas_of(moved).withColumn("batch", F.lit(batch)), ["batch"])
        known = moved.where("known").select(F.col("id").alias("callee_id"))
        asked = kept(contracts.join(known, "callee_id", "left_semi"), "asked")
        callers = asked.select(F.col("caller_id").alias("id")).distinct()
        around = self.points(batch, self._buckets_of(callers)).join(callers, "id", "left_semi").join(moved.select("id"), "id", "left_anti")
        after = around.unionByName(moved.select(*around.columns))
        self._write("tensions", tensions_of(moved, asked, after).withColumn("batch", F.lit(batch)), ["batch"])
        self._rewrite(batch, None, moved)

    def prune(self, present: DataFrame, batch: int) -> DataFrame:
        """Drop the points whose file isn't in `present` (file_path); returns their ids. Only their buckets are written."""
        gone = kept(index.stale(self.points(batch), present).select("id"), "gone")
        self._rewrite(batch, gone, None)
        return gone

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the latest `keep` batches of each bucket; how many partitions went."""
        batches: dict[int, list[int]] = {}
        for p in self._partitions("points/bucket=*/batch=*"):
            batches.setdefault(p["bucket"], []).append(p["batch"])
        old = [f"{self.root}/points/bucket={k}/batch={b}" for k, all_ in batches.items() for b in sorted(all_)[:-keep]]
        for path in old:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return len(old)


def start(stream: DataFrame, store: Store, contracts: DataFrame, checkpoint: str, domains: dict[str, list[str]] | None = None, once: bool = True) -> StreamingQuery:
    """Store.apply() on each micro-batch of `stream` (file_path, content, updated_at)."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: store.apply(batch, number, contracts, domains)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def change_rates(stream: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Movements of files in windows of time from a stream of deltas (created_at, code_point_id, movement_magnitude)."""
    at = stream.withWatermark("created_at", late)
    return at.groupBy(F.window("created_at", every), "code_point_id").agg(F.count("*").alias("deltas"), F.sum("movement_magnitude").alias("movement"))
