"""Tables in the folder that driver and executors share, and session settings of the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bounds of what one Arrow batch carries to a Python worker, where the session's owner sets none.
LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: they needn't have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():  # else it comes from an archive that was sent
        own = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        to = Path(own) / f"{root.name}.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def tune(spark: SparkSession) -> None:
    """Ship the package, and bound Arrow batches; bounds that the session's owner has set stay."""
    ship(spark)
    own = spark._jsparkSession.sessionState().conf()
    for key, value in LIMITS.items():
        if not own.contains(key):
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A folder of our own only where none is set and one machine
    does all, as in tests; on a cluster that is an error, since executors don't share local folders."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors.

    The table goes with dropped(), or at the application's end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/orrery-{name}-{uuid.uuid4().hex}"
    where, fs = _file_system(spark, path)
    fs.deleteOnExit(where)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._orrery_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of shared_table() that nothing will read any more, and let Spark delete shuffles that nothing refers to."""
    for t in tables:
        where, fs = _file_system(t.sparkSession, t._orrery_path)
        fs.delete(where, True)
    tables[0].sparkSession._jvm.System.gc()


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
