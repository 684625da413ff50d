"""Tables that are written to the folder all executors share, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A path for one table or store in the folder that all executors share; it goes at the application's end.

    The folder is spark.checkpoint.dir; one of our own is set only where there is none and one machine does all, as in
    tests. On a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/orrery-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` as a written table in folder(): the lineage is cut, and a lost executor loses nothing."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """`df` in parts by columns, before costly work on its rows: small rows make much work, so parts go by cores and aren't merged for their few bytes."""
    conf = df.sparkSession.conf
    n = max(3 * df.sparkSession.sparkContext.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *by)
