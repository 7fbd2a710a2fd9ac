"""Session set-up shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest driver-built (configuration) frame that may be broadcast.
MAX_CONFIG_ROWS = 50_000


def build_session(app: str = "conform", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster, pass your own session instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CONFORM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (a local test) do
    we make a folder of our own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stage(df: DataFrame, label: str, folder: str | None = None, compression: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder (or to ``folder``) and read it back.

    For results that several later branches read: it cuts the lineage, gives the optimizer real
    sizes, and survives the loss of any executor. Without ``compression`` it is packed as the session
    packs tables.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark) + '/stage'}/{label}-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """The same packed well: for tables of a run, which stay until the query is done."""
    return stage(df, label, folder, "zstd")


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate tables once nothing reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
