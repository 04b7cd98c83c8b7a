"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session that spark-submit gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quernel")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset on a local master."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not context.getCheckpointDir():
        if not named and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quernel-"))
    return named or context.getCheckpointDir()


_folders: list[str] = []  # what this driver has written with materialize()


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which release() deletes."""
    _folders.append(os.path.join(shared_dir(spark), f"quernel-{uuid.uuid4().hex}"))
    return _folders[-1]


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later steps survive the loss of executors."""
    spark = df.sparkSession
    folder = new_folder(spark)
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


_tables: list[str] = []  # names of bucketed tables


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write ``df`` once, split and sorted by ``key`` in the shared folder: joins on ``key`` don't shuffle it again."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"quernel_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.option("path", f"{new_folder(spark)}/{name}").option("compression", "zstd")
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    _tables.append(name)
    return spark.table(name)


def release(spark: SparkSession) -> int:
    """Delete the tables that this driver has materialized; call it once results are written. Returns their number."""
    done = 0
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches end at about BATCH_BYTES: 10,000 whole texts are tens of MB, which the JVM, outside its heap, and the worker hold several times."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
