"""Session helpers: a tuned local session, the shared folder and cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session for one machine; on a cluster use the session that is there."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vecquarry")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, on local masters where it is unset, a temporary one."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"vecquarry-{sc.applicationId}")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and every later use sees the same rows
    even if executors are lost. The files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.getParent())
    system.mkdirs(hadoop)
    system.deleteOnExit(hadoop)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salt: Column, salts: int | None = None, how: str = "inner") -> DataFrame:
    """Join of many rows per key (left) with one row per key (right), where one key may hold a large share of left.

    Each right row is copied `salts` times, so that a hot key spreads over as many tasks: 16, or an eighth of the shuffle
    partitions if that is more. `salt` must be a deterministic column of left. Null keys match nothing, as in any join.
    """
    salts = salts or max(16, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    return salted.join(spread, [*keys, "__salt"], how).drop("__salt")
