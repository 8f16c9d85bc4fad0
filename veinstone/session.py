"""Session factory and the helpers every operator shares: table access, checked broadcasts, durable cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings the operators rely on; all are safe to set on a running session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Rows of a side that may be broadcast after its size has been counted.
BROADCAST_ROWS = 20_000


def get_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster use the session the cluster gives and call `prepare` on it."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veinstone")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to any session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir if set, else the session's checkpoint folder, else (tests, local mode) a
    temporary one that is then set."""
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or (given.get() if given.isDefined() else None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "veinstone-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder as a Parquet table and read from there: a cut of the lineage that is safe against lost
    executors, from which later reads prune columns and push filters. The table is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _place(spark, path)
    files.deleteOnExit(at)
    read = spark.read.schema(df.schema).parquet(path)
    read._stored_at = path
    return read


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, deleted with all that is put there when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = _place(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """`stored` under a name of no meaning."""
    return stored(df, "cut")


def discard(df: DataFrame) -> None:
    """Delete the table behind what `stored` gave, once nothing reads it any more."""
    files, at = _place(df.sparkSession, df._stored_at)
    files.delete(at, True)


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data directory, only the columns named (all if none)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def once(df: DataFrame, *key: str) -> DataFrame:
    """One row per key; repeats are whole rows again, so any of them serves. Partial aggregation runs before the shuffle."""
    return df.dropDuplicates(list(key))


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if it has at most `rows` rows (counted up to one more), else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
