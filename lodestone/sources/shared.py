"""The folder that the driver and all executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of numbers or short words that every task may hold.
FEW = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode, where driver and executors are one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, name: str) -> DataFrame:
    """df (keys of a large table) written and counted, broadcast where it has no more than FEW rows: Spark doesn't know that before it has shuffled the large table."""
    kept = written(df, name)
    return F.broadcast(kept) if kept.count() <= FEW else kept


def spread(df: DataFrame) -> DataFrame:
    """df dealt out anew where its scan has fewer splits than there are cores, for heavy work on every row. df is a scan, without shuffles."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
