"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Code points that separate words: the space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only in local mode, where they are one."""
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
    """df as a Parquet table in the shared folder: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def with_new(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns; an input column of the same name (in any case) gives way."""
    names = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *(v.alias(k) for k, v in columns.items()))


def ordinals(df: DataFrame, *order: Column, name: str = "ordinal") -> DataFrame:
    """df with its rows numbered from 1 in the given order, without one task that sees all rows.

    Range partitions are written once, so their bounds can't move; only one row per partition is
    summed up in order, and that many rows are broadcast.
    """
    n = partitions(df.sparkSession)
    placed = written(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()),
        "ordinals",
    ).withColumn("__part", F.shiftright("__at", 33))
    before = (
        placed.groupBy("__part")
        .agg(F.count("*").alias("__n"))
        .withColumn("__before", F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)))
        .select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    )
    return (
        placed.join(F.broadcast(before), "__part")
        .withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("__part", "__at", "__before")
    )


def cuts(df: DataFrame, column: str, n: int) -> list[float]:
    """At most n - 1 rising values of a number column that deal its rows into about equal ranges."""
    at = df.select(F.percentile_approx(column, [i / n for i in range(1, n)], 10 * n).alias("c")).first()["c"] if n > 1 else None
    return sorted({float(x) for x in at or []})


def bucket_of(df: DataFrame, column: str, bounds: list[float], name: str) -> DataFrame:
    """Adds the index of the range that holds column (a binary search in the JVM); nulls go to range 0."""
    from pyspark.ml.feature import Bucketizer

    if not bounds:
        return df.withColumn(name, F.lit(0))
    shadow = f"{name}_in"
    found = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol=shadow, outputCol=name).transform(
        df.withColumn(shadow, F.coalesce(F.col(column).cast("double"), F.lit(float("-inf"))))
    )
    return found.drop(shadow).withColumn(name, F.col(name).cast("int"))


LONG, STRING, DOUBLE, INT = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType()
