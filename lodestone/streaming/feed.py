"""Landed feed files as a stream: each key once, written exactly once."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import shared_dir


def first_of_each(spark: SparkSession, path: str, schema, keys: list[str], files: int = 1000, at: str | None = None) -> DataFrame:
    """The distinct keys of all rows under path, by a stream that reads what is there, ``files`` files a batch, and stops.

    Each batch adds the keys that no earlier batch has; the keys written are the state, so rows that come late lose nothing and no
    state is held in memory. A batch owns a folder that it writes anew when it is repeated, so a restart (with the same ``at``) repeats
    and loses nothing.
    """
    at = at or f"{shared_dir(spark)}/lodestone/{uuid.uuid4().hex}"
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).select(*keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in feed.schema)

    def add(batch: DataFrame, n: int) -> None:
        new = batch.distinct()
        if n:
            known = spark.read.schema(f"{kinds}, batch bigint").option("basePath", f"{at}/out").parquet(f"{at}/out").filter(F.col("batch") < n)
            same = reduce(lambda a, b: a & b, (F.col(f"new.{k}").eqNullSafe(F.col(f"known.{k}")) for k in keys))
            new = new.alias("new").join(known.alias("known"), same, "left_anti")
        new.write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    feed.writeStream.foreachBatch(add).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{kinds}, batch bigint").option("basePath", f"{at}/out").parquet(f"{at}/out").select(*keys)
