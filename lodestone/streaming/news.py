"""Landed news as a stream that ends in chunks: each version of an article once, cleaned, classified, cut and appended.

Which versions an article has had is state of its key in a RocksDB state store, on disk and in the checkpoint, so memory doesn't grow with the keys and no batch reads what
earlier ones wrote. A version is forgotten ``keep`` days after it came; one that comes again later counts as new. A batch owns the folder that it appends,
and writes it anew when it is repeated, so a restart repeats and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.functions import rules
from lodestone.functions import text as T
from lodestone.operators import news as N
from lodestone.sources.shared import new_path

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARTICLE = "article string, title string, url string, source string, at string, content string, version string"
CHUNK = "article string, version string, chunk_index int, chunk_id string, title string, url string, source string, at string, topic string, relevance double, references array<string>, text string, batch bigint"


class Versions(StatefulProcessor):
    """The rows of an article whose version hasn't come before; a timer forgets versions that came ``keep`` ago."""

    def __init__(self, keep: timedelta) -> None:
        self.keep = int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "version string", "came bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for f in rows:
            new = []
            for i, (version, came) in enumerate(zip(f["version"], f["came"], strict=True)):
                if not self.seen.containsKey((version,)):
                    at = came.value // 1_000_000
                    self.seen.updateValue((version,), (at,))
                    self.handle.registerTimer(at + self.keep)
                    new.append(i)
            yield f.iloc[new].drop(columns="came")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = expiredTimerInfo.getExpiryTimeInMs() - self.keep
        for (version,), (came,) in list(self.seen.iterator()):
            if came <= last:
                self.seen.removeKey((version,))
        return iter([])

    def close(self) -> None:
        pass


def keyed(news: DataFrame) -> DataFrame:
    """News (title, url, source, at, content) with article, the key of each (its address, else its title, else its content's hash), and the version of its words."""
    version = T.content_hash(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    key = F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.nullif(F.trim("title"), F.lit("")), version)
    return news.select(key.alias("article"), "title", "url", "source", "at", "content", version.alias("version"))


def chunked(news: DataFrame, least: int = 0) -> DataFrame:
    """Chunks of keyed news: the content as the cleaner leaves it, with ``least`` characters at least, under its topic, relevance and references."""
    said = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    known = news.withColumn("text", N.cleaned(F.col("title"), F.col("content"), least)).filter("text <> ''")
    rated = known.withColumns({"topic": T.first_class(said, rules.NEWS_TOPICS, "general_tax_news"), "relevance": T.weight_in(said, rules.NEWS_WEIGHTS), "references": T.references(F.col("text"))})
    each = rated.select("*", F.posexplode(N.chunks(F.col("title"), F.col("text"))).alias("chunk_index", "chunk"))
    name = F.concat_ws("_", F.md5("article"), F.left("version", F.lit(8)), F.col("chunk_index").cast("string"))
    return each.select("article", "version", "chunk_index", name.alias("chunk_id"), "title", "url", "source", "at", "topic", "relevance", "references", F.col("chunk").alias("text"))


def to_chunks(spark: SparkSession, path: str, schema: str, at: str | None = None, files: int = 1000, keep: timedelta = timedelta(days=365), least: int = 0) -> DataFrame:
    """The chunks of all news files (Parquet: title, url, source, at, content) landed under path so far; the stream reads what is new since the last call with
    the same ``at``, ``files`` files a batch, and stops."""
    at = at or new_path(spark, "news-stream")
    # time is that of the batch, so no row is ever late
    feed = keyed(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)).withColumn("came", F.current_timestamp()).withWatermark("came", "0 seconds")
    new = feed.groupBy("article").transformWithStateInPandas(Versions(keep), outputStructType=ARTICLE, outputMode="Append", timeMode="EventTime")

    def append(batch: DataFrame, n: int) -> None:
        chunked(batch, least).write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        new.writeStream.foreachBatch(append).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(CHUNK).option("basePath", f"{at}/out").parquet(f"{at}/out")
