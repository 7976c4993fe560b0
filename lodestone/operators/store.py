"""The chunk store: Parquet with typed columns and an ordinal, filters as predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .legal import FILTERS
from .rank import near
from .vectors import VectorIndex, build

_COMPARED = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
}
_KEPT = (T.StringType, T.BooleanType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.FloatType, T.DoubleType)


def matching(column: str, wanted: str) -> Column:
    """column equals the column wanted, where that holds a filter; none, "" and "all" hold none."""
    return F.coalesce(F.col(wanted), F.lit("")).isin("", "all") | (F.col(column) == F.col(wanted))


def base_filters(filters: dict | None) -> dict:
    """The filters that name a column of FILTERS and hold a value; None, "" and "all" hold none."""
    return {k: v for k, v in (filters or {}).items() if k in FILTERS and v not in (None, "", "all")}


def where(filters: dict | None) -> Column:
    """Filters as one predicate: {column: value} or {column: {"$gt": value, ...}}, all of them; "$and" and "$or" hold lists of filters."""

    def one(key: str, value: object) -> Column:
        if key in ("$and", "$or"):
            return reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), map(where, value))
        if isinstance(value, dict):
            return reduce(lambda a, b: a & b, (_COMPARED[op](F.col(key), v) for op, v in value.items()))
        return F.col(key) == value

    return reduce(lambda a, b: a & b, (one(k, v) for k, v in (filters or {}).items()), F.lit(True))


def normalised(df: DataFrame, apart: tuple[str, ...] = ("id", "ord", "text", "embedding")) -> DataFrame:
    """df with its metadata columns as stores keep them: null strings are "", lists, maps and structs JSON, others than numbers and
    booleans their string; the columns ``apart`` stay."""

    def kept(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if f.name in apart:
            return c
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        elif not isinstance(f.dataType, _KEPT):
            c = c.cast("string")
        else:
            return F.coalesce(c, F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else c
        return F.coalesce(c, F.lit("")).alias(f.name)

    return df.select(*map(kept, df.schema))


def chunk_rows(docs: DataFrame) -> DataFrame:
    """docs with id and text as chunks have them: text, else content, else ""; id, else chunk_id, else the code and article of its place. Columns that
    are not there count as null."""
    have = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit(None).cast("string")
    place = F.concat(F.coalesce(have("ma_van_ban"), F.lit("")), F.lit("_"), F.coalesce(have("dieu"), F.lit("")))
    return docs.withColumns({"id": F.coalesce(have("id"), have("chunk_id"), place), "text": F.coalesce(have("text"), have("content"), F.lit(""))})


class ChunkStore:
    """Chunks in a Parquet folder, partitioned by document code; ord is the order in which they came."""

    def __init__(self, spark: SparkSession, path: str, partition: str = "ma_van_ban") -> None:
        self.spark, self.path, self.partition = spark, path, partition

    def append(self, chunks: DataFrame) -> None:
        """Adds chunks with normalised metadata; rows without an id get one, all an ord behind those that are there."""
        if not chunks.limit(1).count():
            return
        if "id" not in chunks.columns:
            chunks = chunks.withColumn("id", F.expr("uuid()"))
        try:
            last = self.scan().agg(F.max("ord")).first()[0]
        except Exception as e:  # nothing is there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            last = None
        rows = normalised(chunks).withColumn("ord", F.monotonically_increasing_id() + (0 if last is None else last + 1))
        rows.write.mode("append").partitionBy(self.partition).parquet(self.path)

    def scan(self, filters: dict | None = None) -> DataFrame:
        """All chunks that pass the filters; those on the partition column prune folders."""
        return self.spark.read.parquet(self.path).filter(where(filters))

    def page(self, filters: dict | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
        return self.scan(filters).orderBy("ord").offset(offset).limit(limit)

    def containing(self, phrase: str, limit: int = 10, offset: int = 0) -> DataFrame:
        return self.scan().filter(F.contains("text", F.lit(phrase))).orderBy("ord").offset(offset).limit(limit)

    def nearest(self, queries: DataFrame, k: int = 10, filters: dict | None = None, phrase: str | None = None) -> DataFrame:
        """query_id, ord, distance, rank, score of the k nearest chunks to each of queries (query_id, q), among those that pass the filters and
        hold the phrase."""
        rows = self.scan(filters)
        if phrase is not None:
            rows = rows.filter(F.contains("text", F.lit(phrase)))
        return near(rows.select(F.col("ord").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")), queries, k).withColumnRenamed("vec_id", "ord")

    def results(self, queries: DataFrame, k: int = 10, filters: dict | None = None, phrase: str | None = None) -> DataFrame:
        """The rows of nearest with each chunk's id, text and metadata (all columns but the vector), by query and rank."""
        rows = self.scan(filters).drop("embedding")
        return self.nearest(queries, k, filters, phrase).join(rows, "ord").orderBy("query_id", "rank")

    def indexed(self, path: str | None = None) -> VectorIndex:
        """A vector index of the chunks that are there now, by ord, with the columns that filters may name."""
        rows = self.scan()
        return build(rows.select(F.col("ord").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), *(c for c in FILTERS if c in rows.columns)), path)

    def delete(self, ids: DataFrame, to: str) -> ChunkStore:
        """The store without the given ids, written to a new folder; the old one stays for its readers."""
        self.scan().join(ids.select("id").distinct(), "id", "left_anti").write.partitionBy(self.partition).parquet(to)
        return ChunkStore(self.spark, to, self.partition)

    def reset(self) -> None:
        """Leaves no chunk, and the columns."""
        schema = self.scan().schema
        self.spark.createDataFrame([], schema).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self.path)

    def count(self) -> int:
        return self.scan().count()
