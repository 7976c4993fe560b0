"""Token ids in ORC files by rising document id.

Ids are integer lists, so ORC stores them with integer run-length encoding. Rows rise by doc_id over and
within files; stripes (STRIPE bytes) can be read in parallel, and their statistics, the row index
(every STRIDE rows) and the Bloom filter on doc_id let a reader pass over what it doesn't need.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import new_path, partitions, table, written
from .encoding import encoder

STRIPE, STRIDE, END = 16 << 20, 1_000, 2
#: Rows after which a writer looks whether its stripe is full, so that long documents don't fill its memory.
CHECK = 500
SCHEMA = "doc_id bigint, part int, row bigint, ids array<int>"


def write_ids(docs: DataFrame, vocabulary: str, path: str, end: int = END) -> None:
    """Writes doc_id, part (file), row (place in it) and ids of every row of docs (doc_id, text).

    Each document is its text's ids and then ``end``; a null text is empty. Rows rise by doc_id, null first,
    repeated ids by text; other columns are ignored; an empty table gives files without rows.
    """
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, enc = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                ids = [enc.encode(t.as_py()) + last for t in s.column(1)]
                n = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(n), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(row, row + len(ids))), lists], names=["doc_id", "part", "row", "ids"])
                row += len(ids)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").option("orc.stripe.size", STRIPE).option("orc.rows.between.memory.checks", CHECK).option("orc.create.index", "true").option("orc.row.index.stride", STRIDE)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """All rows; a filter on doc_id is pushed down to the files."""
    return spark.read.schema(SCHEMA).orc(path)


def spans(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all rows before it), n_tokens, ids_crc32, read back from the files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            off, raw = np.asarray(lists.offsets, np.int64), memoryview(np.ascontiguousarray(np.asarray(lists.values), "<i4").tobytes())
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(off)), pa.array(crc, pa.int64())], names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    rows = written(read_ids(spark, path).mapInArrow(run, "doc_id bigint, part int, row bigint, n_tokens bigint, ids_crc32 bigint"), "spans")
    before = rows.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a file
    within = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("within", within).join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op4_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return spans(spark, path)
