"""A substring index in Parquet: which documents hold a run of up to three characters, for phrases of any kind.

Documents fall into blocks of BLOCK that lie beside each other in the table; tasks make the blocks of what they read, so no text is shuffled.
Every distinct gram of 1, 2 and 3 characters of a text (in lower case) has one row for each block that
holds it: the places of its documents in the block, or a bit for each document where that is shorter. A phrase is looked up by its rarest grams (PROBES of them); documents that hold these
meet the phrase, and texts decide. So neither phrases nor questions are tried on all texts, and phrases of one character are found too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.sources.shared import few, new_path, spread, written

BLOCK, PROBES = 1024, 4
_BITS = np.uint64(21)
_LAST = np.uint64((1 << 21) - 1)


def folded(text: Column) -> Column:
    """Lower case in which every letter has one form, wherever it stands: the two small sigmas are one."""
    return F.translate(F.lower(text), "ς", "σ")


def grams(texts: list[str]) -> np.ndarray:
    """The distinct runs of 1, 2 and 3 characters of texts, none across two of them, as numbers: 21 bits a character, its code and one."""
    # two marks (0) end each text, so its last runs are the beginnings of runs of three
    a = np.frombuffer("".join(f"{t}\0\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = np.cumsum([len(t) + 2 for t in texts])
    a += np.uint64(1)
    a[np.concatenate([at - 1, at - 2])] = 0
    three = np.unique(a[:-2] << np.uint64(42) | a[1:-1] << _BITS | a[2:])
    three = three[three >> np.uint64(42) > 0]
    two = three >> _BITS << _BITS
    two = two[np.flatnonzero(np.diff(two, prepend=np.uint64(0)))]
    one = two >> np.uint64(42) << np.uint64(42)
    one = one[np.flatnonzero(np.diff(one, prepend=np.uint64(0)))]
    return np.concatenate([one, two[two >> _BITS & _LAST > 0], three[three & _LAST > 0]])


def shown(gram: int) -> str:
    """The characters of a gram's number."""
    return "".join(chr(c - 1) for c in (gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF) if c)


def _block(number: int, ids: pa.Array, texts: list[list[str]]) -> Iterator[tuple[list, pa.Array | None]]:
    """The rows of a block: its documents' ids under the empty gram, and for each gram how many of them hold it and which."""
    every = [grams(t) for t in texts]
    gram = np.concatenate(every)
    place = np.repeat(np.arange(len(every), dtype=np.uint16), [len(x) for x in every])
    order = np.argsort(gram, kind="stable")
    gram, place = gram[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.empty(0, np.intp)
    n = np.diff(np.append(first, len(gram)))
    names = np.array([shown(int(g)) for g in gram[first]], object)
    many = 2 * n >= (len(every) + 7) // 8
    bits = np.zeros((int(many.sum()), len(every)), bool)
    dense = np.repeat(many, n)
    bits[np.repeat(np.arange(len(bits)), n[many]), place[dense]] = True
    rows = np.packbits(bits, axis=1)
    for chosen, size, body in ((many, np.full(len(rows), rows.shape[1]), rows), (~many, 2 * n[~many], place[~dense])):
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        docs = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body.tobytes())])
        yield [pa.array(names[chosen], pa.string()), pa.array(np.full(len(size), number), pa.int32()), pa.array(n[chosen], pa.int64()), docs], None
    yield [pa.array([""]), pa.array([number], pa.int32()), pa.array([len(every)], pa.int64()), pa.array([None], pa.binary())], ids


def places(docs: bytes, n: int, size: int) -> np.ndarray:
    """The places that a row's bytes tell: n of the block's ``size`` documents."""
    if 2 * n >= (size + 7) // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(docs, np.uint8), count=size))
    return np.frombuffer(docs, np.uint16)


@dataclass(frozen=True)
class GramIndex:
    """The folder of an index: grams (gram, block, n, docs; the empty gram has all ids of a block), and counts (gram, n)."""

    spark: SparkSession
    path: str
    doc_type: str

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(_schema(self.doc_type)).parquet(f"{self.path}/grams")

    @property
    def grams(self) -> DataFrame:
        return self.rows.filter("gram <> ''").drop("ids")

    @property
    def blocks(self) -> DataFrame:
        return self.rows.filter("gram = ''").select("block", "ids")

    @property
    def counts(self) -> DataFrame:
        return self.spark.read.schema("gram string, n bigint").parquet(f"{self.path}/counts")


def _schema(doc_type: str) -> str:
    return f"gram string, block int, n bigint, docs binary, ids array<{doc_type}>"


def build(docs: DataFrame, texts: list[str], path: str | None = None) -> GramIndex:
    """The index of the columns ``texts`` of docs (doc_id, ...) at a new folder; no gram spans two columns, a null text has none."""
    spark = docs.sparkSession
    path = path or new_path(spark, "grams")
    doc_type = docs.schema["doc_id"].dataType

    def beside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kind = TaskContext.get().partitionId() << 16, pa.list_(to_arrow_type(doc_type))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                for columns, ids in _block(number, part.column(0), list(zip(*(c.to_pylist() for c in part.columns[1:]), strict=True))):
                    kept = pa.nulls(len(columns[0]), kind) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(kind)
                    yield pa.RecordBatch.from_arrays([*columns, kept], names=["gram", "block", "n", "docs", "ids"])
                number += 1

    held = spread(docs.select("doc_id", *texts)).select("doc_id", *(F.coalesce(folded(F.col(c)), F.lit("")).alias(f"t{i}") for i, c in enumerate(texts)))
    held.mapInArrow(beside, _schema(doc_type.simpleString())).write.parquet(f"{path}/grams")
    index = GramIndex(spark, path, doc_type.simpleString())
    index.grams.groupBy("gram").agg(F.sum("n").alias("n")).write.parquet(f"{path}/counts")
    return index


def candidates(index: GramIndex, phrases: DataFrame, probes: int = PROBES) -> DataFrame:
    """phrase, doc_id: the documents that hold the rarest grams of each phrase (phrase), each phrase once.

    An empty or null phrase has no grams and finds none.
    """
    keyed = phrases.filter("phrase <> ''").select("phrase").distinct().withColumn("f", folded(F.col("phrase")))
    n = F.char_length("f")
    own = F.when(n <= 3, F.array("f")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring("f", i, F.lit(3)))))
    asked = keyed.select("phrase", F.explode(own).alias("gram"))
    # a gram that no document has is the rarest
    known = asked.join(index.counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    chosen = known.withColumn("place", F.row_number().over(W.partitionBy("phrase").orderBy("n", "gram"))).filter(F.col("place") <= probes)
    size = F.count("*").over(W.partitionBy("phrase"))
    chosen = written(chosen.select("phrase", "gram", size.alias("size")), "chosen")
    met = index.grams.join(few(chosen.select("gram").distinct(), "asked"), "gram", "left_semi").join(chosen, "gram")
    kind = to_arrow_type(index.blocks.schema["ids"].dataType.elementType)

    def common(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        names, out = [], []
        if rows.num_rows and blocks.num_rows:
            ids = blocks.column("ids").combine_chunks().flatten()
            ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
            found: dict[str, list] = {}
            for phrase, size, n, docs in zip(*(rows.column(c).to_pylist() for c in ("phrase", "size", "n", "docs")), strict=True):
                found.setdefault(phrase, []).append((size, places(docs, n, len(ids))))
            for phrase, held in found.items():
                if len(held) == held[0][0]:
                    at = held[0][1]
                    for _, other in held[1:]:
                        at = np.intersect1d(at, other, assume_unique=True)
                    names += [phrase] * len(at)
                    out.append(ids.take(pa.array(at)))
        return pa.table({"phrase": pa.array(names, pa.string()), "doc_id": pa.concat_arrays(out).cast(kind) if out else pa.array([], kind)})

    return met.groupBy("block").cogroup(index.blocks.groupBy("block")).applyInArrow(common, f"phrase string, doc_id {index.doc_type}").distinct()
