"""A word index in Parquet: documents are split into words once, questions read only what can still matter.

Documents fall into blocks of about BLOCK that lie beside each other in the table, and a word has one row a block that holds it: its documents with their
counts and lengths, and the largest count and least length among them. Tasks make the blocks of what they read, so nothing is shuffled but words with their
numbers. From counts and lengths alone follows how much a block can give a
question at most. A question's FIRST most promising blocks are read in full; its k-th score there is what any other block must reach to be read at
all. So ranks are those of a full scan, and a frequent word is spread over as many rows as there are blocks. Blocks meet questions in pieces of PIECE blocks and groups of
ASKED questions: a task adds up the scores of both and gives k rows a question. A search runs jobs while it is built: the
questions' words, blocks and first hits are written once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.text import tokens
from lodestone.sources.shared import few, new_path, spread, written

from .rank import FLOOR, K1, B, top

BLOCK, FIRST = 256, 4
#: Blocks of a piece (a power of two), and questions of a group.
PIECE, ASKED = 32, 4096
#: What rounding can add to a score.
SLACK = 1e-5


@dataclass(frozen=True)
class Postings:
    """The folders of an index: words by block, and words with the number of their documents."""

    spark: SparkSession
    path: str
    n: int
    words: int
    doc_type: str

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(_blocks_schema(self.doc_type)).parquet(f"{self.path}/blocks")

    @property
    def tokens(self) -> DataFrame:
        return self.spark.read.schema("token string, df bigint, raw double").parquet(f"{self.path}/tokens")


def _blocks_schema(doc_type: str) -> str:
    return f"token string, block int, most_tf bigint, least_dl int, df bigint, cf bigint, entries array<struct<doc_id:{doc_type},tf:bigint,dl:int>>"


def _block(number: int, doc: pa.Array, words: pa.Array) -> pa.RecordBatch:
    """The rows of the documents of one block: ids, and the words of each."""
    dl = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
    coded = words.flatten().dictionary_encode()
    pairs, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(dl)) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
    code, owner = np.divmod(pairs, max(1, len(dl)))
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.intp)
    entries = pa.StructArray.from_arrays([doc.take(pa.array(owner)), pa.array(tf, pa.int64()), pa.array(dl[owner], pa.int32())], names=["doc_id", "tf", "dl"])
    of = lambda f, x: f.reduceat(x, first) if len(first) else x[:0]
    ends = np.append(first, len(code))
    columns = [
        coded.dictionary, pa.array(np.full(len(first), number), pa.int32()), pa.array(of(np.maximum, tf), pa.int64()), pa.array(of(np.minimum, dl[owner]), pa.int32()), pa.array(np.diff(ends), pa.int64()),
        pa.array(of(np.add, tf), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["token", "block", "most_tf", "least_dl", "df", "cf", "entries"])


def build(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> Postings:
    """The index of docs (doc_id, text) at a new folder. A null text has no words; a doc_id that stands twice is two documents of one name."""
    spark = docs.sparkSession
    path = path or new_path(spark, "postings")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = _blocks_schema(doc_type)
    said = lambda df: df.select("doc_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("t"))
    n, once = docs.agg(F.count("*"), F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).first()

    def beside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 16
        for b in batches:
            for at in range(0, b.num_rows, block):
                yield _block(number, b.column(0).slice(at, block), b.column(1).slice(at, block))
                number += 1

    def gathered(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        return pa.Table.from_batches([_block(key[0].as_py(), *(pa.concat_arrays(t.column(c).chunks) for c in ("doc_id", "t")))])

    if not n or n == once:
        rows = said(spread(docs.select("doc_id", "text"))).mapInArrow(beside, schema)
    else:  # documents of one name must meet in one block
        rows = said(docs).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // block))).cast("int")).groupBy("block").applyInArrow(gathered, schema)
    rows.write.parquet(f"{path}/blocks")
    made = spark.read.schema(schema).parquet(f"{path}/blocks")
    counted = written(made.groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), "counted")
    words = counted.agg(F.sum("cf")).first()[0] or 0
    # documents without words count too, so n is that of the input
    raw = F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    counted.select("token", "df", raw.alias("raw")).write.parquet(f"{path}/tokens")
    return Postings(spark, path, n, words, doc_type)


def _weight(tf: Column, dl: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def _asked(index: Postings, questions: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """The weight of every word of a question, what each block can give it at most (place: the most promising first), and the mean length."""
    mean = index.words / index.n if index.words else 1.0
    asked = questions.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qn"))
    floor = index.tokens.agg((F.avg("raw") * FLOOR).alias("floor"))
    known = asked.join(index.tokens, "token").crossJoin(floor)  # one row
    weighted = written(known.select("query_id", "token", (F.col("qn") * F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw"))).alias("w")), "weighted")
    heads = index.blocks.select("token", "block", "most_tf", "least_dl").join(_words(weighted), "token", "left_semi").join(weighted, "token")
    most = heads.groupBy("query_id", "block").agg(F.sum(F.greatest(F.lit(0.0), F.col("w") * _weight(F.col("most_tf"), F.col("least_dl"), mean))).alias("most"))
    placed = most.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("most"), "block")))
    return weighted, written(placed, "most"), mean


def _words(weighted: DataFrame) -> DataFrame:
    return few(weighted.select("token").distinct(), "words")


def _begun(index: Postings, weighted: DataFrame, most: DataFrame, mean: float, k: int, first: int) -> tuple[DataFrame, DataFrame]:
    """The k best of a question's first blocks, and the further blocks that can still change them."""
    begun = written(_best(_scores(index, weighted, most.filter(F.col("place") <= first), mean, k), k), "begun")
    least = begun.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    more = most.filter(F.col("place") > first).join(least, "query_id", "left")
    return begun, more.filter(F.col("least").isNull() | (F.col("most") + SLACK >= F.col("least")))


def _scores(index: Postings, weighted: DataFrame, of: DataFrame, mean: float, k: int) -> DataFrame:
    """query_id, doc_id, score: the k best of each question in each piece, in the blocks that ``of`` (query_id, block) names."""
    query_type = weighted.schema["query_id"].dataType
    none = pa.schema([("query_id", to_arrow_type(query_type)), ("doc_id", to_arrow_type(index.blocks.schema["entries"].dataType.elementType["doc_id"].dataType)), ("score", pa.float64())]).empty_table()
    shift = PIECE.bit_length() - 1
    groups = weighted.select("query_id").distinct().count() // ASKED + 1
    held = index.blocks.select("token", "block", "entries").join(_words(weighted), "token", "left_semi").join(few(of.select("block").distinct(), "wanted"), "block", "left_semi")
    held = held.withColumns({"piece": F.shiftright("block", shift), "qb": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    told = weighted.groupBy("query_id").agg(F.collect_list("token").alias("words"), F.collect_list("w").alias("w"))
    asked = of.groupBy("query_id", F.shiftright("block", shift).alias("piece")).agg(F.collect_set("block").alias("blocks")).join(told, "query_id")
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    schema = f"query_id {query_type.simpleString()}, doc_id {index.doc_type}, score double"

    def score(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return none
        v = v.sort_by("token")
        lists = pa.concat_arrays(v.column("entries").chunks)
        size, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
        coded = flat.field("doc_id").dictionary_encode(null_encoding="encode")
        code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        block = np.empty(len(names), np.int64)
        block[code] = np.repeat(v.column("block").to_numpy(), size)
        give = _weight(flat.field("tf").to_numpy(), flat.field("dl").to_numpy(), mean)
        token, ends = np.array(v.column("token").to_pylist(), object), np.concatenate([[0], np.cumsum(size)])
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        part = {t: slice(a, b) for t, a, b in zip(token[start], ends[start], ends[[*start[1:], len(token)]], strict=True)}
        out = []
        for i, (words, w, blocks) in enumerate(zip(q.column("words").to_pylist(), q.column("w").to_pylist(), q.column("blocks").to_pylist(), strict=True)):
            met = [(part[t], x) for t, x in zip(words, w, strict=True) if t in part]
            if not met:
                continue
            at = np.concatenate([code[s] for s, _ in met])
            total = np.round(np.bincount(at, np.concatenate([give[s] * x for s, x in met]), len(names)), 6)
            took = np.zeros(len(names), bool)
            took[at] = True
            took = np.flatnonzero(took & np.isin(block, blocks))
            if len(took) > k:
                took = took[total[took] >= np.partition(total[took], len(took) - k)[len(took) - k]]
            found = pa.table({"doc_id": names.take(pa.array(took)), "score": pa.array(total[took], pa.float64())}).sort_by([("score", "descending"), ("doc_id", "ascending")]).slice(0, k)
            out.append(found.add_column(0, "query_id", q.column("query_id").take(pa.array(np.full(len(found), i)))))
        return pa.concat_tables(out).combine_chunks() if out else none

    return asked.groupBy("piece", "qb").cogroup(held.groupBy("piece", "qb")).applyInArrow(score, schema)


def _best(rows: DataFrame, k: int) -> DataFrame:
    return top(rows, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def bm25(index: Postings, questions: DataFrame, k: int, first: int = FIRST) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each question (query_id, text).

    Okapi weights; an idf below 0 becomes FLOOR times the mean idf of all words; a word repeated in a question counts as often; scores have 6
    decimals and ties end at the smaller doc_id.
    """
    weighted, most, mean = _asked(index, questions)
    begun, more = _begun(index, weighted, most, mean, k, first)
    return _best(begun.select("query_id", "doc_id", "score").unionByName(_scores(index, weighted, more, mean, k)), k)


def blocks_read(index: Postings, questions: DataFrame, k: int, first: int = FIRST) -> tuple[int, int]:
    """How many blocks hold a word of a question, and how many of these bm25 reads in full, over all questions."""
    weighted, most, mean = _asked(index, questions)
    more = _begun(index, weighted, most, mean, k, first)[1]
    return most.count(), most.filter(F.col("place") <= first).count() + more.count()
