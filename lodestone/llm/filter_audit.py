"""What each filter removes in each order of filters, and what it takes from good and toxic documents.

Duplicates are found by sorting: documents go to ranges of (fingerprint, doc_id) and are sorted there by fingerprint,
full text and doc_id, so each is compared with the one before it. The bounds of ranges pass through the driver,
so they hold the id in place of the text, whose length nothing bounds. A run of equal texts may go on in the next ranges:
every range tells the texts of its first and last fingerprint, and the smallest id over all ranges decides.

Each document becomes a mask of the filters that it fails. Masks are counted by part (at most 32 a part), and all orders of
filters are read off these counts, so they cost nothing more per document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, partitions, table, written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, MARKS = 200, 50, 3, "[#$%&*|]"

_SCHEMA = "doc_id bigint, part string, mask int, again boolean, fp bigint, range int, place int, text string"


def quality_mask(text: Column) -> Column:
    """The filters A to D that a text fails, as the bits 1, 2, 4 and 8. Percentages are compared as whole numbers."""
    all_words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def mask(w: Column) -> Column:
        fails = (
            F.size(w) < LEAST_WORDS,
            F.size(F.array_distinct(w)).cast("long") * 100 < F.size(w).cast("long") * LEAST_DISTINCT,
            F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * MOST_UPPER,
            F.regexp_like(text, F.lit(MARKS)),
        )
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))

    return let(all_words, mask)


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order, each compared with the one before it.

    again: a smaller id with this text stands in the range. place: the number of its text among those of the range's first
    fingerprint, which may go on from earlier ranges. Rows with a text are the texts of the first and last fingerprint.
    """
    from pyspark import TaskContext

    at = TaskContext.get().partitionId()
    before: tuple | None = None  # fingerprint, text and smallest id of the last group
    first: int | None = None
    opened, last = -1, []  # groups of the first fingerprint so far; those of the last one
    for b in batches:
        if not b.num_rows:
            continue
        fp, text = b.column("fp").to_numpy(), b.column("text")
        ids = b.column("doc_id")
        first = fp[0] if first is None else first
        starts = np.empty(len(fp), bool)
        starts[0] = before is None or before[0] != fp[0] or before[1] != text[0].as_py()
        starts[1:] = (fp[1:] != fp[:-1]) | ~np.asarray(pc.equal(text[1:], text[:-1]))
        head = np.maximum.accumulate(np.where(starts, np.arange(len(fp)), -1))
        least = ids.take(pa.array(np.maximum(head, 0)))
        if before is not None and (head < 0).any():
            least = pc.if_else(pa.array(head < 0), pa.scalar(before[2], pa.int64()), least)
        again = pc.fill_null(pc.greater(ids, least), False)
        place = np.cumsum(starts & (fp == first)) + opened
        opened = int(place[-1])
        place = pa.array(place, pa.int32(), mask=fp != first)
        mask = b.column("mask")
        none = pa.nulls(len(fp), pa.string())
        yield pa.RecordBatch.from_arrays([ids, b.column("part"), mask, again, pa.array(fp), pa.array(np.full(len(fp), at), pa.int32()), place, none], names=[f.split()[0] for f in _SCHEMA.split(", ")])
        new = np.flatnonzero(starts)
        edges = [(int(fp[i]), ids[i].as_py(), int(place[i].as_py()), text[i].as_py()) for i in new[fp[new] == first]]
        if edges:
            yield _edges(edges, at)
        if before is not None and fp[-1] != before[0]:
            last = []
        last += [(int(fp[i]), ids[i].as_py(), None, text[i].as_py()) for i in new[fp[new] == fp[-1]]]
        before = (int(fp[-1]), text[-1].as_py(), least[-1].as_py())
    if last:
        yield _edges(last, at)


def _edges(rows: list[tuple], at: int) -> pa.RecordBatch:
    fp, ids, place, text = zip(*rows, strict=True)
    n = len(rows)
    columns = [pa.array(ids, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.array(fp, pa.int64()), pa.array([at] * n, pa.int32()), pa.array(place, pa.int32()), pa.array(text, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _SCHEMA.split(", ")])


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask: the filters that each document fails.

    A null text is empty and a null lang the part of the empty string. A row repeats an earlier one if a smaller doc_id has its text; equal
    ids never repeat each other, and a row without id neither repeats nor is repeated. Columns other than
    doc_id, text and lang are ignored; an empty table gives an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("fp"))
    ids = F.col("doc_id").asc_nulls_last()
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), F.col("fp").asc(), ids).sortWithinPartitions("fp", "text", ids)
    found = written(ranged.select("doc_id", "part", quality_mask(F.col("text")).cast("int").alias("mask"), "text", "fp").mapInArrow(_compared, _SCHEMA), "compared")
    edges = found.filter("text is not null")
    smallest = edges.groupBy("fp", "text").agg(F.min("doc_id").alias("least"))
    # one row a range, but for texts that share a fingerprint
    before = edges.filter("place is not null").join(smallest, ["fp", "text"]).filter(F.col("least") < F.col("doc_id")).select("range", "place", F.lit(True).alias("earlier")).distinct()
    own = found.filter("text is null").join(F.broadcast(before), ["range", "place"], "left")
    repeats = F.col("doc_id").isNotNull() & (F.col("again") | F.coalesce("earlier", F.lit(False)))
    return own.select("doc_id", "part", (F.col("mask") + F.when(repeats, 16).otherwise(0)).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with what the step's filter does there; an empty table gives none.

    A label counts once for each document row of its id, however often the label is repeated; rows without id have none.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = masks(docs).join(marks, "doc_id", "left")
    counts = marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    orders = " ".join(map("".join, permutations(FILTERS)))
    steps = counts.withColumn("filter_order", F.explode(F.split(F.lit(orders), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord("A"))
    earlier = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1), F.lit(0), lambda m, c: m.bitwiseOR(bit(c)))
    own = bit(F.substr("filter_order", F.col("step"), F.lit(1)))
    steps = steps.select("part", "filter_order", "step", "mask", "n", "good", "toxic", own.alias("own"), earlier.alias("earlier"))
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    passed = F.col("mask").bitwiseAND(F.col("earlier")) == 0
    total = lambda when, what: F.sum(F.when(when, F.col(what)).otherwise(0))
    return steps.groupBy("part", "filter_order", "step").agg(
        total(passed & ~fails, "n").alias("kept"),
        total(passed & fails, "n").alias("removed"),
        total(~passed & fails, "n").alias("redundant"),
        total(F.col("mask") == F.col("own"), "n").alias("unique_fails"),
        total(passed & fails, "good").alias("good_lost"),
        total(passed & fails, "toxic").alias("toxic_lost"),
        # of all orders, a filter stands first among the k that a document fails in one of k
        F.sum(F.when(fails, F.col("n") * F.floor(F.lit(factorial(len(FILTERS))) / F.bit_count("mask"))).otherwise(0)).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
