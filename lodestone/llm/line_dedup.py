"""Line deduplication: a suffix array over line sequences, by distributed prefix doubling.

The corpus is one sequence of lines by (doc_id, line), with a separator after each document. Level 0 ranks the
lines that occur again. Level k + 1 joins the ranks of a place and of the place 2^k lines on, and ranks the pairs that
occur again, so it orders suffixes by their first 2^(k+1) lines: those of one rank are an interval of the suffix
array whose longest common prefix is at least that long. Ranks are numbered over range partitions. Places whose prefix is
unique leave at each level, so the work shrinks to the repeated runs.

Two suffixes have a common prefix of t lines, 2^k <= t < 2^(k+1), exactly if their ranks at level k agree
at both ends of it, which gives the interval of any length without the whole array. A run of t lines with at least
``min_words`` words that occurs earlier is a later copy. All
maximal runs with that many words are unions of the shortest such runs that start or end at each line, so
it is enough to test those: all lines of later copies are deleted. The first copy of a run stays, but for lines in which it
overlaps an earlier one: of six equal lines of 30 words the first stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ordinals, table, written

MIN_WORDS = 50
_NULL_ID = -(1 << 63)


def _text_key(text: Column) -> Column:
    return F.to_binary(F.md5(F.coalesce(text, F.lit(""))), F.lit("hex"))


def _doc(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(_NULL_ID))


def shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, the lines of the shortest run of at least ``least`` words from it, and up to it; 0 if none."""
    n = len(words)
    upto = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(upto, upto[:-1] + least, side="left")  # first end whose words suffice
    forward = np.where(end <= n, end - np.arange(n), 0)
    start = np.searchsorted(upto, upto[1:] - least, side="right") - 1  # last start whose words suffice
    backward = np.where(upto[1:] >= least, np.arange(1, n + 1) - start, 0)
    return np.maximum(forward, 0), np.maximum(backward, 0)


def lines(docs: DataFrame, least: int) -> DataFrame:
    """d, th (document), pos, h (128-bit hash of the line), fwd, bwd (see shortest_runs)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                index, pos, hashes, fwd, bwd = [], [], [], [], []
                for i, text in enumerate(s.column(2).to_pylist()):
                    own = text.split("\n")
                    f, g = shortest_runs(np.fromiter((len(x.split()) for x in own), np.int64, len(own)), least)
                    index.append(np.full(len(own), i))
                    pos.append(np.arange(len(own), dtype=np.int32))
                    hashes += [xxhash.xxh3_128_digest(x) for x in own]
                    fwd.append(f)
                    bwd.append(g)
                take = pa.array(np.concatenate(index))
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).take(take), s.column(1).take(take), pa.array(np.concatenate(pos)), pa.array(hashes, pa.binary()), pa.array(np.concatenate(fwd).astype(np.int32)), pa.array(np.concatenate(bwd).astype(np.int32))],
                    names=["d", "th", "pos", "h", "fwd", "bwd"],
                )

    used = docs.select(_doc().alias("d"), _text_key(F.col("text")).alias("th"), F.coalesce("text", F.lit("")).alias("t"))
    return used.mapInArrow(run, "d bigint, th binary, pos int, h binary, fwd int, bwd int")


def _place() -> Column:
    return F.struct("d", "th", "pos")


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with the rank of their ``by`` columns among those that several rows agree in; others leave.

    The ranks are a table of their own before rows meet them, so a frequent key is counted in each task first, and its rows are
    dealt to several tasks where Spark finds their partition skewed.
    """
    again = rows.groupBy(*by).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).filter("first != last").select(*by)
    return rows.join(ordinals(again, *map(F.col, by), name="rank"), by)


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, th, start, n: runs of lines of at least min_words words that occur earlier in the corpus."""
    level = _ranked(written(lines(docs, min_words), "lines"), ["h"]).groupBy("d", "th", "pos").agg(F.first("rank").alias("rank"), F.first("fwd").alias("fwd"), F.first("bwd").alias("bwd"))
    level = written(level, "level0")
    runs = (
        level.select("d", "th", F.explode(F.array(F.struct(F.col("pos").alias("start"), F.col("fwd").alias("n")), F.struct((F.col("pos") - F.col("bwd") + 1).alias("start"), F.col("bwd").alias("n")))).alias("r"))
        .select("d", "th", "r.start", "r.n").filter("n > 0").distinct()
    )
    runs = written(runs, "runs")
    longest = runs.agg(F.max("n")).first()[0] or 0
    level = level.select("d", "th", "pos", "rank")
    found, k = None, 0
    while (1 << k) <= longest:
        own = runs.filter((F.col("n") >= 1 << k) & (F.col("n") < 2 << k))
        head = own.join(level.withColumnsRenamed({"pos": "start", "rank": "head"}), ["d", "th", "start"])
        tail = level.select("d", "th", F.col("pos").alias("at"), F.col("rank").alias("tail"))
        both = head.withColumn("at", F.col("start") + F.col("n") - (1 << k)).join(tail, ["d", "th", "at"])
        both = written(both.select("d", "th", F.col("start").alias("pos"), "n", "head", "tail"), "ends")
        interval = ["n", "head", "tail"]
        firsts = written(both.groupBy(*interval).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).filter("first != last").select(*interval, "first"), "intervals")
        copies = both.join(firsts, interval).filter(_place() != F.col("first")).select("d", "th", F.col("pos").alias("start"), "n")
        found = copies if found is None else found.unionByName(copies)
        if (2 << k) > longest:
            break
        ahead = level.select("d", "th", (F.col("pos") - (1 << k)).alias("pos"), F.col("rank").alias("b"))
        pairs = written(level.select("d", "th", "pos", F.col("rank").alias("a")).join(ahead, ["d", "th", "pos"]), "pairs")
        level = written(_ranked(pairs, ["a", "b"]).select("d", "th", "pos", "rank"), "level")
        k += 1
    if found is None:
        return docs.sparkSession.createDataFrame([], "d bigint, th binary, start int, n int")
    return written(found, "copies")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs whose text lacks later copies, with n_lines (before) and n_removed; n_chars, if there, is set anew.

    "Earlier" is by doc_id (null first), then text hash, then line. Rows that agree in doc_id and text are one
    document: they are treated alike and are no copies of each other. A null text stays null, has one line (an
    empty one) and loses none; other columns stay, those named as an added one give way.
    """
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in ("n_lines", "n_removed")))
    spans = later_copies(docs, min_words).groupBy(F.col("d").alias("__d"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("start", "n")).alias("__spans"))
    joined = docs.withColumns({"__d": _doc(), "__th": _text_key(F.col("text"))}).join(spans, ["__d", "__th"], "left").drop("__d", "__th")
    names = docs.columns
    at = [c.lower() for c in names].index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, before, removed = [], [], []
            for text, cut in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                own = (text or "").split("\n")
                keep = np.ones(len(own), bool)
                for c in cut or ():
                    keep[c["start"] : c["start"] + c["n"]] = False
                texts.append(text if keep.all() else "\n".join(x for x, k in zip(own, keep, strict=True) if k))
                before.append(len(own))
                removed.append(len(own) - int(keep.sum()))
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(before, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_lines", "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = joined.mapInArrow(run, f"{schema}, n_lines bigint, n_removed bigint")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


def drop_copied_lines(docs: DataFrame) -> DataFrame:
    """The stage of a pipeline: columns as they are, without documents that lost all their lines."""
    out = dedup_lines(docs)
    return out.filter("n_removed < n_lines or n_removed = 0").select(*(f"`{c}`" for c in docs.columns))


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
