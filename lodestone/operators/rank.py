"""Ranked retrieval over many questions at once: BM25, vectors, exact phrases, fusion and packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.functions.text import tokens
from lodestone.sources.shared import written

K1, B, FLOOR = 1.5, 0.75, 0.25
RRF = 60


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts groups to k before they are shuffled."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def bm25(docs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents (doc_id, text) of each question (query_id, text).

    Okapi weights; an idf below 0 becomes FLOOR times the mean idf of all words. A word repeated in a question
    counts as often. Postings are kept for question words only, and meet the questions before any shuffle
    when Spark finds the questions small; scores are summed in each task first.
    """
    held = written(docs.select("doc_id", tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t")), "words")  # split once, read three times
    whole = held.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = held.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    raw = df.crossJoin(whole).select("token", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))  # one row
    mean = raw.agg((F.avg("raw") * FLOOR).alias("floor"))
    asked = questions.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qn"))
    idf = raw.join(asked.select("token").distinct(), "token").crossJoin(mean).select("token", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    weighted = asked.join(idf, "token").select("query_id", "token", (F.col("qn") * F.col("idf")).alias("w"))
    words = held.select("doc_id", "dl", F.explode("t").alias("token")).join(idf.select("token"), "token", "left_semi").groupBy("doc_id", "dl", "token").agg(F.count("*").alias("tf"))
    part = words.crossJoin(whole.select("avgdl")).select("doc_id", "token", (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).alias("s"))
    scores = part.join(weighted, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("s") * F.col("w")), 6).alias("score"))
    return top(scores, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def nearest(vectors: DataFrame, asked: Column, k: int, block: int = 4096) -> DataFrame:
    """query_id, vec_id, distance (squared L2), score (1 - distance), rank of the k nearest vectors to those that ``asked`` picks."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return near(rows, rows.filter(asked).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), k, block)


def near(rows: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """As nearest, for queries (query_id, q) over rows (vec_id, v). A column want_x of queries lets those rows take part only whose x equals it,
    where it isn't null.

    A full scan, in blocks of vectors and of queries: a task holds one of each and gives k rows a query.
    """
    wants = [c for c in queries.columns if c.startswith("want_")]
    n = {c: df.count() // block + 1 for c, df in (("vb", rows), ("qb", queries))}
    held = rows.withColumns({"vb": F.pmod(F.xxhash64("vec_id"), F.lit(n["vb"])), "qb": F.explode(F.sequence(F.lit(0), F.lit(n["qb"] - 1)))})
    sent = queries.withColumns({"qb": F.pmod(F.xxhash64("query_id"), F.lit(n["qb"])).cast("int"), "vb": F.explode(F.sequence(F.lit(0), F.lit(n["vb"] - 1)))}).withColumn("vb", F.col("vb").cast("bigint"))

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "distance": []}
        if len(q) and len(v):
            ids, x = v["vec_id"].to_numpy(), np.stack(v["v"].to_numpy())
            for _, one in q.iterrows():
                d = np.round(((x - one["q"]) ** 2).sum(1), 6)
                for w in wants:
                    if one[w] is not None:
                        d = np.where((v[w[5:]] == one[w]).to_numpy(), d, np.inf)
                at = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                at = at[np.isfinite(d[at])]
                at = at[np.lexsort((ids[at], d[at]))[:k]]
                out["query_id"] += [one["query_id"]] * len(at)
                out["vec_id"] += ids[at].tolist()
                out["distance"] += d[at].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "distance": "float64"})

    found = sent.groupBy("vb", "qb").cogroup(held.groupBy("vb", "qb")).applyInPandas(search, "query_id bigint, vec_id bigint, distance double")
    return top(found, ["query_id"], [F.col("distance"), F.col("vec_id")], k).select("query_id", "vec_id", "distance", "rank", F.round(1 - F.col("distance"), 6).alias("score"))


def phrase_hits(docs: DataFrame, phrases: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, rank: the first k documents that hold each phrase (query_id, phrase).

    A document that holds a phrase holds its inner words as words, so the longest of them finds the
    candidates by an equi-join of ids, and texts meet them after; phrases without inner words are all tried on every document.
    """
    inner = F.expr("slice(words, 2, greatest(size(words) - 2, 0))")
    keyed = phrases.withColumn("words", tokens(F.col("phrase"))).select("query_id", "phrase", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("anchor"))
    by_word = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("anchor")).join(keyed.filter("anchor is not null"), "anchor").select("doc_id", "query_id", "phrase")
    long = by_word.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", F.col("phrase")))
    short = keyed.filter("anchor is null").select("query_id", "phrase")
    by_scan = docs.join(short, F.contains("text", F.col("phrase")))
    return top(long.select("query_id", "doc_id").unionByName(by_scan.select("query_id", "doc_id")), ["query_id"], [F.col("doc_id")], k)


def fuse(lists: dict[str, DataFrame], k: int) -> DataFrame:
    """query_id, doc_id, score, sources, rank: reciprocal-rank fusion of ranked lists (query_id, doc_id, rank), in order.

    A document that stands twice in a list counts twice; equal scores stand by first list, rank, then doc_id.
    """
    rows = None
    for i, (name, df) in enumerate(lists.items()):
        one = df.select("query_id", "doc_id", "rank", F.lit(i).alias("list"), F.lit(name).alias("name"))
        rows = one if rows is None else rows.unionByName(one)
    seen = F.array_sort(F.collect_list(F.struct("list", "rank", "name")))
    fused = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"), seen.alias("seen"))
    fused = fused.withColumn("sources", F.array_join(F.array_distinct(F.transform("seen", lambda x: x["name"])), "+"))
    return top(fused, ["query_id"], [F.desc("score"), F.col("first"), F.col("doc_id")], k).select("query_id", "doc_id", "score", "sources", "rank")


def pack_context(blocks: DataFrame, budget: int, between: str = "\n\n---\n\n") -> DataFrame:
    """query_id, n_blocks, n_chars, context: blocks (query_id, rank, block) by rank up to the first beyond the budget.

    Blank blocks are passed over and separators aren't counted. Lengths are positive, so a running sum within the
    budget is the same as stopping at the first block beyond it.
    """
    full = blocks.filter(F.trim("block") != "")
    upto = F.sum(F.char_length("block")).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    kept = full.withColumn("upto", upto).filter(F.col("upto") <= budget)
    rows = kept.groupBy("query_id").agg(F.count("*").alias("n_blocks"), F.max("upto").alias("n_chars"), F.sort_array(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return rows.select("query_id", "n_blocks", "n_chars", F.array_join(F.transform("b", lambda x: x["block"]), between).alias("context"))


def packed(blocks: Column, budget: int) -> Column:
    """The blocks of an array, in order, up to the first beyond the budget; blank ones are passed over."""
    full = F.filter(blocks, lambda b: F.trim(b) != "")
    kept = F.array().cast("array<string>")
    start = F.struct(kept.alias("kept"), F.lit(0).alias("n"))

    def step(acc: Column, b: Column) -> Column:
        n = acc["n"] + F.char_length(b)
        return F.struct(F.when(n <= budget, F.array_append(acc["kept"], b)).otherwise(acc["kept"]).alias("kept"), n.alias("n"))

    return F.aggregate(full, start, step, lambda acc: acc["kept"])
