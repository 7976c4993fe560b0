"""Rules as tables that users extend: boosts, documents that replace others, places that go first.

A boost has a trait of the question ("any", "dieu", "khoan", "diem", "loai", "chu_de", "late", "amend" or "topic:..."), conditions on the chunk, all of which must hold where they
are given, and a weight. Questions meet rules by an equi-join on the trait, so a rule costs only the questions that it is about.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.sources.shared import written

from .legal import of

BOOSTS = "trait string, same string, code string, dieu int, khoan int, says string, titled string, told string, weight double"
SUPERSEDED = "topic string, newer string, older string"
PRIORITIES = "phrase string, dieu int, khoan int, priority int"

#: What "same" may ask of a chunk.
SAME = {
    "dieu": "c.dieu = q_dieu", "not_dieu": "coalesce(c.dieu <> q_dieu, true)", "khoan": "c.khoan = q_khoan", "whole_dieu": "c.dieu = q_dieu and c.khoan is null", "diem": "lower(c.diem) = lower(q_diem)",
    "loai": "c.loai_van_ban = q_loai", "chu_de": "c.chu_de = q_chu_de",
}


def _row(trait: str, weight: float, **how) -> tuple:
    return (trait, *(how.get(k) for k in ("same", "code", "dieu", "khoan", "says", "titled", "told")), weight)


def default_boosts(spark: SparkSession) -> DataFrame:
    """The rules of rules.BOOSTS as rows: "says" in the text, "titled" in the title, "told" in either, in lower case."""
    late, invoice, till, fine = "miễn tiền chậm nộp", "topic:hoa_don_dien_tu", "topic:hoa_don_may_tinh_tien", "topic:tien_cham_nop_phat"
    threshold, trader = "topic:nguong_doanh_thu", "topic:ho_kinh_doanh"
    rows = [
        _row("dieu", 0.35, same="dieu"), _row("dieu", -0.08, same="not_dieu"), _row("khoan", 0.25, same="khoan"), _row("khoan", 0.04, same="whole_dieu"), _row("diem", 0.10, same="diem"),
        _row("loai", 0.05, same="loai"), _row("chu_de", 0.05, same="chu_de"),
        _row("late", 0.25, says=late), _row("late", 0.30, titled=late), _row("late", 0.30, dieu=16), _row("late", 0.40, dieu=16, khoan=5), _row("late", -0.20, dieu=21),
        _row(threshold, 2.0, code="141_2026_ND_CP"), _row(threshold, 0.20, code="68_2026_ND_CP"), _row(threshold, 0.50, says="01 tỷ đồng"), _row(threshold, 0.50, says="1 tỷ đồng"), _row(threshold, 0.50, says="1.000.000.000"),
        _row(invoice, 0.25, code="70_2025_ND_CP"), _row(invoice, 0.20, told="hóa đơn điện tử"), _row(till, 0.35, code="70_2025_ND_CP"), _row(till, 0.25, told="máy tính tiền"), _row(till, 0.20, dieu=11),
        _row(trader, 0.10, code="68_2026_ND_CP"), _row(trader, 0.50, code="141_2026_ND_CP"), _row(fine, 0.30, code="18_2023_TT_BTC"), _row(fine, 0.25, says="chậm nộp phạt"),
        _row("amend", 0.60, code="141_2026_ND_CP"), _row("amend", 0.30, says="01 tỷ đồng"), _row("amend", 0.30, says="1 tỷ đồng"), _row("amend", 0.20, says="sửa đổi"), _row("amend", 2.0, code="141_2026_ND_CP"), _row("amend", 0.50, says="sửa đổi"),
    ]
    return spark.createDataFrame(rows, BOOSTS)


def default_superseded(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([rules.SUPERSEDES], SUPERSEDED)


def default_priorities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(rules.LATE_PHRASE, *r) for r in rules.LATE_PRIORITY], PRIORITIES)


def _traits() -> Column:
    given = [("dieu", F.col("q_dieu").isNotNull()), ("khoan", F.col("q_khoan").isNotNull()), ("diem", F.col("q_diem").isNotNull()), ("loai", F.col("q_loai").isNotNull()), ("chu_de", F.col("q_chu_de").isNotNull()), ("late", F.col("q_mien")), ("amend", F.col("q_amend"))]
    return F.array_compact(F.array(F.lit("any"), F.concat(F.lit("topic:"), "q_topic"), *(F.when(c, F.lit(name)) for name, c in given)))


def boosts(hits: DataFrame, chunks: DataFrame, asked: DataFrame, table: DataFrame) -> DataFrame:
    """query_id, doc_id, boost: the weights of all rules of the table (BOOSTS) that hold for each hit (query_id, doc_id), and of the question's own phrases
    in the chunk. asked: see legal.boost. A hit that no rule is about has 0; equal rules count each."""
    q = asked.select("query_id", "q_dieu", "q_khoan", "q_diem", "q_loai", "q_chu_de", "phrases", F.explode(_traits()).alias("trait"))
    about = q.join(table.select(*(F.col(c).alias(f"r_{c}" if c != "trait" else c) for c in table.columns)), "trait")
    pairs = written(hits.select("query_id", "doc_id").distinct(), "pairs")
    c = of(chunks, pairs, "ma_van_ban", "loai_van_ban", "chu_de", "dieu", "khoan", "diem", "text", "tieu_de_dieu").withColumns({"t": F.lower("text"), "ti": F.lower("tieu_de_dieu")}).drop("text", "tieu_de_dieu")
    met = pairs.join(c, "doc_id").alias("c").join(about.alias("r"), "query_id")
    same = reduce(lambda acc, kv: acc.when(F.col("r_same") == kv[0], F.coalesce(F.expr(kv[1]), F.lit(False))), SAME.items(), F.when(F.col("r_same").isNull(), True)).otherwise(False)
    free = lambda c, holds: F.col(f"r_{c}").isNull() | F.coalesce(holds, F.lit(False))
    holds = same & free("code", F.col("c.ma_van_ban") == F.col("r_code")) & free("dieu", F.col("c.dieu") == F.col("r_dieu")) & free("khoan", F.col("c.khoan") == F.col("r_khoan"))
    holds = holds & free("says", F.contains("t", F.col("r_says"))) & free("titled", F.contains("ti", F.col("r_titled"))) & free("told", F.contains("t", F.col("r_told")) | F.contains("ti", F.col("r_told")))
    ruled = met.filter(holds).groupBy("query_id", "doc_id").agg(F.sum("r_weight").alias("ruled"))
    said = F.filter(F.split("phrases", r"\|"), lambda x: x != "")
    held = lambda c: F.size(F.filter(said, lambda p: F.contains(F.col(c), p)))
    own = pairs.join(c, "doc_id").join(asked.select("query_id", "phrases"), "query_id")
    own = own.select("query_id", "doc_id", reduce(lambda a, b: a + b, (held(c) * w for c, w in zip(("t", "ti"), rules.PHRASE_BOOSTS, strict=True))).alias("own"))
    return own.join(ruled, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.round(F.col("own") + F.coalesce("ruled", F.lit(0.0)), 6).alias("boost"))


def without_older(hits: DataFrame, chunks: DataFrame, asked: DataFrame, table: DataFrame) -> DataFrame:
    """hits without documents that another of the question's hits replaces on its topic, by the table (SUPERSEDED)."""
    met = hits.select("query_id", "doc_id").join(chunks.select("doc_id", F.col("ma_van_ban").alias("ma")), "doc_id").join(asked.select("query_id", F.col("legal_topic").alias("topic")), "query_id")
    newer = met.join(table, (F.col("ma") == F.col("newer")) & (met["topic"] == table["topic"])).select("query_id", "older").distinct()
    gone = met.join(newer, "query_id").filter(F.col("ma") == F.col("older")).select("query_id", "doc_id").distinct()
    return hits.join(gone, ["query_id", "doc_id"], "left_anti").select(*hits.columns)


def prioritised(hits: DataFrame, chunks: DataFrame, asked: DataFrame, table: DataFrame) -> DataFrame:
    """hits of questions that hold a phrase of the table (PRIORITIES) with its places first, the highest priority of each hit, then by score; place is the order."""
    late = asked.select("query_id", "question").join(table.select("phrase").distinct(), F.contains(F.lower("question"), F.lower("phrase"))).select("query_id", "phrase")  # a few phrases
    met = hits.join(chunks.select("doc_id", "dieu", "khoan"), "doc_id")
    place = table.select("phrase", F.col("dieu").alias("p_dieu"), F.col("khoan").alias("p_khoan"), "priority")
    at = (F.col("dieu") == F.col("p_dieu")) & (F.col("p_khoan").isNull() | F.coalesce(F.col("khoan") == F.col("p_khoan"), F.lit(False)))
    best = met.select("query_id", "doc_id", "dieu", "khoan").join(late, "query_id").join(place, "phrase").filter(at).groupBy("query_id", "doc_id").agg(F.max("priority").alias("priority"))
    rows = met.join(best, ["query_id", "doc_id"], "left").join(late.select("query_id", F.lit(True).alias("late")).distinct(), "query_id", "left")
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.when(F.col("late"), F.coalesce("priority", F.lit(0))).desc(), F.when(F.col("late"), F.col("score")).desc(), "rank"))
    return rows.withColumn("place", order).select(*hits.columns, "place")
