"""The retrieval flow over chunks of laws, for all questions at once.

Chunks: doc_id (order of the corpus), chunk_id, ma_van_ban, ten_van_ban, loai_van_ban, chu_de, dieu, tieu_de_dieu, khoan, diem, level, text.
Questions: the columns of ``questions.analyzed``. Ranked lists and hits are (query_id, doc_id, ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.blocks import rerank_header, rerank_text
from lodestone.functions.text import point_order
from lodestone.sources.shared import few, written

from . import grams as G
from .models import Make
from .models import reranked as called
from .rank import RRF, top

#: Candidates of a phrase that are read first, for each row wanted, and how many times as many every further time.
FIRST, MORE = 8, 16

#: Columns that a filter may name.
FILTERS = ("ma_van_ban", "loai_van_ban", "trang_thai_hieu_luc", "chu_de", "co_quan_ban_hanh")


def wanted(asked: DataFrame, filters: dict | None = None) -> DataFrame:
    """asked with want_<column> for every column that a filter may name: the caller's value, but the question's own code, or else its
    type, goes before. None, "" and "all" want nothing; other names are passed over."""
    given = {k: v for k, v in (filters or {}).items() if k in FILTERS and v not in (None, "", "all")}
    own = {"ma_van_ban": F.col("ma_van_ban"), "loai_van_ban": F.when(F.col("ma_van_ban").isNull(), F.col("loai_van_ban"))}
    return asked.withColumns({f"want_{k}": F.coalesce(own.get(k, F.lit(None)), F.lit(given.get(k))).cast("string") for k in FILTERS if k in own or k in given})


def _passes(wants: list[str], chunk: str = "", asked: str = "") -> Column:
    return reduce(lambda a, w: a & (F.col(f"{asked}{w}").isNull() | F.coalesce(F.col(f"{chunk}{w[5:]}") == F.col(f"{asked}{w}"), F.lit(False))), wants, F.lit(True))


def _wants(asked: DataFrame) -> list[str]:
    return [c for c in asked.columns if c.startswith("want_")]


def _first_of(chunks: DataFrame, places: DataFrame, on: dict[str, str], wants: list[str], k: int) -> DataFrame:
    """The first k chunks of each distinct place (a row of places) by doc_id; questions that ask for one place share the work."""
    c = chunks.select("doc_id", *{w[5:] for w in wants} | set(on))
    met = places.distinct().alias("q").join(c.alias("c"), reduce(lambda a, b: a & b, (F.col(f"c.{x}") == F.col(f"q.{y}") for x, y in on.items()))).filter(_passes(wants, "c.", "q."))
    return top(met.select("c.doc_id", *(F.col(f"q.{x}") for x in places.columns)), places.columns, [F.col("doc_id")], k, "n").drop("n")


def _back(asked: DataFrame, found: DataFrame, keys: list[str], name: int) -> DataFrame:
    same = reduce(lambda a, b: a & b, (F.col(f"a.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys))
    return asked.alias("a").join(found.alias("f"), same).select("a.query_id", "f.doc_id", F.lit(name).alias("branch"))


def structured(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, doc_id, rank: chunks by the place or else the kind that a question names.

    A question that names an article gets 30 chunks of it, then 30 of the clause and 10 of the point that it names, one behind the
    other, repeats included. Any other gets 20 of its document type and 20 of its topic, each chunk once.
    """
    wants = _wants(asked)
    q = asked.select("query_id", *wants, F.col("dieu").alias("q_dieu"), F.col("khoan").alias("q_khoan"), F.col("diem").alias("q_diem"), F.col("loai_van_ban").alias("q_loai"), F.col("chu_de").alias("q_chu_de"))
    branches = []
    placed = q.filter("q_dieu is not null")
    kinds = q.filter("q_dieu is null")
    for i, (rows, on, k) in enumerate((
        (placed, {"dieu": "q_dieu"}, 30), (placed.filter("q_khoan is not null"), {"dieu": "q_dieu", "khoan": "q_khoan"}, 30),
        (placed.filter("q_khoan is not null and q_diem is not null"), {"dieu": "q_dieu", "khoan": "q_khoan", "diem": "q_diem"}, 10),
        (kinds.filter("q_loai is not null"), {"loai_van_ban": "q_loai"}, 20), (kinds.filter("q_chu_de is not null"), {"chu_de": "q_chu_de"}, 20),
    )):
        keys = [*wants, *on.values()]
        branches.append(_back(rows, _first_of(chunks, rows.select(*keys), on, wants, k), keys, i))
    every = reduce(DataFrame.unionByName, branches)
    once = every.filter("branch >= 3").groupBy("query_id", "doc_id").agg(F.min("branch").alias("branch"))
    rows = every.filter("branch < 3").unionByName(once)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("branch", "doc_id"))).drop("branch")


def of(chunks: DataFrame, hits: DataFrame, *columns: str) -> DataFrame:
    """The columns of the chunks that are among hits (doc_id, ...), a table that is written: only these are shuffled where texts meet hits."""
    return chunks.select("doc_id", *columns).join(few(hits.select("doc_id").distinct(), "ids"), "doc_id", "left_semi")


def _holds(texts: list[str], whole_case: bool) -> Column:
    said = (lambda c: c) if whole_case else F.lower
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(said(F.col(t)), said(F.col("phrase"))), F.lit(False)) for t in texts))


def _holders(chunks: DataFrame, phrases: DataFrame, texts: list[str], index: G.GramIndex | None, whole_case: bool) -> DataFrame:
    """phrase, doc_id of the chunks one of whose columns ``texts`` holds the phrase; with ``whole_case`` letter for letter, else in any case."""
    met = written(G.candidates(index or G.build(chunks, texts), phrases), "met")
    return met.join(of(chunks, met, *texts), "doc_id").filter(_holds(texts, whole_case)).select("phrase", "doc_id")


def _first_holders(chunks: DataFrame, met: DataFrame, by: str, texts: list[str], k: int, whole_case: bool) -> DataFrame:
    """by, doc_id, n: the first k chunks of each ``by`` that hold its phrase, of the candidates met (by, phrase, doc_id).

    Candidates are read in the order of the corpus, FIRST for each row wanted and MORE times as many every further time, until k hold the phrase or none is left.
    """
    placed = written(met.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("doc_id"))), "placed")
    left, found, low, high = placed, None, 0, FIRST * k
    while True:
        now = written(left.filter((F.col("place") > low) & (F.col("place") <= high)), "now")
        new = written(now.join(of(chunks, now, *texts), "doc_id").filter(_holds(texts, whole_case)).select(by, "doc_id"), "holders")
        found = new if found is None else found.unionByName(new)
        full = found.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(by)
        left = written(placed.filter(F.col("place") > high).join(full, by, "left_anti"), "left")
        if left.isEmpty():
            return top(found, [by], [F.col("doc_id")], k, "n")
        low, high = high, high * MORE


def exact(chunks: DataFrame, asked: DataFrame, k: int = 20, index: G.GramIndex | None = None) -> DataFrame:
    """query_id, doc_id, rank: for each phrase of the question and each place that it names, the first k chunks that hold the words,
    of those the ones that pass the question's filters; one phrase behind the other, repeats included.

    Each distinct phrase is looked up once in an index of substrings (that of the chunks' text, made here where none is given).
    """
    wants = _wants(asked)
    named = lambda label, c: F.concat(F.lit(label), F.col(c).cast("string"))
    own = F.array_compact(F.array(named("Điều ", "dieu"), named("Khoản ", "khoan"), named("khoản ", "khoan"), named("Điểm ", "diem"), named("điểm ", "diem")))
    phrases = asked.select("query_id", *wants, F.posexplode(F.concat(F.filter(F.split("phrases", r"\|"), lambda x: x != ""), own)).alias("at", "phrase"))
    met = G.candidates(index or G.build(chunks, ["text"]), phrases)
    first = _first_holders(chunks, met.withColumn("said", F.col("phrase")), "said", ["text"], k, whole_case=True).withColumnRenamed("said", "phrase")
    first = first.join(chunks.select("doc_id", *(w[5:] for w in wants)), "doc_id")
    met = phrases.join(first, "phrase").filter(_passes(wants))
    return met.select("query_id", "doc_id", F.row_number().over(W.partitionBy("query_id").orderBy("at", "doc_id")).alias("rank"))


def contains_lookup(chunks: DataFrame, phrases: DataFrame, k: int = 20, index: G.GramIndex | None = None) -> DataFrame:
    """query_id, doc_id, rank: the first k chunks whose text or title holds a phrase (query_id, phrase) in any case, among those that pass
    the phrase's filters (want_ columns). Filters go before the limit. An empty phrase finds none.

    Phrases are looked up in an index of substrings (that of the chunks' text and tieu_de_dieu, made here where none is given).
    """
    wants = _wants(phrases)
    texts = ["text", "tieu_de_dieu"]
    met = G.candidates(index or G.build(chunks, texts), phrases).join(phrases, "phrase").join(chunks.select("doc_id", *(w[5:] for w in wants)), "doc_id").filter(_passes(wants))
    return _first_holders(chunks, met.select("query_id", "phrase", "doc_id"), "query_id", texts, k, whole_case=False).withColumnRenamed("n", "rank")


def boost(asked: DataFrame) -> DataFrame:
    """asked with what the rules of rules.BOOSTS name."""
    return asked.withColumnsRenamed({"dieu": "q_dieu", "khoan": "q_khoan", "diem": "q_diem", "loai_van_ban": "q_loai", "chu_de": "q_chu_de", "legal_topic": "q_topic", "amendment": "q_amend", "ma_van_ban": "q_ma"}).withColumn("q_mien", F.contains(F.lower("phrases"), F.lit(rules.LATE_PHRASE)))


def boosted(hits: DataFrame) -> Column:
    """The boost of every hit that holds chunk and question columns (see boost)."""
    conditions = [F.when(F.expr(condition), F.lit(w)).otherwise(0.0) for condition, w in rules.BOOSTS]
    said = F.filter(F.split("phrases", r"\|"), lambda x: x != "")
    held = lambda c: F.size(F.filter(said, lambda p: F.contains(F.col(c), p)))
    each = [held(c) * w for c, w in zip(("t", "ti"), rules.PHRASE_BOOSTS, strict=True)]
    return reduce(lambda a, b: a + b, [*conditions, *each])


def fused(lists: dict[str, DataFrame], chunks: DataFrame, asked: DataFrame, k: int = 20, rrf: int = RRF) -> DataFrame:
    """query_id, doc_id, score, sources, rank: reciprocal ranks of all lists added up and the rules' boosts; equal ones by first list and rank."""
    rows = reduce(DataFrame.unionByName, (df.select("query_id", "doc_id", "rank", F.lit(i).alias("list"), F.lit(name).alias("name")) for i, (name, df) in enumerate(lists.items())))
    seen = F.array_sort(F.collect_list(F.struct("list", "rank", "name")))
    added = rows.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (rrf + F.col("rank"))).alias("rrf"), F.min(F.struct("list", "rank")).alias("first"), F.array_join(F.array_distinct(F.transform(seen, lambda x: x["name"])), "+").alias("sources"))
    added = written(added, "added")
    c = of(chunks, added, "ma_van_ban", "loai_van_ban", "chu_de", "dieu", "khoan", "diem", "text", "tieu_de_dieu").withColumns({"t": F.lower("text"), "ti": F.lower("tieu_de_dieu")}).drop("text", "tieu_de_dieu")
    q = boost(asked).select("query_id", "q_dieu", "q_khoan", "q_diem", "q_loai", "q_chu_de", "q_topic", "q_amend", "q_mien", "phrases")
    met = added.join(c, "doc_id").join(q, "query_id")
    return top(met.withColumn("score", F.round(F.col("rrf") + boosted(met), 9)), ["query_id"], [F.desc("score"), F.col("first"), F.col("doc_id")], k).select("query_id", "doc_id", "score", "sources", "rank")


def attached(hits: DataFrame, chunks: DataFrame, asked: DataFrame, distance: int = 1) -> DataFrame:
    """hits (query_id, doc_id, score, sources, rank) with the chunks beside them behind: added tells them.

    A chunk of a hit's article comes with it if the question names that article and no clause, or if its clause is at most ``distance`` from
    the hit's. Hits of another document than the one that the question names bring none. The first hit that brings a chunk counts.
    """
    c = chunks.select("doc_id", "ma_van_ban", "dieu", "khoan")
    q = asked.select("query_id", F.col("ma_van_ban").alias("q_ma"), F.col("dieu").alias("q_dieu"), F.col("khoan").alias("q_khoan"))
    primary = hits.select("query_id", "doc_id", "rank").join(c, "doc_id").join(q, "query_id").filter("(q_ma is null or ma_van_ban = q_ma) and ma_van_ban <> '' and dieu <> 0")
    p = primary.select("query_id", F.col("rank").alias("p_rank"), "ma_van_ban", "dieu", F.col("khoan").alias("p_khoan"), F.coalesce((F.col("q_dieu") == F.col("dieu")) & F.col("q_khoan").isNull(), F.lit(False)).alias("all"))
    near = p.join(c, ["ma_van_ban", "dieu"]).filter(F.col("all") | F.abs(F.col("khoan") - F.col("p_khoan")).between(1, distance))
    new = near.groupBy("query_id", "doc_id").agg(F.min("p_rank").alias("p_rank")).join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    count = hits.groupBy("query_id").agg(F.max("rank").alias("n"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("p_rank", "doc_id"))
    more = new.join(count, "query_id").select("query_id", "doc_id", F.lit(0.0).alias("score"), F.lit("sibling").alias("sources"), (F.col("n") + place).cast("int").alias("rank"), F.lit(True).alias("added"))
    return hits.select("query_id", "doc_id", "score", "sources", F.col("rank").cast("int").alias("rank"), F.lit(False).alias("added")).unionByName(more)


def expanded(hits: DataFrame, chunks: DataFrame, asked: DataFrame, limit: int = 30) -> DataFrame:
    """hits (see attached) of questions that name article and clause with all chunks of that clause, the first ``limit``, ordered anew by
    score, level, place in the law; other questions' hits as they are."""
    wants = _wants(asked)
    q = asked.filter("dieu is not null and khoan is not null").select("query_id", *wants, F.col("dieu").alias("q_dieu"), F.col("khoan").alias("q_khoan"))
    q = q.join(hits.select("query_id").distinct(), "query_id", "left_semi")
    keys = [*wants, "q_dieu", "q_khoan"]
    found = _back(q, _first_of(chunks, q.select(*keys), {"dieu": "q_dieu", "khoan": "q_khoan"}, wants, limit), keys, 0)
    order = chunks.select("doc_id", "khoan", "level", "diem")
    at = F.row_number().over(W.partitionBy("query_id").orderBy(F.coalesce("khoan", F.lit(0)), F.coalesce("level", F.lit(99)), point_order(F.col("diem")), "doc_id"))
    score = F.lit(0.18) + 0.10 + 0.10 + F.when(F.col("level") == 2, 0.03).when(F.col("level") == 3, 0.02).otherwise(0.0)
    new = found.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").join(order, "doc_id")
    new = new.select("query_id", "doc_id", F.round(score, 9).alias("score"), F.lit("sibling_expand").alias("sources"), (at + (1 << 20)).cast("int").alias("rank"), F.lit(True).alias("added"))
    every = hits.unionByName(new).join(order, "doc_id").join(q.select("query_id", F.lit(True).alias("named")), "query_id", "left")
    number = F.coalesce("khoan", F.lit(0)) * 100 + point_order(F.col("diem"))
    keyed = lambda c: F.when(F.col("named"), c)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(keyed(F.col("score")).desc(), keyed(F.coalesce("level", F.lit(99))), keyed(number), keyed(F.coalesce("diem", F.lit(""))).desc(), "rank"))
    return every.select("query_id", "doc_id", "score", "sources", place.alias("rank"), "added")


def final_limit(k: int) -> Column:
    return F.when(F.col("dieu").isNotNull() & F.col("khoan").isNotNull(), max(k, 12)).when(F.col("dieu").isNotNull(), max(k, 8)).otherwise(k)


def limited(hits: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """hits up to each question's limit: at least 12 where it names article and clause, 8 where an article, else k."""
    q = asked.select("query_id", final_limit(k).alias("most"))
    return hits.join(q, "query_id").filter(F.col("rank") <= F.col("most")).drop("most")


def skips_rerank(asked: DataFrame) -> Column:
    """Whether a question is not ordered anew: it names article and clause, or asks for the revenue threshold."""
    return (F.col("dieu").isNotNull() & F.col("khoan").isNotNull()) | F.coalesce(F.col("legal_topic") == rules.SUPERSEDES[0], F.lit(False))


def reranked(hits: DataFrame, chunks: DataFrame, asked: DataFrame, make: Make, k: int = 5, most: int = 5) -> DataFrame:
    """hits of the questions that aren't passed over, as make()'s function orders all of them anew: the first ``most`` of its results, k at most or what the
    question's limit allows; the hits of other questions up to their limit.

    The function gets a question and its chunks, as models.reranked states: their text is header and body, as blocks.rerank_text puts them.
    """
    q = asked.select("query_id", "question", skips_rerank(asked).alias("skips"), final_limit(k).alias("most"))
    hits = written(hits, "candidates")
    met = hits.join(q, "query_id")
    chunks = of(chunks, hits, *(c for c in chunks.columns if c != "doc_id"))
    have = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string")
    header = rerank_header(have("ten_van_ban"), have("tieu_de_dieu"), have("dieu"), have("khoan"), have("diem"), have("don_vi_con"))
    sent = met.filter(~F.col("skips")).join(chunks.select("doc_id", have("chunk_id").alias("chunk_id"), rerank_text(header, F.col("text")).alias("body")), "doc_id")
    new = called(sent.withColumn("id", F.col("doc_id").cast("string")), make, "query_id", "question", "id", "chunk_id", "body", "rank").filter(F.col("rank") <= F.least(F.lit(most), "most"))
    named = F.when(F.contains("sources", F.lit("reranker")), F.col("sources")).otherwise(F.concat("sources", F.lit("+reranker")))
    return new.withColumns({"sources": named, "score": F.round("score", 9)}).select(*hits.columns).unionByName(met.filter(F.col("skips") & (F.col("rank") <= F.col("most"))).select(*hits.columns))


def without_older(hits: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """hits of questions on rules.SUPERSEDES' topic without the older document where the newer one is among them."""
    topic, newer, older = rules.SUPERSEDES
    met = hits.join(chunks.select("doc_id", F.col("ma_van_ban").alias("ma")), "doc_id").join(asked.select("query_id", "legal_topic"), "query_id")
    has = F.max(F.col("ma") == newer).over(W.partitionBy("query_id"))
    return met.withColumn("has", has).filter(~F.coalesce((F.col("legal_topic") == topic) & F.col("has") & (F.col("ma") == older), F.lit(False))).select(*hits.columns)


def prioritised(hits: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """hits of questions on late payment with the places of rules.LATE_PRIORITY first, then by score; place is the order."""
    at = lambda dieu, khoan: (F.col("dieu") == dieu) & (F.lit(True) if khoan is None else F.coalesce(F.col("khoan") == khoan, F.lit(False)))
    priority = reduce(lambda acc, r: F.when(at(*r[:2]), r[2]) if acc is None else acc.when(at(*r[:2]), r[2]), rules.LATE_PRIORITY, None).otherwise(0)
    met = hits.join(chunks.select("doc_id", "dieu", "khoan"), "doc_id").join(asked.select("query_id", F.contains(F.lower("question"), F.lit(rules.LATE_PHRASE)).alias("late")), "query_id")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.when(F.col("late"), priority).desc(), F.when(F.col("late"), F.col("score")).desc(), "rank"))
    return met.withColumn("place", place).select(*hits.columns, "place")


def located(hits: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """hits of questions that name an article within it, and within the clause or outside any where they name one."""
    met = hits.join(chunks.select("doc_id", "dieu", "khoan"), "doc_id").join(asked.select("query_id", F.col("dieu").alias("q_dieu"), F.col("khoan").alias("q_khoan")), "query_id")
    return met.filter("q_dieu is null or (dieu = q_dieu and (q_khoan is null or khoan is null or khoan = q_khoan))").select(*hits.columns)


def by_location(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """chunks at places (query_id, p_ma, p_dieu, p_khoan, p_diem): an article must be named, code, clause and point may be."""
    met = chunks.join(places.filter("p_dieu is not null"), F.col("dieu") == F.col("p_dieu"))
    return met.filter("(p_ma is null or ma_van_ban = p_ma) and ma_van_ban <> '' and (p_khoan is null or khoan = p_khoan) and (p_diem is null or lower(diem) = lower(p_diem))")


def finished(hits: DataFrame, chunks: DataFrame, asked: DataFrame, k: int = 5, make: Make | None = None, most: int = 5, neighbors: int = 1, limit: int = 30) -> DataFrame:
    """query_id, doc_id, score, sources, added, rank: hits (see fused) with siblings, limits, versions, priorities and places. Where make is given,
    its function orders all of a question's hits and siblings anew before the limit."""
    rows = written(attached(hits, chunks, asked, neighbors), "attached")
    rows = written(expanded(rows, chunks, asked, limit), "expanded")
    rows = written(reranked(rows, chunks, asked, make, k, most) if make else limited(rows, asked, k), "limited")
    rows = located(prioritised(without_older(rows, chunks, asked), chunks, asked), chunks, asked)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("place"))).drop("place")
