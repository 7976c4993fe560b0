"""Queries over the retrieval flow: ranked lists, fusion, siblings, limits, and contexts and sources from them.

Chunks and questions are those of ``corpus``; the vector of a chunk is that of its id, as is that of a question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.engine import SOURCE
from lodestone.functions import rules as V
from lodestone.operators import legal as L
from lodestone.operators import postings as P
from lodestone.operators import rank as R
from lodestone.operators import ruled as U
from lodestone.operators import vectors as X
from lodestone.operators.models import word_reranker
from lodestone.operators.questions import guarded
from lodestone.sources import table
from lodestone.sources.shared import written

from . import corpus, sql

TOP, KEPT, FINAL, BUDGET = 20, 20, 5, 12_000


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _words(spark: SparkSession, sf_dir: str) -> P.Postings:
    """The word index of the documents: one a session for as long as the table stays as it is."""
    held = corpus.engine(spark, sf_dir)
    if not hasattr(held, "documents"):
        held.documents = P.build(_docs(spark, sf_dir))
    return held.documents


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From postings that this session has built before, or builds now."""
    return P.bm25(_words(spark, sf_dir), _questions(spark, sf_dir), TOP)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full scan in blocks."""
    return R.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 10)


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.vectors(spark, sf_dir).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


def dense_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of dense_topk from the cells of the vector index that can hold them."""
    return X.search(X.build(corpus.vectors(spark, sf_dir)), _vector_queries(spark, sf_dir), 10)


def dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks nearest to every question among those of the document or type that it names, from the index."""
    held, asked = corpus.engine(spark, sf_dir), _asked(spark, sf_dir)
    queries = asked.join(corpus.vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").select("query_id", "q", "want_ma_van_ban", "want_loai_van_ban")
    return X.search(held.vectors, queries, KEPT).select("query_id", F.col("vec_id").alias("doc_id"), "distance", "rank")


def exact_phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.phrase_hits(_docs(spark, sf_dir), _questions(spark, sf_dir).withColumnRenamed("text", "phrase"), TOP)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.engine(spark, sf_dir).analyzed(corpus.questions(spark, sf_dir))


def structured_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.structured(corpus.chunks(spark, sf_dir), _asked(spark, sf_dir))


def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = corpus.engine(spark, sf_dir)
    return L.exact(held.chunks, _asked(spark, sf_dir), index=held.phrases)


def contains_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunks whose text or title holds the question's first phrase in any case."""
    held = corpus.engine(spark, sf_dir)
    asked = _asked(spark, sf_dir).filter("phrases <> ''").withColumn("phrase", F.upper(F.split("phrases", r"\|")[0]))
    return L.contains_lookup(held.chunks, asked.select("query_id", "phrase", "want_ma_van_ban", "want_loai_van_ban"), index=held.phrases)


def _question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


def _flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, questions and fused hits; the latter two, some rows a question, are written once for what follows."""
    held = corpus.engine(spark, sf_dir)
    asked, hits = held.fused(corpus.questions(spark, sf_dir), FINAL, KEPT, None, _question_vectors(spark, sf_dir))
    return held.chunks, asked, hits


def list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every ranked list of every question, before fusion."""
    asked = written(_asked(spark, sf_dir), "asked")
    rows = None
    for name, df in corpus.engine(spark, sf_dir).lists(asked, KEPT, _question_vectors(spark, sf_dir)).items():
        one = df.select("query_id", F.lit(name).alias("list"), "doc_id")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("query_id", "list").agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_chunks"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four lists fused, with the rules' boosts."""
    return _flow(spark, sf_dir)[2]


def rule_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boost of every question's structured and exact hits."""
    chunks, asked = corpus.chunks(spark, sf_dir), _asked(spark, sf_dir)
    hits = L.structured(chunks, asked).select("query_id", "doc_id").unionByName(L.exact(chunks, asked).select("query_id", "doc_id")).distinct()
    met = hits.join(chunks.withColumns({"t": F.lower("text"), "ti": F.lower("tieu_de_dieu")}).drop("text"), "doc_id").join(L.boost(asked).drop("q_ma"), "query_id")
    return met.select("query_id", "doc_id", F.round(L.boosted(met), 6).alias("boost"))


def sibling_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked, hits = _flow(spark, sf_dir)
    return L.attached(hits, chunks, asked).select("query_id", "doc_id", "score", "sources", "rank", "added")


def sibling_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked, hits = _flow(spark, sf_dir)
    return L.expanded(L.attached(hits, chunks, asked), chunks, asked)


def final_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked, hits = _flow(spark, sf_dir)
    return L.limited(L.expanded(L.attached(hits, chunks, asked), chunks, asked), asked, FINAL).select("query_id", "doc_id", "rank")


def version_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fused hits without the document that a newer one among them replaces."""
    chunks, asked, hits = _flow(spark, sf_dir)
    return L.without_older(hits, chunks, asked).select("query_id", "doc_id", "rank")


def priority_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked, hits = _flow(spark, sf_dir)
    return L.prioritised(hits, chunks, asked).select("query_id", "doc_id", "score", "place")


def location_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks at the place that each question names."""
    places = _asked(spark, sf_dir).select("query_id", F.col("ma_van_ban").alias("p_ma"), F.col("dieu").alias("p_dieu"), F.col("khoan").alias("p_khoan"), F.col("diem").alias("p_diem"))
    return L.by_location(corpus.chunks(spark, sf_dir), places).select("query_id", "chunk_id", F.lit(1.0).alias("score"), F.lit("location").alias("retrieval_source"))


def location_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked, hits = _flow(spark, sf_dir)
    return L.located(hits, chunks, asked).select("query_id", "doc_id", "rank")


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused hits ordered anew, five a question; questions that pass the reranking over keep theirs up to their limit."""
    chunks, asked, hits = _flow(spark, sf_dir)
    return L.reranked(hits.withColumn("added", F.lit(False)), chunks, asked, word_reranker(), FINAL).select("query_id", "doc_id", "score", "sources", "rank")


def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow: query_id, doc_id, score, sources, added, rank."""
    return corpus.engine(spark, sf_dir).retrieve(corpus.questions(spark, sf_dir), FINAL, KEPT, None, _question_vectors(spark, sf_dir))


def retrieve_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow with all candidates and their siblings ordered anew before the limit."""
    return corpus.engine(spark, sf_dir).retrieve(corpus.questions(spark, sf_dir), FINAL, KEPT, None, _question_vectors(spark, sf_dir), word_reranker())


def retrieve_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow within the laws that hold, for the caller's filters and limits."""
    filters = {"trang_thai_hieu_luc": "còn_hiệu_lực", "co_quan_ban_hanh": "all", "page": 3}
    return corpus.engine(spark, sf_dir).retrieve(corpus.questions(spark, sf_dir), 3, KEPT, filters, _question_vectors(spark, sf_dir))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, sources (array of the final hits by rank), n_blocks, context."""
    return corpus.engine(spark, sf_dir).sources(retrieve(spark, sf_dir))


def rule_boost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of rule_boost by rules that are read from a table."""
    held = corpus.engine(spark, sf_dir)
    asked = _asked(spark, sf_dir)
    hits = L.structured(held.chunks, asked).select("query_id", "doc_id").unionByName(L.exact(held.chunks, asked, index=held.phrases).select("query_id", "doc_id"))
    return U.boosts(hits, held.chunks, L.boost(asked), written(U.default_boosts(spark), "boosts"))


def version_filter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of version_filter by a table of documents that replace others."""
    chunks, asked, hits = _flow(spark, sf_dir)
    return U.without_older(hits, chunks, asked, written(U.default_superseded(spark), "superseded")).select("query_id", "doc_id", "rank")


def priority_sort_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of priority_sort by a table of places that go first."""
    chunks, asked, hits = _flow(spark, sf_dir)
    return U.prioritised(hits, chunks, asked, written(U.default_priorities(spark), "priorities")).select("query_id", "doc_id", "score", "place")


def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's final hits, and the context made of them within the budget."""
    said = F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["retrieval_source"])), ", ")
    return _answers(spark, sf_dir).select("query_id", said.alias("sources"), "n_blocks", F.md5("context").alias("context_hash"))


def source_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of every answer as rows: document and what is known of it, place, title, page, score, where it came from."""
    rows = _answers(spark, sf_dir).select("query_id", F.explode("sources").alias("s"))
    return rows.select("query_id", *(f"s.{c}" for c in ("rank", *SOURCE, "score", "retrieval_source")))


def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client gets for every question as JSON: question, answer (the guard's, the empty one's or the first line of the context), sources."""
    q = corpus.questions(spark, sf_dir)
    met = q.join(_answers(spark, sf_dir), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    first = F.coalesce(F.split("context", "\n", 2)[0], F.lit(""))
    answer = guarded(F.when(first == "", F.lit(V.EMPTY_ANSWER)).otherwise(F.concat(first, F.lit(": không phải nộp thuế"))), F.col("question"), F.col("context"), V.GUARD_ANSWER)
    shown = F.transform("sources", lambda s: F.struct(s["ten_van_ban"].alias("document"), s["ma_van_ban"].alias("document_code"), s["dieu"].alias("dieu"), s["khoan"].alias("khoan"), s["diem"].alias("diem"), s["tieu_de_dieu"].alias("title"), F.format_number(s["score"], 6).alias("score"), s["retrieval_source"].alias("retrieval_source"), s["trang_bat_dau"].alias("page"), F.struct(*(s[c].alias(c) for c in SOURCE)).alias("metadata")))
    body = F.to_json(F.struct(F.trim("question").alias("question"), answer.alias("answer"), shown.alias("sources")), {"ignoreNullFields": "false"})
    return met.select("query_id", body.alias("body"))


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns packed into at most 1200 characters."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat(F.lit("["), "role", F.lit("] "), "text").alias("block"))
    return R.pack_context(turns, 1200).select("query_id", "n_blocks", "n_chars", F.md5("context").alias("context_hash"))


def news_rank_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunk of each article (source) by score less distance, the ten best articles of each question."""
    near = R.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 50)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "n_chars")
    scored = near.join(docs, "vec_id").withColumn("final", F.round(F.log10(F.col("n_chars") + 1) - F.col("distance"), 6))
    one = R.top(scored, ["query_id", "source"], [F.desc("final"), F.col("vec_id")], 1, "n")
    return R.top(one, ["query_id"], [F.desc("final"), F.col("vec_id")], 10, "place").select("query_id", "vec_id", "source", "final", "place")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, dense_topk, dense_indexed, dense_filtered, exact_phrase_hits, structured_lookup, exact_lookup, contains_lookup, list_counts, rrf_fusion, rule_boost, rule_boost_table, version_filter_table, priority_sort_table, sibling_attach, sibling_expand, final_limit, version_filter, priority_sort,
        location_lookup, location_filter, rerank, retrieve, retrieve_reranked, retrieve_filtered, hybrid_retrieve, source_projection, response_json, context_pack, news_rank_dedup,
    )
}


def _bm25(docs: str, asked: str, k: int) -> str:
    return f"""
h as (select doc_id, {sql.tokens('text')} as t, len({sql.tokens('text')}) as dl from {docs}),
whole as (select count(*) as n, avg(dl) as avgdl from h),
df as (select token, count(*) as df from (select unnest(list_distinct(t)) as token from h) group by token),
raw as (select token, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, whole),
floor as (select avg(raw) * 0.25 as f from raw),
idf as (select token, case when raw < 0 then f else raw end as idf from raw, floor),
words as (select query_id, token, count(*) as qn from (select query_id, unnest({sql.tokens('text')}) as token from {asked}) group by all),
tf as (select doc_id, dl, token, count(*) as tf from (select doc_id, dl, unnest(t) as token from h) group by all),
scores as (
  select query_id, doc_id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from words join idf using (token) join tf using (token), whole group by query_id, doc_id
),
bm25 as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scores) where rank <= {k})"""


_BM25 = _bm25("documents", "(select item_id as query_id, text from benchmark)", TOP)
_EXACT = f"""
exact as (select query_id, doc_id, rank from (
  select item_id as query_id, doc_id, row_number() over (partition by item_id order by doc_id) as rank
  from benchmark b join documents d on contains(d.text, b.text)) where rank <= {TOP})
"""
_L2 = "round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (v.embedding[i]::double - q.embedding[i]::double) * (v.embedding[i]::double - q.embedding[i]::double))), 6)"
_NEAR = f"""
near as (select q.vec_id as query_id, v.vec_id, {_L2} as distance from embeddings v, embeddings q where q.vec_id % 50 = 0)
"""


def analysis(question: str) -> str:
    """What a question names and asks for, as columns."""
    q = f"lower(trim({question}))"
    no = lambda form: f"nullif(regexp_extract({q}, '{form}', 1), '')"
    return rf"""try_cast({no(r'điều\s+(\d+)')} as integer) as dieu, try_cast({no(r'khoản\s+(\d+)')} as integer) as khoan, {no(r'điểm\s+([a-zđ])')} as diem, upper({no(r'chương\s+([ivxlcdm0-9]+)')}) as chuong,
  {sql.first_class(q, V.INTENTS)} as intent, {sql.first_class(q, [(d[0], d[3]) for d in V.DOCUMENTS])} as ma_van_ban, coalesce({sql.first_class(q, [(d[2], d[3]) for d in V.DOCUMENTS])}, {sql.first_class(q, V.DOCUMENT_TYPES)}) as loai_van_ban,
  array_to_string(list_filter([{', '.join(map(sql.quoted, V.LEGAL_PHRASES))}], lambda p: contains({q}, p)), '|') as phrases, {sql.first_class(q, V.TOPICS)} as chu_de, {sql.first_class(q, V.LEGAL_TOPICS)} as legal_topic,
  {sql.any_of(q, V.AMENDMENT_PHRASES)} or {sql.any_of(q, V.THRESHOLD_PHRASES)} as amendment"""


_PASS = "(want_ma is null or c.ma_van_ban = want_ma) and (want_loai is null or c.loai_van_ban = want_loai)"
_RERANKED = rf"""
rm as (select h.*, (q_dieu is not null and q_khoan is not null) or coalesce(q_topic, '') = 'nguong_doanh_thu' as skips, case when q_dieu is not null and q_khoan is not null then 12 when q_dieu is not null then 8 else {FINAL} end as most,
    {sql.tokens('question')} as qt, concat_ws(chr(10), 'Văn bản: ' || ten_van_ban, tieu_de_dieu, 'Khoản ' || c.khoan, 'Điểm ' || c.diem, 'Đơn vị nội dung: ' || don_vi_con) || chr(10) || chr(10) || text as body
  from %s h join chunks c using (doc_id) join qq using (query_id)),
rs as (select *, round(len(list_intersect(list_distinct(qt), list_distinct({sql.tokens('body')})))::double / greatest(len(list_distinct(qt)), 1), 9) as s from rm where not skips),
rr as (select query_id, doc_id, score, sources, rank::integer as rank, added from rm where skips and rank <= most
  union all select query_id, doc_id, s, sources || '+reranker', place::integer, added from (select *, row_number() over (partition by query_id order by s desc, rank) as place from rs) where place <= least({FINAL}, most))"""
_ASKED = f"""{corpus.CHUNKS}, {corpus.QUESTIONS},
asked as (select *, ma_van_ban as want_ma, case when ma_van_ban is null then loai_van_ban end as want_loai from (select query_id, question, {analysis('question')} from questions))"""


def _branch(on: str, where: str, k: int, n: int) -> str:
    return f"select query_id, doc_id, {n} as branch from (select q.query_id, c.doc_id, row_number() over (partition by q.query_id order by c.doc_id) as n from asked q join chunks c on {on} and {_PASS} where {where}) where n <= {k}"


_STRUCTURED = f"""
st as ({_branch('c.dieu = q.dieu', 'true', 30, 0)} union all {_branch('c.dieu = q.dieu and c.khoan = q.khoan', 'true', 30, 1)} union all {_branch('c.dieu = q.dieu and c.khoan = q.khoan and c.diem = q.diem', 'true', 10, 2)}
  union all select query_id, doc_id, min(branch) from ({_branch('c.loai_van_ban = q.loai_van_ban', 'q.dieu is null', 20, 3)} union all {_branch('c.chu_de = q.chu_de', 'q.dieu is null', 20, 4)}) group by 1, 2),
structured as (select query_id, doc_id, row_number() over (partition by query_id order by branch, doc_id) as rank from st)"""
_PHRASES = f"""
ph as (select query_id, want_ma, want_loai, unnest(ps) as phrase, generate_subscripts(ps, 1) as pos from (select query_id, want_ma, want_loai,
  list_concat(list_filter(string_split(phrases, '|'), lambda x: x <> ''), list_filter(['Điều ' || dieu, 'Khoản ' || khoan, 'khoản ' || khoan, 'Điểm ' || diem, 'điểm ' || diem], lambda x: x is not null)) as ps from asked)),
pf as (select * from (select phrase, doc_id, row_number() over (partition by phrase order by doc_id) as n from (select distinct phrase from ph) join chunks on contains(text, phrase)) where n <= 20),
exact as (select query_id, doc_id, row_number() over (partition by query_id order by pos, doc_id) as rank from ph join pf using (phrase) join chunks c using (doc_id) where {_PASS})"""
_BOOST = " + ".join(f"case when {c} then {w} else 0 end" for c, w in V.BOOSTS)
_BOOST = f"({_BOOST} + len(list_filter(string_split(phrases, '|'), lambda p: p <> '' and contains(t, p))) * {V.PHRASE_BOOSTS[0]} + len(list_filter(string_split(phrases, '|'), lambda p: p <> '' and contains(ti, p))) * {V.PHRASE_BOOSTS[1]})::double"
_BOTH = """
cq as (select c.doc_id, c.ma_van_ban, c.loai_van_ban, c.chu_de, c.dieu, c.khoan, c.diem, c.level, lower(c.text) as t, lower(c.tieu_de_dieu) as ti from chunks c),
qq as (select query_id, question, dieu as q_dieu, khoan as q_khoan, diem as q_diem, loai_van_ban as q_loai, chu_de as q_chu_de, legal_topic as q_topic, amendment as q_amend, ma_van_ban as q_ma, phrases, contains(lower(phrases), 'miễn tiền chậm nộp') as q_mien from asked)"""
_FUSED = f"""{_ASKED}, {_STRUCTURED}, {_PHRASES}, {_bm25('chunks', '(select query_id, question as text from asked)', 2 * KEPT)},
bm as (select * from (select query_id, doc_id, row_number() over (partition by query_id order by b.rank) as rank from bm25 b join chunks c using (doc_id) join asked using (query_id) where {_PASS}) where rank <= {KEPT}),
de as (select query_id, doc_id, row_number() over (partition by query_id order by distance, doc_id) as rank from (
  select a.query_id, c.doc_id, {_L2} as distance from asked a join embeddings q on q.vec_id = a.query_id, embeddings v join chunks c on c.doc_id = v.vec_id where {_PASS}) qualify rank <= {KEPT}),
lists as (select query_id, doc_id, rank, 0 as list, 'structured' as name from structured union all select query_id, doc_id, rank, 1, 'exact' from exact union all select query_id, doc_id, rank, 2, 'bm25' from bm union all select query_id, doc_id, rank, 3, 'dense' from de),
{_BOTH},
added as (select query_id, doc_id, sum(1.0::double / (60 + rank)) as rrf, min(list * 100000 + rank) as first, list_sort(list_distinct(list(list || name))) as names from lists group by 1, 2),
fused as (select query_id, doc_id, score, sources, rank from (select *, row_number() over (partition by query_id order by score desc, first, doc_id) as rank from (
  select query_id, doc_id, first, array_to_string(list_transform(names, lambda x: x[2:]), '+') as sources, round(rrf + {_BOOST}, 9) as score from added join cq using (doc_id) join qq using (query_id))) where rank <= {KEPT})"""
_ATTACHED = f"""{_FUSED},
pr as (select query_id, rank as p_rank, ma_van_ban, dieu, khoan as p_khoan, coalesce(q_dieu = dieu and q_khoan is null, false) as every from fused join cq using (doc_id) join qq using (query_id) where q_ma is null or ma_van_ban = q_ma),
nw as (select query_id, c.doc_id, min(p_rank) as p_rank from pr p join cq c on c.ma_van_ban = p.ma_van_ban and c.dieu = p.dieu and (every or abs(c.khoan - p_khoan) = 1) where not exists (select 1 from fused f where f.query_id = p.query_id and f.doc_id = c.doc_id) group by 1, 2),
attached as (select query_id, doc_id, score, sources, rank::integer as rank, false as added from fused union all
  select query_id, doc_id, 0.0, 'sibling', ((select max(rank) from fused f where f.query_id = nw.query_id) + row_number() over (partition by query_id order by p_rank, doc_id))::integer, true from nw)"""
_PO = "case when diem is null then 0 else coalesce(list_position(['a','b','c','d','đ','e','g','h','i','k','l','m','n'], lower(diem)), 99) end"
_EXPANDED = f"""{_ATTACHED},
ex as (select query_id, doc_id from (select q.query_id, c.doc_id, row_number() over (partition by q.query_id order by c.doc_id) as n from asked q join chunks c on c.dieu = q.dieu and c.khoan = q.khoan and {_PASS} where exists (select 1 from fused f where f.query_id = q.query_id)) where n <= 30),
ev as (select * from attached union all select query_id, doc_id, round(0.38 + case level when 2 then 0.03 when 3 then 0.02 else 0 end, 9)::double, 'sibling_expand', (1048576 + row_number() over (partition by query_id order by coalesce(khoan, 0), level, {_PO}, doc_id))::integer, true
  from ex join cq using (doc_id) where not exists (select 1 from attached f where f.query_id = ex.query_id and f.doc_id = ex.doc_id)),
expanded as (select query_id, doc_id, score, sources, row_number() over (partition by query_id order by case when named then score end desc, case when named then level end, case when named then coalesce(khoan, 0) * 100 + {_PO} end, case when named then coalesce(diem, '') end desc, rank) as rank, added
  from (select ev.*, level, khoan, diem, q_dieu is not null and q_khoan is not null as named from ev join cq using (doc_id) join qq using (query_id))),
lim as (select e.* from expanded e join qq using (query_id) where rank <= case when q_dieu is not null and q_khoan is not null then 12 when q_dieu is not null then 8 else {FINAL} end)"""


def _versions(hits: str) -> str:
    return f"(select h.*, c.dieu, c.khoan, q.* exclude (query_id) from {hits} h join cq c using (doc_id) join qq q using (query_id) where not (coalesce(q_topic, '') = 'nguong_doanh_thu' and ma_van_ban = '68_2026_ND_CP' and exists (select 1 from {hits} o join cq oc using (doc_id) where o.query_id = h.query_id and oc.ma_van_ban = '141_2026_ND_CP')))"


_PLACE = "row_number() over (partition by query_id order by case when contains(lower(question), 'miễn tiền chậm nộp') then case when dieu = 16 and khoan = 5 then 100 when dieu = 16 then 80 when dieu = 21 then 20 else 0 end end desc nulls last, case when contains(lower(question), 'miễn tiền chậm nộp') then score end desc nulls last, rank)"
_LOCATED = "(q_dieu is null or (dieu = q_dieu and (q_khoan is null or khoan is null or khoan = q_khoan)))"


def _final(hits: str) -> str:
    return f"final as (select query_id, doc_id, score, sources, added, row_number() over (partition by query_id order by place)::integer as rank from (select *, {_PLACE} as place from {_versions(hits)}) where {_LOCATED})"


_FINAL = f"{_EXPANDED}, {_final('lim')}"
_HOLDS = " and c.trang_thai_hieu_luc = 'còn_hiệu_lực'"
_CONTEXT = rf"""{_FINAL},
bl as (select query_id, rank, doc_id, sources, score, c.*  exclude (doc_id), '[' || concat_ws(' | ', ten_van_ban, 'Điều ' || dieu, 'Khoản ' || khoan, 'Điểm ' || diem) || ']' || chr(10) || chr(10) || '    ' || regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') as block from final join chunks c using (doc_id)),
up as (select *, sum(length(block)) over (partition by query_id order by rank) as upto from bl),
ctx as (select query_id, string_agg(doc_id || ':' || sources, ', ' order by rank) as sources, count(*) filter (where upto <= {BUDGET}) as n_blocks, coalesce(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) filter (where upto <= {BUDGET}), '') as context from up group by 1)"""

ORACLE_SQL = {
    "bm25_topk": f"with {_BM25} select query_id, doc_id, score, rank::integer as rank from bm25",
    "dense_topk": f"with {_NEAR} select query_id, vec_id, distance, rank::integer as rank, round(1 - distance, 6) as score from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from near) where rank <= 10",
    "dense_indexed": f"with {_NEAR} select query_id, vec_id, distance, rank::integer as rank, round(1 - distance, 6) as score from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from near) where rank <= 10",
    "exact_phrase_hits": f"with {_EXACT} select query_id, doc_id, rank::integer as rank from exact",
    "structured_lookup": f"with {_ASKED}, {_STRUCTURED} select query_id, doc_id, rank::integer as rank from structured",
    "exact_lookup": f"with {_ASKED}, {_PHRASES} select query_id, doc_id, rank::integer as rank from exact",
    "contains_lookup": f"with {_ASKED} select query_id, doc_id, rank::integer as rank from (select query_id, c.doc_id, row_number() over (partition by query_id order by c.doc_id) as rank from asked a join chunks c on (contains(lower(c.text), string_split(phrases, '|')[1]) or contains(lower(c.tieu_de_dieu), string_split(phrases, '|')[1])) and {_PASS} where phrases <> '') where rank <= 20",
    "list_counts": f"with {_FUSED} select query_id, name as list, count(*) as n_rows, count(distinct doc_id) as n_chunks from lists group by 1, 2",
    "rrf_fusion": f"with {_FUSED} select query_id, doc_id, score, sources, rank::integer as rank from fused",
    "rule_boost": f"with {_ASKED}, {_STRUCTURED}, {_PHRASES}, {_BOTH}, hit as (select query_id, doc_id from structured union select query_id, doc_id from exact) select query_id, doc_id, round({_BOOST}, 6) as boost from hit join cq using (doc_id) join qq using (query_id)",
    "sibling_attach": f"with {_ATTACHED} select * from attached",
    "sibling_expand": f"with {_EXPANDED} select query_id, doc_id, score, sources, rank::integer as rank, added from expanded",
    "final_limit": f"with {_EXPANDED} select query_id, doc_id, rank::integer as rank from lim",
    "version_filter": f"with {_FUSED} select query_id, doc_id, rank::integer as rank from {_versions('fused')}",
    "priority_sort": f"with {_FUSED} select query_id, doc_id, score, {_PLACE}::integer as place from (select f.*, c.dieu, c.khoan, q.question from fused f join cq c using (doc_id) join qq q using (query_id))",
    "location_lookup": f"with {_ASKED} select query_id, chunk_id, 1.0::double as score, 'location' as retrieval_source from asked q join chunks c on c.dieu = q.dieu and (q.ma_van_ban is null or c.ma_van_ban = q.ma_van_ban) and (q.khoan is null or c.khoan = q.khoan) and (q.diem is null or c.diem = q.diem)",
    "location_filter": f"with {_FUSED} select query_id, doc_id, rank::integer as rank from fused join cq using (doc_id) join qq using (query_id) where {_LOCATED}",
    "rerank": f"with {_FUSED}, fa as (select *, false as added from fused), {_RERANKED % 'fa'} select query_id, doc_id, score, sources, rank from rr",
    "retrieve_reranked": f"with {_EXPANDED}, {_RERANKED % 'expanded'}, {_final('rr')} select * from final",
    "retrieve_filtered": f"with {_FINAL.replace(_PASS, _PASS + _HOLDS).replace(f'else {FINAL} end)', 'else 3 end)')} select * from final",
    "dense_filtered": f"with {_ASKED} select query_id, doc_id, distance, rank::integer as rank from (select a.query_id, c.doc_id, {_L2} as distance, row_number() over (partition by a.query_id order by {_L2}, c.doc_id) as rank from asked a join embeddings q on q.vec_id = a.query_id, embeddings v join chunks c on c.doc_id = v.vec_id where {_PASS}) where rank <= {KEPT}",
    "retrieve": f"with {_FINAL} select * from final",
    "hybrid_retrieve": f"with {_CONTEXT} select query_id, sources, n_blocks, md5(context) as context_hash from ctx",
    "source_projection": f"with {_CONTEXT} select query_id, rank, {', '.join(SOURCE)}, score, sources as retrieval_source from bl",
    "response_json": f"""with {_CONTEXT},
ls as (select query_id, list({{'document': ten_van_ban, 'document_code': ma_van_ban, 'dieu': dieu, 'khoan': khoan, 'diem': diem, 'title': tieu_de_dieu, 'score': format('{{:.6f}}', score), 'retrieval_source': sources, 'page': trang_bat_dau, 'metadata': {{{', '.join(f"'{c}': {c}" for c in SOURCE)}}}}} order by rank) as sources from bl group by 1),
an as (select query_id, question, ls.sources, coalesce(context, '') as context, case when string_split(coalesce(context, ''), chr(10))[1] = '' then {sql.quoted(V.EMPTY_ANSWER)} else string_split(context, chr(10))[1] || ': không phải nộp thuế' end as answer from questions left join ls using (query_id) left join ctx using (query_id))
select query_id, to_json({{'question': trim(question), 'answer': case when contains(lower(question), 'phải nộp thuế') and contains(lower(answer), 'không phải nộp thuế') and not contains(lower(context), 'không phải nộp thuế') then {sql.quoted(V.GUARD_ANSWER)} else answer end, 'sources': sources}})::varchar as body from an
""",
    "context_pack": """
with b as (select conv_id as query_id, turn as rank, '[' || role || '] ' || text as block from conversations),
u as (select *, sum(length(block)) over (partition by query_id order by rank) as upto from b where trim(block) <> '')
select query_id, count(*) as n_blocks, max(upto)::bigint as n_chars, md5(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)) as context_hash from u where upto <= 1200 group by query_id
""",
    "news_rank_dedup": f"""with {_NEAR},
n as (select * from (select *, row_number() over (partition by query_id order by distance, vec_id) as r from near) where r <= 50),
s as (select query_id, vec_id, source, round(log10(n_chars + 1) - distance, 6) as final from n join documents on doc_id = vec_id),
o as (select * from s qualify row_number() over (partition by query_id, source order by final desc, vec_id) = 1)
select query_id, vec_id, source, final, row_number() over (partition by query_id order by final desc, vec_id)::integer as place from o qualify place <= 10
""",
}
ORACLE_SQL |= {f"{q}_table": ORACLE_SQL[q] for q in ("rule_boost", "version_filter", "priority_sort")}
