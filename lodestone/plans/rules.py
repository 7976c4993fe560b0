"""Queries over question analysis, guards, sources and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import blocks as B
from lodestone.functions import rules as V
from lodestone.functions import text as T
from lodestone.operators import questions as Q
from lodestone.sources import table
from lodestone.streaming.feed import first_of_each

from . import corpus, retrieval, sql


def query_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.analyzed(corpus.questions(spark, sf_dir))


def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of every benchmark text as a request; some blank, short, long or missing."""
    i, text = F.col("item_id"), F.col("text")
    asked = F.when(i % 7 == 0, F.lit("   ")).when(i % 7 == 1, F.left(text, F.lit(1))).when(i % 7 == 2, F.repeat(text, F.lit(40))).when(i % 7 != 3, text)
    return table(spark, sf_dir, "benchmark").select(i.alias("query_id"), B.status(asked).alias("status"))


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with a chunk as its context, and an answer that denies a duty for every second one."""
    context = corpus.chunks(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("text").alias("context"))
    answer = F.when(F.col("query_id") % 2 == 0, F.lit("Bạn KHÔNG phải nộp thuế.")).otherwise("Bạn phải nộp thuế.")
    return corpus.questions(spark, sf_dir).join(context, "query_id").withColumn("answer", answer)


def answer_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select("query_id", Q.guarded(F.col("answer"), F.col("question"), F.col("context"), V.GUARD_ANSWER).alias("answer"))


def answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extractive answer to every question: the first line of its context, or the empty one's."""
    found = retrieval._answers(spark, sf_dir).select("query_id", F.split("context", "\n", 2)[0].alias("said"))
    return corpus.questions(spark, sf_dir).join(found, "query_id", "left").select("query_id", F.coalesce(F.nullif("said", F.lit("")), F.lit(V.EMPTY_ANSWER)).alias("answer"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for every question from its context, shortened to 2800 characters."""
    found = retrieval._answers(spark, sf_dir).select("query_id", "context")
    out = corpus.questions(spark, sf_dir).join(found, "query_id", "left").withColumn("prompt", B.prompt(F.col("question"), B.shortened(F.coalesce("context", F.lit("")), 2800)))
    return out.select("query_id", F.char_length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("hash"))


def citation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk as a context and as a reranking model sees it."""
    c = corpus.chunks(spark, sf_dir)
    block = B.context_block(F.nullif("ten_van_ban", F.lit("141-2026-ND-CP")), F.col("dieu"), F.col("khoan"), F.col("diem"), F.col("text"))
    header = B.rerank_header(F.col("ten_van_ban"), F.when(F.col("doc_id") % 3 > 0, F.col("tieu_de_dieu")), F.col("dieu"), F.col("khoan"), F.col("diem"), F.when(F.col("doc_id") % 2 == 0, F.lit("khoản")))
    return c.select("doc_id", F.md5(block).alias("block"), F.md5(B.rerank_text(header, F.col("text"))).alias("rerank"))


def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What identifies a chunk: its chunk_id, else its id, else its place and the beginning of its text."""
    c = corpus.chunks(spark, sf_dir)
    key = B.identity(F.when(F.col("doc_id") % 3 == 0, F.col("chunk_id")), F.when(F.col("doc_id") % 3 == 1, F.col("doc_id").cast("string")), F.col("ma_van_ban"), F.col("dieu"), F.col("khoan"), F.col("diem"), F.col("text"))
    return c.select("doc_id", key.alias("key"))


def source_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one answer with its sources: turns in order, with a label."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" | ", F.col("conv_id").cast("string"), F.concat(F.lit("Điều "), F.col("turn").cast("string")), F.nullif("role", F.lit("user"))).alias("label"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "label"))).alias("s"))
    return rows.select("conv_id", F.size("s").alias("n_sources"), F.array_join(F.transform("s", lambda x: x["label"]), "; ").alias("sources"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published items, and every benchmark text as one with expectations from its id."""
    published = spark.createDataFrame(V.BENCHMARK, "id string, question string, expected_document string, expected_keywords array<string>, category string")
    none = F.array().cast("array<string>")
    published = published.select("id", "category", "expected_document", F.lit(None).cast("int").alias("expected_dieu"), F.array().cast("array<int>").alias("acceptable_dieu"), F.lit(None).cast("string").alias("expected_khoan"), none.alias("acceptable_khoan"), "expected_keywords", none.alias("must_contain"), none.alias("must_not_contain"), none.alias("expected_citation"))
    i = F.col("item_id")
    one = lambda c, *values: F.when(c, F.array(*values)).otherwise(none)
    own = table(spark, sf_dir, "benchmark").select(
        i.cast("string").alias("id"), corpus._of(["resolution", "cross_document", "vat", None], i % 4).alias("category"), corpus._of(["Nghị quyết 198/2025/QH15", "68-2026-ND-CP", "khác", None, None], i % 5).alias("expected_document"),
        F.when(i % 3 == 0, 4).alias("expected_dieu"), F.when(i % 6 == 0, F.array(F.lit(4), F.lit(5), F.lit(0))).otherwise(F.array().cast("array<int>")).alias("acceptable_dieu"), F.when(i % 4 == 1, "2").alias("expected_khoan"),
        one(i % 8 == 1, F.lit("1"), F.lit("2")).alias("acceptable_khoan"), one(i % 7 > 0, F.left("text", F.lit(12))).alias("expected_keywords"), one(i % 3 == 1, F.lit("ĐIỀU")).alias("must_contain"),
        one(i % 5 == 2, F.lit("bắt buộc")).alias("must_not_contain"), one(i % 4 == 3, F.lit("Điều"), F.lit("điều 3")).alias("expected_citation"),
    )
    return published.unionByName(own)


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the items; none for some."""
    published = spark.createDataFrame([(b[0], b[1]) for b in V.BENCHMARK], "id string, answer string").select("id", "answer", F.lit("198-2025-QH15").alias("top_document"), F.lit(10).alias("top_dieu"), F.lit("6").alias("top_khoan"))
    i = F.col("item_id")
    said = F.concat(F.when(i % 2 == 0, F.left("text", F.lit(40))).otherwise("không rõ"), F.lit(" Điều "), (i % 6).cast("string"), F.when(i % 10 == 2, " bắt buộc").otherwise(""))
    own = table(spark, sf_dir, "benchmark").filter("item_id % 9 < 8").select(i.cast("string").alias("id"), said.alias("answer"), corpus._of(["198-2025-QH15", "68-2026-ND-CP", "khác", None], i % 4).alias("top_document"), (i % 6).cast("int").alias("top_dieu"), (i % 3).cast("string").alias("top_khoan"))
    return published.unionByName(own)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([(k, a) for k, v in V.DOCUMENT_ALIASES.items() for a in v], "name string, alias string")
    return Q.evaluated(_items(spark, sf_dir), _given(spark, sf_dir), aliases)


def eval_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.summary(_flags(spark, sf_dir))


def eval_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.by_category(_flags(spark, sf_dir))


def eval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.failures(_flags(spark, sf_dir), _items(spark, sf_dir))


def eval_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.breakdown(_flags(spark, sf_dir))


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.report(_flags(spark, sf_dir))


def eval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rates of labelled documents by source."""
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return labels.groupBy(F.coalesce("source", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n_items"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


def feed_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return first_of_each(spark, f"{sf_dir}/event[s].parquet", schema, ["user_id", "event_type"])  # a stream takes one file as a pattern only


QUERIES = {
    f.__name__: f
    for f in (
        query_analyze, request_status, answer_guard, answer_batch, prompts, citation_blocks, chunk_keys, source_envelope, eval_flags, eval_summary, eval_category, eval_failures, eval_breakdown, eval_report, eval_labels,
        feed_stream_dedup,
    )
}

_ONE = "case when {0} then [{1}]::varchar[] else []::varchar[] end"
_ITEMS = f"""
items as (
  select id, category, expected_document, null::integer as expected_dieu, []::integer[] as acceptable_dieu, null::varchar as expected_khoan, []::varchar[] as acceptable_khoan, expected_keywords, []::varchar[] as must_contain, []::varchar[] as must_not_contain, []::varchar[] as expected_citation
  from {sql.values(V.BENCHMARK, 'id, question, expected_document, expected_keywords, category')}
  union all
  select item_id::varchar, {corpus._pick(['resolution', 'cross_document', 'vat', None], 'item_id % 4')}, {corpus._pick(['Nghị quyết 198/2025/QH15', '68-2026-ND-CP', 'khác', None, None], 'item_id % 5')}, case when item_id % 3 = 0 then 4 end,
    case when item_id % 6 = 0 then [4, 5, 0] else []::integer[] end, case when item_id % 4 = 1 then '2' end, {_ONE.format('item_id % 8 = 1', "'1', '2'")}, {_ONE.format('item_id % 7 > 0', 'left("text", 12)')}, {_ONE.format('item_id % 3 = 1', "'ĐIỀU'")},
    {_ONE.format('item_id % 5 = 2', "'bắt buộc'")}, {_ONE.format('item_id % 4 = 3', "'Điều', 'điều 3'")} from benchmark),
given as (
  select id, question as answer, '198-2025-QH15' as top_document, 10 as top_dieu, '6' as top_khoan from {sql.values(V.BENCHMARK, 'id, question, expected_document, expected_keywords, category')}
  union all
  select item_id::varchar, case when item_id % 2 = 0 then left("text", 40) else 'không rõ' end || ' Điều ' || (item_id % 6) || case when item_id % 10 = 2 then ' bắt buộc' else '' end, {corpus._pick(['198-2025-QH15', '68-2026-ND-CP', 'khác', None], 'item_id % 4')}, (item_id % 6)::integer, (item_id % 3)::varchar
  from benchmark where item_id % 9 < 8)"""
_HELD = "len(list_filter({0}, lambda k: contains(lower(coalesce(answer, '')), lower(k))))"
_FLAGS = f"""
with {_ITEMS}, al as {sql.values([(k, a) for k, v in V.DOCUMENT_ALIASES.items() for a in v], 'name, alias')},
f as (
  select i.id, coalesce(category, 'unknown') as category,
    expected_document is null or coalesce(case when exists (select 1 from al where name = expected_document) then exists (select 1 from al where name = expected_document and alias = top_document) else top_document = expected_document end, false) as document_correct,
    case when len(acceptable_dieu) > 0 then coalesce(list_contains(acceptable_dieu, top_dieu), false) else expected_dieu is null or coalesce(expected_dieu = top_dieu, false) end as dieu_correct,
    case when len(acceptable_khoan) > 0 then coalesce(list_contains(acceptable_khoan, top_khoan), false) else expected_khoan is null or coalesce(expected_khoan = top_khoan, false) end as khoan_correct,
    {_HELD.format('expected_keywords')} > 0 as keyword_match, {_HELD.format('must_contain')} = len(must_contain) as must_contain_match, {_HELD.format('must_not_contain')} = 0 as hallucination_safe,
    {_HELD.format('expected_citation')} = len(expected_citation) as citation_correct, len(expected_citation) > 0 as citation_required, expected_document, expected_dieu, expected_khoan
  from items i left join given a on i.id = a.id
)"""
_OK = " and ".join(Q.FLAGS)
_METRICS = f"m as (unpivot (select id, {', '.join(Q.FLAGS)}, {_OK} as perfect from f) on {', '.join(Q.FLAGS)}, perfect into name metric value met)"
_SHARE = "{0}::varchar || '/' || {1} || ' (' || printf('%.1f', 100.0 * {0} / {1}) || '%)'"
_NAME = "coalesce(nullif(ten_van_ban, '141-2026-ND-CP'), 'Không rõ văn bản')"
_STRIPPED = r"regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"

ORACLE_SQL = {
    "query_analyze": f"with {corpus.QUESTIONS} select query_id, {retrieval.analysis('question')} from questions",
    "request_status": """
select item_id as query_id, case when length(coalesce(q, '')) not between 2 and 2000 then 422 when trim(coalesce(q, '')) = '' then 400 else 200 end as status
from (select item_id, case item_id % 7 when 0 then '   ' when 1 then left(text, 1) when 2 then repeat(text, 40) when 3 then null else text end as q from benchmark)
""",
    "answer_guard": f"""with {corpus.CHUNKS}, {corpus.QUESTIONS}
select query_id, case when contains(lower(question), 'phải nộp thuế') and query_id % 2 = 0 and not contains(lower(text), 'không phải nộp thuế') then {sql.quoted(V.GUARD_ANSWER)} when query_id % 2 = 0 then 'Bạn KHÔNG phải nộp thuế.' else 'Bạn phải nộp thuế.' end as answer
from questions join chunks on doc_id = query_id
""",
    "answer_batch": f"with {retrieval._CONTEXT} select query_id, coalesce(nullif(string_split(context, chr(10))[1], ''), {sql.quoted(V.EMPTY_ANSWER)}) as answer from questions left join ctx using (query_id)",
    "prompts": rf"""with {retrieval._CONTEXT},
p as (select query_id, 'Chỉ trả lời dựa trên ngữ cảnh sau và nêu căn cứ.' || chr(10) || chr(10) || case when length(x) > 2800 then rtrim(regexp_replace(left(x, 2800), ' [^ ]*$', '')) || ' [...]' else x end || chr(10) || chr(10) || 'Câu hỏi: ' || question as prompt
  from (select query_id, question, coalesce(context, '') as x from questions left join ctx using (query_id)))
select query_id, length(prompt)::bigint as n_chars, md5(prompt) as hash from p
""",
    "citation_blocks": f"""with {corpus.CHUNKS}
select doc_id, md5('[' || concat_ws(' | ', {_NAME}, 'Điều ' || dieu, 'Khoản ' || khoan, 'Điểm ' || diem) || ']' || chr(10) || chr(10) || '    ' || {_STRIPPED}) as block,
  md5(concat_ws(chr(10), 'Văn bản: ' || ten_van_ban, case when doc_id % 3 > 0 then tieu_de_dieu else 'Điều ' || dieu end, 'Khoản ' || khoan, 'Điểm ' || diem, case when doc_id % 2 = 0 then 'Đơn vị nội dung: khoản' end) || chr(10) || chr(10) || {_STRIPPED}) as rerank from chunks
""",
    "chunk_keys": f"with {corpus.CHUNKS} select doc_id, case doc_id % 3 when 0 then chunk_id when 1 then doc_id::varchar else ma_van_ban || '|' || dieu || '|' || coalesce(khoan::varchar, '') || '|' || coalesce(diem, '') || '|' || left(text, 100) end as key from chunks",
    "source_envelope": """
select conv_id, count(*)::integer as n_sources, string_agg(concat_ws(' | ', conv_id::varchar, 'Điều ' || turn, nullif(role, 'user')), '; ' order by turn) as sources from conversations group by conv_id
""",
    "eval_flags": f"{_FLAGS} select * exclude (expected_document, expected_dieu, expected_khoan) from f",
    "eval_summary": f"{_FLAGS}, {_METRICS} select metric, count(*) filter (where met) as n_true, count(*) as n_items, round(100 * avg(met::integer), 4) as percent from m group by metric",
    "eval_category": f"{_FLAGS} select category, count(*) as n_items, count(*) filter (where {_OK}) as n_perfect, count(*) filter (where not ({_OK})) as n_failing, round(avg(({_OK})::integer), 6) as rate from f group by category",
    "eval_failures": f"""{_FLAGS} select id, category, concat_ws(', ', {', '.join(f'case when not {m} then {sql.quoted(m)} end' for m in Q.FLAGS)}) as failed,
  concat_ws('; ', case when not document_correct then 'Expected Doc: ' || coalesce(expected_document, 'None') end, case when not dieu_correct then 'Expected Điều: ' || coalesce(expected_dieu::varchar, 'None') end, case when not khoan_correct then 'Expected Khoản: ' || coalesce(expected_khoan, 'None') end) as expected from f where not ({_OK})
""",
    "eval_breakdown": f"{_FLAGS}, {_METRICS} select row_number() over (order by n desc, metric)::integer as place, metric, n from (select metric, count(*) as n from m where not met and metric <> 'perfect' group by 1)",
    "eval_report": f"""{_FLAGS}, {_METRICS},
c as (select category, count(*) as n, count(*) filter (where {_OK}) as p from f group by 1)
select 'summary' as section, list_position([{', '.join(map(sql.quoted, [*Q.FLAGS, 'perfect']))}], metric)::integer as place, metric || ': ' || {_SHARE.format('t', 'n')} as line from (select metric, count(*) filter (where met) as t, count(*) as n from m group by 1)
union all select 'category', row_number() over (order by category)::integer, category || ': ' || {_SHARE.format('p', 'n')} from c
union all select 'breakdown', row_number() over (order by n desc, metric)::integer, metric || ': ' || n from (select metric, count(*) as n from m where not met and metric <> 'perfect' group by 1)
union all select 'failures', row_number() over (order by n - p desc, category)::integer, category || ' ' || (n - p) from c where n > p
""",
    "eval_labels": "select coalesce(source, 'unknown') as category, count(*) as n_items, count(*) filter (where quality = 1) as n_good, count(*) filter (where toxic = 1) as n_toxic from labels join documents using (doc_id) group by 1",
    "feed_stream_dedup": "select distinct user_id, event_type from events",
}
