"""Queries over documents: words, hashes, names, cleaning and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.rank import top
from lodestone.operators.store import matching
from lodestone.sources import table

from . import sql


def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, words and distinct words of each language."""
    docs = table(spark, sf_dir, "documents").select("lang", T.tokens(F.col("text")).alias("t"))
    words = docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size("t")).cast("bigint").alias("n_tokens"))
    distinct = docs.select("lang", F.explode("t").alias("token")).distinct().groupBy("lang").agg(F.count("*").alias("n_distinct"))
    return words.join(distinct, "lang")


def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content hash, and its copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable readable id from language, source and the first words."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws("_", "lang", "source", T.slug(F.substring("text", 1, 40)), F.col("doc_id").cast("string")).alias("chunk_id"))


def clean_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.clean_page(F.col("text")).alias("t"))
    return docs.select("doc_id", F.char_length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("hash"))


FILTERS = [(1, "en", "src1"), (2, "fr", None), (3, None, "src3"), (4, "all", ""), (5, "de", "all")]


def metadata_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 documents that pass each filter; none, "" and "all" pass everything."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    filters = spark.createDataFrame(FILTERS, "filter_id int, f_lang string, f_source string")
    hits = docs.join(filters, matching("lang", "f_lang") & matching("source", "f_source"))
    return top(hits, ["filter_id"], [F.col("doc_id")], 30).select("filter_id", "doc_id", "lang", "source", "rank")


QUERIES = {
    "tokenize_stats": tokenize_stats,
    "content_hash_dedup": content_hash_dedup,
    "slug_ids": slug_ids,
    "clean_page_text": clean_page_text,
    "metadata_lookup": metadata_lookup,
}

_SLUG = r"trim(regexp_replace(lower(trim(substring(text, 1, 40))), '[^\p{L}\p{N}_]+', '_', 'g'), '_')"
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' +([,.;:])', '\1', 'g'))"

ORACLE_SQL = {
    "tokenize_stats": f"""
with d as (select lang, {sql.tokens('text')} as t from documents)
select lang, count(*) as n_docs, sum(len(t))::bigint as n_tokens,
  (select count(distinct x) from (select unnest(t) as x from d d2 where d2.lang = d.lang)) as n_distinct
from d group by lang
""",
    "content_hash_dedup": r"""
select md5(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')) as content_hash, min(doc_id) as doc_id, count(*) as n_copies from documents group by 1
""",
    "slug_ids": f"select doc_id, concat_ws('_', lang, source, {_SLUG}, doc_id::varchar) as chunk_id from documents",
    "clean_page_text": f"select doc_id, length({_CLEAN})::bigint as n_chars, md5({_CLEAN}) as hash from documents",
    "metadata_lookup": f"""
select filter_id::integer as filter_id, doc_id, lang, source, rank::integer as rank from (
  select filter_id, doc_id, lang, source, row_number() over (partition by filter_id order by doc_id) as rank
  from documents join {sql.values(FILTERS, 'filter_id, f_lang, f_source')} f
    on (coalesce(f_lang, '') in ('', 'all') or lang = f_lang) and (coalesce(f_source, '') in ('', 'all') or source = f_source)
) where rank <= 30
""",
}
