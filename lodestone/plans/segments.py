"""Queries over segmentation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import tables
from lodestone.functions.text import normal_legal, point_order
from lodestone.operators import segment as S
from lodestone.sources import table

from . import corpus


def fixed_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(S.fixed_windows(F.col("text"), 800, 100)).alias("chunk_index", "chunk")).select("doc_id", "chunk_index", F.md5("chunk").alias("hash"))


def line_pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(S.packed_lines(F.col("text"), 1800)).alias("chunk_index", "chunk")).select("doc_id", "chunk_index", F.md5("chunk").alias("hash"))


def article_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.articles(corpus.pages(spark, sf_dir)).select("doc", "pos", "dieu", "title", F.md5("text").alias("hash"))


def article_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.articles(corpus.pages(spark, sf_dir)).select("doc", "pos", "dieu", "chapter", "first_page")


def appendix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the appendices behind the articles."""
    return S.appendices(corpus.pages(spark, sf_dir)).select("doc", "idx", "title", F.md5("text").alias("hash"))


def law_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and appendices of every law with what is known of the law; nothing is known of some, and not all of others."""
    doc = F.col("doc_id")
    laws = table(spark, sf_dir, "documents").filter("doc_id % 7 <> 3").select(
        doc.alias("doc"), corpus._of(corpus.NAMES, doc % 6).alias("ten_van_ban"), corpus._of(corpus.CODES, doc % 6).alias("ma_van_ban"), F.when(doc % 2 == 0, corpus._of(corpus.TYPES, doc % 6)).alias("loai_van_ban"), F.when(doc % 3 == 0, corpus._of(corpus.ISSUERS, doc % 6)).alias("cap_ban_hanh"),
    )
    rows = S.parsed(corpus.pages(spark, sf_dir), laws)
    return rows.withColumn("hash", F.md5("text")).drop("text")


def legal_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pages(spark, sf_dir).select("doc", "page", F.md5(normal_legal(F.col("text"))).alias("hash"))


def clause_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clauses(S.articles(corpus.pages(spark, sf_dir))).select("doc", "pos", "khoan", "head", F.md5("clause").alias("hash"))


def point_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.points(S.clauses(S.articles(corpus.pages(spark, sf_dir)))).select("doc", "pos", "khoan", "diem", F.md5("said").alias("hash"))


def refine_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every content once, without cuts by size (refine_cut has them)."""
    return S.refined(corpus.pages(spark, sf_dir), most=1 << 30).select("doc", "pos", "dieu", "khoan", "diem", "level", "unit", "idx", F.col("n_parts").cast("bigint").alias("n_parts"), "chunk_id", "hash")


def refine_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As refine_chunks, with texts of more than 2200 characters cut."""
    return S.refined(corpus.pages(spark, sf_dir)).select("doc", "pos", "khoan", "diem", "level", "unit", "idx", "n_parts", "chunk_id", "hash")


def legal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each article in legal order: clause, level, point, place."""
    rows = S.refined(corpus.pages(spark, sf_dir), most=1 << 30, once=False)
    place = F.row_number().over(W.partitionBy("doc", "pos").orderBy(F.coalesce("khoan", F.lit(0)), "level", point_order(F.col("diem")), "idx"))
    return rows.withColumn("place", place).select("doc", "pos", "khoan", "diem", "idx", "place")


def chapter_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view of each user before each of their purchases."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    before = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1))
    return events.withColumn("view_id", before).filter("event_type = 'purchase'").select("user_id", "event_id", "view_id")


def smart_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.chunked(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), S.smart_cuts)
    return docs.select("doc_id", "lang", "chunk_index", F.md5("text").alias("hash"))


def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunked(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), S.recursive_cuts)


def _sql(spark: SparkSession, rows: DataFrame, text: str) -> DataFrame:
    """What SQL says of rows, under the name given_rows in the text."""
    tables.register(spark)
    name = f"given_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    return spark.sql(text.replace("given_rows", name))


def sql_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of clause_split by a table function."""
    rows = S.articles(corpus.pages(spark, sf_dir)).select("doc", "pos", "text")
    return _sql(spark, rows, "SELECT doc, pos, khoan, head, md5(clause) AS hash FROM lodestone_clauses(TABLE(given_rows) PARTITION BY doc ORDER BY pos)")


def sql_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of point_split by a table function over those of another."""
    rows = S.articles(corpus.pages(spark, sf_dir)).select("doc", "pos", "text")
    return _sql(spark, rows, """
        WITH c AS (SELECT * FROM lodestone_clauses(TABLE(given_rows) PARTITION BY doc))
        SELECT doc, pos, khoan, diem, md5(said) AS hash FROM lodestone_points(TABLE(c) PARTITION BY doc)""")


def sql_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of fixed_window_chunks by a table function."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _sql(spark, rows, "SELECT doc_id, chunk_index, md5(chunk) AS hash FROM lodestone_windows_of(TABLE(given_rows) PARTITION BY (doc_id), 800, 100)")


def sql_news_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under their titles as chunks of news, by a table function."""
    rows = corpus.news(spark, sf_dir).select("news_id", "title", F.col("text").alias("content"))
    return _sql(spark, rows, "SELECT news_id, chunk_index, md5(chunk) AS hash FROM lodestone_news_chunks(TABLE(given_rows) PARTITION BY (news_id), 1800)")


QUERIES = {
    f.__name__: f
    for f in (sql_clauses, sql_points, sql_windows, sql_news_chunks, fixed_window_chunks, line_pack_chunks, article_split, article_chapters, appendix_blocks, law_rows, legal_normalise, clause_split, point_split, refine_chunks, refine_cut, legal_order, chapter_asof, smart_split, recursive_chunks)
}

_WS = r"[\s\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _steps(x: str, steps: list[tuple[str, str]]) -> str:
    for form, to in steps:
        x = f"regexp_replace({x}, '{form}', {to}, 'g')"
    return _strip(x)


_LF = "chr(10)"
_DIEU = (r"(?i)(^|[^\p{L}\p{N}_])Đ\s*i\s*ề\s*u([^\p{L}\p{N}_]|$)", r"'\1Điều\2'")
_LINES = [(r"\r\n?", _LF)]


def _clean(x: str) -> str:
    return _steps(x, [*_LINES, (r"[ \t]+", "' '"), (r"\n{3,}", f"{_LF} || {_LF}"), (r"\s+([,.;:])", r"'\1'"), _DIEU])


def _normal(x: str) -> str:
    return _steps(x, [
        *_LINES, _DIEU, (r"(?i)Điều\s*\n\s*(\d+)\.", r"'Điều \1.'"), (r"([\p{L}\p{N}_])\s*-\s*\n\s*([\p{L}\p{N}_])", r"'\1-\2'"), (r"[ \t]+", "' '"), (r"\n{3,}", f"{_LF} || {_LF}"),
        (r"(?i)(^|[^\n])\s([a-zđ]\)\s+)", rf"'\1' || {_LF} || '\2'"), (r"(?i)(^|[^\n])\s([a-zđ]\.\d+\)\s+)", rf"'\1' || {_LF} || '\2'"),
    ])


_CHAPTER = r"(?i)Chương\s+[IVXLC]+(?:\s*\n+|\s+)[A-ZÀ-Ỹ0-9 ,\-/()]+"
_APPENDIX = r"(?i)\n((phụ lục|danh sách các biểu mẫu)([^\p{L}\p{N}_]|$)|mẫu số(\s*[: ]|\s+\d+))"
_BLOCK = r"(?i)((phụ lục|danh sách các biểu mẫu)([^\p{L}\p{N}_]|$)|mẫu số([: ]|\s+\d+))"
_NUMBERED = _strip("regexp_replace(" + _strip("part") + r", '^\d+\.\s+', '')")
_LETTERED = _strip("regexp_replace(" + _strip("part") + r", '(?i)^[a-zđ]\)\s+', '')")
_ARTICLES = rf"""
{corpus.PAGES},
cp as (select doc, page, {_clean('text')} as text from pages_of),
w as (select doc, string_agg(text, chr(10) || chr(10) order by page) filter (where text <> '') as t from cp group by doc),
parts as (select doc, generate_subscripts(s, 1) - 1 as pos, unnest(s) as part from (select doc, string_split(regexp_replace({_strip(f"string_split_regex(t, '{_APPENDIX}')[1]")}, '(?i)(Đi.{{0,2}}u\s+\d+\.\s*[^\n]+)', chr(1) || '\1', 'g'), chr(1)) as s from w)),
c as (select *, regexp_replace({_strip(f"regexp_extract_all(part, '{_CHAPTER}')[-1]")}, '\s*\n+\s*', ' - ', 'g') as ch from parts),
h as (select *, last_value(ch ignore nulls) over (partition by doc order by pos rows between unbounded preceding and 1 preceding) as chapter, regexp_extract(part, '(?i)^Đi.{{0,2}}u\s+(\d+)\.', 1) as no from c),
fp as (select doc, try_cast(no as integer) as dieu, min(page) as first_page from (select doc, page, unnest(regexp_extract_all(text, '(?i)Đi.{{0,2}}u\s+(\d+)\.', 1)) as no from cp) group by all),
art as (select doc, pos::integer as pos, chapter, try_cast(no as integer) as dieu, 'Điều ' || regexp_replace(no, '^0+([0-9])', '\1') || '. ' || {_strip(r"regexp_extract(part, '(?i)^Đi.{0,2}u\s+\d+\.\s*([^\n]+)', 1)")} as title, {_strip('part')} as text from h where no <> ''),
nt as (select *, {_normal('text')} as n from art),
ti as (select *, {_strip('string_split(n, chr(10))[1]')} as first, regexp_extract({_strip('string_split(n, chr(10))[1]')}, '(?i)^(Điều\s+\d+\.\s+.*?)(\s+\d+\.\s+|$)', 1) as tt, string_split(n, chr(10))[2:] as rest from nt),
bd as (select *, case when tt = '' then first else {_strip('tt')} end as head, {_strip(f"array_to_string(case when tt = '' or {_strip('substring(first, length(tt) + 1)')} = '' then rest else list_concat([{_strip('substring(first, length(tt) + 1)')}], rest) end, chr(10))")} as body from ti),
cs as (select doc, pos, dieu, title, head, string_split(regexp_replace(chr(10) || body, '\n\s*(\d+\.\s)', chr(1) || '\1', 'g'), chr(1)) as s from bd),
ce as (select doc, pos, dieu, title, head, {_strip('s[1]')} as preface, generate_subscripts(s[2:], 1) - 1 as k, unnest(s[2:]) as part from cs),
cl as (select doc, pos, dieu, title, head, k::integer as k, try_cast(regexp_extract(part, '^(\d+)\.', 1) as integer) as khoan, {_strip("case when k = 0 and preface <> '' then preface || chr(10) else '' end || " + _NUMBERED)} as clause from ce),
pl2 as (select *, array_to_string(list_filter(list_transform(string_split({_normal('clause')}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), chr(10)) as ls from cl),
ps as (select doc, pos, dieu, title, head, k, khoan, string_split(regexp_replace(chr(10) || ls, '(?i)\n\s*([a-zđ]\)\s)', chr(1) || '\1', 'g'), chr(1)) as s from pl2),
pe as (select doc, pos, dieu, title, head, k, khoan, generate_subscripts(s, 1) - 1 as p, unnest(s) as part from ps),
pt as (select * from (select doc, pos, dieu, title, head, k, khoan, p, lower(nullif(regexp_extract(part, '(?i)^([a-zđ])\)(\s|$)', 1), '')) as diem, {_LETTERED} as said from pe) where said <> '')
"""
_SLUG = r"trim(regexp_replace(regexp_replace({_x}, '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '_+', '_', 'g'), '_')"
_REFINED = rf"""{_ARTICLES},
sv as (select *, max(diem is not null) over (partition by doc, pos, k) as several from pt),
rw as (
  select doc, pos, dieu, title, null::integer as khoan, null::varchar as diem, 1 as level, -1 as k, 0 as p, 'toàn_bộ_điều' as unit, {_normal('text')} as text from art
  union all
  select doc, pos, dieu, title, khoan, diem, case when diem is null then 2 else 3 end, k, p, 'khoản_' || khoan || case when diem is not null then '_điểm_' || diem when several then '_mở_đầu' else '' end,
    {_normal("head || chr(10) || chr(10) || 'Khoản ' || khoan || '.' || case when diem is null then ' ' || said else chr(10) || 'Điểm ' || diem || ') ' || said end")} from sv
),
nb as (select *, row_number() over (partition by doc, pos order by k, p) as idx, count(*) over (partition by doc, pos) as n_parts, concat_ws(chr(10), 'Văn bản: ' || doc, title, 'Khoản ' || khoan, 'Điểm ' || diem, 'Đơn vị nội dung: ' || unit) as hd from rw),
md as (select *, concat_ws('_', doc::varchar, 'dieu' || dieu, 'khoan' || khoan, 'diem' || diem, unit, 'chunk' || idx) as chunk_id, case when starts_with(text, hd) then text else hd || chr(10) || chr(10) || text end as full_text from nb),
hs as (select *, md5(regexp_replace({_strip('lower(full_text)')}, '{_WS}+', ' ', 'g')) as hash from md)
"""

_PIECE = _strip("substring(t, start + 1, cut - start)")


def _cuts(keys: str, rows: str) -> str:
    """The recursive table cuts: where smart_cuts begins and ends each piece of the texts t of rows, a step that finds a cut and one that moves on in turn."""
    return rf"""
cuts as (
  select {keys}, t, 0 as chunk_index, 0 as start, case when length(t) <= 2200 then length(t) end as cut from {rows}
  union all
  select {keys}, t, case when done is not null then chunk_index + 1 else chunk_index end, case when done is not null then next else start end, case when done is null then best when length(t) - next <= 2200 then length(t) end from (
    select *, case when cut is not null and cut < length(t) then case when back > start then back else cut end end as next, cut as done,
      start + 1320 + coalesce(case when p1 > 0 then 880 - p1 + 1 when p2 > 0 then 880 - p2 + 1 when p3 > 0 then 880 - p3 + 1 when p4 > 0 then 880 - p4 + 1 when p5 > 0 then 880 - p5 + 1 when p6 > 0 then 880 - p6 + 1 when p7 > 0 then 880 - p7 + 1 end, 880) as best
    from (
      select *, strpos(win, chr(10) || chr(10)) as p1, strpos(win, chr(10)) as p2, strpos(win, ' .') as p3, strpos(win, ' ;') as p4, strpos(win, ' :') as p5, strpos(win, ' ,') as p6, strpos(win, ' ') as p7,
        greatest(0, length(regexp_extract(substring(t, 1, greatest(cut - 200, 0) + 1), '(?s)^(.*)\s', 1))) as back
      from (select *, reverse(substring(t, start + 1321, 880)) as win from cuts) where cut is null or cut < length(t))
  )
)"""


def _recursive(size: int = 800, overlap: int = 100) -> str:
    """recursive_cuts: down the marks, a table of nodes each (path: the place at every level above), then up again, overlapping where a level has cut."""
    marks = ["chr(10) || chr(10)", "chr(10)", "'. '", "' '"]
    down, up = [f"n0 as (select doc_id, lang, source, []::integer[] as path, {_strip('text')} as t, []::boolean[] as cut from documents)"], []
    for i, mark in enumerate(marks):
        longer = f"case when a[-1] <> '' then a[-1] || {mark} || x[1] else x[1] end"
        held = f"list_filter(list_reduce(list_transform(string_split(t, {mark}), lambda x: [x]), lambda a, x: case when length({longer}) <= {size} then list_concat(a[1:-2], [{longer}]) else list_concat(a, x) end, ['']), lambda x: x <> '')"
        down.append(f"g{i} as (select *, length(t) > {size} and contains(t, {mark}) as here, case when length(t) > {size} and contains(t, {mark}) then {held} else [t] end as ts from n{i})")
        down.append(f"n{i + 1} as (select doc_id, lang, source, list_append(path, j::integer) as path, ts[j] as t, list_append(cut, here) as cut from (select *, unnest(range(1, len(ts) + 1)) as j from g{i}))")
    n = len(marks)
    starts = f"range(0, length(t) - {overlap}, {size - overlap})"
    down.append(f"u{n} as (select doc_id, lang, source, path, cut, j::integer as j, case when length(t) <= {size} then t else substring(t, ({starts})[j] + 1, {size}) end as t from (select *, unnest(range(1, case when length(t) <= {size} then 2 else len({starts}) + 1 end)) as j from n{n}))")
    for i in reversed(range(n)):
        before = f"lag(t) over (partition by doc_id, path[1:{i}] order by path, j)"
        up.append(f"u{i} as (select * exclude (t), case when cut[{i + 1}] and {before} is not null then left(right({before}, {overlap}) || t, {size + overlap}) else t end as t from u{i + 1})")
    return f"""
with {', '.join([*down, *up])}, s as (select doc_id, lang, source, path, j, {_strip('t')} as t from u0)
select doc_id, lang, source, (row_number() over (partition by doc_id order by path, j) - 1)::integer as chunk_index, t as "text" from s where t <> ''
"""


ORACLE_SQL = {
    "fixed_window_chunks": """
select doc_id, unnest(range(0, greatest(0, length(text) - 1 - 100) // 700 + 1))::integer as chunk_index, md5(substring(text, unnest(range(0, greatest(0, length(text) - 1 - 100) // 700 + 1)) * 700 + 1, 800)) as hash from documents where length(text) > 0
""",
    "line_pack_chunks": r"""
with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as ls from documents),
f as (select doc_id, list_reduce(list_transform(ls, lambda x: [x]), lambda a, x: case when len(a) > 0 and length(a[-1]) + length(x[1]) + 1 <= 1800 then list_concat(a[1:-2], [a[-1] || chr(10) || x[1]]) else list_concat(a, x) end, []::varchar[]) as c from l)
select doc_id, (generate_subscripts(c, 1) - 1)::integer as chunk_index, md5(unnest(c)) as hash from f
""",
    "article_split": f"with {_ARTICLES} select doc, pos, dieu, title, md5(text) as hash from art",
    "chapter_asof": """
select user_id, event_id, view_id from (select *, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as view_id from events) where event_type = 'purchase'
""",
    "article_chapters": f"with {_ARTICLES} select doc, pos, dieu, chapter, coalesce(first_page, -1) as first_page from art left join fp using (doc, dieu)",
    "appendix_blocks": rf"""with {_ARTICLES},
tl as (select doc, {_strip(f"substring(t, length(string_split_regex(t, '{_APPENDIX}')[1]) + 1)")} as t from w),
bl as (select doc, list_filter(list_transform(string_split(regexp_replace(t, '{_BLOCK}', chr(1) || '\1', 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') as b from tl where t <> '')
select doc, generate_subscripts(b, 1)::integer as idx, left({_strip('string_split(unnest(b), chr(10))[1]')}, 200) as title, md5(unnest(b)) as hash from bl
""",
    "law_rows": rf"""with {_ARTICLES},
tl as (select doc, {_strip(f"substring(t, length(string_split_regex(t, '{_APPENDIX}')[1]) + 1)")} as t from w),
bl as (select doc, list_filter(list_transform(string_split(regexp_replace(t, '{_BLOCK}', chr(1) || '\1', 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') as b from tl where t <> ''),
ap as (select doc, generate_subscripts(b, 1) as idx, unnest(b) as text from bl),
un as (
  select doc, pos as place, 'nội_dung_chính' as loai_noi_dung, coalesce(chapter, '') as chuong, dieu, title as tieu_de_dieu, coalesce(first_page, -1) as trang_bat_dau, null::varchar as tieu_de_phu_luc, text from art left join fp using (doc, dieu)
  union all select doc, idx::integer, 'phụ_lục', null, null, null, null, left({_strip('string_split(text, chr(10))[1]')}, 200), text from ap),
lw as (select doc_id as doc, {corpus._pick(corpus.NAMES, 'doc_id % 6')} as ten_van_ban, {corpus._pick(corpus.CODES, 'doc_id % 6')} as ma_van_ban, case when doc_id % 2 = 0 then {corpus._pick(corpus.TYPES, 'doc_id % 6')} end as loai_van_ban, case when doc_id % 3 = 0 then {corpus._pick(corpus.ISSUERS, 'doc_id % 6')} end as cap_ban_hanh from documents where doc_id % 7 <> 3)
select doc, place, loai_noi_dung, coalesce(ten_van_ban, '') as ten_van_ban, coalesce(ma_van_ban, '') as ma_van_ban, coalesce(loai_van_ban, case loai_noi_dung when 'phụ_lục' then 'phụ_lục_văn_bản' else '' end) as loai_van_ban, coalesce(cap_ban_hanh, 'không_xác_định') as cap_ban_hanh,
  chuong, dieu, tieu_de_dieu, trang_bat_dau, tieu_de_phu_luc, md5(text) as hash from un left join lw using (doc)
""",
    "legal_normalise": f"with {corpus.PAGES} select doc, page, md5({_normal('text')}) as hash from pages_of",
    "clause_split": f"with {_ARTICLES} select doc, pos, khoan, head, md5(clause) as hash from cl",
    "point_split": f"with {_ARTICLES} select doc, pos, khoan, diem, md5(said) as hash from pt",
    "refine_chunks": f"with {_REFINED} select doc, pos, dieu, khoan, diem, level, unit, idx::integer as idx, n_parts, chunk_id, hash from (select *, row_number() over (partition by hash order by doc, pos, idx) as n from hs) where n = 1",
    "legal_order": f"""with {_REFINED}
select doc, pos, khoan, diem, idx::integer as idx, row_number() over (partition by doc, pos order by coalesce(khoan, 0), level, case when diem is null then 0 else coalesce(list_position(['a','b','c','d','đ','e','g','h','i','k','l','m','n'], diem), 99) end, idx)::integer as place from hs
""",
    "smart_split": rf"""
with recursive d as (select doc_id, lang, {_strip('text')} as t from documents), {_cuts('doc_id, lang', 'd')}
select doc_id, lang, chunk_index::integer as chunk_index, md5({_PIECE}) as hash from cuts where cut is not null
""",
    "refine_cut": rf"""
with recursive {_REFINED.split('nb as (')[0]}
lg as materialized (select row_number() over () as rid, * from rw where length(text) > 2200), d as (select rid, text as t from lg), {_cuts('rid', 'd')},
sz as (
  select doc, pos, dieu, title, khoan, diem, level, k, p, 0 as w, unit, text from rw where length(text) <= 2200
  union all
  select doc, pos, dieu, title, khoan, diem, level, k, p, chunk_index, unit || '_cửa_sổ_' || (chunk_index + 1), {_PIECE} from lg join cuts using (rid) where cut is not null
),
nb as (select *, row_number() over (partition by doc, pos order by k, p, w) as idx, {_REFINED.split('as idx, ')[1].replace('from rw)', 'from sz)', 1)}
select doc, pos, khoan, diem, level, unit, idx::integer as idx, n_parts, chunk_id, hash from (select *, row_number() over (partition by hash order by doc, pos, idx) as n from hs) where n = 1
""",
    "recursive_chunks": _recursive(),
}
ORACLE_SQL |= {"sql_clauses": ORACLE_SQL["clause_split"], "sql_points": ORACLE_SQL["point_split"], "sql_windows": ORACLE_SQL["fixed_window_chunks"]}
