"""Queries over raw pages: links, hosts and article texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import rules as V
from lodestone.functions import web
from lodestone.operators.rank import top
from lodestone.sources import table
from lodestone.sources.articles import articles

from . import sql


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with a title, absolute, the first of each address on a page; some addresses are made relative ones."""
    pages = table(spark, sf_dir, "pages").withColumn("html", _relative())
    links = pages.select("page_id", "url", F.posexplode(web.links(F.col("html"))).alias("pos", "a"))
    rows = links.select("page_id", "pos", web.absolute(F.col("url"), F.col("a.href")).alias("link"), web.stripped(F.col("a.title")).alias("title")).filter("title <> '' and link <> ''")
    return top(rows, ["page_id", "link"], [F.col("pos")], 1, "n").select("page_id", "link", "title")


def _relative():
    """Pages whose links are "../x", "./x", "?x" or "//h/x" by page, for those that begin with "/"."""
    start = F.element_at(F.array(*map(F.lit, ("../", "./", "?", "//h.vn/", "/", "x/../"))), (F.col("page_id") % 6 + 1).cast("int"))
    return F.regexp_replace("html", F.lit('href="/'), F.concat(F.lit('href="'), start))


def news_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that lead to news: titles and addresses of every page's links with phrases of the law put in, by their place."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.posexplode(web.links(F.col("html"))).alias("pos", "a"))
    i = F.col("pos") + F.col("page_id")
    title = F.concat(F.when(i % 3 == 0, F.lit("Hộ kinh doanh và kê khai: ")).when(i % 3 == 1, F.lit("Chính sách thuế cho hộ kinh doanh ")).otherwise(F.lit("Tin về doanh thu ")), web.stripped(F.col("a.title")))
    url = F.concat(F.lit("https://a.vn"), F.col("a.href"), F.when(i % 2 == 0, F.lit("?URILE=wcm:path")).otherwise(""))
    return links.select("page_id", "pos", title.alias("title"), url.alias("url")).filter(web.news_link(F.col("title"), F.col("url")))


def html_article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main content of every page: the longest of the known places with more than 300 characters, else the body's long lines."""
    rows = articles(table(spark, sf_dir, "pages").select("page_id", "html"))
    return rows.select("page_id", F.char_length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("hash"), "published_at")


def page_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host")).agg(F.count("*").alias("n_pages"))


QUERIES = {f.__name__: f for f in (html_links, news_links, html_article_text, page_host)}

_STRIP = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '#'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[\s\p{{Z}}]+', ' ', 'g'))".replace("'#'", "'\"'")
_LINKS = r"""a as (select page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) as href, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) as title,
  generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1), 1) - 1 as pos from p)"""

#: Texts between tags; "&amp" is a reference without its semicolon too, as HTML has it.
_NODES = r"list_filter(list_transform(string_split_regex({}, '<!--.*?-->|<[^>]*>'), lambda x: regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '#'), '&#x27;', chr(39)), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda x: x <> '')".replace("'#'", "'\"'")

ORACLE_SQL = {
    "html_links": rf"""
with p as (select page_id, url, replace(html, 'href="/', 'href="' || ['../', './', '?', '//h.vn/', '/', 'x/../'][page_id % 6 + 1]) as html from pages), {_LINKS},
f as (select *, regexp_extract(url, '^(\w+:)', 1) as scheme, regexp_extract(url, '^(\w+://[^/?#]+)', 1) as host, regexp_extract(url, '^(\w+://[^/?#]+(/[^?#]*)?)', 1) as plain from a),
g as (select *, regexp_replace(plain, '^(\w+://[^/]+.*)/[^/]*$', '\1') as dir, regexp_replace(regexp_replace(plain, '^(\w+://[^/]+.*)/[^/]*$', '\1'), '^(\w+://[^/]+.*)/[^/]*$', '\1') as up from f),
b as (select page_id, pos, case when regexp_matches(href, '^[a-z]+:') then href when href = '' then '' when starts_with(href, '//') then scheme || href when starts_with(href, '/') then host || href when starts_with(href, '?') then plain || href
  when starts_with(href, '../') then up || '/' || href[4:] when starts_with(href, './') then dir || '/' || href[3:] when starts_with(href, 'x/../') then dir || '/' || href[6:] else dir || '/' || href end as link, {_STRIP.format('title')} as title from g)
select page_id, link, title from b where title <> '' and link <> '' qualify row_number() over (partition by page_id, link order by pos) = 1
""",
    "news_links": rf"""
with p as (select * from pages), {_LINKS},
t as (select page_id, pos::integer as pos, case (pos + page_id) % 3 when 0 then 'Hộ kinh doanh và kê khai: ' when 1 then 'Chính sách thuế cho hộ kinh doanh ' else 'Tin về doanh thu ' end || {_STRIP.format('title')} as title, 'https://a.vn' || href || case when (pos + page_id) % 2 = 0 then '?URILE=wcm:path' else '' end as url from a)
select * from t where length(title) >= 20 and contains(lower(url), 'urile=wcm') and not {sql.any_of('lower(title)', V.NEWS_IGNORED)} and {sql.any_of('lower(title)', V.NEWS_WANTED)}
""",
    "html_article_text": rf"""
with r as (select page_id, regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'g') as h from pages),
t as (select page_id, {_NODES.format("regexp_extract(h, '(?is)<article[^>]*>(.*?)(?:</article>|</body>|$)', 1)")} as a, {_NODES.format("regexp_extract(h, '(?is)<body[^>]*>(.*?)(?:</body>|$)', 1)")} as b from r),
l as (select page_id, array_to_string(a, chr(10)) as a, array_to_string(list_filter(list_transform(string_split(array_to_string(b, chr(10)), chr(10)), lambda x: trim(x)), lambda x: length(x) >= 30), chr(10)) as b from t),
c as (select page_id, case when length(a) > 300 then a when length(b) > 300 then b end as c from l)
select page_id, length(c)::bigint as n_chars, md5(c) as hash, null::varchar as published_at from c
""",
    "page_host": r"select lower(regexp_extract(url, '^\w+://([^/:?#]+)', 1)) as host, count(*) as n_pages from pages group by 1",
}
