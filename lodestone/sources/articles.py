"""Article pages as rows: main content and date of publication, and pages fetched by a given reader."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import first_date

# Places of the main content and of dates: a class, or an element.
CONTENT = [".article-content", ".news-detail", ".content-detail", ".detail-content", ".item-page", ".content", "article", "main"]
DATES = ["time", ".date", ".news-date", ".article-date", ".publish-date", ".created-date", ".time"]
LEAST, LINE = 300, 30
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "noscript"}


class _Texts(HTMLParser):
    """Text nodes of a page, each with the places that it stands in: "article" or ".content" and the element's number."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, dict[str, int]]] = []
        self.made: list[tuple[str, str | None]] = []  # (place, datetime) by number
        self.nodes: list[tuple[str, dict[str, int], bool]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        places = dict(self.open[-1][1]) if self.open else {}
        for place in (tag, *(f".{c}" for c in (given.get("class") or "").split())):
            self.made.append((place, given.get("datetime")))
            places[f"{place}#{len(self.made) - 1}"] = len(self.made) - 1
        if tag not in _VOID:
            self.open.append((tag, places))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.nodes.append((data.strip(), self.open[-1][1] if self.open else {}, any(t in _SILENT for t, _ in self.open)))


def parsed(html: str) -> tuple[str | None, list[str]]:
    """Main content (null where none is long enough), and the texts that may hold a date, in the order of the places."""
    page = _Texts()
    page.feed(html)
    page.close()
    within = lambda n, between, silent: between.join(t for t, places, s in page.nodes if n in places.values() and not (s and silent))
    first = {place: i for i, (place, _) in reversed(list(enumerate(page.made)))}
    found = [t for t in (within(first[p], "\n", True) for p in CONTENT if p in first) if len(t) > LEAST]
    if found:
        content = max(found, key=len)
    else:
        lines = (x.strip() for x in within(first["body"], "\n", True).splitlines()) if "body" in first else ()
        content = "\n".join(x for x in lines if len(x) >= LINE)
        content = content if len(content) > LEAST else None
    dates = [given or within(i, " ", False) for p in DATES for i, (place, given) in enumerate(page.made) if place == p]
    return content, [d for d in dates if d] + [" ".join(t for t, _, _ in page.nodes)]


def articles(pages: DataFrame) -> DataFrame:
    """pages (html, ...) with content and published_at (ISO; a value that pages have already goes before)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parsed(h or "") for h in b["html"]]
            yield b.drop(columns="html").assign(content=[f[0] for f in found], dates=[f[1] for f in found])

    kept = [c for c in pages.columns if c not in ("content", "html", "dates")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in kept)
    out = pages.select(*(f"`{c}`" for c in kept), "html").mapInPandas(run, f"{schema}, content string, dates array<string>")
    found = first_date(F.col("dates"))
    return out.withColumn("published_at", F.coalesce(F.nullif(F.col("published_at"), F.lit("")), found) if "published_at" in kept else found).drop("dates")


def fetched(items: DataFrame, read: Callable[[str], str]) -> DataFrame:
    """items (url, ...) with content, published_at, article_crawled_at (UTC, ISO) and crawl_error: the page that read(url) gives.

    What read raises, or a missing address, becomes the error of its row, which has no content then. read is given by the caller; it
    runs in tasks, so a lost executor reads its pages again.
    """
    kept = [f for f in items.schema if f.name not in ("html", "crawl_error", "content", "article_crawled_at")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages, errors = [], []
            for url in b["url"]:
                page, error = None, None if url else "Missing URL"
                try:
                    page = read(url) if url else None
                except Exception as e:  # any failure is told in its row
                    error = str(e)
                pages.append(page)
                errors.append(error)
            yield b.assign(html=pages, crawl_error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    rows = items.select(*(f"`{f.name}`" for f in kept)).mapInPandas(run, f"{schema}, html string, crawl_error string")
    if "published_at" not in rows.columns:
        rows = rows.withColumn("published_at", F.lit(None).cast("string"))
    at = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return articles(rows).withColumn("article_crawled_at", at)
