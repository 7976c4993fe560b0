"""Files as Spark data sources: feeds, pages of documents and links of HTML pages by ``spark.read.format(...)``.

    spark.dataSource.register(FeedFiles)
    spark.read.format("lodestone_feeds").load(path)

A reader lists the files of a folder (any store that pyarrow knows by the path's scheme), deals them into partitions of about ``partition_mb`` and reads
each file piece by piece, so memory holds one document at a time. What can't be read is a row with its error, and all other rows stay.

Formats: lodestone_feeds (file, doc, source_name, title, url, summary, published_at, error), files of one or more RSS documents;
lodestone_links (file, doc, pos, href, title, error), files of one or more HTML pages, each up to its end tag;
lodestone_pages (file, page, extract_method, text, error), files of pages parted by form feeds, or what option ``layer``, the name
"module:function" of a function from bytes to page texts, makes of them; a page with fewer than ``least`` (50) characters is read by
``recognise``, a function of the file's bytes and the page's number, where one is named.

A store that pyarrow doesn't know, or a path that is no address to it, is read by ``read``: Spark opens the files and cuts them into documents, tasks parse these as the
data source does. There a file must fit in memory, and one that can't be opened fails the query.
"""

from __future__ import annotations

import html
import importlib
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .feeds import ENTITIES

BLOCK = 1 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def _store(self) -> tuple[fs.FileSystem, str]:
        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[Files]:
        store, path = self._store()
        found = store.get_file_info(path)
        infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        most = int(float(self.options.get("partition_mb", "16")) * (1 << 20))
        out, size = [], most
        for i in sorted((i for i in infos if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))), key=lambda i: i.path):
            if size + i.size > most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(i.path)
            size += max(i.size, 1 << 12)
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._store()
        for path in partition.paths:
            try:
                with store.open_input_stream(path) as f:
                    yield from self.rows(path, f)
            except Exception as e:  # noqa: BLE001  a file that can't be read is a row
                yield self.failed(path, None, e)

    def documents(self, f, end: bytes) -> Iterator[str]:
        """The texts of a file that end with the tag ``end``; what stands behind the last is one if it isn't blank."""
        held, form = b"", re.compile(re.escape(end), re.I)
        while block := f.read(BLOCK):
            at = max(0, len(held) - len(end))  # the tag may lie across two blocks
            held += block
            while found := form.search(held, at):
                yield held[: found.end()].decode("utf-8", "replace")
                held, at = held[found.end() :], 0
        if held.strip():
            yield held.decode("utf-8", "replace")


def plain(markup: str) -> str:
    """Text of a feed's field: references are characters, tags go, white space is joined."""
    return " ".join(re.sub(r"<[^>]+>", " ", html.unescape(markup)).split())


def repaired(xml: str) -> str:
    """XML without entities that it doesn't know; stray ampersands are entities."""
    for entity, text in ENTITIES:
        xml = xml.replace(entity, text)
    return re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)", "&amp;", xml)


class FeedReader(_Reader):
    def failed(self, path: str, doc: int | None, e: Exception) -> tuple:
        return path, doc, None, None, None, None, None, f"{type(e).__name__}: {e}"

    END = "</rss>"

    def rows(self, path: str, f) -> Iterator[tuple]:
        for doc, xml in enumerate(self.documents(f, self.END.encode())):
            yield from self.document(path, doc, xml)

    def document(self, path: str, doc: int, xml: str) -> Iterator[tuple]:
        try:
            root = ElementTree.fromstring(repaired(xml).strip())
        except ElementTree.ParseError as e:
            yield self.failed(path, doc, e)
            return
        named = plain(root.findtext("channel/title") or "") or None
        for item in root.iter("item"):
            title, url = plain(item.findtext("title") or ""), (item.findtext("link") or "").strip()
            if title and url:
                yield path, doc, named, title, url, plain(item.findtext("description") or "") or None, (item.findtext("pubDate") or "").strip() or None, None


class LinkReader(_Reader):
    END = "</html>"
    LINK = re.compile(r'<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', re.I | re.S)

    def failed(self, path: str, doc: int | None, e: Exception) -> tuple:
        return path, doc, None, None, None, f"{type(e).__name__}: {e}"

    def rows(self, path: str, f) -> Iterator[tuple]:
        for doc, page in enumerate(self.documents(f, self.END.encode())):
            yield from self.document(path, doc, page)

    def document(self, path: str, doc: int, page: str) -> Iterator[tuple]:
        for pos, (href, inner) in enumerate(self.LINK.findall(page)):
            yield path, doc, pos, href, " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split()), None


def named(function: str) -> Callable:
    module, _, name = function.partition(":")
    return getattr(importlib.import_module(module), name)


class PageReader(_Reader):
    def failed(self, path: str, page: int | None, e: Exception) -> tuple:
        return path, page, None, None, f"{type(e).__name__}: {e}"

    def rows(self, path: str, f) -> Iterator[tuple]:
        content = f.read()
        layer, other = self.options.get("layer"), self.options.get("recognise")
        texts = named(layer)(content) if layer else content.decode("utf-8", "replace").split("\f")
        for page, text in enumerate(texts, 1):
            short = bool(other) and len(text.strip()) < int(self.options.get("least", "50"))
            try:
                yield path, page, "ocr" if short else "text", named(other)(content, page) if short else text, None
            except Exception as e:  # noqa: BLE001  a page that can't be recognised is a row
                yield self.failed(path, page, e)


class FeedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestone_feeds"

    def schema(self) -> str:
        return "file string, doc int, source_name string, title string, url string, summary string, published_at string, error string"

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(dict(self.options))


class LinkFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestone_links"

    def schema(self) -> str:
        return "file string, doc int, pos int, href string, title string, error string"

    def reader(self, schema) -> DataSourceReader:
        return LinkReader(dict(self.options))


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestone_pages"

    def schema(self) -> str:
        return "file string, page int, extract_method string, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))


def read(spark: SparkSession, source: type[FeedFiles] | type[LinkFiles], path: str) -> DataFrame:
    """The rows of ``source`` for the files under a path of any store that Spark knows, every document of a file a row of its own before it is parsed."""
    made = source({})
    parse = made.reader(None)
    columns = [c.split()[0] for c in made.schema().split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [r for file, doc, text in zip(b["file"], b["doc"], b["text"], strict=True) for r in parse.document(file, doc, text)]
            yield pd.DataFrame(found, columns=columns)

    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    pieces = F.split(F.make_valid_utf8(F.col("content").cast("string")), f"(?i)(?<={parse.END})")
    return held.select(F.col("path").alias("file"), F.posexplode(pieces).alias("doc", "text")).filter(F.rlike("text", F.lit(r"\S"))).mapInPandas(rows, made.schema())


def register(spark) -> None:
    for source in (FeedFiles, LinkFiles, PageFiles):
        spark.dataSource.register(source)
