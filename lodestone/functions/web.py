"""Column functions over HTML and addresses."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import WS, let

_LINK = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'


def links(html: Column) -> Column:
    """struct(href, title) of every link, in page order."""
    return F.zip_with(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)), F.regexp_extract_all(html, F.lit(_LINK), F.lit(2)), lambda h, t: F.struct(h.alias("href"), t.alias("title")))


#: The named references of HTML by name, from the standard library.
_NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def decoded(text: Column) -> Column:
    """Character references as characters, each once: named ones, decimal and hexadecimal ones; a no-break space becomes a space. What
    isn't a reference, and numbers that no character has, stay."""

    def one(part: Column) -> Column:
        # a part is what follows an ampersand
        def shown(name: Column) -> Column:
            number = F.when(F.startswith(name, F.lit("#")), F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("int"))
            real = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
            by_number = F.when(real, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
            return F.coalesce(by_number, F.try_element_at(F.create_map(*(F.lit(x) for kv in _NAMED.items() for x in kv)), name))

        found = let(F.regexp_extract(part, _REFERENCE, 1), lambda name: F.when(name != "", F.concat(F.translate(shown(name), "\u00a0", " "), F.substr(part, F.char_length(name) + 2))))
        return F.coalesce(found, F.concat(F.lit("&"), part))

    parts = lambda p: F.concat(p[0], F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), one), ""))
    return F.when(F.contains(text, F.lit("&")), let(F.split(text, "&"), parts)).otherwise(text)


def stripped(html: Column) -> Column:
    """Text of markup: tags go, then entities are decoded, white space is joined."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(html, "<[^>]*>", " ")), f"{WS}+", " "))


def feed_text(escaped: Column) -> Column:
    """Text of a feed's field, which holds escaped markup: entities are decoded first, then tags go."""
    return F.trim(F.regexp_replace(F.regexp_replace(decoded(escaped), "<[^>]+>", " "), f"{WS}+", " "))


def absolute(base: Column, href: Column) -> Column:
    """href as an absolute address under base: whole ones stay; "//host", "/path", "?query", "#part" and relative ones ("x",
    "./x", "../x") stand where base puts them; an empty one stays empty."""
    scheme, host = F.regexp_extract(base, r"^(\w+:)", 1), F.regexp_extract(base, r"^(\w+://[^/?#]+)", 1)
    plain = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(plain, r"^(\w+://[^/]+(?:/.*)?)/[^/]*$", 1)
    root = F.when(folder == "", host).otherwise(folder)
    # segments one by one: ".." takes the one before, if there is any; "." goes
    rest = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.substr(href, F.char_length(rest) + 1)
    segments = F.split(F.substr(F.concat(root, F.lit("/"), rest), F.char_length(host) + 2), "/")
    none = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        return F.when(x == "..", F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).when(x == ".", done).otherwise(F.array_append(done, x))

    ends = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise("")
    joined = F.aggregate(segments, none, step, lambda done: F.concat(F.array_join(done, "/"), F.when(F.size(done) > 0, ends).otherwise("")))
    path = F.concat(host, F.lit("/"), joined, tail)
    return (
        F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), href).when(href == "", "").when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(host, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href)).when(href.startswith("?"), F.concat(plain, href)).otherwise(path)
    )


def news_link(title: Column, url: Column, wanted: list[str] = rules.NEWS_WANTED, ignored: list[str] = rules.NEWS_IGNORED, mark: str = "urile=wcm", least: int = 20) -> Column:
    """Whether a link leads to news: a long enough title, the mark in its address, no ignored word and a wanted one."""
    from .text import contains_any

    said = F.lower(title)
    return (F.char_length(title) >= least) & F.contains(F.lower(url), F.lit(mark)) & ~contains_any(said, ignored) & contains_any(said, wanted)
