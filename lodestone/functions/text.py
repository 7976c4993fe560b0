"""Column functions over texts, all within Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

NOT_WORD = r"[^\p{L}\p{N}_]+"
#: A white space character of any script.
WS = r"[\s\p{Z}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda x: x != "")


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def content_hash(text: Column) -> Column:
    return F.md5(F.regexp_replace(stripped(F.lower(text)), f"{WS}+", " "))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(stripped(F.lower(text)), NOT_WORD, "_"), "_+", "_"), F.lit("_"))


def _replaced(text: Column, steps: tuple) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


#: "Điều" with blanks that recognition put between its letters.
_SPACED = (r"(?iu)(?<![\p{L}\p{N}_])Đ\s*i\s*ề\s*u(?![\p{L}\p{N}_])", "Điều")


CLEAN_STEPS = ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"\s+([,.;:])", "$1"), _SPACED)
LEGAL_STEPS = (
    (r"\r\n?", "\n"), _SPACED, (r"(?iu)Điều\s*\n\s*(\d+)\.", "Điều $1."), (r"([\p{L}\p{N}_])\s*-\s*\n\s*([\p{L}\p{N}_])", "$1-$2"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"),
    (r"(?iu)(?<!\n)\s([a-zđ]\)\s+)", "\n$1"), (r"(?iu)(?<!\n)\s([a-zđ]\.\d+\)\s+)", "\n$1"),
)


def clean_page(text: Column) -> Column:
    """Line ends made alike, blanks joined, at most one empty line, no white space before marks, "Đ i ề u" closed up."""
    return stripped(_replaced(text, CLEAN_STEPS))


def normal_legal(text: Column) -> Column:
    """As clean_page for marks of the law: a heading's number joins its "Điều", words cut at line ends join by their hyphen, and
    points ("a)", "a.1)") begin lines."""
    return stripped(_replaced(text, LEGAL_STEPS))


def contains_any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


def first_class(text: Column, classes: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """The first class one of whose phrases the text holds."""
    found = reduce(lambda acc, c: F.when(contains_any(text, c[1]), F.lit(c[0])) if acc is None else acc.when(contains_any(text, c[1]), F.lit(c[0])), classes, None)
    return found.otherwise(F.lit(default).cast("string"))


def phrases_in(text: Column, phrases: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def weight_in(text: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the phrases that the text holds."""
    return reduce(lambda a, b: a + b, (F.when(F.contains(text, F.lit(k)), F.lit(v)).otherwise(F.lit(0.0)) for k, v in weights.items()))


def references(text: Column) -> Column:
    """References to legal documents, by form, each once."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(f"(?iu){form}"), F.lit(0)), F.trim) for form in rules.REFERENCE_FORMS]
    return F.array_distinct(F.concat(*found))


def first_date(candidates: Column) -> Column:
    """The first date in an array of texts, in their order, as an ISO time of day 00:00: day/month/year, or else with dashes."""
    forms = ((r"(?<![\p{L}\p{N}_])\d{1,2}/\d{1,2}/\d{4}(?![\p{L}\p{N}_])", "d/M/yyyy"), (r"(?<![\p{L}\p{N}_])\d{1,2}-\d{1,2}-\d{4}(?![\p{L}\p{N}_])", "d-M-yyyy"))
    dated = lambda t: F.coalesce(*(F.try_to_timestamp(F.nullif(F.regexp_extract(t, form, 0), F.lit("")), F.lit(shape)) for form, shape in forms))
    return F.date_format(F.get(F.filter(F.transform(candidates, dated), lambda x: x.isNotNull()), F.lit(0)), "yyyy-MM-dd'T'HH:mm:ss")


def point_order(point: Column) -> Column:
    """1, 2, ... for the points of a clause, 0 for none, 99 for any other."""
    at = F.array_position(F.array(*map(F.lit, rules.POINT_ORDER)), F.lower(point))
    return F.when(F.coalesce(point, F.lit("")) == "", 0).when(at > 0, at).otherwise(99).cast("int")
