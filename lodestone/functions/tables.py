"""Table functions that SQL can call over a table, in parts that no row of another part is needed for: lodestone_clauses(TABLE(articles) PARTITION BY doc) and others.

They give the rows of operators.segment and operators.news, whose patterns they share.
"""

from __future__ import annotations

import regex
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .text import LEGAL_STEPS

_S = " \\t\\n\\x0b\\f\\r"


def _form(java: str) -> regex.Pattern:
    """A pattern of the column functions, whose white space and digits are those of ASCII."""
    return regex.compile(java.replace(rf"\s", f"[{_S}]").replace(r"\d", "[0-9]"))


_LEGAL = [(_form(a), b.replace("$", "\\")) for a, b in LEGAL_STEPS]
_ENDS = regex.compile(rf"^[{_S}\p{{Z}}]+|[{_S}\p{{Z}}]+$")
_TITLE = _form(r"(?iu)^(Điều\s+\d+\.\s+.*?)(?=\s+\d+\.\s+|$)")
_CLAUSE, _NUMBER = _form(r"\n\s*(?=\d+\.\s)"), _form(r"^(\d+)\.")
_NUMBERED = _form(r"^\d+\.\s+")
_POINT, _LETTER, _LETTERED = _form(r"(?iu)\n\s*(?=[a-zđ]\)\s)"), _form(r"(?iu)^([a-zđ])\)(?:\s|$)"), _form(r"(?iu)^[a-zđ]\)\s+")
_PARAGRAPH = regex.compile(rf"[{_S}\p{{Z}}]+")


def stripped(text: str) -> str:
    return _ENDS.sub("", text)


def normal(text: str) -> str:
    for form, to in _LEGAL:
        text = form.sub(to, text)
    return stripped(text)


def _int(digits: str) -> int | None:
    return int(digits) if len(digits) < 11 and int(digits) < 1 << 31 else None


def clauses_of(text: str) -> tuple[str, list[tuple[str, str]]]:
    """Head of an article's text, and the number and words of its clauses."""
    lines = normal(text).split("\n")
    first = stripped(lines[0])
    found = _TITLE.search(first)
    title = found[1] if found else ""
    left = stripped(first[len(title) :]) if title else ""
    body = stripped("\n".join([left, *lines[1:]] if left else lines[1:]))
    parts = _CLAUSE.split("\n" + body)
    out = []
    for k, part in enumerate(parts[1:]):
        said = stripped(_NUMBERED.sub("", stripped(part)))
        preface = stripped(parts[0])
        number = _NUMBER.match(part)[1].lstrip("0") or "0"
        out.append((number, stripped(f"{preface}\n{said}") if k == 0 and preface else said))
    return (stripped(title) if title else first), out


class Clauses:
    """Rows with doc, pos, text (an article) by clause."""

    def eval(self, row: Row):
        if row["text"] is None:
            return
        head, found = clauses_of(row["text"])
        for k, (number, said) in enumerate(found):
            yield row["doc"], row["pos"], head, k, number, _int(number), said


class Points:
    """Rows with doc, pos, k, khoan, clause by point."""

    def eval(self, row: Row):
        if row["clause"] is None:
            return
        lines = "\n".join(x for x in map(stripped, normal(row["clause"]).split("\n")) if x)
        for p, part in enumerate(_POINT.split("\n" + lines)):
            letter = _LETTER.match(part)
            said = stripped(_LETTERED.sub("", stripped(part)))
            if said:
                yield row["doc"], row["pos"], row["k"], row["khoan"], p, letter[1].lower() if letter else None, said


class Windows:
    """Rows with doc_id, text by window of ``size`` characters, each ``overlap`` into the one before."""

    def eval(self, row: Row, size: int, overlap: int):
        if overlap >= size:
            raise ValueError("overlap must be below size")
        text = row["text"] or ""
        for i, at in enumerate(range(0, max(0, len(text) - 1 - overlap) + 1, size - overlap) if text else ()):
            yield row["doc_id"], i, text[at : at + size]


class NewsChunks:
    """Rows with news_id, title, content by chunk: paragraphs of at most ``most`` characters together, the last one again at the next chunk's beginning."""

    def eval(self, row: Row, most: int):
        title = stripped(row["title"] or "")
        lines = [p for x in regex.sub(r"\r\n?", "\n", row["content"] or "").split("\n") if (p := stripped(_PARAGRAPH.sub(" ", x)))]
        if lines and lines[0] == title:
            lines = lines[1:]
        done, now = [], []
        for p in lines:
            if len("\n".join([*now, p])) <= most:
                now.append(p)
            else:
                done += [now] if now else []
                now = [*now[-1:], p]
        for i, group in enumerate([*done, now] if now else done):
            yield row["news_id"], i, "\n".join([title, *group] if title else group)


FUNCTIONS = {
    "lodestone_clauses": (Clauses, "doc bigint, pos int, head string, k int, no string, khoan int, clause string"),
    "lodestone_points": (Points, "doc bigint, pos int, k int, khoan int, p int, diem string, said string"),
    "lodestone_windows_of": (Windows, "doc_id bigint, chunk_index int, chunk string"),
    "lodestone_news_chunks": (NewsChunks, "news_id bigint, chunk_index int, chunk string"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the table functions known to the session and returns their names."""
    for name, (made, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made, returnType=schema))
    return list(FUNCTIONS)
