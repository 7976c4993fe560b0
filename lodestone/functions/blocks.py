"""Columns that show chunks to readers and models: citations, headers, prompts, dates and shortened texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped


def citation(document: Column, dieu: Column, khoan: Column, diem: Column) -> Column:
    """[document | Điều a | Khoản b | Điểm c]; what is missing is left out."""
    named = lambda label, c: F.concat(F.lit(label), F.nullif(c.cast("string"), F.lit("")))
    return F.concat(F.lit("["), F.concat_ws(" | ", document, named("Điều ", dieu), named("Khoản ", khoan), named("Điểm ", diem)), F.lit("]"))


def context_block(document: Column, dieu: Column, khoan: Column, diem: Column, text: Column) -> Column:
    """A chunk as a context shows it: its citation and its text; a blank text gives none."""
    said = stripped(text)
    return F.when(said == "", "").otherwise(F.concat(citation(F.coalesce(document, F.lit("Không rõ văn bản")), dieu, khoan, diem), F.lit("\n\n    "), said))


def rerank_header(document: Column, title: Column, dieu: Column, khoan: Column, diem: Column, unit: Column) -> Column:
    """What stands before a chunk's text: document, title or else article, clause, point and unit, a line each; what is missing is left out."""
    named = lambda label, c: F.concat(F.lit(label), F.nullif(c.cast("string"), F.lit("")))
    return F.concat_ws("\n", named("Văn bản: ", document), F.coalesce(F.nullif(title, F.lit("")), named("Điều ", dieu)), named("Khoản ", khoan), named("Điểm ", diem), named("Đơn vị nội dung: ", unit))


def rerank_text(header: Column, body: Column) -> Column:
    """Header and body as a reranking model sees them."""
    return F.when(header == "", stripped(body)).otherwise(F.concat(header, F.lit("\n\n"), stripped(body)))


def identity(chunk_id: Column, id_: Column, code: Column, dieu: Column, khoan: Column, diem: Column, text: Column) -> Column:
    """What tells a chunk from others: its chunk_id, else its id, else its place and the first 100 characters of its text."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    place = F.concat_ws("|", shown(code), shown(dieu), shown(khoan), shown(diem), F.left(shown(text), F.lit(100)))
    return F.coalesce(F.nullif(chunk_id, F.lit("")), F.nullif(id_, F.lit("")), place)


def prompt(question: Column, context: Column) -> Column:
    """What a model is asked: to answer from the context only, and to say where the answer stands."""
    return F.concat(F.lit("Chỉ trả lời dựa trên ngữ cảnh sau và nêu căn cứ.\n\n"), context, F.lit("\n\nCâu hỏi: "), question)


def shortened(text: Column, most: int) -> Column:
    """The text, or its first ``most`` characters up to the last space with a mark of what is missing."""
    cut = F.rtrim(F.regexp_replace(F.left(text, F.lit(most)), r" [^ ]*$", ""))
    return F.when(F.char_length(text) > most, F.concat(cut, F.lit(" [...]"))).otherwise(text)


def shown_date(iso: Column, unknown: str = "Chưa xác định") -> Column:
    """dd/mm/yyyy of an ISO date or time, the value itself where it is none, a label where it is empty."""
    form = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"
    at = F.date_format(F.try_to_timestamp(F.left(F.when(iso.rlike(form), iso), F.lit(10)), F.lit("yyyy-MM-dd")), "dd/MM/yyyy")
    return F.when(F.coalesce(iso, F.lit("")) == "", F.lit(unknown)).otherwise(F.coalesce(at, iso))


def decoded_list(json: Column) -> Column:
    """The strings of a JSON array; anything else is empty."""
    return F.coalesce(F.from_json(json, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def status(question: Column) -> Column:
    """HTTP status of a request: 400 for a blank question, 422 outside 2 to 2000 characters, else 200."""
    q = F.coalesce(question, F.lit(""))
    return F.when(~F.char_length(q).between(2, 2000), 422).when(F.trim(q) == "", 400).otherwise(200)
