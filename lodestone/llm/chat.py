r"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts: text, image, audio and document. A visitor (one fold over the
parts) flattens them into one string: text is escaped, every attachment leaves a placeholder, and its
reference, its place and the tokens that the placeholder expands to are recorded. A turn is written

    <turn ROLE>\nBODY</turn>\n

and a backslash stands before every backslash, "<" and ">" of roles and texts (and before line ends in
roles), so no text can hold a control string and read() gives every text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

#: Placeholder of each kind of attachment, and the tokens it expands to for each of its units
#: (image tiles, audio seconds, document pages).
ATTACHMENTS = {"image": ("<image>", 256), "audio": ("<audio>", 25), "document": ("<document>", 1024)}
PART = "struct<kind:string,text:string,ref:string,units:bigint>"
_REFS = "array<struct<kind:string,ref:string,at:bigint,tokens:bigint>>"
TURN_END = "</turn>\n"


def escape(text: Column) -> Column:
    for c in ("\\", "<", ">"):
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """The content of a turn that is one text; null is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(f"array<{PART}>")


def visit(parts: Column) -> Column:
    """struct(body, refs) of an array of parts. Any kind but those of ATTACHMENTS counts as text; an
    attachment without units has one; null parts and a null array are empty."""
    kinds = list(ATTACHMENTS)
    mark = F.create_map(*(F.lit(x) for k in kinds for x in (k, ATTACHMENTS[k][0])))
    cost = F.create_map(*(F.lit(x) for k in kinds for x in (k, ATTACHMENTS[k][1])))

    def step(acc: Column, p: Column) -> Column:
        held = F.coalesce(p["kind"].isin(kinds), F.lit(False))
        ref = F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), F.char_length(acc["body"]).cast("bigint").alias("at"), (F.coalesce(p["units"], F.lit(1)) * F.element_at(cost, p["kind"])).cast("bigint").alias("tokens"))
        return F.struct(
            F.concat(acc["body"], F.when(held, F.element_at(mark, p["kind"])).otherwise(F.coalesce(escape(p["text"]), F.lit("")))).alias("body"),
            F.when(held, F.concat(acc["refs"], F.array(ref).cast(_REFS))).otherwise(acc["refs"]).alias("refs"),
        )

    start = F.struct(F.lit("").alias("body"), F.array().cast(_REFS).alias("refs"))
    return F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), start, step)


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row a conversation from turns (conv_id, turn, role, parts).

    Returns conv_id, n_turns, formatted, loss_spans (start and length in code points of each body whose
    role is ``learn``), attachments (turn's place, kind, ref, at: place in formatted, tokens) and
    attachment_tokens. Turns stand by turn, null first; ties by role, then body. A null role is empty;
    null conv_ids make one conversation; repeated rows are turns of their own; other columns are ignored.
    """
    role = F.coalesce("role", F.lit(""))
    seen = turns.select("conv_id", "turn", role.alias("role"), visit(F.col("parts")).alias("v"))
    head = F.concat(F.lit("<turn "), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit(">\n"))
    laid = seen.select("conv_id", "turn", "role", head.alias("head"), F.col("v.body").alias("body"), F.col("v.refs").alias("refs"))
    w = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    length = F.char_length("head") + F.char_length("body") + len(TURN_END)
    placed = laid.select(
        "conv_id", "role", "head", "body", "refs",
        F.row_number().over(w).alias("n"),
        F.coalesce(F.sum(length).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("at"),
    )
    begin = F.col("at") + F.char_length("head")
    refs = F.transform("refs", lambda r: F.struct(F.col("n").alias("turn_no"), r["kind"].alias("kind"), r["ref"].alias("ref"), (begin + r["at"]).alias("at"), r["tokens"].alias("tokens")))
    one = F.struct(
        "n", F.concat("head", "body", F.lit(TURN_END)).alias("shown"),
        F.when(F.col("role") == learn, F.struct(begin.alias("start"), F.char_length("body").cast("bigint").alias("length"))).alias("span"), refs.alias("refs"),
    )
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    out = rows.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["shown"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x["refs"])).alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, r: a + r["tokens"]))


def read(formatted: Column) -> Column:
    """The array of struct(role, text) that a formatted conversation holds; placeholders stay in the texts."""
    shown = F.filter(F.split(formatted, "</turn>\n"), lambda x: x != "")

    def turn(x: Column) -> Column:
        end = F.instr(x, ">\n")
        return F.struct(
            unescape(F.substring(x, F.lit(7), end - 7)).alias("role"),
            unescape(F.substring(x, end + 2, F.char_length(x))).alias("text"),
        )

    return F.transform(shown, turn)


def learned(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    extra = extra.select(*(F.col(f.name).cast(f.dataType) for f in turns.schema))
    chats = format_chats(turns.union(extra).withColumn("parts", text_part(F.col("text"))))
    back = chats.withColumn("turns", read(F.col("formatted"))).withColumn("learned", learned(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
