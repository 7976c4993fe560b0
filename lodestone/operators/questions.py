"""Question analysis, boosts, guards and evaluation as column expressions and small joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions import text as T


def analyzed(questions: DataFrame) -> DataFrame:
    """questions (query_id, question) with what they name and ask for; a number beyond 32 bits names no place."""
    q = F.lower(F.trim("question"))
    no = lambda form: F.nullif(F.regexp_extract(q, form, 1), F.lit(""))

    def named(i: int) -> Column:
        return reduce(lambda acc, d: F.when(T.contains_any(q, d[3]), F.lit(d[i])) if acc is None else acc.when(T.contains_any(q, d[3]), F.lit(d[i])), rules.DOCUMENTS, None)

    topic = T.first_class(q, rules.LEGAL_TOPICS)
    return questions.select(
        "query_id", no(r"điều\s+(\d+)").try_cast("int").alias("dieu"), no(r"khoản\s+(\d+)").try_cast("int").alias("khoan"), no(r"điểm\s+([a-zđ])").alias("diem"),
        F.upper(no(r"chương\s+([ivxlcdm0-9]+)")).alias("chuong"), T.first_class(q, rules.INTENTS).alias("intent"), named(0).alias("ma_van_ban"),
        F.coalesce(named(2), T.first_class(q, rules.DOCUMENT_TYPES)).alias("loai_van_ban"), F.array_join(T.phrases_in(q, rules.LEGAL_PHRASES), "|").alias("phrases"),
        T.first_class(q, rules.TOPICS).alias("chu_de"), topic.alias("legal_topic"), (T.contains_any(q, rules.AMENDMENT_PHRASES) | F.coalesce(topic == "nguong_doanh_thu", F.lit(False))).alias("amendment"),
    )


def guarded(answer: Column, question: Column, context: Column, replacement: str) -> Column:
    """replacement where the question asks about a duty that the answer denies and the context doesn't."""
    said, asked, held = F.lower(answer), F.lower(question), F.lower(context)
    wrong = F.contains(asked, F.lit("phải nộp thuế")) & F.contains(said, F.lit("không phải nộp thuế")) & ~F.contains(held, F.lit("không phải nộp thuế"))
    return F.when(wrong, F.lit(replacement)).otherwise(answer)


def news_score(query: Column, title: Column, text: Column, topic: Column, relevance: Column) -> Column:
    """Terms of the query in title (4) or text (2), words of the topic in query (2.5), title (2) or text (1), the intent (3), 0.15 times relevance."""
    q, t, x = F.lower(query), F.lower(title), F.lower(text)
    zero = F.lit(0.0)
    terms = [F.when(F.contains(q, F.lit(p)), F.when(F.contains(t, F.lit(p)), 4.0).when(F.contains(x, F.lit(p)), 2.0).otherwise(zero)).otherwise(zero) for p in rules.QUERY_TERMS]
    words = [
        F.when(topic == name, F.when(F.contains(q, F.lit(p)), 2.5).otherwise(zero) + F.when(F.contains(t, F.lit(p)), 2.0).when(F.contains(x, F.lit(p)), 1.0).otherwise(zero)).otherwise(zero)
        for name, ps in rules.TOPIC_KEYWORDS.items() for p in ps
    ]
    intent = F.when(T.first_class(q, rules.QUERY_TOPICS) == topic, 3.0).otherwise(zero)
    return reduce(lambda a, b: a + b, [*terms, *words]) + intent + F.coalesce(relevance, zero) * 0.15


FLAGS = ["document_correct", "dieu_correct", "khoan_correct", "keyword_match", "must_contain_match", "hallucination_safe", "citation_correct"]


def evaluated(items: DataFrame, answers: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, category, the flags of every item, citation_required: does the answer's top source and text meet what the item expects?

    Items: id, category, expected_document, expected_dieu, acceptable_dieu, expected_khoan (as text), acceptable_khoan, expected_keywords,
    must_contain, must_not_contain, expected_citation. Acceptable places go before the expected one. No expectation is met by
    anything, but an item without keywords matches none; all citations must be there. An item without an answer has an empty one.
    """
    rows = items.join(answers, "id", "left")
    names = aliases.groupBy("name").agg(F.collect_set("alias").alias("known"))
    rows = rows.join(names, F.col("expected_document") == F.col("name"), "left")
    said = F.lower(F.coalesce("answer", F.lit("")))
    list_ = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    held = lambda c: F.transform(list_(c), lambda k: F.contains(said, F.lower(k)))
    any_, all_ = (lambda a: F.exists(a, lambda x: x)), (lambda a: F.forall(a, lambda x: x))
    yes = lambda c: F.coalesce(c, F.lit(False))

    def at(expected: str, acceptable: str, top: str) -> Column:
        return F.when(F.size(F.coalesce(F.col(acceptable), F.array())) > 0, yes(F.array_contains(acceptable, F.col(top)))).otherwise(F.col(expected).isNull() | yes(F.col(expected) == F.col(top)))

    return rows.select(
        "id", F.coalesce("category", F.lit("unknown")).alias("category"),
        (F.col("expected_document").isNull() | yes(F.array_contains(F.coalesce("known", F.array("expected_document")), F.col("top_document")))).alias("document_correct"),
        at("expected_dieu", "acceptable_dieu", "top_dieu").alias("dieu_correct"), at("expected_khoan", "acceptable_khoan", "top_khoan").alias("khoan_correct"),
        any_(held("expected_keywords")).alias("keyword_match"), all_(held("must_contain")).alias("must_contain_match"), (~any_(held("must_not_contain"))).alias("hallucination_safe"),
        all_(held("expected_citation")).alias("citation_correct"), (F.size(list_("expected_citation")) > 0).alias("citation_required"),
    )


def _perfect() -> Column:
    return reduce(lambda a, b: a & b, map(F.col, FLAGS))


def summary(flags: DataFrame) -> DataFrame:
    """metric, n_true, n_items, percent; the metric "perfect" counts items that meet all."""
    long = flags.withColumn("perfect", _perfect()).unpivot(["id"], [*FLAGS, "perfect"], "metric", "met")
    return long.groupBy("metric").agg(F.count_if("met").alias("n_true"), F.count("*").alias("n_items"), F.round(100 * F.avg(F.col("met").cast("double")), 4).alias("percent"))


def breakdown(flags: DataFrame) -> DataFrame:
    """place, metric, n: how many items miss each metric that any misses, the most first, then by name."""
    long = flags.unpivot(["id"], FLAGS, "metric", "met").filter(~F.col("met")).groupBy("metric").agg(F.count("*").alias("n"))
    return long.select(F.row_number().over(W.orderBy(F.desc("n"), "metric")).alias("place"), "metric", "n")  # a row a metric


def by_category(flags: DataFrame) -> DataFrame:
    """category, n_items, n_perfect, n_failing, rate."""
    return flags.withColumn("ok", _perfect()).groupBy("category").agg(F.count("*").alias("n_items"), F.count_if("ok").alias("n_perfect"), F.count_if(~F.col("ok")).alias("n_failing"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("rate"))


def failures(flags: DataFrame, items: DataFrame) -> DataFrame:
    """id, category, failed (the metrics that each failing item misses, in order), expected (what those on document and place expect)."""
    missed = F.array_compact(F.array(*(F.when(~F.col(m), F.lit(m)) for m in FLAGS)))
    wanted = [F.when(~F.col(m), F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("None")))) for m, label, c in (("document_correct", "Expected Doc", "expected_document"), ("dieu_correct", "Expected Điều", "expected_dieu"), ("khoan_correct", "Expected Khoản", "expected_khoan"))]
    rows = flags.join(items.select("id", "expected_document", "expected_dieu", "expected_khoan"), "id")
    return rows.select("id", "category", F.array_join(missed, ", ").alias("failed"), F.concat_ws("; ", *wanted).alias("expected")).filter("failed <> ''")


def report(flags: DataFrame) -> DataFrame:
    """section, place, line: the report of an evaluation, a line a metric, a category (failing ones once more, the most first), a missed metric."""
    share = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("/"), F.col(b).cast("string"), F.lit(" ("), F.format_number(100 * F.col(a) / F.col(b), 1), F.lit("%)"))
    order = F.array_position(F.array(*map(F.lit, [*FLAGS, "perfect"])), F.col("metric")).cast("int")
    one = summary(flags).select(F.lit("summary").alias("section"), order.alias("place"), F.concat("metric", F.lit(": "), share("n_true", "n_items")).alias("line"))
    groups = by_category(flags)
    two = groups.select(F.lit("category").alias("section"), F.row_number().over(W.orderBy("category")).alias("place"), F.concat("category", F.lit(": "), share("n_perfect", "n_items")).alias("line"))
    three = breakdown(flags).select(F.lit("breakdown").alias("section"), "place", F.concat("metric", F.lit(": "), F.col("n").cast("string")).alias("line"))
    four = groups.filter("n_failing > 0").select(F.lit("failures").alias("section"), F.row_number().over(W.orderBy(F.desc("n_failing"), "category")).alias("place"), F.concat("category", F.lit(" "), F.col("n_failing").cast("string")).alias("line"))
    return one.unionByName(two).unionByName(three).unionByName(four)


def write_report(lines: DataFrame, path: str) -> None:
    """The report's lines (see report) as text under path: sections one after the other, each in its order, in one file, as they are some tens."""
    order = F.array_position(F.array(*map(F.lit, ("summary", "category", "breakdown", "failures"))), F.col("section"))
    text = F.concat("section", F.lit("\t"), "line")
    lines.orderBy(order, "place").select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)
