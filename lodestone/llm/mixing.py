"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every document gets a rate r between 0 and ``cap``. Among all rates whose expected words meet each
source's target, entropy balancing takes those nearest (in relative entropy bounded by 0 and ``cap``)
to one copy each. The optimum is an exponential tilt in the token constraint,

    r = cap * q * exp(l * x) / (1 - q + q * exp(l * x)),   q = 1 / cap,   x = size / scale of the source

with one multiplier ``l`` per source, the minimiser of the convex dual. Newton steps, kept within a
shrinking bracket, solve it for all sources at once. Documents enter a step only through the counts of
(source, size), an exact pre-aggregation, so a hot source costs no more than its distinct sizes.

Rates become whole copies by rounding the running sum of rates from the largest size down; the few
words still missing or in excess are then made up with the smallest documents, and one of the nearest size. Copies of a size are
dealt to its documents by hash, in SALTS groups, so a hot (source, size) never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, ordinals, table, written

SALTS = 64
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL = 1.5
CAP = 2


def size_of(text: Column) -> Column:
    """Words of a text: runs free of spaces and U+0009 to U+000D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE.replace("[", "[^"))).cast("long"), F.lit(0))


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) with target: shares of total * all sizes by weight, by code point of
    the source and null last, none above cap * source_size, the excess shared again by weight.

    Sharing the excess until none is above ends at one level L with target = min(cap * size, weight * L).
    L is found by one-row aggregates, so no task sees all sources.
    """
    n = len(weights)
    ranked = ordinals(sources, F.col("source").isNull().asc(), F.col("source").asc(), name="__rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("__rank") - 1, F.lit(n)) + 1).cast("int"))
    ranked = written(ranked.withColumn("__weight", weight).withColumn("__most", F.col("source_size") * F.lit(float(cap))), "sources")
    all_words = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * total
    level = 0.0
    while True:
        full = F.col("__most") <= F.col("__weight") * level
        a = ranked.agg(F.sum(F.when(full, F.col("__most")).otherwise(0.0)).alias("m"), F.sum(F.when(full, 0.0).otherwise(F.col("__weight"))).alias("w")).first()
        higher = (all_words - (a["m"] or 0.0)) / a["w"] if a["w"] else level
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return ranked.withColumn("target", F.least("__most", F.col("__weight") * level)).drop("__rank", "__weight", "__most")


def _rate(cap: int) -> Column:
    # cap * logistic(l * x + logit(1 / cap)); the exponent is bounded so that exp stays finite
    z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -(F.col("l") * F.col("size") / F.col("scale"))))
    return F.when(F.col("target") >= F.col("source_size") * cap * (1 - 1e-12), F.lit(float(cap))).otherwise(cap / (1 + (cap - 1) * F.exp(z)))


def solve(cells: DataFrame, sources: DataFrame, cap: int = CAP, tol: float = 1e-9, most: int = 60) -> DataFrame:
    """The multiplier l of each source. cells: k, size, c (documents of that size); sources: k, source_size, scale, target."""
    state = written(sources.withColumns({"l": F.lit(0.0), "lo": F.lit(float("-inf")), "hi": F.lit(float("inf")), "off": F.lit(1.0)}), "dual")
    for _ in range(most):
        at = cells.join(state.select("k", "source_size", "scale", "target", "l"), "k").withColumn("r", _rate(cap))
        mass = F.col("c") * F.col("size")
        grad = at.groupBy("k").agg(
            F.sum(mass * F.col("r")).alias("g"),
            F.sum(mass * F.col("size") / F.col("scale") * F.col("r") * (1 - F.col("r") / cap)).alias("h"),
        )
        err = F.col("g") - F.col("target")
        done = F.abs(err) <= tol * F.greatest(F.col("target"), F.lit(1.0))
        lo, hi = F.when(err < 0, F.col("l")).otherwise(F.col("lo")), F.when(err > 0, F.col("l")).otherwise(F.col("hi"))
        newton = F.col("l") - err / F.col("h")
        inside = (F.col("h") > 0) & (newton > F.col("lo1")) & (newton < F.col("hi1"))
        away = F.when(err < 0, F.greatest(F.lit(1.0), F.col("l") * 2)).otherwise(F.least(F.lit(-1.0), F.col("l") * 2))
        bounded = (F.col("lo1") > float("-inf")) & (F.col("hi1") < float("inf"))
        step = F.when(done, F.col("l")).when(inside & (F.abs(newton - F.col("l")) < 16), newton).when(bounded, (F.col("lo1") + F.col("hi1")) / 2).otherwise(away)
        state = written(
            state.join(grad, "k").withColumns({"lo1": lo, "hi1": hi}).select("k", "source_size", "scale", "target", step.alias("l"), F.col("lo1").alias("lo"), F.col("hi1").alias("hi"), F.when(done, 0.0).otherwise(1.0).alias("off")),
            "dual",
        )
        if not state.filter("off > 0").limit(1).count():
            break
    return state


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: int = CAP) -> DataFrame:
    """docs with size, source_size, target and copies (0 to cap), one row per input row.

    A null or empty text has size 0 and keeps one copy (it takes no words). Null is a source of its own,
    the last. Equal rows are told apart by nothing: any of them may get the odd copy. Reruns agree, as
    copies depend on the hash of the whole row alone. Input columns named as an added one give way; an
    empty table gives an empty one.
    """
    added = {"size", "source_size", "target", "copies"}
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in added))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    sized = docs.withColumns({"size": size_of(F.col("text")), "k": key, "h": F.xxhash64(*docs.columns)}).withColumn("b", F.pmod("h", F.lit(SALTS)).cast("int"))
    parts = written(sized.groupBy("k", "size", "b").agg(F.count("*").alias("n"), F.first("source").alias("source")), "parts")
    cells = parts.groupBy("k", "size").agg(F.sum("n").alias("c"))
    sources = parts.groupBy("k").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.col("n") * F.col("size") * F.col("size")).alias("sq"))
    sources = sources.withColumn("scale", F.coalesce(F.try_divide(F.col("sq").cast("double"), "source_size"), F.lit(1.0))).drop("sq")
    targets = written(source_targets(sources, weights, total, cap), "targets")
    dual = solve(cells, targets, cap).drop("lo", "hi", "off")

    rated = cells.join(dual, "k").withColumn("r", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(cap)))
    down = W.partitionBy("k").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, 0)
    upto = F.sum(F.col("c") * F.col("r")).over(down)
    some = F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("c") * F.col("r") + 0.5)
    rounded = rated.withColumn("upto", upto).withColumn("some", F.when(F.col("size") == 0, F.col("c")).otherwise(F.least(F.greatest(some, F.lit(0)), F.col("c") * cap)))
    # what rounding left over is made up from the smallest documents upwards
    whole = W.partitionBy("k")
    up = W.partitionBy("k").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    short = F.col("target") - F.sum(F.col("some") * F.col("size")).over(whole)
    room = F.when(F.col("short") > 0, F.col("c") * cap - F.col("some")).otherwise(F.col("some"))
    words = F.when(F.col("size") > 0, F.col("room") * F.col("size")).otherwise(0)
    left = F.greatest(F.lit(0.0), F.abs("short") - (F.sum("words").over(up) - F.col("words")))
    moved = F.when(F.col("size") > 0, F.least(F.floor(F.col("left") / F.col("size")), F.col("room"))).otherwise(0)
    made_up = rounded.withColumn("short", short).withColumn("room", room).withColumn("words", words).withColumn("left", left).withColumn("moved", moved)
    # one more document, of the size nearest to what is left, where that brings the source nearer to its target
    rest = F.abs("short") - F.sum(F.col("moved") * F.col("size")).over(whole)
    miss = F.when((F.col("room") > F.col("moved")) & (F.abs(F.col("rest") - F.col("size")) < F.col("rest")), F.struct(F.abs(F.col("rest") - F.col("size")).alias("off"), "size"))
    last = made_up.withColumn("rest", rest).withColumn("nearest", F.min(miss).over(whole))
    extra = F.when(F.col("nearest.size") == F.col("size"), 1).otherwise(0)
    quota = last.withColumn("quota", (F.col("some") + F.signum("short") * (F.col("moved") + extra)).cast("long")).select("k", "size", "c", "quota", F.col("source_size").alias("total"), "target")
    inner = W.partitionBy("k", "size").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    share = F.floor(F.col("quota") * F.col("seen") / F.col("c")) - F.floor(F.col("quota") * (F.col("seen") - F.col("n")) / F.col("c"))
    dealt = (
        parts.select("k", "size", "b", "n").withColumn("seen", F.sum("n").over(inner)).join(quota, ["k", "size"])
        .select("k", "size", "b", "n", share.cast("long").alias("share"), F.col("total").alias("source_size"), "target")
    )
    place = F.row_number().over(W.partitionBy("k", "size", "b").orderBy("h"))
    copies = F.floor(F.col("share") / F.col("n")) + F.when(F.col("place") <= F.pmod("share", "n"), 1).otherwise(0)
    return (
        sized.join(dealt, ["k", "size", "b"]).withColumn("place", place)
        .select(*(f"`{c}`" for c in docs.columns), "size", "source_size", "target", copies.cast("int").alias("copies"))
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row as often as it has copies, with the columns of docs."""
    out = mix(docs, **how)
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*(f"`{c}`" for c in docs.columns))


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
