"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every distinct shingle hash below 2^64 / SCALE, so its size follows the document's. Sketches
of any two documents therefore hold comparable samples: their union's sketch is the union of both (see
merged), and the part of one found in the other estimates containment however unequal the lengths are. A
text none of whose hashes is below the threshold keeps its least one, so that only empty texts have empty
sketches; in a union it gives way to any hash below the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bucket_of, cuts, let, partitions, table, with_new, words

WIDTH = 5
SCALE = 4


def _below(scale: int) -> Column:
    return F.lit(-(1 << 63) + (1 << 64) // scale)


def _kept(hashes: Column, scale: int) -> Column:
    low = F.filter(hashes, lambda h: h < _below(scale))
    return F.when(F.size(low) > 0, F.sort_array(low)).otherwise(F.slice(F.sort_array(hashes), 1, 1))


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hash of every run of width words, lower case; of all words where there are fewer; none of an empty text."""

    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(w[i + k] for k in range(width))))
        return F.when(n >= width, runs).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return let(words(F.lower(text)), of)


def sketch(text: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """The rising kept hashes of a text; null counts as empty."""
    return let(F.array_distinct(shingle_hashes(text, width)), lambda h: _kept(h, scale))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of both documents' shingles together."""
    return let(F.array_union(a, b), lambda h: _kept(h, scale))


def containment(a: Column, b: Column) -> Column:
    """Estimated part of a's shingles found in b, 0 to 1; an empty a is in anything."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Estimated common part of all shingles of both, 0 to 1; two empty sketches are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, F.lit(1.0)).otherwise(let(both, lambda n: n / (F.size(a) + F.size(b) - n)))


def encoded(a: Column) -> Column:
    """A sketch as a string: 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprints(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """docs with the column sketch. Null and empty texts have an empty sketch; equal texts equal ones;
    repeated rows stay; columns named as an added one give way."""
    return with_new(docs, {"sketch": sketch(F.col("text"), width, scale)})


def with_next(docs: DataFrame, column: str, carried: list[str], n: int | None = None) -> DataFrame:
    """docs with next_<c> for each carried column: that of the next row by falling column (ties by the carried
    values; after the last row, the first). Null is least.

    Ranges of the column are windows of their own; the first row of each is also dealt to the range before
    it, found by a table of one number a range. So no task sees all rows and texts move once.
    """
    n = n or partitions(docs.sparkSession)
    ranged = bucket_of(docs, column, cuts(docs, column, n), "__range")
    # the first (greatest) value of each range also closes the range above it; that of the top range the lowest
    firsts = ranged.groupBy("__range").agg(F.max(F.coalesce(F.col(column), F.lit(-(1 << 63)))).alias("__first"))
    up = W.orderBy("__range")  # over at most n rows
    lowest = F.min("__range").over(W.partitionBy())
    guests = firsts.select("__first", F.coalesce(F.lead("__range").over(up), lowest).alias("__guest"))
    at = F.coalesce(F.col(column), F.lit(-(1 << 63)))
    placed = ranged.join(F.broadcast(guests), at == F.col("__first"), "left")
    own = F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("g")))
    dealt = placed.withColumn("__to", F.explode(F.when(F.col("__guest").isNull(), own).otherwise(F.array_append(own, F.struct(F.col("__guest").alias("r"), F.lit(1).alias("g"))))))
    w = W.partitionBy("__to.r").orderBy(F.col("__to.g"), at.desc(), *carried)
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).filter("__to.g = 0")
    return out.drop("__range", "__first", "__guest", "__to")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(fingerprints(docs), "doc_id", ["text", "sketch"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    both = near.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), encoded(F.col("sketch")).alias("fingerprint"), encoded(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
