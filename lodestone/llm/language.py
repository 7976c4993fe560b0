"""Language identification by n-gram Bloom filters that hold a language bitmask a row.

Fitting counts character 3- and 4-grams (of words with their borders) in a bounded sample of labelled
documents, FIT_ROWS a language at most in expectation, drawn by hash. A gram is put into the filters of the
languages in which it is about as frequent as in its best one. The filters of all languages share one
table of ROWS masks: the masks of a gram's HASHES rows, and-ed, have a bit for every language that contains
the gram. A text's language is the one with most of its grams after correction for false positives.

Only text and labels of documents outside the held-out third are learned from; predictions see text alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

FIT_ROWS = 1_000
ROWS, HASHES = 1 << 18, 2
NEAR_BEST, LEAST_COUNT = 0.25, 3
#: Characters that are turned into grams at a time.
CHUNK = 1 << 17
UNKNOWN = "und"

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


_LETTERS: np.ndarray | None = None


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def grams(texts: list[str | None], size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram hashes, index of each one's text), about ``size`` characters at a time; a null has none.

    A text longer than that comes in pieces. Each goes on from the last codes of the one before, and a gram belongs to
    the piece that it ends in, so all pieces together have the grams of the whole text, each as often.
    """
    held: list[str] = []
    index: list[int] = []
    n = 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        if len(t) > size:
            before = np.zeros(1, np.uint32)
            for at in range(0, len(t), size):
                piece = _codes(t[at : at + size] + (" " if at + size >= len(t) else ""), int(before[-1]))
                stream = np.concatenate([before, piece])
                h, _ = _grams(stream, np.zeros(len(stream), np.int64), len(before))
                yield h, np.full(len(h), i)
                before = stream[-3:]
            continue
        held.append(t)
        index.append(i)
        n += len(t)
        if n >= size:
            yield _joined(held, index)
            held, index, n = [], [], 0
    if held:
        yield _joined(held, index)


def _codes(text: str, before: int) -> np.ndarray:
    """Code points of the letters, with one 0 for what stands between words; ``before`` is the code ahead of the text."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.where(_letters()[a], a, 0).astype(np.uint32)
    return a[(a != 0) | (np.concatenate([[before], a[:-1]]) != 0)]


def _joined(texts: list[str], index: list[int]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.asarray(index, np.int64), [len(t) + 1 for t in texts])
    owner = np.concatenate([owner[:1], owner])
    a = np.where(_letters()[a], a, 0)
    keep = (a != 0) | (np.concatenate([[1], a[:-1]]) != 0)  # one border between words
    h, w = _grams(a[keep].astype(np.uint32), owner[keep], 0)
    order = np.argsort(w, kind="stable")
    return h[order], w[order]


def _grams(a: np.ndarray, owner: np.ndarray, old: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a stream of codes that end at or behind place ``old``, and the owners of the codes that they end at (a border
    belongs to the text before it)."""
    a, out, who = a.astype(np.uint64), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for n in (3, 4):
        first = max(0, old - n + 1)
        m = len(a) - n + 1 - first
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n))
        inner = np.ones(m, bool)
        for k in range(n):
            part = a[first + k : first + k + m]
            h = h * _MIX[0] + part
            if 0 < k < n - 1:
                inner &= part != 0
        out.append(mixed(h[inner]))
        who.append(owner[first + n - 1 : first + n - 1 + m][inner])
    return np.concatenate(out), np.concatenate(who)


def rows_of(h: np.ndarray) -> list[np.ndarray]:
    """The HASHES rows of the mask table that each gram has."""
    return [((h >> np.uint64(k * 24)) & np.uint64(ROWS - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    """masks[row, i] has bit j set where language 64 * i + j has a gram there; wrong: each one's false-positive rate."""

    langs: list[str]
    masks: np.ndarray
    wrong: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(self.langs)
        hits, total = np.zeros((n, len(texts))), np.zeros(len(texts))
        for h, owner in grams(texts):
            if not len(h):
                continue
            found = self.masks[rows_of(h)[0]]
            for r in rows_of(h)[1:]:
                found = found & self.masks[r]
            at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            np.add.at(total, owner[at], np.diff(np.concatenate([at, [len(owner)]])))
            for j in range(n):
                bit = (found[:, j // 64] >> np.uint64(j % 64)).astype(np.uint8) & 1
                np.add.at(hits[j], owner[at], np.add.reduceat(bit, at, dtype=np.int64))
        true = np.maximum(0.0, hits - total * self.wrong[:, None]) / (1 - self.wrong[:, None])
        if not n:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = true.argmax(0)  # the first by name among equals
        score = np.minimum(1.0, true.max(0) / np.maximum(1e-9, true.sum(0)))
        known = _has_letters(texts)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0)


def _has_letters(texts: list[str | None]) -> np.ndarray:
    return np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)


def fit(labelled: DataFrame, rows: int = FIT_ROWS, near_best: float = NEAR_BEST) -> Filters:
    """Filters from labelled (doc_id, text, lang). Null labels and texts are passed over. Documents are drawn by the hash
    of doc_id, at a rate that gives about ``rows`` of each language, or all where there are fewer."""
    spark = labelled.sparkSession
    labelled = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sorted((r["lang"], r["n"]) for r in counts.collect())  # one row a language
    if not langs:
        return Filters([], np.zeros((ROWS, 1), np.uint64), np.zeros(0))
    rate = F.create_map(*(F.lit(x) for lang, n in langs for x in (lang, min(1.0, rows / n))))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * (1 << 30)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, names = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            for name in np.unique(names):
                own = [t for t, x in zip(texts, names) if x == name]
                for h, _ in grams(own):
                    g, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "g", "n"])

    found = written(labelled.filter(drawn).select("text", "lang").mapInArrow(count, "lang string, g bigint, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["t"] for r in found.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    langs = [lang for lang, _ in langs if totals.get(lang)]
    if not langs:
        return Filters([], np.zeros((ROWS, 1), np.uint64), np.zeros(0))
    place = F.create_map(*(F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)))
    total = F.create_map(*(F.lit(x) for lang in langs for x in (lang, float(totals[lang]))))
    share = found.filter(F.col("n") >= LEAST_COUNT).withColumns({"f": F.col("n") / F.element_at(total, F.col("lang")), "j": F.element_at(place, F.col("lang"))})
    top = share.groupBy("g").agg(F.max("f").alias("best"), F.collect_list(F.struct("j", "f")).alias("of"))  # a language has one entry at most
    held = top.select("g", F.explode(F.filter("of", lambda x: x["f"] >= F.col("best") * near_best)).alias("x")).select("g", F.col("x.j").alias("j"))
    row = F.explode(F.array(*(F.shiftrightunsigned("g", k * 24).bitwiseAND(F.lit(ROWS - 1)) for k in range(HASHES))))
    bits = held.select(row.alias("row"), (F.col("j") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(j % 64 as int))").alias("bit")).groupBy("row", "word").agg(F.bit_or("bit").alias("mask"))
    masks = np.zeros((ROWS, (len(langs) + 63) // 64), np.uint64)
    got = bits.toPandas()  # at most ROWS rows for each 64 languages
    masks[got["row"].to_numpy(np.int64), got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([((masks[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean() for j in range(len(langs))])
    return Filters(langs, masks, np.minimum(0.9, fill**HASHES))


def _told(docs: DataFrame, filters: Filters, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs with lang_pred and score; a text is sent once."""
    shown = docs.select(*(f"`{c}`" for c in keep))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema)
    text = [c.lower() for c in keep].index("text") if "text" in map(str.lower, keep) else len(keep)
    used = shown if text < len(keep) else docs.select(*(f"`{c}`" for c in keep), "text")
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # ROWS masks, whatever the input

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                langs, score = shared.value.predict(b.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return used.mapInArrow(run, f"{schema}, lang_pred string, score double")


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs with lang_pred and score (0 to 1: the best language's part of all languages' corrected counts).

    A null text or one without letters is ``und`` with score 0; letters without known grams give the first
    language by name with score 0; every row stays; columns named as an added one give way.
    """
    return _told(docs, filters, [c for c in docs.columns if c.lower() not in ("lang_pred", "score")])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """predict with filters fitted, where none are given, to the documents outside the held-out third."""
    return predict(docs, filters or fit(docs.filter(~held_out())))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is told: all but ``und``, those without letters; columns stay as they are.

    The score doesn't decide, as it is shared among all languages that are alike, so good texts would go the sooner the more are learned.
    """
    filters = docs.sparkSession.sparkContext.broadcast(fit(docs.filter(~held_out())))
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                langs, _ = filters.value.predict(b.column(at).to_pylist())
                yield b.filter(pa.array([x != UNKNOWN for x in langs], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = _told(docs.select("doc_id", held_out().alias("held_out"), "text"), fit(docs.filter(~held_out())), ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")
