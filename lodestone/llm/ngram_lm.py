"""Language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

Training documents fall into two folds by the hash of their id: most are kept, one in DELETED is deleted. Weights of the
orders (trigram, bigram, unigram, and 1 / (V + 1) for any word) are learned by expectation-maximisation on the counts of the deleted fold under
estimates from the kept fold, one set of weights for each bucket of contexts that are about as frequent. Scores then use
the counts of both folds.

Texts become blocks of BLOCK tokens at most, word numbers with one table of word hashes a block, each of one fold. A block
asks for the counts of its distinct n-grams, numbers of KEY_BITS bits (a hash and the order) cut into slices of their range. A slice adds up what all blocks
hold of its n-grams and tells every block the totals in the order asked. A frequent n-gram is one entry a block, so no word
is hot, and a block cuts only at slices that it holds something of. The exchange is by slice, then by block; nothing is gathered in
the driver but the weights and four totals.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, partitions, table, written
from .language import mixed

KEPT, DELETED_FOLD, HELD_OUT = 0, 1, 2
DELETED = 10
BLOCK = 1 << 20
#: Bytes of a text that become tokens at a time; a slice has about so many n-grams.
PIECE, SLICE = 1 << 23, 1 << 21
#: Of 10^13 n-grams, about one in 2,000 shares its number with another.
KEY_BITS = 56
END, START = b"\n", b"\n\n"  # no words, as words hold no white space
_EDGE, _STEP = np.uint64(xxhash.xxh3_64_intdigest(START)), np.uint64(0x9E3779B97F4A7C15)
#: Weights before learning, and how many deleted tokens they count as. Rows: known trigram context, only the last word known, neither.
PRIOR, PRIOR_TOKENS = ((0.4, 0.3, 0.2, 0.1), (0.0, 0.5, 0.3, 0.2), (0.0, 0.0, 0.7, 0.3)), 8
ROUNDS, TOLERANCE = 20, 1e-3
#: Counts of deleted tokens are kept by the logarithm of each estimate in steps of 1 / STEPS octaves.
STEPS = 8
#: Buckets of a context kind, by the bits of its frequency.
BITS = 64

_BLOCKS = "block bigint, fold int, words binary, ids binary, docs array<bigint>, doc_ids array<bigint>, tokens array<bigint>, context array<int>"


def fold_of(doc_id: Column) -> Column:
    """HELD_OUT where crc32(doc_id as text) mod 7 is 2; DELETED_FOLD for one in DELETED of the others; a null id is kept."""
    crc = F.crc32(doc_id.cast("string"))
    return F.when(crc % 7 == 2, HELD_OUT).when(F.floor(crc / 7) % DELETED == 0, DELETED_FOLD).otherwise(KEPT)


def packed(x: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed: of small numbers nearly nothing is left."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True) if len(x) else b"\0\0\0\0"


def unpacked(b: bytes, dtype: type) -> np.ndarray:
    n, size = int.from_bytes(b[:4], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.empty(0, dtype)
    planes = np.frombuffer(pa.decompress(b[4:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(dtype)


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """The text, cut at white space where it is longer than size."""
    while len(text) > size:
        at = max(text.rfind(s, 0, size) for s in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if at <= 0:
            at = min((p for s in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (p := text.find(s, size)) > 0), default=len(text))
        yield text[:at]
        text = text[at:]
    yield text


def _blocks(batches: Iterable[pa.RecordBatch], size: int, piece: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, made, seen = TaskContext.get().partitionId(), 0, 0
    held: dict[int, list[tuple[int, int | None, array, int]]] = {KEPT: [], DELETED_FOLD: [], HELD_OUT: []}
    words = {fold: defaultdict() for fold in held}  # the number of each word of a block
    load = dict.fromkeys(held, 0)
    for w in words.values():
        w.default_factory = w.__len__

    def block(fold: int) -> pa.RecordBatch:
        nonlocal made
        rows = held[fold]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words[fold]), np.uint64, len(words[fold]))
        ids = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows])
        row = [(part << 32) + made, fold, packed(hashes), packed(ids), [r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], [r[3] for r in rows]]
        made, held[fold], load[fold] = made + 1, [], 0
        words[fold].clear()
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[f.split()[0] for f in _BLOCKS.split(", ")])

    for b in batches:
        for at in range(0, b.num_rows, 64):
            few = b.slice(at, 64)
            for doc_id, fold, text in zip(few.column("doc_id").to_pylist(), few.column("fold").to_pylist(), few.column("text").cast(pa.binary()).to_pylist(), strict=True):
                row, before = (part << 40) + seen, []
                seen += 1
                cut = list(pieces(text or b"", piece))
                for i, p in enumerate(cut):
                    # bytes.lower() maps A to Z alone, bytes.split() cuts at the space and U+0009 to U+000D
                    tokens = p.lower().split() + ([END] if i == len(cut) - 1 else [])
                    for j in range(0, len(tokens), size):
                        mine = tokens[j : j + size]
                        if load[fold] and load[fold] + len(mine) > size:
                            yield block(fold)
                        number = words[fold]
                        held[fold].append((row, doc_id, array("i", [number[w] for w in before + mine]), len(before)))
                        load[fold] += len(mine)
                        before = (([START, START] if not before else before) + mine)[-2:]
    for fold, rows in held.items():
        if rows:
            yield block(fold)


def blocks(docs: DataFrame, size: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """The documents as blocks of tokens: per document row (docs), its id, tokens, and how many of them only stand before."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold_of(F.col("doc_id")).alias("fold"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lambda batches: _blocks(batches, size, piece), _BLOCKS)


def _key(hashes: np.ndarray, order: int) -> np.ndarray:
    """Hashes as keys of KEY_BITS bits, whose last two are the order."""
    return (hashes >> np.uint64(64 - KEY_BITS)) & ~np.uint64(3) | np.uint64(order)


class Grams:
    """The n-grams of a block: its sorted distinct keys, how often the block has each, and for every token the places of its word, bigram and trigram.

    Words that only stand before a piece of a long text are asked for, as its first tokens' contexts, but count 0.
    """

    def __init__(self, block: dict):
        tokens, context = np.array(block["tokens"]), np.array(block["context"])
        hashes, ids = unpacked(block["words"], np.uint64), unpacked(block["ids"], np.int32)
        start = np.cumsum(tokens) - tokens
        h = hashes[ids]
        two, three = np.roll(h, 1), np.roll(h, 2)
        two[start] = three[start] = three[(start + 1)[tokens > 1]] = _EDGE
        self.first = np.zeros(len(h), bool)
        self.first[start[context == 0]] = True
        self.scored = np.ones(len(h), bool)
        for k in (0, 1):
            self.scored[start[context > k] + k] = False
        self.docs = np.repeat(np.arange(len(tokens)), tokens)
        made, inverse = [], []
        for order in (1, 2, 3):
            with np.errstate(over="ignore"):
                k = mixed(hashes if order == 1 else two * _STEP + h if order == 2 else mixed(three * _STEP + two) * _STEP + h)
            u, at = np.unique(_key(k, order), return_inverse=True)
            made.append(u)
            inverse.append((at[ids] if order == 1 else at).astype(np.int32))
        del h, two, three, k, at
        self.keys = np.sort(np.concatenate(made))
        self.word, self.pair, self.triple = (np.searchsorted(self.keys, u).astype(np.int32)[at] for u, at in zip(made, inverse, strict=True))
        self.count = sum(np.bincount(at[self.scored], minlength=len(self.keys)) for at in (self.word, self.pair, self.triple))


def _ask(rows: Iterable[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    """A row for each slice that a block holds n-grams of: their keys as differences, and how often the block has each."""
    for b in rows:
        for r in b.to_pylist():
            g = Grams(r)
            part = (g.keys >> np.uint64(shift)).astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            out = []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                base = np.uint64(int(part[i]) << shift)
                out.append((int(part[i]), packed(np.diff(g.keys[i:j] - base, prepend=np.uint64(0))), packed(g.count[i:j].astype("<i4"))))
            s, k, c = zip(*out, strict=True)
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array([r["block"]] * n, pa.int64()), pa.array([r["fold"]] * n, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=["slice", "block", "fold", "keys", "counts"])


_TOLD = "block bigint, fold int, slice bigint, kept binary, deleted binary, kept_words bigint, all_words bigint"


def _tell(t: pa.Table) -> pa.Table:
    """For one slice, the counts of each block's n-grams in the kept and the deleted fold, and one row with its number of words."""
    keys = [np.cumsum(unpacked(k, np.uint64), dtype=np.uint64) for k in t.column("keys").to_pylist()]
    end = np.cumsum([len(k) for k in keys])
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    fold = np.repeat(t.column("fold").to_numpy(), [len(k) for k in keys])
    n = np.concatenate([unpacked(c, np.int32) for c in t.column("counts").to_pylist()])
    sums = [np.bincount(at, np.where(fold == f, n, 0), len(u)).astype("<i8") for f in (KEPT, DELETED_FOLD)]
    told = [[packed(s[at[e - len(k) : e]]) for k, e in zip(keys, end, strict=True)] for s in sums]
    word = (u & np.uint64(3)) == 1
    blocks = t.column("block").to_pylist()
    part = t.column("slice")[0].as_py()
    none = [0] * len(blocks)
    columns = [[*blocks, -1], [*t.column("fold").to_pylist(), -1], [part] * (len(blocks) + 1), [*told[0], b""], [*told[1], b""], [*none, int((word & (sums[0] > 0)).sum())], [*none, int((word & (sums[0] + sums[1] > 0)).sum())]]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, y) for c, y in zip(columns, types, strict=True)], names=[f.split()[0] for f in _TOLD.split(", ")])


class Estimates:
    """Per scored token of a block: the estimates of all orders, the bucket of its context, and the count of its word."""

    def __init__(self, block: dict, told: pa.Table, totals: dict, deleted: bool):
        g = Grams(block)
        told = told.sort_by("slice")
        counts = np.concatenate([unpacked(b, np.int64) for b in told.column("kept").to_pylist()])
        if deleted:
            counts = counts + np.concatenate([unpacked(b, np.int64) for b in told.column("deleted").to_pylist()])
        docs, tokens, words = (totals[("all_" if deleted else "kept_") + n] for n in ("docs", "tokens", "words"))
        # the context of a token is the n-gram that ends before it; that of a first token is the start of a document
        one, two = (np.where(g.first, docs, np.roll(counts[at], 1))[g.scored] for at in (g.word, g.pair))
        self.docs, self.word = g.docs[g.scored], counts[g.word][g.scored]
        with np.errstate(invalid="ignore", divide="ignore"):
            p = [counts[g.triple][g.scored] / two, counts[g.pair][g.scored] / one, self.word / max(tokens, 1)]
        self.p = [np.nan_to_num(x, copy=False, nan=0.0, posinf=0.0) for x in p] + [1 / (words + 1)]
        bits = lambda n: np.frexp(n.astype(np.float64))[1].astype(np.int64)
        self.bucket = np.where(two > 0, bits(two), np.where(one > 0, BITS + bits(one), 2 * BITS))


def _cells(block: dict, told: pa.Table, totals: dict) -> pa.Table:
    """Deleted tokens counted by bucket and the steps of their estimates' logarithms."""
    e = Estimates(block, told, totals, deleted=False)
    with np.errstate(divide="ignore"):
        steps = [np.where(x > 0, np.round(np.log2(x) * STEPS), 1).astype(np.int64) for x in e.p[:3]]
    rows, n = np.unique(np.column_stack([e.bucket, *steps]), axis=0, return_counts=True)
    return pa.table({"bucket": pa.array(rows[:, 0], pa.int32()), "three": pa.array(rows[:, 1], pa.int32()), "two": pa.array(rows[:, 2], pa.int32()), "one": pa.array(rows[:, 3], pa.int32()), "n": pa.array(n, pa.int64())})


def learned(cells: DataFrame, totals: dict, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The weights of the orders in each bucket by expectation-maximisation over the counted deleted tokens."""
    weights = np.array([PRIOR[0]] * BITS + [PRIOR[1]] * BITS + [PRIOR[2]])
    p = [F.when(F.col(c) > 0, 0.0).otherwise(F.pow(F.lit(2.0), F.col(c) / STEPS)) for c in ("three", "two", "one")] + [F.lit(1 / (totals["kept_words"] + 1))]
    cells = written(cells.groupBy("bucket", "three", "two", "one").agg(F.sum("n").alias("n")).select("bucket", "n", F.array(*p).alias("p")), "cells")
    prior = weights.copy()
    for _ in range(rounds):
        lists = F.element_at(F.array(*(F.array(*map(F.lit, w)) for w in weights.tolist())), F.col("bucket") + 1)
        share = let(F.zip_with("p", lists, lambda a, b: a * b), lambda m: F.transform(m, lambda x: x / F.aggregate(m, F.lit(0.0), lambda s, y: s + y)))
        sums = cells.withColumn("share", share).groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col("share")[i]).alias(f"s{i}") for i in range(4)))
        before = weights.copy()
        for r in sums.collect():  # one row a bucket
            k = r["bucket"]
            weights[k] = (np.array([r[f"s{i}"] for i in range(4)]) + PRIOR_TOKENS * prior[k]) / (r["n"] + PRIOR_TOKENS)
        if np.abs(weights - before).max() < tolerance:
            break
    return weights


_SCORED = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _scores(block: dict, told: pa.Table, totals: dict, weights: np.ndarray) -> pa.Table:
    e = Estimates(block, told, totals, deleted=True)
    docs = len(block["docs"])
    sums = lambda x: np.bincount(e.docs, x, docs)
    base = np.log10((e.word + 1) / (totals["all_tokens"] + totals["all_words"] + 1))
    score = np.log10(sum(x * weights[e.bucket, i] for i, x in enumerate(e.p)))
    columns = [block["docs"], block["doc_ids"], [block["fold"] == HELD_OUT] * docs, sums(np.ones(len(e.docs))).astype(np.int64), sums(e.word > 0).astype(np.int64), sums(base), sums(score)]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in _SCORED.split(", ")])


def score(docs: DataFrame, size: int = BLOCK, piece: int = PIECE, slice_keys: int = SLICE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    A null or empty text is its end alone. A document without id is learned from; repeated rows count each, and each gets
    its row. Without training documents all counts are 0 and both scores those of unknown words; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    coded = written(blocks(docs, size, piece), "blocks")
    own = F.aggregate(F.zip_with("tokens", "context", lambda t, c: t - c), F.lit(0).cast("long"), lambda s, x: s + x)
    first = F.size(F.filter("context", lambda c: c == 0)).cast("long")
    sums = {r["fold"]: r for r in coded.groupBy("fold").agg(F.sum(own).alias("tokens"), F.sum(first).alias("docs")).collect()}
    folds = {"kept": (KEPT,), "all": (KEPT, DELETED_FOLD)}
    totals = {f"{name}_{what}": sum(sums[f][what] for f in of if f in sums) for name, of in folds.items() for what in ("tokens", "docs")}
    every = sum(r["tokens"] for r in sums.values())
    if not every:
        return spark.createDataFrame([], "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    shift = KEY_BITS - (max(4 * partitions(spark), 3 * every // slice_keys) - 1).bit_length()
    asked = coded.select("block", "fold", "words", "ids", "tokens", "context").mapInArrow(lambda rows: _ask(rows, shift), "slice bigint, block bigint, fold int, keys binary, counts binary")
    told = written(asked.groupBy("slice").applyInArrow(_tell, _TOLD), "told")
    words = told.filter("block = -1").agg(F.sum("kept_words"), F.sum("all_words")).first()
    totals |= {"kept_words": int(words[0]), "all_words": int(words[1])}

    def answered(fold: Column, make: Callable[[dict, pa.Table], pa.Table], schema: str) -> DataFrame:
        def run(block: pa.Table, told: pa.Table) -> pa.Table:
            return make(block.to_pylist()[0], told)

        return coded.filter(fold).groupBy("block").cogroup(told.filter(fold).select("block", "slice", "kept", "deleted").groupBy("block")).applyInArrow(run, schema)

    cells = answered(F.col("fold") == DELETED_FOLD, lambda b, t: _cells(b, t, totals), "bucket int, three int, two int, one int, n bigint")
    weights = learned(cells, totals)
    found = answered(F.col("fold") >= 0, lambda b, t: _scores(b, t, totals, weights), _SCORED)
    merged = found.groupBy("row", "doc_id", "held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    return merged.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals["all_tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op11_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
