"""MinHash near-deduplication by improved consistent weighted sampling over TF-IDF word shingles.

A text is the multiset of its WIDTH-word shingles, lower case. A shingle weighs its count times the inverse
document frequency, counted for every shingle over all documents: documents are dealt into chunks, a chunk sends its
distinct shingles and their counts to slices of the hash range, and gets the frequencies back, so no
table of all shingles is held anywhere. The hashes sent have at least SPARE bits more than the number of shingles needs,
so hardly one in 2^SPARE shares its own, at any size of the input. ICWS draws, per
document and sample, one shingle with its quantised weight, such that two documents draw the same with a
probability equal to their weighted Jaccard similarity. BANDS bands of BAND draws give candidates; a link is
a pair whose weighted Jaccard similarity itself is at least THRESHOLD.

Texts with the same words form one class, represented once, so a group of copies costs one row. In a
bucket of a band no pairs of all members are made: each member meets one hub, chosen by hash. HUBS turns of that join
large groups cheaply; they are no cap, as what buckets of three or more members still hold apart after them is settled
exactly: two texts of a similarity of at least THRESHOLD share a shingle among the rarest ones of
each (see ``rarest``) and have sizes near to each other, so an equi-join on these shingles finds every pair
that is left, and each is verified. Linked classes are joined by contracting the links; labels, links and
candidates stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, written

WIDTH, THRESHOLD = 5, 0.8
BANDS, BAND = 16, 4
#: Characters of a chunk of documents, and of all documents for each slice of the hash range.
CHUNK, SLICE = 4_000_000, 8_000_000
SPARE = 11
#: A shingle that less than one in so many documents hold is as rare as one of a single document. Else what a copy has of its own would outweigh, the more the larger the
#: table, what it shares with a large group, and the same two texts would be near in a small table only.
RARE = 1000
HUBS = 3
#: Rows of a shingle from which on pairs are held against the weights of so many parts before they meet.
CROWD, PARTS = 16, 128
_NULL_ID = -(1 << 63)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Hash of the word that splitting makes of a text without words.
_EMPTY = pd.util.hash_array(np.array([""], object), categorize=False)[0]
#: Counts of quantiles for the two gamma variables of a draw.
_R_BITS, _C_BITS = 12, 16


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-case words of all texts, one behind the other, and where each text's begin and end."""
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))
    coded = words.flatten().dictionary_encode()
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])
    return hashes[coded.indices.to_numpy()] if len(hashes) else np.empty(0, np.uint64), ends


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of WIDTH words of a text, of all words where there are fewer; none of no words."""
    if not len(h) or len(h) == 1 and h[0] == _EMPTY:
        return np.empty(0, np.uint64)
    n = min(WIDTH, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out *= _M1
        out += h[k : k + len(out)]
        out ^= out >> np.uint64(29)
    out *= _M2
    out ^= out >> np.uint64(32)
    return out


@lru_cache(1)
def _draws(n: int) -> tuple[np.ndarray, ...]:
    """Quantiles of the gamma distribution of shape 2, logarithms of finer ones, and two odd factors for each of n samples."""
    x = np.concatenate([np.linspace(0, 1, 20001)[1:] ** 2, np.linspace(1, 40, 200001)[1:]])
    q = lambda bits: np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), 1 - (1 + x) * np.exp(-x), x)
    odd = np.random.default_rng(7).integers(0, 1 << 31, (2, n)).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    return q(_R_BITS).astype(np.float32), np.log(q(_C_BITS)).astype(np.float32), odd[0][:, None], odd[1][:, None]


@lru_cache(2)
def _room(n: int) -> tuple[np.ndarray, ...]:
    """Arrays that blocks of n draws are computed in, again and again."""
    return np.empty(n, np.uint32), np.empty(n, np.uint32), np.empty(n, np.intp), *(np.empty(n, np.float32) for _ in range(4))


def _costs(h: np.ndarray, log_weight: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The cost and the quantised weight of each of n samples and at most ``width`` distinct shingles (64-bit).

    With r and c of gamma distribution and b uniform, all by hash of shingle and sample: t = floor(log(weight) / r + b), at a
    cost of log(c) - r * (t - b + 1).
    """
    gamma, log_gamma, m1, m2 = _draws(n)
    u, v, i, r, c, t, b = (z[: n * len(h)].reshape(n, len(h)) for z in _room(n * width))
    np.multiply(m1, h.astype(np.uint32), out=u)
    np.right_shift(u, np.uint32(15), out=v)
    u ^= v
    u *= np.uint32(0x2C1B3C6D)
    u ^= (h >> np.uint64(32)).astype(np.uint32)
    u *= m2
    np.right_shift(u, np.uint32(32 - _R_BITS), out=i, casting="unsafe")
    np.take(gamma, i, out=r, mode="clip")
    np.right_shift(u, np.uint32(13), out=v)
    v ^= u
    v *= np.uint32(0x297A2D39)
    np.right_shift(v, np.uint32(32 - _C_BITS), out=i, casting="unsafe")
    np.take(log_gamma, i, out=c, mode="clip")
    np.left_shift(v, np.uint32(17), out=u)
    u ^= v
    u *= np.uint32(0x85EBCA6B)
    u >>= np.uint32(8)
    np.multiply(u, np.float32(2.0**-24), out=b, casting="unsafe")
    np.divide(log_weight, r, out=t)
    t += b
    np.floor(t, out=t)
    np.subtract(t, b, out=b)
    b += np.float32(1)
    b *= r
    c -= b
    return c, t


def icws(h: np.ndarray, log_weight: np.ndarray, sizes: list[int], n: int = BANDS * BAND, width: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The drawn shingle (upper half of its hash) and quantised weight, [text, sample], of texts that stand one behind the
    other, each with ``sizes`` distinct shingles, of at least one: the shingle of the least cost is drawn."""
    ends = np.cumsum(sizes)
    best = np.full((len(sizes), n), np.inf, np.float32)
    who, level, every = np.zeros((len(sizes), n), np.uint32), np.zeros((len(sizes), n), np.int32), np.arange(n)
    k = 0
    for at in range(0, len(h), width):
        x = h[at : at + width]
        cost, t = _costs(x, log_weight[at : at + width], n, width)
        start = 0
        while start < len(x):
            end = min(len(x), int(ends[k]) - at)
            i = cost[:, start:end].argmin(1) + start
            least = cost[every, i]
            better = least < best[k]
            np.copyto(best[k], least, where=better)
            np.copyto(who[k], (x[i] >> np.uint64(32)).astype(np.uint32), where=better)
            np.copyto(level[k], t[every, i].astype(np.int32), where=better)
            start = end
            k += end + at == ends[k]
    return who, level


def bands(who: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band's place and draws."""
    z = (who.astype(np.uint64) << np.uint64(32)) ^ level.astype(np.int64).view(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _M2
    for k in range(BAND):
        out = (out ^ z.reshape(BANDS, BAND)[:, k]) * _M1
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def idf(df: np.ndarray, n: int) -> np.ndarray:
    """Weights of shingles that df of n documents hold: the logarithm of the share and one, alike for all that less than one in RARE hold."""
    return np.log(np.minimum((1 + n) / (1 + df.astype(np.float64)), RARE)) + 1


def packed(h: np.ndarray, df: np.ndarray, count: np.ndarray) -> bytes:
    """A vector of distinct rising shingles: how often those that no other document has stand in the text, and of the others the
    upper halves of their hashes, their document frequencies and counts. What no other document has meets nothing, so its
    weight is all that comparisons need of it."""
    shared = df > 1
    own, h, df, count = count[~shared].sum(), h[shared], df[shared], count[shared]
    x = (h >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.intp)
    n = np.add.reduceat(count, first) if len(x) else count
    return np.concatenate([[own], x[first], df[first], n]).astype(np.uint32).tobytes()


def unpacked(v: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Distinct rising hashes, weights and document frequencies of the shared shingles, and the weight of all others; n is the number of documents."""
    own, rest = np.split(np.frombuffer(v, np.uint32), [1])
    x, df, count = rest.reshape(3, -1)
    return x, count * idf(df, n), df, float(own[0] * idf(np.ones(1), n)[0])


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two vectors (see unpacked); two empty ones are alike."""
    total = a[1].sum() + b[1].sum() + a[3] + b[3]
    if not total:
        return 1.0
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    common = np.minimum(a[1][at[same]], b[1][same]).sum()
    return float(common / (total - common))


def rarest(v: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The rarest shingles of a vector that any other document has, up to where the others weigh less than threshold times the
    whole; what each weighs with all behind it; and the weight of the whole.

    Two vectors of similarity threshold or more share at least threshold / (1 + threshold) of their summed weights, which is no
    less than threshold times that of either. All they share stands, in the order of rarity, at or behind the first
    shingle of both, so that one weighs as much with all behind it, in both.
    """
    x, weight, df, own = v
    order = np.lexsort((x, df))
    rest = np.cumsum(weight[order][::-1])[::-1]
    whole = own + float(weight.sum())
    k = order[rest >= threshold * whole * (1 - 1e-6)]
    return x[k], rest[: len(k)], whole


def parts(v: tuple) -> np.ndarray:
    """What the shared shingles of a vector weigh in each of PARTS parts of all shingles: two vectors share no more of a part than
    the lesser of both weighs there."""
    return (np.bincount(v[0] % PARTS, v[1], PARTS) * (1 + 1e-6)).astype(np.float32)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of a row of numbers, all least ones first, so that the high ones, mostly 0, are compressed away."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _shingled(keys: list, texts: pa.ChunkedArray) -> dict:
    """Key of the words, distinct rising shingles and their counts, by key of the text."""
    first = {key: i for i, key in reversed(list(enumerate(keys)))}
    h, ends = word_hashes(texts.take(pa.array(first.values())).combine_chunks())
    parts = [h[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return {key: (md5(x.tobytes()).digest(), *np.unique(shingles(x), return_counts=True)) for key, x in zip(first, parts, strict=True)}


def frequencies(dealt: DataFrame, slices: int, bits: int) -> DataFrame:
    """c, slice, df: document frequencies of the distinct shingle hashes (upper bits) of each chunk c of dealt (c, d, rk, text), in order."""
    down = np.uint64(64 - bits)

    def send(t: pa.Table) -> pa.Table:
        keys = t.column("rk").to_pylist()
        held = _shingled(keys, t.column("text"))
        h, n = np.unique(np.concatenate([held[k][1] >> down for k in keys]), return_counts=True)
        cut = np.searchsorted(h, [(i << bits) // slices for i in range(slices)])
        rows = [(i, _planes(np.diff(h[x:y], prepend=np.uint64(0))), _planes(n[x:y].astype(np.uint32))) for i, (x, y) in enumerate(zip(cut, [*cut[1:], len(h)], strict=True)) if x < y]
        c = t.column("c")[0].as_py()
        return pa.table({"c": pa.array([c] * len(rows), pa.int64()), "slice": pa.array([r[0] for r in rows], pa.int32()), "h": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        parts = [np.cumsum(_numbers(x.as_py(), np.uint64), dtype=np.uint64) for x in t.column("h")]
        n = np.concatenate([_numbers(x.as_py(), np.uint32) for x in t.column("n")])
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        df = np.bincount(at, n).astype(np.uint32)[at]
        ends = np.cumsum([len(x) for x in parts])
        return pa.table({"c": t.column("c"), "slice": t.column("slice"), "df": pa.array([_planes(x) for x in np.split(df, ends[:-1])], pa.binary())})

    sent = dealt.groupBy("c").applyInArrow(send, "c bigint, slice int, h binary, n binary")
    return sent.groupBy("slice").applyInArrow(add, "c bigint, slice int, df binary")


def _counted(df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, int]:
    """df written, and how many of its rows meet the condition, in one job."""
    seen = Observation()
    out = written(df.observe(seen, F.count_if(condition).alias("n")), name)
    return out, seen.get["n"]


def _components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) from edges (u, v).

    A node whose least neighbour is least among its own neighbours joins it; the edges between what remains are taken up
    again. A star is done in two rounds, and the edges left shrink with every round.
    """
    done = None
    while True:
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("p")).select("node", F.least("node", "p").alias("p"))
        above = least.select(F.col("node").alias("p"), (F.col("p") == F.col("node")).alias("top"))
        step = written(least.join(above, "p").select("node", F.when(F.col("top"), F.col("p")).otherwise(F.col("node")).alias("root")), "roots")
        done = step if done is None else done.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        u, v = step.withColumnsRenamed({"node": "u", "root": "ru"}), step.withColumnsRenamed({"node": "v", "root": "rv"})
        edges, left = _counted(edges.join(u, "u").join(v, "v").filter("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "edges", F.lit(True))
        if not left:
            return done


def _text_key(text: Column) -> Column:
    return F.to_binary(F.md5(F.coalesce(text, F.lit(""))), F.lit("hex"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """d, rk, group, group_d: for every distinct (document, text), its near-duplicate group and the least document of that."""
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("chars")).first()
    n_docs, bits = size["n"], min(64, size["chars"].bit_length() + SPARE)
    down = np.uint64(64 - bits)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("d"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rk", _text_key(F.col("text")))
    dealt = texts.select(F.pmod(F.xxhash64("d", "rk"), F.lit(size["chars"] // CHUNK + 1)).alias("c"), "d", "rk", "text")

    def sign(t: pa.Table, sums: pa.Table) -> pa.Table:
        raw = t.column("rk").to_pylist()
        held = _shingled(raw, t.column("text"))
        h = np.unique(np.concatenate([x >> down for _, x, _ in held.values()])) if held else np.empty(0, np.uint64)
        parts = sorted(zip(sums.column("slice").to_pylist(), sums.column("df").to_pylist(), strict=True))
        df = np.concatenate([_numbers(x, np.uint32) for _, x in parts]) if parts else np.empty(0, np.uint32)
        signs, vectors, log_weights, sized = {}, {}, [], {}
        for key, x, n in held.values():
            if key not in vectors:
                f = df[np.searchsorted(h, x >> down)]
                vectors[key] = packed(x, f, n)
                if len(x):
                    log_weights.append(np.log(idf(f, n_docs) * n).astype(np.float32))
                    sized[key] = x
        if sized:
            who, level = icws(np.concatenate(list(sized.values())), np.concatenate(log_weights), [len(x) for x in sized.values()])
            signs = {key: bands(a, b) for key, a, b in zip(sized, who, level, strict=True)}
        keys = [held[k][0] for k in raw]
        return pa.table({"d": t.column("d"), "rk": t.column("rk"), "key": pa.array(keys, pa.binary()), "bands": pa.array([signs.get(k) for k in keys], pa.list_(pa.int64())), "v": pa.array([vectors.pop(k, None) for k in keys], pa.binary())})

    sums = frequencies(dealt, size["chars"] // SLICE + 1, bits)
    signed = written(dealt.groupBy("c").cogroup(sums.groupBy("c")).applyInArrow(sign, "d bigint, rk binary, key binary, bands array<bigint>, v binary"), "signed")
    classes = signed.groupBy("key").agg(F.min("d").alias("d"))
    rows = signed.filter("v is not null").select("key", F.explode("bands").alias("h"))
    # whether a bucket has several members is told by a number of each, which aggregates by hash
    crowded = rows.withColumn("k", F.xxhash64("key")).groupBy("h").agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low != high").select("h")
    members = written(rows.join(crowded, "h").distinct(), "members")
    wanted = members.select("key").distinct()
    vectors = written(signed.filter("v is not null").select("key", "v").join(wanted, "key").dropDuplicates(["key"]), "vectors")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = [similarity(unpacked(p.as_py(), n_docs), unpacked(q.as_py(), n_docs)) for p, q in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), b.column(5), pa.array(sim, pa.float64())], names=["a", "b", "u", "v", "sim"])

    labels, tested = None, None

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.withColumn("label", F.col("key")) if labels is None else rows.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))

    def settle(pairs: DataFrame) -> int:
        """Verifies the pairs (a, b, u, v) not yet tested and joins the labels (u, v) of the links; returns how many links."""
        nonlocal labels, tested
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        sides = pairs.join(vectors.select(F.col("key").alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col("key").alias("b"), F.col("v").alias("vb")), "b")
        new, links = _counted(sides.select("a", "b", "va", "vb", "u", "v").mapInArrow(verify, "a binary, b binary, u binary, v binary, sim double"), "tested", F.col("sim") >= threshold)
        tested = new if tested is None else tested.unionByName(new)
        if not links:
            return 0
        roots = _components(new.filter(F.col("sim") >= threshold).select("u", "v").distinct())
        if labels is None:
            labels = written(roots.select(F.col("node").alias("key"), F.col("root").alias("label")), "labels")
        else:
            moved = roots.select(F.col("node").alias("label"), "root")
            known = labels.join(moved, "label", "left").select("key", F.coalesce("root", "label").alias("label"))
            fresh = roots.select(F.col("node").alias("key"), F.col("root").alias("label")).join(labels, "key", "left_anti")
            labels = written(known.unionByName(fresh), "labels")
        return links

    def paired(met: DataFrame, x: str, y: str) -> DataFrame:
        sides = (F.least(f"{x}key", f"{y}key").alias("a"), F.greatest(f"{x}key", f"{y}key").alias("b"))
        return met.select(*sides, F.least(f"{x}label", f"{y}label").alias("u"), F.greatest(f"{x}label", f"{y}label").alias("v")).distinct()

    for turn in range(HUBS):
        at = labelled(members)
        order = F.xxhash64("key", F.lit(turn)) if turn else F.col("key")
        hubs = at.groupBy("h").agg(F.min_by(F.struct("key", "label"), order).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("h", "hub")
        if not settle(paired(at.join(hubs, "h").filter("label != hub.label"), "", "hub.")):
            break

    # a bucket of two is settled by its hub; members of the others that are still apart meet by their rarest shingles
    def rare_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                found = [(key, *rarest(unpacked(v.as_py(), n_docs), threshold)) for key, v in zip(b.column(0).slice(at, 256).to_pylist(), b.column(1).slice(at, 256), strict=True)]
                keys = [key for key, x, _, _ in found for _ in range(len(x))]
                columns = [np.concatenate([f[1] for f in found]).astype(np.int64), np.concatenate([f[2] for f in found]), np.concatenate([np.full(len(f[1]), f[3]) for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *map(pa.array, columns)], names=["key", "s", "rest", "size"])

    def part_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights = [parts(unpacked(v.as_py(), n_docs)) for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weights, pa.list_(pa.float32()))], names=["key", "parts"])

    at = labelled(members)
    apart = at.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low != high and n > 2").select("h")
    left, n_left = _counted(at.join(apart, "h").select("key").distinct(), "left", F.lit(True))
    if n_left:
        rare = written(vectors.join(left, "key").select("key", "v").mapInArrow(rare_rows, "key binary, s bigint, rest double, size double"), "rarest")
        crowds, n_crowds = _counted(rare.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= CROWD).select("s", F.lit(True).alias("crowd")), "crowds", F.lit(True))
        if n_crowds:
            # all meet the one with least of its own: whoever is near enough to what a family shares is linked to it
            at = labelled(rare.join(crowds, "s"))
            stars = at.groupBy("s").agg(F.max_by(F.struct("key", "label"), F.struct(F.col("rest") / F.col("size"), "key")).alias("hub"))
            settle(paired(at.join(stars, "s").filter("label != hub.label"), "", "hub."))
        rare = labelled(rare)
        # of the label with most rows of a shingle no two are paired, so a group already joined costs no square of its size
        counts = rare.groupBy("s", "label").agg(F.count("*").alias("n"))
        most = counts.groupBy("s").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("n")).filter("n > 1").select("s", "most")
        held = rare.join(most, "s").withColumn("main", F.col("label") == F.col("most")).drop("most")
        if n_crowds:
            weighed = vectors.join(left, "key").select("key", "v").mapInArrow(part_rows, "key binary, parts array<float>")
            held = held.join(crowds, "s", "left").join(weighed, "key", "left").withColumn("parts", F.when(F.col("crowd"), F.col("parts"))).drop("crowd")
        held = written(held, "held")
        # x is the smaller one, so of its shingles only those count that weigh, with all behind, half of what both must share at least
        share = threshold / (1 + threshold) * (1 - 1e-6)
        small = held.filter(F.col("rest") >= 2 * share * F.col("size")).alias("x")
        both = F.col("x.size") + F.col("y.size")
        near = (F.col("x.s") == F.col("y.s")) & (F.col("x.label") != F.col("y.label")) & (F.col("x.size") <= F.col("y.size")) & (F.least("x.rest", "y.rest") >= share * both)
        if n_crowds:
            common = F.aggregate(F.zip_with("x.parts", "y.parts", lambda p, q: F.least(p, q)), F.lit(0.0), lambda total, part: total + part)
            near &= F.col("x.parts").isNull() | (common >= share * both)
        met = [paired(small.filter(mine).join(held.filter(other).alias("y"), near), "x.", "y.") for mine, other in (("not main", F.lit(True)), ("main", ~F.col("main")))]
        settle(met[0].unionByName(met[1]).distinct())
    placed = labelled(classes).withColumnRenamed("label", "group")
    least = placed.groupBy("group").agg(F.min("d").alias("group_d"))
    every = signed.select("d", "rk", "key").distinct()
    return every.join(placed.select("key", "group"), "key").join(least, "group").select("d", "rk", "group", "group_d")


def _id(column: str) -> Column:
    return F.when(F.col(column) != _NULL_ID, F.col(column))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a distinct (doc_id, text): doc_id, class_id (least doc_id of its near-duplicate group) and kept.

    Null is the least id. One text of each group is kept: the one of the least id, and of several texts
    under that id the one of the least hash. Null counts as the empty text; texts without words are alike; a text of fewer
    than WIDTH words is one shingle. Other columns are ignored; an empty table gives an empty result.
    """
    found = near_classes(docs, threshold)
    out = found.join(_first(found), "group")
    return out.select(_id("d").alias("doc_id"), _id("group_d").alias("class_id"), ((F.col("d") == F.col("group_d")) & (F.col("rk") == F.col("first"))).alias("kept"))


def _first(found: DataFrame) -> DataFrame:
    return found.filter("d = group_d").groupBy("group").agg(F.min("rk").alias("first"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay when one of each near-duplicate group does (see near_duplicates); columns as they are.

    Of rows that agree in doc_id and text the one whose columns have the least hash stays, so reruns agree.
    """
    found = near_classes(docs, threshold)
    stay = found.join(_first(found), "group").filter("d = group_d and rk = first").select(F.col("d").alias("__d"), F.col("rk").alias("__rk"))
    keyed = docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)), "__rk": _text_key(F.col("text")), "__h": F.xxhash64(*(f"`{c}`" for c in docs.columns))})
    again = W.partitionBy("__d", "__rk").orderBy("__h")
    return keyed.join(stay, ["__d", "__rk"]).withColumn("__n", F.row_number().over(again)).filter("__n = 1").select(*(f"`{c}`" for c in docs.columns))


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
