"""Approximate nearest neighbours by learned partitions.

Fitting takes a bounded sample (SAMPLE vectors a part): its k-nearest-neighbour graph is cut into balanced parts
(median splits along leading directions, then capacity-bounded moves of nodes to the part of most of their
neighbours), and a small classifier learns the part of a vector. It deals every vector of the table to its
most probable part. A query goes to as many of its most probable parts as held-out sample queries needed
for TARGET recall against brute force, or more where these hold too few vectors, and all vectors of those parts are
ranked by exact cosine. The number of parts grows with the table, PART vectors a part, from LEAST_PARTS up to MOST_PARTS (beyond
that parts grow).

Parts are searched in blocks of (part, block of vectors, block of queries), so neither a part that holds
much of the table nor a frequent vector lands in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, written

SAMPLE, HELD_OUT, DEGREE, HIDDEN, TARGET = 375, 400, 10, 64, 0.97
PART, LEAST_PARTS, MOST_PARTS = 20_000, 16, 64
#: A task holds one block of each: about 10 MB of vectors of 64 components.
BLOCK, QUERY_BLOCK = 20_000, 20_000


def parts_of(rows: int) -> int:
    """The number of parts for so many vectors: a power of two."""
    return min(MOST_PARTS, max(LEAST_PARTS, 1 << max(0, -(-rows // PART) - 1).bit_length()))


@dataclass
class Router:
    """A softmax classifier with one hidden layer over unit vectors, and the parts that a query visits."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray
    probes: int

    def order(self, unit: np.ndarray) -> np.ndarray:
        """Parts by falling probability."""
        return np.argsort(-(np.maximum(unit @ self.a + self.b, 0) @ self.c + self.d), axis=1, kind="stable")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def knn_graph(x: np.ndarray, degree: int) -> np.ndarray:
    out = np.empty((len(x), degree), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + 512] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 8, slack: float = 1.05) -> np.ndarray:
    """A part of each node, none above slack times the mean, that cuts few edges of the graph."""
    part = np.zeros(len(x), np.int64)
    size = 1
    while size < parts:
        for p in range(size):
            at = np.flatnonzero(part == p)
            y = x[at] - x[at].mean(0)
            _, _, v = np.linalg.svd(y[: 4 * x.shape[1] + 64], full_matrices=False)
            part[at[np.argsort(y @ v[0], kind="stable")[len(at) // 2 :]]] += size
        size *= 2
    most = int(slack * len(x) / size) + 1
    back: list[list[int]] = [list(r) for r in graph]
    for i, r in enumerate(graph):
        for j in r:
            back[j].append(i)
    load = np.bincount(part, minlength=size)
    rng = np.random.default_rng(0)
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(part[back[i]], minlength=size)
            votes[load >= most] = -1
            best, own = int(votes.argmax()), part[i]
            if best != own and votes[best] > (np.asarray(part[back[i]]) == own).sum():
                load[own] -= 1
                load[best] += 1
                part[i] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return part


def train(x: np.ndarray, part: np.ndarray, parts: int, hidden: int = HIDDEN, epochs: int = 60) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(1)
    w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)) * 4, np.zeros(hidden), rng.normal(0, (2 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            z = x[at] @ w[0] + w[1]
            h = np.maximum(z, 0)
            o = h @ w[2] + w[3]
            o = np.exp(o - o.max(1, keepdims=True))
            o /= o.sum(1, keepdims=True)
            o[np.arange(len(at)), part[at]] -= 1
            o /= len(at)
            back = (o @ w[2].T) * (z > 0)
            t += 1
            for i, g in enumerate((x[at].T @ back, back.sum(0), h.T @ o, o.sum(0))):
                g = g + 1e-4 * w[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(w)


def fit(x: np.ndarray, parts: int = LEAST_PARTS, k: int = 5, target: float = TARGET) -> Router:
    """A router from sample vectors (rows); the last of them are held out to find the probes."""
    x = np.unique(unit(x), axis=0)
    x = x[np.random.default_rng(2).permutation(len(x))]
    held = min(HELD_OUT, len(x) // 5)
    own = x[: len(x) - held]
    while parts > 1 and len(own) < 8 * parts:
        parts //= 2
    if parts < 2:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    part = balanced_parts(own, knn_graph(own, min(DEGREE, len(own) - 1)), parts)
    router = Router(*train(own, part, parts), probes=parts)
    asked, at = router.order(x[len(own) :]), router.order(own)[:, 0]
    near = np.argsort(-(x[len(own) :] @ own.T), axis=1)[:, :k]
    rank = np.argsort(asked, axis=1)  # place of each part in a query's order
    needed = np.take_along_axis(rank, at[near], axis=1)
    found = [(needed < p).mean() for p in range(1, parts + 1)]
    router.probes = next((p for p, f in enumerate(found, 1) if f >= target), parts)
    return router


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v (its components as doubles, packed) of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", e.alias("e")).filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~bad & F.exists("e", lambda x: x != 0))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(1)
            flat, off = np.asarray(e.values), np.asarray(e.offsets) * 8
            raw = flat.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[i:j] for i, j in zip(off[:-1], off[1:])], pa.binary())], names=["vec_id", "v"])

    return rows.mapInArrow(pack, "vec_id bigint, v binary")


def _matrix(v: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1)


def best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of c to each of q by exact cosine, ties to smaller ids, never the query's own id."""
    cu, out = unit(c), []
    qn, cn = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    for i in range(0, len(q), 256):
        s = unit(q[i : i + 256]) @ cu.T
        s[qid[i : i + 256, None] == cid[None, :]] = -np.inf
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -2.0)
        rows, cols = np.nonzero(s >= np.maximum(least, -2.0)[:, None] - 1e-9)
        # matrix products may differ in the last bits for equal vectors, so scores are computed anew, one way
        score = np.empty(len(rows))
        for j in range(0, len(rows), 65536):
            r, t = rows[j : j + 65536], cols[j : j + 65536]
            score[j : j + 65536] = (q[i + r] * c[t]).sum(1) / (qn[i + r] * cn[t])
        found = pd.DataFrame({"query_id": qid[i + rows], "vec_id": cid[cols], "score": score}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        found = found.drop_duplicates(["query_id", "vec_id"])
        out.append(found[found.groupby("query_id").cumcount() < k])
    return pd.concat(out, ignore_index=True)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, parts: int | None = None, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row (all, if fewer), nearest first.

    Rows whose vector is null, empty, zero or holds null or non-finite components take no part, nor do rows
    without id or whose length differs from the most frequent one; a repeated row counts once; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(valid_vectors(vectors).withColumn("n", F.octet_length("v")), "vectors")
    usual = rows.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    out_schema = "query_id bigint, vec_id bigint, score double"
    none = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if usual is None:
        return none
    rows = rows.filter(F.col("n") == usual["n"])
    parts = parts or parts_of(usual["count"])
    chosen = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(int(SAMPLE * parts)).toPandas()
    fitted = fit(_matrix(list(chosen["v"])), parts, k, target)
    router = spark.sparkContext.broadcast(fitted)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                order = router.value.order(unit(_matrix(b.column(1).to_pylist()))).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], names=["vec_id", "v", "parts"])

    routed = written(rows.select("vec_id", "v").mapInArrow(route, "vec_id bigint, v binary, parts array<int>").select("vec_id", "v", F.col("parts")[0].alias("p"), F.when(is_query, F.col("parts")).alias("parts")), "routed")
    # of copies of a row one counts, and one candidate may be the query itself
    sizes = {r["p"]: r["n"] for r in routed.groupBy("p").agg(F.count("*").alias("n"), F.approx_count_distinct("vec_id").alias("ids")).select("p", F.least("n", (F.col("ids") * 0.8).cast("long")).alias("n")).collect()}  # one row a part
    lookup = lambda d, at, other: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in sorted(d.items()) for x in kv)), at), F.lit(other))
    upto = F.aggregate("parts", F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(0).alias("n")), lambda acc, p: F.when((acc["n"] >= fitted.probes) & (acc["held"] > 2 * k), acc).otherwise(F.struct((acc["held"] + lookup(sizes, p, 0)).cast("bigint").alias("held"), (acc["n"] + 1).alias("n"))))
    asks = routed.filter("parts is not null").select("vec_id", "v", F.explode(F.slice("parts", F.lit(1), upto["n"])).alias("p"))
    asked = {r["p"]: r["n"] for r in asks.groupBy("p").agg(F.count("*").alias("n")).collect()}
    if not asked:
        return none
    blocks = {p: -(-n // BLOCK) for p, n in {r["p"]: r["n"] for r in routed.groupBy("p").agg(F.count("*").alias("n")).collect()}.items()}
    groups = {p: -(-n // QUERY_BLOCK) for p, n in asked.items()}
    h, p = F.xxhash64("vec_id"), F.col("p")
    held = routed.withColumns({"cb": F.pmod(h, lookup(blocks, p, 1)), "qb": F.explode(F.sequence(F.lit(0), lookup(groups, p, 1) - 1))}).select("p", "cb", F.col("qb").cast("int").alias("qb"), "vec_id", "v")
    sent = asks.withColumns({"qb": F.pmod(h, lookup(groups, p, 1)).cast("int"), "cb": F.explode(F.sequence(F.lit(0), lookup(blocks, p, 1) - 1))}).select("p", F.col("cb").cast("bigint").alias("cb"), "qb", "vec_id", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        left = left.drop_duplicates(["vec_id", "v"])
        return best(left["vec_id"].to_numpy(), _matrix(list(left["v"])), right["vec_id"].to_numpy(), _matrix(list(right["v"])), k)

    keys = ["p", "cb", "qb"]
    found = sent.groupBy(*keys).cogroup(held.withColumn("cb", F.col("cb").cast("bigint")).groupBy(*keys)).applyInPandas(search, out_schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
