"""Centroid clustering: plain Lloyd over whole numbers, so results are the same on any cluster.

Vectors are scaled and rounded down once and kept packed in the shared folder. A round broadcasts the centroids,
finds the nearest one of each vector in NumPy (the lowest number on a tie) and adds up vectors by centroid inside each
partition; only these sums, CLUSTERS * (components + 2) numbers a partition, are exchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

COMPONENTS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Scaled components beyond this are held at it: squared distances of 64 components stay below 2^63.
MOST = 1 << 27


def scaled(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and v (packed 32-bit integers) of the vectors of this length without null or non-finite components."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).filter((F.size("e") == components) & ~bad)

    def pack(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                with np.errstate(over="ignore"):
                    whole = np.clip(np.floor(np.stack(f["e"].to_list()) * scale), -MOST, MOST).astype("<i4")
                yield pd.DataFrame({"vec_id": f["vec_id"], "v": [r.tobytes() for r in whole]})

    # an id may be null: it travels as text, as pandas would make numbers of doubles
    packed = rows.withColumn("vec_id", F.col("vec_id").cast("string")).mapInPandas(pack, "vec_id string, v binary")
    return packed.select(F.col("vec_id").cast("long").alias("vec_id"), "v")


def assigned(v: pd.Series, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors as rows, the number of each one's nearest centroid, and the squared distance to it."""
    x = np.frombuffer(b"".join(v), "<i4").reshape(len(v), -1).astype(np.int64)
    d = np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)
    at = d.argmin(1)
    return x, at, d[np.arange(len(x)), at]


def _sums(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By centroid: the sums of its vectors' components and, last, of distances; and the counts."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    k, width = centroids.shape[0], centroids.shape[1] + 1

    def partial(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for f in frames:
            if len(f):
                x, at, d = assigned(f["v"], shared.value)
                for c in np.unique(at):
                    total[c, :-1] += x[at == c].sum(0)
                    total[c, -1] += d[at == c].sum()
                n += np.bincount(at, minlength=k)
        used = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": np.repeat(used, width), "component": np.tile(np.arange(width), len(used)), "total": total[used].ravel(), "n": np.repeat(n[used], width)})

    merged = rows.select("v").mapInPandas(partial, "cluster int, component int, total bigint, n bigint").groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    total, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
    for r in merged.collect():  # clusters * components rows
        total[r["cluster"], r["component"]], n[r["cluster"]] = r["total"], r["n"]
    shared.unpersist()
    return total, n


def lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per vector kept.

    Centroids start as the vectors with the smallest sha256 of ``seed:vec_id`` (ties by the vector itself, a null id
    as no digits); where fewer vectors are kept, all of them. Repeated rows count each, and of equal centroids the lowest number gets all vectors.
    Null, shorter, longer vectors and those with null or non-finite components are left out; scaled
    components are held at MOST. Other columns are ignored; a table without such vectors gives no rows.
    """
    rows = written(scaled(vectors, components, scale), "scaled")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(order.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    if not first:
        return rows.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.stack([np.frombuffer(r["v"], "<i4") for r in first]).astype(np.int64)
    for _ in range(rounds):
        total, n = _sums(rows, centroids)
        centroids = np.where(n[:, None] > 0, total[:, :-1] // np.maximum(n, 1)[:, None], centroids)
    inertia = _sums(rows, centroids)[0][:, -1]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    shared = rows.sparkSession.sparkContext.broadcast((centroids, inertia, np.array(digests, object)))

    def final(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, inertia, digests = shared.value
        for f in frames:
            if len(f):
                _, at, d = assigned(f["v"], centroids)
                yield pd.DataFrame({"vec_id": f["vec_id"], "cluster": at, "distance": d, "cluster_inertia": inertia[at], "inertia": inertia.sum(), "centroid_sha256": digests[at]})

    text_id = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "v")
    out = text_id.mapInPandas(final, "vec_id string, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.withColumn("vec_id", F.col("vec_id").cast("long"))


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
