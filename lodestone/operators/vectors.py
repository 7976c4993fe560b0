"""An inverted-file index of vectors in Parquet: cells around centroids, searched cell by cell, with metadata filters.

Centroids are fitted on a bounded sample (SAMPLE vectors a cell); every vector goes to its nearest centroid, and files are sorted by cell,
so that a search reads the cells that it asks for. A cell keeps its centroid, its radius and its size. No vector of a cell is nearer to a question than
the distance to its centroid less its radius: a search of a question's ``probes`` nearest cells gives a k-th distance, and only
cells that can hold something nearer are searched after. That is exact; without the second step it is a search of ``probes`` cells
alone. Filters act inside cells, so a question whose filter leaves few vectors goes on to further cells until it has k.

Vectors meet questions in groups of (cell, piece of the cell, block of questions) of about PIECE vectors and ASKED questions at most, so a cell that
holds most of the table is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.sources.shared import new_path, written

from .rank import top

SAMPLE, MOST_CELLS, PIECE, QUESTIONS, ASKED = 64, 4096, 4096, 256, 4096
PROBES, ROUNDS = 8, 12


def cells_of(rows: int) -> int:
    """About the square root of the rows, a power of two, MOST_CELLS at most."""
    return min(MOST_CELLS, 1 << max(0, (max(1, rows).bit_length() - 1) // 2))


def fitted(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of sample rows by Lloyd's rounds from rows drawn far apart; fewer where there are fewer distinct rows."""
    x, rng = np.unique(x, axis=0), np.random.default_rng(0)
    first = [int(rng.integers(len(x)))]
    gap = ((x - x[first[0]]) ** 2).sum(1)
    while len(first) < cells and gap.any():
        first.append(int(rng.choice(len(x), p=gap / gap.sum())))
        gap = np.minimum(gap, ((x - x[first[-1]]) ** 2).sum(1))
    c = x[first]
    for _ in range(rounds):
        at = nearest_cell(x, c)[0]
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest_cell(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance to it."""
    at, d = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), 1024):
        gap = np.maximum(((x[i : i + 1024] ** 2).sum(1)[:, None] - 2 * x[i : i + 1024] @ c.T + (c * c).sum(1)), 0)
        at[i : i + 1024] = gap.argmin(1)
        d[i : i + 1024] = np.sqrt(gap[np.arange(len(gap)), at[i : i + 1024]])
    return at, d


@dataclass(frozen=True)
class VectorIndex:
    """The folder of an index: vectors (vec_id, v, metadata, cell, piece), and cells (cell, centroid, radius, n, pieces)."""

    spark: SparkSession
    path: str
    n: int

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")


def build(rows: DataFrame, path: str | None = None, cells: int | None = None) -> VectorIndex:
    """The index of rows (vec_id, v array<double>, any metadata columns) at a new folder. Rows whose v is null, empty or holds null or non-finite
    components are left out, as are those of another length than the most frequent one."""
    spark = rows.sparkSession
    path = path or new_path(spark, "vectors")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad)
    usual = good.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        good.withColumns({"cell": F.lit(0), "radius": F.lit(0.0), "piece": F.lit(0)}).write.parquet(f"{path}/vectors")
        spark.createDataFrame([], "cell int, centroid array<double>, radius double, n bigint, pieces int").write.parquet(f"{path}/cells")
        return VectorIndex(spark, path, 0)
    good, n = good.filter(F.size("v") == usual["size"]), usual["count"]
    cells = cells or cells_of(n)
    chosen = good.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE * cells).toPandas()  # bounded by the number of cells; copies count once
    centroids = fitted(np.stack(chosen["v"].to_numpy()), cells)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            at, d = nearest_cell(np.stack(v.to_numpy()), shared.value) if len(v) else (np.empty(0, np.int64), np.empty(0))
            yield pd.DataFrame({"cell": at, "radius": d})

    placed = good.withColumn("p", F.pandas_udf(assign, "cell int, radius double")("v")).select("*", "p.cell", "p.radius").drop("p")
    placed = written(placed, "placed")
    one = placed.groupBy("cell").agg(F.max("radius").alias("radius"), F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int"))
    at = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    one.join(at, "cell").select("cell", "centroid", (F.col("radius") + 1e-6).alias("radius"), "n", "pieces").coalesce(1).write.parquet(f"{path}/cells")  # a row a cell
    known = spark.read.parquet(f"{path}/cells")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = placed.drop("radius").join(known.select("cell", "pieces"), "cell").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int")).drop("pieces")
    cut.repartitionByRange(parts, "cell", "piece").sortWithinPartitions("cell", "piece").write.parquet(f"{path}/vectors")
    return VectorIndex(spark, path, n)


def _search(index: VectorIndex, asks: DataFrame, queries: DataFrame, k: int, wants: list[str]) -> DataFrame:
    """query_id, vec_id, distance: the k nearest of each (query, cell) that ``asks`` (query_id, cell) names."""
    keys = ["cell", "piece", "qb"]
    groups = queries.count() // ASKED + 1
    met = asks.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).join(index.cells.select("cell", "pieces"), "cell")
    sent = met.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).join(queries, "query_id").select(*keys, "query_id", "q", *wants)
    asked = met.select(F.col("cell").alias("c"), F.col("qb").alias("b")).distinct()
    held = index.vectors.join(asked, F.col("cell") == F.col("c")).select("cell", "piece", F.col("b").alias("qb"), "vec_id", "v", *(w[5:] for w in wants))

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            ids, x = v["vec_id"].to_numpy(), np.stack(v["v"].to_numpy())
            codes = {w: (pd.factorize(pd.concat([v[w[5:]], q[w]], ignore_index=True))[0], q[w].notna().to_numpy()) for w in wants}
            qid, asked = q["query_id"].to_numpy(), np.stack(q["q"].to_numpy())
            for i in range(0, len(q), QUESTIONS):
                # the distances that a scan gives, to the digit: differences are squared and summed one by one
                d = np.stack([np.round(((x - one) ** 2).sum(1), 6) for one in asked[i : i + QUESTIONS]])
                for code, given in codes.values():
                    other = (code[None, : len(v)] != code[len(v) + i : len(v) + i + len(d), None]) & given[i : i + len(d), None]
                    d[other] = np.inf
                m = min(k, len(ids))
                kth = np.partition(d, m - 1, axis=1)[:, m - 1]
                at, col = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
                found = pd.DataFrame({"query_id": qid[i + at], "vec_id": ids[col], "distance": d[at, col]}).sort_values(["query_id", "distance", "vec_id"])
                out.append(found[found.groupby("query_id").cumcount() < k])
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "distance": []}).astype({"query_id": "int64", "vec_id": "int64"})

    return sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, "query_id bigint, vec_id bigint, distance double")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = True) -> DataFrame:
    """query_id, vec_id, distance (squared L2), rank, score (1 - distance): the k nearest vectors to each of queries (query_id, q).

    A column want_x of queries lets those vectors take part only whose metadata x equals it, where it isn't null. With ``exact`` the rows are those of a full scan;
    without, those of the probes nearest cells, and of further ones for questions that found fewer than k there.
    """
    wants = [c for c in queries.columns if c.startswith("want_")]
    cells = index.cells.collect()  # a row a cell, MOST_CELLS at most
    if not cells:
        return index.spark.createDataFrame([], "query_id bigint, vec_id bigint, distance double, rank int, score double")
    number, centroid, radius = np.array([c["cell"] for c in cells]), np.array([c["centroid"] for c in cells]), np.array([c["radius"] for c in cells])
    shared = index.spark.sparkContext.broadcast((number, centroid, radius))

    def order(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, centroid, radius = shared.value
        for f in frames:
            for query, q in zip(f["query_id"], f["q"], strict=True):
                gap = np.sqrt(((centroid - q) ** 2).sum(1))
                at = np.argsort(gap, kind="stable")
                yield pd.DataFrame({"query_id": query, "cell": number[at], "place": np.arange(len(at)), "least": np.maximum(gap - radius, 0)[at] ** 2})

    routed = written(queries.select("query_id", "q").mapInPandas(order, "query_id bigint, cell int, place int, least double"), "routed")
    best = lambda rows: top(rows, ["query_id"], [F.col("distance"), F.col("vec_id")], k)
    begun = written(best(_search(index, routed.filter(F.col("place") < probes), queries, k, wants)), "begun")
    kth = begun.filter(F.col("rank") == k).select("query_id", F.col("distance").alias("kth"))
    rest = routed.filter(F.col("place") >= probes).join(kth, "query_id", "left")
    near = F.col("kth").isNull() | (F.col("least") <= F.col("kth") + 1e-5) if exact else F.col("kth").isNull()
    after = _search(index, rest.filter(near).select("query_id", "cell"), queries, k, wants)
    found = best(begun.select("query_id", "vec_id", "distance").unionByName(after))
    return found.select("query_id", "vec_id", "distance", "rank", F.round(1 - F.col("distance"), 6).alias("score"))


def share(index: VectorIndex, queries: DataFrame, probes: int = PROBES) -> float:
    """The part of the vectors that a search of ``probes`` cells alone compares a question with, on average."""
    cells = index.cells
    n = cells.agg(F.sum("n")).first()[0] or 1
    size = {c["cell"]: c["n"] for c in cells.collect()}
    number, centroid = np.array(sorted(size)), np.array([c["centroid"] for c in sorted(cells.collect(), key=lambda c: c["cell"])])
    sizes = np.array([size[c] for c in number])

    def part(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for q in f["q"]:
                at = np.argsort(((centroid - q) ** 2).sum(1), kind="stable")[:probes]
                yield pd.DataFrame({"n": [int(sizes[at].sum())]})

    return (queries.select("q").mapInPandas(part, "n bigint").agg(F.avg("n")).first()[0] or 0) / n
