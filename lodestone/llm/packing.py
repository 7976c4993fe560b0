"""Bounded-space online packing of documents into sequences.

Each input partition keeps OPEN windows. A document's ids fill whole windows first; what remains goes to the
window that it leaves fullest. Where none has room, the fullest is emitted: topped up with the head of the
document if at least LEAST_CUT ids fit, else padded. What the windows hold at a partition's end is merged,
FAN partitions at a time, by putting the largest pieces first. Only piece rows are shuffled, never ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .encoding import encoder

LENGTH, OPEN, LEAST_CUT, FAN, END = 4096, 32, 64, 16, 2
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = [c.split()[0] for c in PIECE.split(", ")]


class Windows:
    """Open windows by room left; add() gives the windows that it closes, as (key, pieces)."""

    def __init__(self, length: int = LENGTH, most: int = OPEN, least_cut: int = LEAST_CUT) -> None:
        self.length, self.most, self.least_cut = length, most, least_cut
        self.open: list[tuple[int, int]] = []  # (room, key), rising
        self.held: dict[int, list] = {}
        self.made = 0

    def _new(self) -> tuple[int, int]:
        self.made += 1
        self.held[self.made] = []
        return self.length, self.made

    def add(self, n: int, piece: Callable[[int, int], object], cut: bool = True) -> Iterator[tuple[int, list]]:
        """Places the n ids of a document; piece(start, length) makes what a window holds of it."""
        start = 0
        while start < n:
            left = n - start
            i = bisect_left(self.open, (left, 0))
            if left >= self.length and cut:
                (room, key), size = self._new(), self.length
            elif i < len(self.open):  # the least room that is enough
                (room, key), size = self.open.pop(i), left
            elif len(self.open) < self.most:
                (room, key), size = self._new(), left
            else:
                room, key = self.open.pop(0)
                size = room if cut and room >= self.least_cut else 0
                room = size  # the fullest goes, with the head of the document or without
            if size:
                self.held[key].append(piece(start, size))
            start, room = start + size, room - size
            if room:
                insort(self.open, (room, key))
            else:
                yield key, self.held.pop(key)

    def rest(self) -> Iterator[tuple[int, list]]:
        for _, key in self.open:
            yield key, self.held.pop(key)
        self.open = []


def _crc(ids: bytes, start: int, n: int) -> int:
    return zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)])


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its text's ids and then ``end``; a null text is empty. Repeated rows are documents of
    their own; a null doc_id stays null; other columns are ignored; an empty table gives no pieces.
    """
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, windows, enc = TaskContext.get().partitionId(), Windows(length), encoder(path)
        ready: list[tuple] = []

        def closed(key: int, pieces: list[tuple], is_open: bool) -> None:
            at = 0
            for doc, start, n, crc, tokens in pieces:
                ready.append((doc, start, n, crc, tokens, task << 32 | key, at, is_open, task))
                at += n

        def flush() -> pa.RecordBatch:
            cols = list(zip(*ready, strict=True)) if ready else [[]] * 9
            kinds = [*[pa.int64()] * 7, pa.bool_(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*_NAMES, "open", "part"])
            ready.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.encode(text.as_py()) + last
                total = len(ids) // 4
                for key, pieces in windows.add(total, lambda at, n: (doc, at, n, _crc(ids, at, n), total)):  # noqa: B023
                    closed(key, pieces, False)
            if ready:
                yield flush()
        for key, pieces in windows.rest():
            closed(key, pieces, True)
        yield flush()

    first = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{PIECE}, open boolean, part bigint"), "pieces")

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        windows, rows = Windows(length, most=len(group) + 1), []
        for i, n in enumerate(group["length"]):
            rows += windows.add(int(n), lambda _, n: (i, n), cut=False)  # noqa: B023
        rows += windows.rest()
        seq, at, order = [], [], []
        for key, pieces in rows:
            off = 0
            for i, n in pieces:
                order.append(i)
                seq.append(1 << 62 | int(group["part"].iloc[0]) // FAN << 32 | key)
                at.append(off)
                off += n
        return group.iloc[order].assign(sequence_id=seq, offset=at)[_NAMES]

    leftovers = first.filter("open").withColumn("g", F.floor(F.col("part") / FAN)).groupBy("g").applyInPandas(merge, PIECE)
    return first.filter("not open").select(*_NAMES).unionByName(leftovers)


def op3_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
