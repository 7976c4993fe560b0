"""Models as columns: embedding, reranking and answering by functions that the caller gives, in Arrow batches.

A function takes a list and gives a list of the same length. It is made by ``make()`` once a batch iterator, in the task, so that it may
open a connection. Blank texts are not sent and give null; the rows stay, so nothing shifts. Offline stand-ins are at the end.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import sqrt

import pandas as pd
import regex
from pyspark.sql import DataFrame

Make = Callable[[], Callable[..., list]]


@dataclass(frozen=True)
class Pace:
    """How a service is called: at most ``rate`` calls a second of each task (``tasks`` bounds the tasks, so tasks * rate bounds all); a call that fails is
    repeated ``retries`` times after ``wait``, 2 * ``wait``, 4 * ``wait``, ... seconds. Where ``error`` names a column, rows of a call that fails for good keep a null
    value and the error's text there; where it doesn't, the job fails."""

    rate: float | None = None
    retries: int = 0
    wait: float = 1.0
    error: str | None = None


def _paced(call: Callable[..., list], pace: Pace) -> Callable[[list], tuple[list, str | None]]:
    free = 0.0

    def once(given: list) -> tuple[list, str | None]:
        nonlocal free
        for turn in range(pace.retries + 1):
            if pace.rate:
                time.sleep(max(0.0, free - time.monotonic()))
                free = max(free, time.monotonic()) + 1 / pace.rate
            try:
                out = call(given)
                if len(out) != len(given):
                    raise ValueError(f"{len(out)} results for {len(given)} rows")
                return out, None
            except Exception as e:
                if turn < pace.retries:
                    time.sleep(pace.wait * 2**turn)
                elif pace.error is None:
                    raise
                else:
                    return [None] * len(given), f"{type(e).__name__}: {e}"
        raise AssertionError

    return once


def _called(rows: DataFrame, inputs: list[str], output: str, kind: str, make: Make, batch: int, tasks: int | None, pace: Pace) -> DataFrame:
    made = [output, *([pace.error] if pace.error else [])]
    kept = [f for f in rows.schema if f.name not in made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"{output} {kind}", *(f"`{c}` string" for c in made[1:])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = _paced(make(), pace)
        for b in batches:
            sent = [i for i, row in enumerate(zip(*(b[c] for c in inputs), strict=True)) if all(x is not None and str(x).strip() for x in row)]
            values: list = [None] * len(b)
            errors: list = [None] * len(b)
            for at in range(0, len(sent), batch):
                part = sent[at : at + batch]
                given = [tuple(b[c].iloc[i] for c in inputs) if len(inputs) > 1 else b[inputs[0]].iloc[i] for i in part]
                got, error = call(given)
                for i, v in zip(part, got, strict=True):
                    values[i], errors[i] = v, error
            yield b.assign(**{output: values}, **({pace.error: errors} if pace.error else {}))

    used = rows.select(*(f"`{f.name}`" for f in kept))
    return (used.repartition(tasks) if tasks else used).mapInPandas(run, schema)


def embedded(rows: DataFrame, make: Make, text: str = "text", batch: int = 10, tasks: int | None = None, pace: Pace = Pace()) -> DataFrame:
    """rows with embedding (array of doubles) of text. ``tasks`` bounds how many calls run at a time, where a service asks for that."""
    return _called(rows, [text], "embedding", "array<double>", make, batch, tasks, pace)


def scored(rows: DataFrame, make: Make, question: str = "question", text: str = "text", batch: int = 32, tasks: int | None = None, pace: Pace = Pace()) -> DataFrame:
    """rows with score of each (question, text)."""
    return _called(rows, [question, text], "score", "double", make, batch, tasks, pace)


def reranked(rows: DataFrame, make: Make, query: str = "query_id", question: str = "question", id_: str = "id", chunk_id: str = "chunk_id", text: str = "text", rank: str = "rank") -> DataFrame:
    """rows of each query as a reranking function orders them: score is what it gives, rank its order from 1.

    The function gets (question, chunks), the query's rows in order as dicts with id, chunk_id and text, and gives results, dicts with id or
    chunk_id and score, the best first. A result stands for the row of its id, else of its chunk_id (of rows that share one the last); it is dropped where
    there is none; a row that is named twice stands twice. A blank question gives no rows. A query's rows go to one call: some tens, as the lists before are cut.
    """
    names = rows.columns

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(rank, kind="stable")
        asked = f[question].iloc[0]
        if asked is None or not str(asked).strip():
            return f.iloc[:0]
        ids, chunks = f[id_].tolist(), f[chunk_id].tolist()
        results = make()(asked.strip(), [{"id": i, "chunk_id": c, "text": t} for i, c, t in zip(ids, chunks, f[text], strict=True)])
        by_id = {i: n for n, i in enumerate(ids) if i}
        by_chunk = {c: n for n, c in enumerate(chunks) if c}
        found = [(by_id.get(r.get("id") or None, by_chunk.get(r.get("chunk_id") or None)), float(r.get("score") or 0.0)) for r in results]
        found = [(n, s) for n, s in found if n is not None]
        last = dict(found)  # a row that is named twice has the later score
        out = f.iloc[[n for n, _ in found]].copy()
        out["score"], out[rank] = [last[n] for n, _ in found], range(1, len(found) + 1)
        return out[names]

    return rows.groupBy(query).applyInPandas(run, rows.schema)


def answered(rows: DataFrame, make: Make, prompt: str = "prompt", batch: int = 1, tasks: int | None = None, pace: Pace = Pace()) -> DataFrame:
    """rows with answer to each prompt."""
    return _called(rows, [prompt], "answer", "string", make, batch, tasks, pace)


def hashed_embedding(size: int = 64) -> Make:
    """Unit vectors of hashed words."""

    def one(text: str) -> list[float]:
        v = [0.0] * size
        for w in text.lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            v[h % size] += 1.0 if h >> 63 else -1.0
        n = sqrt(sum(x * x for x in v)) or 1.0
        return [x / n for x in v]

    return lambda: lambda texts: [one(t) for t in texts]


def shared_words() -> Make:
    """The part of the question's words that the text holds."""

    def one(pair: tuple[str, str]) -> float:
        asked, held = (set(x.lower().split()) for x in pair)
        return len(asked & held) / max(1, len(asked))

    return lambda: lambda pairs: [one(p) for p in pairs]


def word_reranker() -> Make:
    """Chunks by the part of the question's distinct words that their text holds, equal ones in order; scores have 9 decimals."""

    def words(text: str) -> set[str]:
        return set(regex.findall(r"[\p{L}\p{N}_]+", (text or "").lower()))

    def order(question: str, chunks: list[dict]) -> list[dict]:
        asked = words(question)
        scores = [round(len(asked & words(c["text"])) / max(1, len(asked)), 9) for c in chunks]
        return [{"id": chunks[i]["id"], "score": scores[i]} for i in sorted(range(len(chunks)), key=lambda i: -scores[i])]

    return lambda: order


def first_line() -> Make:
    """The first line of the prompt."""
    return lambda: lambda prompts: [p.split("\n")[0] for p in prompts]
