"""The engine as a library: a corpus of chunks with its indexes, questions in, hits and answers out.

``Engine(spark, chunks, vectors)`` writes the chunks once and makes the indexes of words, substrings and vectors when they are first needed; all
questions after that use the same files. ``retrieve`` and ``ask`` take any number of questions as a table. Both run jobs
while they are built: question analysis and fused hits, some tens of rows a question, are written once for the steps that follow.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Settings, settings
from lodestone.functions import blocks as B
from lodestone.functions import rules
from lodestone.operators import grams, legal, models, postings, rank, vectors
from lodestone.operators.questions import analyzed, guarded
from lodestone.sources.shared import spread, written

#: What an answer tells of each source.
SOURCE = [
    "ten_van_ban", "ma_van_ban", "loai_van_ban", "co_quan_ban_hanh", "trang_thai_hieu_luc", "ngay_hieu_luc", "chuong", "dieu", "khoan", "diem", "tieu_de_dieu", "trang_bat_dau", "chu_de",
]


class Engine:
    """Chunks: doc_id (the order of the corpus), chunk_id, text, and the metadata columns of ``legal``. Vectors: vec_id (a doc_id), v.

    The limits are those of ``settings`` unless a call gives its own.
    """

    def __init__(self, spark: SparkSession, chunks: DataFrame, vectors: DataFrame | None = None, limits: Settings | None = None) -> None:
        self.spark, self.limits = spark, limits or settings(spark)
        self._chunks, self._vectors = chunks, vectors

    @cached_property
    def chunks(self) -> DataFrame:
        return written(spread(self._chunks), "chunks")

    @cached_property
    def words(self) -> postings.Postings:
        return postings.build(self.chunks.select("doc_id", "text"))

    @cached_property
    def phrases(self) -> grams.GramIndex:
        return grams.build(self.chunks, ["text", "tieu_de_dieu"])

    @cached_property
    def vectors(self) -> vectors.VectorIndex | None:
        if self._vectors is None:
            return None
        meta = self.chunks.select(F.col("doc_id").alias("vec_id"), *(c for c in legal.FILTERS if c in self.chunks.columns))
        return vectors.build(self._vectors.select("vec_id", "v").join(meta, "vec_id"))

    def analyzed(self, questions: DataFrame, filters: dict | None = None) -> DataFrame:
        """What questions (query_id, question) name and ask for, with the filters of the call and their own."""
        return legal.wanted(analyzed(questions).join(questions.select("query_id", "question"), "query_id"), filters)

    def lists(self, asked: DataFrame, candidates: int, queries: DataFrame | None = None) -> dict[str, DataFrame]:
        """The ranked lists of questions (see analyzed): by place or kind, by exact words, by words, and by vectors (query_id, q) where there are any."""
        wants = [c for c in asked.columns if c.startswith("want_")]
        words = written(postings.bm25(self.words, asked.select("query_id", F.col("question").alias("text")), 2 * candidates), "words")
        met = words.withColumnRenamed("rank", "was").join(self.chunks.select("doc_id", *(w[5:] for w in wants)), "doc_id").join(asked.select("query_id", *wants), "query_id")
        passed = rank.top(met.filter(legal._passes(wants)), ["query_id"], [F.col("was")], candidates).select("query_id", "doc_id", "rank")
        found = {"structured": legal.structured(self.chunks, asked), "exact": legal.exact(self.chunks, asked, index=self.phrases), "bm25": passed}
        if queries is not None and self.vectors is not None:
            sent = asked.select("query_id", *wants).join(queries.select("query_id", "q"), "query_id")
            found["dense"] = vectors.search(self.vectors, sent, candidates).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
        # some tens of rows a question each; one plan of all lists would fill the driver
        return {name: written(df.select("query_id", "doc_id", "rank"), name) for name, df in found.items()}

    def fused(self, questions: DataFrame, top_k: int | None = None, candidate_k: int | None = None, filters: dict | None = None, queries: DataFrame | None = None, observed: dict[str, Observation] | None = None) -> tuple[DataFrame, DataFrame]:
        """The questions as analysed and their fused hits, both written. Where ``observed`` is a dict, it gets an Observation of every list, filled by this run."""
        k = top_k or self.limits.top_k
        candidates = candidate_k or max(self.limits.candidates_per_list, 4 * k)
        asked = written(self.analyzed(questions, filters), "asked")
        found = self.lists(asked, candidates, queries)
        if observed is not None:
            for name, df in found.items():
                observed[name] = Observation(name)
                first = F.when(F.col("rank") <= 3, F.struct("rank", "query_id", "doc_id"))
                found[name] = df.observe(observed[name], F.count(F.lit(1)).alias("n_rows"), F.max("rank").alias("longest"), F.min(first).alias("first"))
        return asked, written(legal.fused(found, self.chunks, asked, candidates, self.limits.rrf_k), "fused")

    def retrieve(self, questions: DataFrame, top_k: int | None = None, candidate_k: int | None = None, filters: dict | None = None, queries: DataFrame | None = None, reranker: models.Make | None = None) -> DataFrame:
        """query_id, doc_id, score, sources, added, rank of the hits of questions (query_id, question), with their vectors in queries (query_id, q).

        filters: {column: value} over legal.FILTERS; a document or its type that a question names itself goes before. A reranker (see models.reranked) orders all
        candidates and their siblings anew before the limit.
        """
        k, own = top_k or self.limits.top_k, self.limits
        asked, hits = self.fused(questions, k, candidate_k, filters, queries)
        return legal.finished(hits, self.chunks, asked, k, reranker, own.rerank_top_k, own.sibling_neighbors, own.sibling_limit)

    def sources(self, hits: DataFrame) -> DataFrame:
        """query_id, sources (hits by rank, as SOURCE, score, retrieval_source), n_blocks, context: what fits in the budget."""
        hits = written(hits, "hits")
        met = hits.withColumnRenamed("sources", "retrieval_source").join(legal.of(self.chunks, hits, *(c for c in self.chunks.columns if c != "doc_id")), "doc_id")
        block = B.context_block(F.col("ten_van_ban"), F.col("dieu"), F.col("khoan"), F.col("diem"), F.col("text"))
        source = F.struct("rank", "doc_id", *(c if c in self.chunks.columns else F.lit(None).cast("string").alias(c) for c in SOURCE), "score", "retrieval_source")
        one = met.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("block"), source.alias("s")))).alias("r"))
        kept = rank.packed(F.transform("r", lambda x: x["block"]), self.limits.max_context_chars)
        rows = one.select("query_id", F.transform("r", lambda x: x["s"]).alias("sources"), kept.alias("kept"))
        return rows.select("query_id", "sources", F.size("kept").cast("bigint").alias("n_blocks"), F.array_join("kept", "\n\n---\n\n").alias("context"))

    def ask(self, questions: DataFrame, answer: models.Make, filters: dict | None = None, queries: DataFrame | None = None, reranker: models.Make | None = None, top_k: int | None = None) -> DataFrame:
        """query_id, question, answer, sources of questions (query_id, question): what ``answer`` says to the prompt of question and context, as the guard lets it stand.

        Blank questions get no row. A question without context is told so without a call.
        """
        said = questions.select("query_id", F.trim("question").alias("question")).filter("question <> ''")
        met = said.join(self.sources(self.retrieve(said, top_k, None, filters, queries, reranker)), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
        prompt = F.when(F.trim("context") != "", B.prompt(F.col("question"), F.col("context")))
        told = models.answered(met.withColumn("prompt", prompt), answer)
        kept = guarded(F.coalesce("answer", F.lit(rules.EMPTY_ANSWER)), F.col("question"), F.col("context"), rules.GUARD_ANSWER)
        return told.select("query_id", "question", kept.alias("answer"), "sources")
