"""The stages of the pipeline against brute force on their own inputs."""

import collections

from test_operators import brute_classes, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as p
    from lodestone.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in p.STAGES:
        out = written(stage(spark, docs, SF), name)
        rows = out.collect()
        if name == "language_id":
            assert {r["doc_id"] for r in rows} == {k for k, t in before.items() if any(map(str.isalpha, t))}
        if name == "line_dedup":
            want = brute_lines(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
            assert {r["doc_id"]: r["text"] for r in rows} == {k: t for k, t in want.items() if t or not before[k]}
        if name == "near_dedup":
            want = brute_classes(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
            assert sorted(r["doc_id"] for r in rows) == sorted(set(want.values()))
        if name == "mixing":
            assert max(collections.Counter(r["doc_id"] for r in rows).values()) <= 2
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
        if name == "packing":
            assert sum(1 for r in rows if r["start"] == 0) == docs.count()
        else:
            assert out.columns == columns
        docs = out
    assert p.run(spark, SF).count() == len(rows)


def test_stages_over_odd_rows(spark):
    """Nulls in every column, an empty and a long text, repeated rows, one id with two texts, clashing columns, no rows."""
    import corpus_pipeline as p
    from lodestone.llm.common import written
    from pyspark.sql import functions as F
    from test_operators import odd_docs

    clash = odd_docs(spark).withColumns({c: F.lit(1) for c in ("score", "lang_pred", "n_lines", "target", "size", "copies", "d", "key", "label", "k", "h", "b")})
    for rows, counts in ((odd_docs(spark), True), (clash, True), (odd_docs(spark).limit(0), False)):
        docs = rows
        for name, stage in p.STAGES:
            before = docs.count()
            docs = written(stage(spark, docs, SF), name)
            if name != "packing":
                assert docs.columns == rows.columns
            if name == "language_id":
                assert docs.count() == (5 if counts else 0) and docs.filter("text is null or text = ''").count() == 0
            if name == "line_dedup":
                assert docs.count() == before  # nothing repeats across these documents
            if name == "near_dedup":
                assert docs.count() == (4 if counts else 0)  # one of the rows that repeat goes
            if name == "mixing":
                assert docs.count() <= 2 * before
            if name == "packing":
                assert docs.filter("start = 0").count() == before
