"""Pages and files of odd forms: what the queries over them give, against their SQL."""

import duckdb
import pytest


def _entry():
    import __spark_entry__

    return __spark_entry__


def _same(spark, name, sf):
    got = _entry().queries()[name](spark, str(sf))
    cols = got.columns
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{sf}/pages.parquet/*.parquet'")
    want = duck.execute(f"select {', '.join(cols)} from ({_entry().oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))
    return rows


@pytest.fixture
def sf(spark, tmp_path):
    long = "Một câu của trang này dài hơn ba mươi ký tự. " * 8
    rows = [
        (1, "https://a.vn/1", f"<html><body><article><h1>Thuế &amp; phí&amp</h1><p>{long}</p></article></body></html>"),
        (2, "https://a.vn/2", f"<html><body><div>{long}</div><article><h1>Ngắn</h1></article><footer>{long}"),
        (3, "https://a.vn/3", f"<html><body><article><p>{long}</p><p>cuối"),
        (4, "https://a.vn/4", "<html><body><p>Ngắn</p></body></html>"),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return tmp_path


def test_article_texts_of_cut_pages_and_bare_references(spark, sf):
    rows = {r[0]: r[1] for r in _same(spark, "html_article_text", sf)}
    assert rows[4] is None and all(rows[i] > 300 for i in (1, 2, 3))


@pytest.mark.parametrize("name", ["feed_files", "link_files"])
def test_files_in_a_folder_that_only_spark_opens(spark, tmp_path, monkeypatch, name):
    from lodestone.plans import envelope

    (tmp_path / "a b").mkdir()
    monkeypatch.setattr(envelope, "new_path", lambda spark, name: f"file://{tmp_path}/a b/{name}")
    titles = ["Thuế &amp; phí", "b", "c"]
    rows = [(i, f"https://a.vn/{i}", f"<html><title>{t}</title><a href=\"/x\">{t}</a>\n</HTML>") for i, t in enumerate(titles, 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(_same(spark, name, tmp_path)) == 3


def test_files_read_by_spark_are_rows_of_the_data_source(spark, tmp_path):
    from lodestone.sources import files

    files.register(spark)
    (tmp_path / "f").mkdir()
    item = "<rss><channel><title>n</title><item><title>t{0}</title><link>u</link></item></channel></rss>"
    (tmp_path / "f" / "a.xml").write_bytes((item.format(1) + "\n" + item.format(2).replace("</rss>", "</RSS>") + item.format(3) + "<rss>").encode())
    (tmp_path / "f" / "b.xml").write_bytes(b"\xff" + item.format(4).encode() + b"\n \n")
    for source in (files.FeedFiles, files.LinkFiles):
        want = spark.read.format(source.name()).load(str(tmp_path / "f"))
        got = files.read(spark, source, str(tmp_path / "f"))
        assert got.columns == want.columns
        bare = lambda df: sorted(tuple(str(v).rpartition("/")[2] for v in r) for r in df.collect())
        assert bare(got) == bare(want)


def test_texts_stay_where_they_are_for_few_hits(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import legal as L
    from lodestone.sources.shared import written

    # more candidates that don't hold the phrase than are read first
    n = L.FIRST * 3
    texts = ["THUẾ"] * n + ["thuế"] * 5
    chunks = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "chunks")
    asked = spark.createDataFrame([(1, "thuế"), (2, "Thuế")], "query_id long, phrase string")
    met = asked.crossJoin(chunks.select("doc_id")).withColumn("said", F.col("phrase"))
    found = L._first_holders(chunks, met, "said", ["text"], 2, True)
    assert sorted(tuple(r) for r in found.collect()) == [("thuế", n, 1), ("thuế", n + 1, 2)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = L.of(chunks, written(asked.select(F.col("query_id").alias("doc_id")), "hits"), "text")._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan
    asked = spark.createDataFrame([(1, "hiếm")], "query_id long, text string")
    from lodestone.operators import postings as P

    # documents of one name count as one, wherever they stand
    docs = spark.createDataFrame([(i % 300, "hiếm" if i in (5, 305) else f"từ{i}") for i in range(600)], "doc_id long, text string").repartition(8)
    assert [(r["doc_id"], r["rank"]) for r in P.bm25(P.build(docs, block=16), asked, 3).collect()] == [(5, 1)]
