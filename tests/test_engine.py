import pytest
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fusion_counts_repeats_and_orders_sources(spark):
    from lodestone.operators.rank import fuse

    exact = spark.createDataFrame([("q", 2, 1), ("q", 2, 2)], "query_id string, doc_id long, rank int")
    bm25 = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id long, rank int")
    out = {r["doc_id"]: r for r in fuse({"exact": exact, "bm25": bm25}, 5).collect()}
    assert out[2]["score"] == pytest.approx(1 / 61 + 1 / 62 + 1 / 62, abs=1e-8) and out[2]["sources"] == "exact+bm25"
    assert out[1]["score"] == pytest.approx(1 / 61, abs=1e-8) and out[1]["sources"] == "bm25"


def test_packing_stops_at_the_first_block_beyond_the_budget(spark):
    from lodestone.operators.rank import pack_context

    blocks = spark.createDataFrame([("q", i, "x" * n) for i, n in enumerate((10, 20, 5, 1), 1)], "query_id string, rank int, block string")
    assert rows(pack_context(blocks, 30), "n_blocks", "n_chars") == [(2, 30)]


def test_fixed_windows(spark):
    from lodestone.operators.segment import fixed_windows

    df = spark.createDataFrame([("abcdefghijk",), ("",), ("ab",)], "t string")
    assert [r["w"] for r in df.select(fixed_windows(F.col("t"), 5, 2).alias("w")).collect()] == [["abcde", "defgh", "ghijk"], [], ["ab"]]
    with pytest.raises(ValueError):
        fixed_windows(F.col("t"), 2, 2)


LAW = [
    ("law", 1, "Mở đầu\nChương I\nNHỮNG QUY ĐỊNH CHUNG\nĐ i ề u 5. Nội dung quản lý\n1. Cơ quan quản lý thực hiện đăng ký.\n2. Nội dung gồm :\na) khai báo;\nb) nộp tiền."),
    ("law", 2, "Chương II\nXỬ LÝ\nĐiều 16. Xử lý chậm nộp\nLời dẫn.\n1. Các trường hợp: a) nộp muộn;\nb) khai sai.\n2. Mức tính theo ngày.\n5. Trường hợp được miễn."),
    ("law", 3, "Điều 17. Gia hạn 1. Được gia hạn.\nđ) điểm riêng.\nPHỤ LỤC 1\nDanh mục\nMẫu số 01\nĐơn"), ("note", 1, "Điều 1. Phạm vi\nCó hiệu lực ngay."), ("blank", 1, " "),
]


def test_segmentation_of_a_small_law(spark):
    from lodestone.operators import segment as S

    pages = spark.createDataFrame(LAW, "doc string, page int, text string")
    found = {(r["doc"], r["dieu"]): r for r in S.articles(pages).collect()}
    assert set(found) == {("law", 5), ("law", 16), ("law", 17), ("note", 1)}
    assert [(found["law", n]["chapter"], found["law", n]["first_page"]) for n in (5, 16, 17)] == [("Chương I - NHỮNG QUY ĐỊNH CHUNG", 1), ("Chương II - XỬ LÝ", 2), ("Chương II - XỬ LÝ", 3)]
    assert found["law", 17]["text"].endswith("điểm riêng.") and "PHỤ LỤC" in {r["dieu"]: r["text"] for r in S.articles(pages, with_appendix=True).collect()}[17]
    assert rows(S.appendices(pages), "doc", "idx", "title", "text") == [("law", 1, "PHỤ LỤC 1", "PHỤ LỤC 1\nDanh mục"), ("law", 2, "Mẫu số 01", "Mẫu số 01\nĐơn")]
    chunks = {(r["doc"], r["dieu"], r["khoan"], r["diem"]): r for r in S.refined(pages, name=F.lit("Luật A")).collect()}
    assert set(chunks) == {("law", 5, None, None), ("law", 5, 1, None), ("law", 5, 2, None), ("law", 5, 2, "a"), ("law", 5, 2, "b"), ("law", 16, None, None), ("law", 16, 1, None), ("law", 16, 1, "a"), ("law", 16, 1, "b"), ("law", 16, 2, None), ("law", 16, 5, None), ("law", 17, None, None), ("law", 17, 1, None), ("law", 17, 1, "đ"), ("note", 1, None, None)}
    one = chunks["law", 16, 1, None]
    assert one["text"].endswith("Điều 16. Xử lý chậm nộp\n\nKhoản 1. Lời dẫn.\nCác trường hợp:") and one["level"] == 2 and one["unit"] == "khoản_1_mở_đầu"
    a = chunks["law", 16, 1, "a"]
    assert a["text"].startswith("Văn bản: Luật A\nĐiều 16. Xử lý chậm nộp\nKhoản 1\nĐiểm a\nĐơn vị nội dung: khoản_1_điểm_a\n\n") and a["text"].endswith("Khoản 1.\nĐiểm\na) nộp muộn;") and a["level"] == 3 and a["n_parts"] == 6
    assert a["chunk_id"] == "law_dieu16_khoan1_diema_khoản_1_điểm_a_chunk3"
    assert "Điều 17. Gia hạn\n\nKhoản 1. Được gia hạn." in chunks["law", 17, 1, None]["text"]


def test_refined_options_and_cuts(spark):
    from lodestone.operators import segment as S

    long = "Điều 1. Dài\n1. " + " ".join(f"từ{i}" for i in range(300)) + "\na) điểm"
    pages = spark.createDataFrame([("d", 1, long), ("e", 1, long)], "doc string, page int, text string")
    cut = S.refined(pages, most=500, overlap=50, name=F.lit("x")).collect()
    assert all(len(r["text"].split("\n\n", 1)[1]) <= 500 for r in cut) and {r["unit"] for r in cut if r["level"] == 1} >= {"toàn_bộ_điều_cửa_sổ_1", "toàn_bộ_điều_cửa_sổ_2"}
    assert {r["doc"] for r in cut} == {"d"}  # equal contents once
    assert S.refined(pages, once=False).filter("doc = 'e'").count() > 0 and S.refined(pages, split_points=False).filter("level = 3").count() == 0
    assert S.refined(pages, whole=False).filter("level = 1").count() == 0 and S.refined(pages, enriched=False).filter("text like 'Văn bản%'").count() == 0
    assert S.refined(pages.limit(0)).count() == 0


def test_text_functions(spark):
    from lodestone.functions import text as T
    from lodestone.functions.web import feed_text

    one = lambda f, x: spark.createDataFrame([(x,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(T.slug, " a_ b--C ") == "a_b_c" and one(T.content_hash, " Ab  c\n") == one(T.content_hash, "ab c")
    assert one(T.clean_page, "a \n, b\r\n\n\n\nĐ i ề u 3 .") == "a, b\n\nĐiều 3."
    assert one(T.normal_legal, "Điều\n5. x a) y b-\nc a.1) z\na) w") == "Điều 5. x\na) y b-c\na.1) z\na) w"
    assert one(feed_text, "Tin &lt;p&gt;x&lt;/p&gt; A &amp;amp; B") == "Tin x A &amp; B"
    assert one(lambda c: T.first_date(F.array(c, F.lit("7-8-2025"))), "31/2/2025") == "2025-08-07T00:00:00"


def test_recursive_cuts():
    from lodestone.operators.segment import recursive_cuts

    assert recursive_cuts("aaaaaa bbbbbb cccccc", 10, 3) == ["aaaaaa", "aaabbbbbb", "bbbcccccc"]
    text = "\n\n".join(". ".join(f"câu số {i} của đoạn {j}" for i in range(40)) for j in range(5))
    pieces = recursive_cuts(text, 300, 0)
    assert "".join("".join(p.split()) for p in pieces).replace(".", "") == "".join(text.split()).replace(".", "") and max(map(len, pieces)) <= 300
    assert all(len(p) <= 360 for p in recursive_cuts(text, 300, 60)) and recursive_cuts("x" * 25, 10, 4) == ["x" * 10, "x" * 10, "x" * 10, "x" * 7]
    assert recursive_cuts("  ", 10, 2) == [] and recursive_cuts(" a ", 10, 2) == ["a"]
    with pytest.raises(ValueError):
        recursive_cuts("x", 5, 5)


def test_smart_cuts_cover_the_text():
    from lodestone.operators.segment import smart_cuts

    text = ". ".join(f"sentence number {i} of the text" for i in range(400))
    pieces = smart_cuts(text, 500, 50)
    assert all(len(p) <= 500 for p in pieces) and text.startswith(pieces[0]) and text.endswith(pieces[-1]) and all(p in text for p in pieces) and smart_cuts("") == [""]


def test_store(spark, tmp_path):
    from lodestone.operators.store import ChunkStore, base_filters, normalised

    store = ChunkStore(spark, str(tmp_path / "a"))
    df = spark.createDataFrame([(str(i), f"text {i}", "x" if i % 2 else "y", [float(i), 1.0], None, ["t"]) for i in range(10)], "id string, text string, ma_van_ban string, embedding array<double>, note string, tags array<string>").coalesce(1)
    store.append(df.filter("id < '5'"))
    store.append(df.filter("id >= '5'"))
    store.append(df.limit(0))
    assert store.count() == 10 and [r["id"] for r in store.page(None, 20).collect()] == [str(i) for i in range(10)]
    assert store.scan({"ma_van_ban": "x"}).count() == 5 and [r["id"] for r in store.page({"ma_van_ban": "y"}, 2, 1).collect()] == ["2", "4"]
    assert store.scan({"$or": [{"id": {"$in": ["1", "2"]}}, {"$and": [{"id": {"$gt": "7"}}, {"ma_van_ban": {"$ne": "x"}}]}]}).count() == 3
    assert base_filters({"ma_van_ban": "x", "chu_de": "all", "other": 1, "loai_van_ban": None}) == {"ma_van_ban": "x"}
    first = store.scan().filter("id = '1'").first()
    assert (first["note"], first["tags"]) == ("", '["t"]') and store.containing("text 3").count() == 1
    queries = spark.createDataFrame([(7, [3.2, 1.0])], "query_id long, q array<double>")
    near = store.nearest(queries, 2, {"ma_van_ban": "y"}).join(store.scan().select("ord", "id"), "ord").orderBy("rank").collect()
    assert [r["id"] for r in near] == ["4", "2"] and near[0]["score"] == pytest.approx(1 - 0.64)
    shown = store.results(queries, 2, {"ma_van_ban": "y"}).collect()
    assert [(r["rank"], r["id"], r["text"], r["ma_van_ban"]) for r in shown] == [(1, "4", "text 4", "y"), (2, "2", "text 2", "y")] and "embedding" not in shown[0]
    from lodestone.operators.vectors import search

    wanted = queries.withColumn("want_ma_van_ban", F.lit("y"))
    assert [r["distance"] for r in search(store.indexed(), wanted, 2).orderBy("rank").collect()] == [r["distance"] for r in shown]
    assert store.delete(df.filter("id < '4'").select("id"), str(tmp_path / "b")).count() == 6
    assert "id" not in df.drop("id").columns and normalised(df.drop("id")).columns == df.drop("id").columns
    store.reset()
    assert store.count() == 0


def test_news_links(spark):
    from lodestone.functions.web import absolute, news_link

    df = spark.createDataFrame([("Doanh thu của hộ kinh doanh năm nay", "/x?urile=wcm:1"), ("Thuế", "/x?urile=wcm:1"), ("Chính sách thuế cho hộ kinh doanh", "/x?urile=wcm:2"), ("Doanh thu của hộ kinh doanh năm nay", "/x")], "title string, url string")
    assert [r["ok"] for r in df.select(news_link(F.col("title"), F.col("url")).alias("ok")).collect()] == [True, False, False, False]
    from urllib.parse import urljoin

    bases, hrefs = ["https://a.vn/b/c", "https://a.vn/b/c/d.html?q=1#p", "https://a.vn", "https://a.vn/"], ["/x?y", "x", "./x", "../x", "../../../x/y", "?k=1", "#f", "//h.vn/z", "http://w.vn/", "mailto:a@b", "x/../y", ""]
    pairs = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    got = {(r["b"], r["h"]): r["u"] for r in pairs.select("b", "h", absolute(F.col("b"), F.col("h")).alias("u")).collect()}
    assert got == {(b, h): urljoin(b, h) if h else "" for b in bases for h in hrefs}


def test_articles_are_read_and_fetched(spark):
    from lodestone.sources.articles import fetched, parsed

    long = "Một câu dài của bài báo. " * 20
    page = f"<html><body><div class='content'><p>ngắn</p></div><div class='a news-detail'><script>x</script><h1>Tin</h1><p>{long}</p><br></div><span class=date>đăng 05/03/2026 10:00</span><time datetime='2-1-2026'>x</time></body></html>"
    content, dates = parsed(page)
    assert content == f"Tin\n{long.strip()}" and dates[:2] == ["2-1-2026", "đăng 05/03/2026 10:00"]
    assert parsed(f"<body><p>{long}</p><p>ngắn</p></body>")[0] == long.strip() and parsed("<body>x</body>")[0] is None and parsed("")[0] is None

    def read(url):
        if url == "bad":
            raise OSError("no answer")
        return page

    items = spark.createDataFrame([(1, "good", None), (2, "bad", None), (3, None, None), (4, "good", "2020-01-01")], "id int, url string, published_at string")
    got = {r["id"]: r for r in fetched(items, read).collect()}
    assert [got[i]["crawl_error"] for i in (1, 2, 3)] == [None, "no answer", "Missing URL"] and got[2]["content"] is None and got[1]["content"] == content
    assert got[1]["published_at"] == "2026-01-02T00:00:00" and got[4]["published_at"] == "2020-01-01" and got[3]["article_crawled_at"].endswith("+00:00")


def test_models_keep_rows_in_place(spark):
    from lodestone.operators import models as M

    df = spark.createDataFrame([(1, "a b", "b c"), (2, " ", "x"), (3, None, None), (4, "a b", "a b")], "id int, question string, text string")
    got = {r["id"]: r for r in M.scored(M.embedded(df, M.hashed_embedding(8), "question", batch=2), M.shared_words()).collect()}
    assert got[1]["embedding"] == got[4]["embedding"] and got[2]["embedding"] is None and got[3]["score"] is None and (got[1]["score"], got[4]["score"]) == (0.5, 1.0)
    assert M.answered(df.withColumn("prompt", F.lit("x\ny")), M.first_line(), tasks=2).filter("answer = 'x'").count() == 4


def test_settings_and_registered_functions(spark):
    from lodestone.config import Settings, settings
    from lodestone.functions.registered import register
    from lodestone.functions.text import references
    from lodestone.operators.segment import recursive_cuts

    spark.conf.set("lodestone.top_k", "7")
    assert settings(spark, {"LODESTONE_TOP_K": "9", "LODESTONE_ENABLE_RERANKER": "True", "LODESTONE_NEWS_MIN_SCORE": "3.5"}) == Settings(top_k=7, enable_reranker=True, news_min_score=3.5)
    spark.conf.unset("lodestone.top_k")
    names = register(spark)
    got = spark.sql("select lodestone_tokens('Điều 5, x_y'), lodestone_slug(' A b '), lodestone_content_hash(' A  b'), lodestone_windows('abcdefghijk', 5, 2), lodestone_paragraphs('a  b\\n\\n c'), lodestone_recursive_cuts('aaaa bbbb')").first()
    assert spark.sql("select lodestone_references('theo Nghị định số 70/2025/NĐ-CP và nghị định số 70/2025/NĐ-CP') as r").first()["r"] == spark.range(1).select(references(F.lit("theo Nghị định số 70/2025/NĐ-CP và nghị định số 70/2025/NĐ-CP")).alias("r")).first()["r"] != []
    assert len(names) == 9 and got[0] == ["điều", "5", "x_y"] and got[1] == "a_b" and got[3] == ["abcde", "defgh", "ghijk"] and got[4] == ["a b", "c"] and list(got[5]) == recursive_cuts("aaaa bbbb")


def test_stream_loses_no_late_key_and_repeats_none(spark, tmp_path):
    from lodestone.streaming.feed import first_of_each

    for i, rows_ in enumerate(([(1, "2026-05-01"), (2, "2026-05-01")], [(3, "2026-09-01"), (1, "2026-09-02"), (None, "2026-09-02")], [(4, "2020-01-01"), (2, "2020-01-01"), (None, "2020-01-01")])):
        spark.createDataFrame(rows_, "k long, ts string").coalesce(1).write.parquet(str(tmp_path / f"in/f{i}"))
    at = str(tmp_path / "state")
    read = lambda: sorted(str(r["k"]) for r in first_of_each(spark, str(tmp_path / "in/*"), "k long, ts string", ["k"], files=1, at=at).collect())
    assert read() == ["1", "2", "3", "4", "None"]
    spark.createDataFrame([(5, "x"), (1, "x")], "k long, ts string").coalesce(1).write.parquet(str(tmp_path / "in/f9"))
    assert read() == ["1", "2", "3", "4", "5", "None"]


def flow(spark, chunks, asked):
    c = spark.createDataFrame(chunks, "doc_id long, ma_van_ban string, dieu int, khoan int, diem string, level int, loai_van_ban string, chu_de string, text string")
    c = c.withColumns({"chunk_id": F.col("doc_id").cast("string"), "ten_van_ban": F.col("ma_van_ban"), "tieu_de_dieu": F.concat(F.lit("Điều "), F.col("dieu").cast("string"))})
    from lodestone.operators.legal import wanted
    from lodestone.operators.questions import analyzed

    q = spark.createDataFrame(asked, "query_id long, question string")
    return c, wanted(analyzed(q).join(q, "query_id"))


def test_structured_and_exact_lists(spark):
    from lodestone.operators import legal as L

    c, q = flow(spark, [(1, "A", 5, None, None, 1, "luật", None, "Điều 5 mở"), (2, "A", 5, 2, None, 2, "luật", None, "Khoản 2 khác"), (3, "A", 5, 2, "a", 3, "luật", None, "Điểm a) Điều 51"), (4, "B", 6, 2, None, 2, "nghị_định", "hộ_kinh_doanh", "hộ kinh doanh, nộp thuế")], [(1, "Điểm a khoản 2 điều 5"), (2, "luật về hộ kinh doanh"), (3, "hộ kinh doanh")])
    assert rows(L.structured(c, q).filter("query_id = 1"), "rank", "doc_id") == [(1, 1), (2, 2), (3, 3), (4, 2), (5, 3), (6, 3)]
    assert rows(L.structured(c, q).filter("query_id > 1"), "query_id", "doc_id") == [(2, 1), (2, 2), (2, 3), (3, 4)]  # the type filters, and the topic within it
    assert rows(L.exact(c, q).filter("query_id = 1"), "rank", "doc_id") == [(1, 1), (2, 3), (3, 2), (4, 3)]  # "Điều 5" stands in "Điều 51"
    assert rows(L.exact(c, q).filter("query_id = 2"), "doc_id") == [] and rows(L.exact(c, q).filter("query_id = 3"), "doc_id") == [(4,)]


def test_boosts_by_hand(spark):
    from lodestone.operators import legal as L

    chunks = [
        (1, "141_2026_ND_CP", 4, 1, None, 2, "nghị_định", None, "Sửa đổi: ngưỡng 01 tỷ đồng"), (2, "68_2026_ND_CP", 4, 1, None, 2, "nghị_định", None, "doanh thu 1.000.000.000 đồng"),
        (3, "X", 16, 5, "a", 3, "luật", None, "Miễn tiền chậm nộp"), (4, "X", 16, None, None, 1, "luật", None, "khác"), (5, "X", 21, 5, "A", 3, "luật", None, "khác"),
    ]
    c, q = flow(spark, chunks, [(1, "doanh thu dưới 1 tỷ"), (2, "điểm a khoản 5 điều 16 về miễn tiền chậm nộp")])
    met = c.crossJoin(L.boost(q).drop("q_ma").select("query_id", "q_dieu", "q_khoan", "q_diem", "q_loai", "q_chu_de", "q_topic", "q_amend", "q_mien", "phrases")).withColumns({"t": F.lower("text"), "ti": F.lower("tieu_de_dieu")})
    got = {(r["query_id"], r["doc_id"]): r["b"] for r in met.select("query_id", "doc_id", F.round(L.boosted(met), 4).alias("b")).collect()}
    # threshold topic 2.0 + 0.5 + 0.5; amendment 0.6 + 0.3 + 0.3 + 0.2 + 2.0 + 0.5
    assert got[1, 1] == pytest.approx(3.0 + 3.9) and got[1, 2] == pytest.approx(0.7) and got[1, 4] == 0
    # article 0.35, clause 0.25, point 0.1, phrase 0.08, late payment 0.25 + 0.3 + 0.4
    assert got[2, 3] == pytest.approx(1.73) and got[2, 4] == pytest.approx(0.35 + 0.04 + 0.3) and got[2, 5] == pytest.approx(-0.08 + 0.25 + 0.1 - 0.2) and got[2, 1] == pytest.approx(-0.08)


def test_hits_get_siblings_versions_and_places(spark):
    from lodestone.operators import legal as L

    chunks = [(i, "A", 5, k, d, 1 if k is None else 3 if d else 2, "luật", None, "x") for i, (k, d) in enumerate([(None, None), (1, None), (2, None), (2, "a"), (2, "đ"), (3, None), (5, None)])]
    chunks += [(20, "141_2026_ND_CP", 4, None, None, 1, "nghị_định", None, "x"), (21, "68_2026_ND_CP", 4, None, None, 1, "nghị_định", None, "x"), (22, "B", 16, 5, None, 2, "luật", None, "x"), (23, "B", 16, 1, None, 2, "luật", None, "x")]
    c, q = flow(spark, chunks, [(1, "khoản 2 điều 5"), (2, "điều 5"), (3, "ngưỡng doanh thu"), (4, "miễn tiền chậm nộp"), (5, "xin chào")])
    hits = spark.createDataFrame([(1, 2, 2.0, "exact", 1), (1, 20, 1.0, "bm25", 2), (2, 0, 1.0, "bm25", 1), (3, 21, 2.0, "bm25", 1), (3, 20, 1.0, "bm25", 2), (4, 23, 2.0, "bm25", 1), (4, 22, 1.0, "bm25", 2), (4, 20, 3.0, "bm25", 3), (5, 1, 1.0, "bm25", 1), (5, 20, 0.5, "bm25", 2)], "query_id long, doc_id long, score double, sources string, rank int")
    got = L.attached(hits, c, q)
    assert rows(got.filter("query_id = 1 and added"), "rank", "doc_id") == [(3, 1), (4, 5)] and rows(got.filter("query_id = 2 and added"), "rank", "doc_id") == [(i + 1, i) for i in range(1, 7)]
    assert rows(got.filter("query_id = 5 and added"), "rank", "doc_id") == [(3, 2), (4, 3), (5, 4)]
    more = rows(L.expanded(got, c, q).filter("query_id = 1"), "rank", "doc_id", "sources")
    assert more == [(1, 2, "exact"), (2, 20, "bm25"), (3, 3, "sibling_expand"), (4, 4, "sibling_expand"), (5, 1, "sibling"), (6, 5, "sibling")]
    final = L.finished(hits, c, q, 2)
    assert rows(final, "query_id", "rank", "doc_id") == [(1, 1, 2), (1, 2, 3), (1, 3, 4), (2, 1, 0), (2, 2, 1), (2, 3, 2), (2, 4, 3), (2, 5, 4), (2, 6, 5), (2, 7, 6), (3, 1, 20), (4, 1, 22), (4, 2, 23), (5, 1, 1), (5, 2, 20)]
    from lodestone.operators.models import word_reranker

    greeted = c.withColumn("text", F.when(F.col("doc_id") == 20, "xin chào").otherwise("x"))
    again = L.reranked(hits.withColumn("added", F.lit(False)), greeted, q, word_reranker(), 1)
    assert rows(again.filter("query_id in (3, 5)"), "query_id", "doc_id", "sources") == [(3, 21, "bm25"), (5, 20, "bm25+reranker")]
    # the chunk that answers is the last of the hits and siblings, beyond the limit
    last = c.withColumn("text", F.when(F.col("doc_id") == 4, "xin chào").otherwise("x"))
    assert rows(L.expanded(L.attached(hits, c, q), c, q).filter("query_id = 5"), "rank", "doc_id")[-2:] == [(4, 3), (5, 4)]
    assert 4 not in {r["doc_id"] for r in L.finished(hits, last, q, 2).filter("query_id = 5").collect()}
    assert rows(L.finished(hits, last, q, 2, word_reranker(), 1).filter("query_id = 5"), "rank", "doc_id", "sources") == [(1, 4, "sibling+reranker")]


def test_reranking_results_meet_their_rows(spark):
    from lodestone.operators.models import reranked

    rows_ = [(1, "q", "1", "a", "x", 1), (1, "q", "2", "b", "y", 2), (1, "q", "3", "b", "z", 3), (2, " ", "4", "c", "x", 1), (3, "q3", None, None, None, 1)]
    df = spark.createDataFrame(rows_, "query_id long, question string, id string, chunk_id string, body string, rank int").withColumn("score", F.lit(0.0))

    def order(question, chunks):
        if question == "q3":
            return []
        assert [c["text"] for c in chunks] == ["x", "y", "z"]
        # by id, by chunk_id alone (the last that has it), one that there is not, one named twice
        return [{"id": "2", "score": 0.9}, {"chunk_id": "b", "score": 0.8}, {"id": "9", "score": 0.7}, {"id": "9", "chunk_id": "a", "score": None}, {"id": "2", "score": 0.1}]

    got = reranked(df, lambda: order, text="body").orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["id"], r["score"]) for r in got] == [(1, 1, "2", 0.1), (1, 2, "3", 0.8), (1, 3, "1", 0.0), (1, 4, "2", 0.1)]


def test_no_number_mark_or_empty_point_stops_or_alters_a_batch(spark):
    from lodestone.operators import segment as S
    from lodestone.operators.questions import analyzed

    long = "9" * 40
    q = spark.createDataFrame([(1, f"điều {long} khoản 00003 là gì"), (2, f"khoản {long}, điều 7"), (3, None), (4, "\x00\x01"), (5, "")], "query_id long, question string")
    assert rows(analyzed(q).filter("query_id <= 2"), "query_id", "dieu", "khoan") == [(1, None, 3), (2, 7, None)] and analyzed(q).count() == 5
    text = f"Điều {long}. Dài\n1. abc\x01def ghi\n{long}. xyz\n003. tiếp\na)\nb) khai\nĐiều 2. Hai\n1. Các mục:\na)\nb) x\x01y\n2. Hết\na)"
    pages = spark.createDataFrame([("d", 1, text), ("m", 1, "\x01\x01"), ("p", 1, "...;;;"), ("n", 1, None)], "doc string, page int, text string")
    found = {r["dieu"]: r for r in S.articles(pages).collect()}
    assert set(found) == {None, 2} and found[None]["title"] == f"Điều {long}. Dài" and "abc\x01def ghi" in found[None]["text"]
    parts = S.points(S.clauses(S.articles(pages))).collect()
    assert sorted((r["dieu"] or 0, r["no"], r["khoan"] or 0, r["diem"] or "", r["said"]) for r in parts) == [
        (0, "1", 1, "", "abc\x01def ghi"), (0, "3", 3, "", "tiếp"), (0, "3", 3, "a", "a)"), (0, "3", 3, "b", "khai"), (0, long, 0, "", "xyz"),
        (2, "1", 1, "", "Các mục:"), (2, "1", 1, "a", "a)"), (2, "1", 1, "b", "x\x01y"), (2, "2", 2, "", "Hết\na)"),
    ]
    units = {r["unit"] for r in S.refined(pages).collect()}
    assert f"khoản_{long}" in units and "khoản_3_điểm_a" in units


def test_clauses_of_long_articles_only_and_names_of_windows(spark):
    from lodestone.operators import segment as S

    pages = spark.createDataFrame([("d", 1, "Điều 1. Ngắn\n1. a\n2. b\nĐiều 2. Dài\n1. " + "từ " * 200)], "doc string, page int, text string")
    got = S.refined(pages, most=300, always=False).collect()
    assert {(r["dieu"], r["khoan"]) for r in got} == {(1, None), (2, None), (2, 1)}
    bare = spark.createDataFrame([("d", 1, "Điều 3. Không khoản\n" + "từ " * 300)], "doc string, page int, text string")
    assert {r["unit"].rstrip("0123456789") for r in S.refined(bare, most=300, whole=False).collect()} == {"cửa_sổ_điều_"}


def words_of(rng, n, size):
    return " ".join(rng.choice([f"từ{rng.randrange(size)}", "thuế", "Điều 5", "x_y"]) for _ in range(n))


def test_postings_give_the_ranks_of_a_scan(spark):
    import random

    from lodestone.operators import postings as P
    from lodestone.operators.rank import bm25

    rng = random.Random(3)
    docs = spark.createDataFrame([(i, words_of(rng, rng.randrange(60), 300)) for i in range(400)] + [(900, ""), (901, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, words_of(rng, 4, 300)) for i in range(20)] + [(30, "không có"), (31, ""), (32, "thuế thuế thuế")], "query_id long, text string")
    index = P.build(docs, block=8)
    want = rows(bm25(docs.fillna(""), asked, 5), "query_id", "rank", "doc_id", "score")
    for first in (1, 4, 100):
        assert rows(P.bm25(index, asked, 5, first), "query_id", "rank", "doc_id", "score") == want
    assert P.build(docs.limit(0)).n == 0 and P.bm25(P.build(docs.limit(0)), asked, 5).count() == 0


def test_blocks_that_cannot_matter_are_not_read(spark):
    from lodestone.operators import postings as P

    # one word in all documents, one in few: once these are read, no other block reaches them
    docs = spark.createDataFrame([(i, "thuế " * 3 + ("hiếm " * 4 if i < 6 else f"từ{i}")) for i in range(500)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "thuế hiếm")], "query_id long, text string")
    index = P.build(docs, block=10)
    held, read = P.blocks_read(index, asked, 3)
    assert held > 40 and read < held / 2
    assert rows(P.bm25(index, asked, 3), "rank", "doc_id") == [(1, 0), (2, 1), (3, 2)]


def test_substrings_are_found_as_by_scanning(spark):
    import random

    from lodestone.operators import grams as G
    from lodestone.operators import legal as L

    rng = random.Random(5)
    texts = [words_of(rng, rng.randrange(30), 50) for _ in range(120)] + ["", None, "ΟΔΟΣΑ 𝒳y", "a", "Ab\n c", "x" * 5000]
    chunks = spark.createDataFrame([(i, t, None if i % 3 else f"Điều {i}") for i, t in enumerate(texts)], "doc_id long, text string, tieu_de_dieu string")
    phrases = ["từ1", "THUẾ ĐIỀU", "u", "ΟΔΟΣ", "𝒳Y", "b\n ", "zzzz", "", None, "điều 3", "xxxx"]
    asked = spark.createDataFrame(list(enumerate(phrases)), "query_id long, phrase string")
    index = G.build(chunks, ["text", "tieu_de_dieu"])
    got = rows(L.contains_lookup(chunks, asked, 1000, index), "query_id", "doc_id")
    # Spark's own lower() decides, as both sides of a scan would use it
    scan = chunks.join(asked.filter("phrase <> ''"), F.contains(F.lower("text"), F.lower("phrase")) | F.contains(F.lower("tieu_de_dieu"), F.lower("phrase")))
    assert got == rows(scan, "query_id", "doc_id") and len({g[0] for g in got}) >= 7
    plan = L.contains_lookup(chunks, asked, 20, index)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert L._holders(chunks, spark.createDataFrame([("ΟΔΟΣ",)], "phrase string"), ["text"], index, True).count() == 1
    assert G.candidates(G.build(chunks.limit(0), ["text"]), asked).count() == 0


def test_vector_index_is_exact_and_respects_filters(spark):
    import numpy as np

    from lodestone.operators import rank as R
    from lodestone.operators import vectors as V

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 6
    x = np.concatenate([centres[i % 20] + rng.normal(size=8) for i in range(1000)]).reshape(-1, 8).round(3)
    data = [(i, [float(c) for c in v], "rare" if i % 97 == 0 else "often") for i, v in enumerate(x)] + [(2000, None, "often"), (2001, [float("nan")] * 8, "often"), (2002, [1.0], "often"), (None, [0.0] * 8, "often"), (2003, [], None)]
    every = spark.createDataFrame(data, "vec_id long, v array<double>, kind string")
    good = every.filter("vec_id < 1000")
    index = V.build(every)
    assert index.n == 1000
    asked = good.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.when(F.col("vec_id") % 80 == 0, F.lit("rare")).alias("want_kind"))
    for q in (asked.drop("want_kind"), asked):
        want = rows(R.near(good, q, 10), "query_id", "rank", "vec_id", "distance")
        assert rows(V.search(index, q, 10, probes=2), "query_id", "rank", "vec_id", "distance") == want
        near = {r[:1] + r[2:3] for r in rows(V.search(index, q, 10, probes=4, exact=False), "query_id", "rank", "vec_id")}
        assert len(near & {r[:1] + r[2:3] for r in want}) >= 0.95 * len(want)
        assert {r[:2] for r in rows(V.search(index, q, 10, probes=1, exact=False), "query_id", "rank")} == {r[:2] for r in want}  # few pass the filter, yet all ranks are filled
    assert V.share(index, asked, 4) < 0.5
    assert V.search(V.build(every.limit(0)), asked, 3).count() == 0


def test_news_search_chunks_and_contexts(spark):
    from lodestone.operators import news as N

    paragraphs = ["Tiêu đề", "a" * 1000, "b" * 700, "c" * 1500, "d" * 2000]
    df = spark.createDataFrame([("Tiêu đề", "\r\n".join(paragraphs)), ("", "x\n\ny"), ("T", "")], "t string, c string")
    got = [r["x"] for r in df.select(N.chunks(F.col("t"), F.col("c")).alias("x")).collect()]
    a, b, c, d = ("Tiêu đề\n" + x for x in ("a" * 1000 + "\n" + "b" * 700, "b" * 700 + "\n" + "c" * 1500, "c" * 1500 + "\n" + "d" * 2000, ""))
    assert got == [[a, b, c], ["x\ny"], []]
    body = ["Mở đầu của tin về cánhân kinh doanh " + "x" * 200, "T", "dòng 3", "dòng 4", "dòng 5", "T", "sau"]
    cleaned = spark.createDataFrame([("T", "\n".join(body)), ("T", "ngắn"), (None, None)], "t string, c string").select(N.cleaned(F.col("t"), F.col("c")).alias("x")).collect()
    assert cleaned[0]["x"] == "Mở đầu của tin về cá nhân kinh doanh " + "x" * 200 + "\nT\ndòng 3\ndòng 4\ndòng 5" and cleaned[1]["x"] is None and cleaned[2]["x"] is None
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "vec_id long, v array<double>")
    news = spark.createDataFrame([(0, "hóa đơn điện tử", "u1", "h", "e_invoice", 10.0, "máy tính tiền"), (1, "khác", "u1", "h", "e_invoice", 0.0, "hóa đơn điện tử"), (2, "", "", "", "e_invoice", 99.0, "x"), (3, "khác", "", "h3", "penalty", 0.0, "x")], "news_id long, title string, url string, hash string, topic string, relevance double, text string")
    asked = spark.createDataFrame([(1, "hóa đơn điện tử", [0.0, 0.0])], "query_id long, question string, q array<double>")
    hits = N.search(vectors, asked, news, least=0.0)
    # title 4, topic words: in the query 2.5, title 2, text 1; intent 3; relevance 1.5
    assert [(r["news_id"], r["final_score"]) for r in hits.collect()] == [(0, 14.0)]
    full = news.withColumns({"source": F.lit(None).cast("string"), "at": F.lit("2026-03-05"), "references": F.array(F.lit("r1"), F.lit("r2"))})
    out = N.prepared(hits, full, asked.unionByName(asked.withColumn("query_id", F.lit(2)))).orderBy("query_id").collect()
    assert out[0]["context"] == "[Nguồn 1]\nTiêu đề: hóa đơn điện tử\nNguồn: Không xác định\nNgày đăng: 05/03/2026\nChủ đề: e_invoice\nVăn bản được nhắc đến: r1; r2\nURL: u1\nNội dung:\nmáy tính tiền\n" and out[0]["sources"][0]["citation"] == "Nguồn 1" and out[1]["context"] == ""


def test_published_evaluation(spark):
    """The labelled items with answers of which one misses its keyword: five of six are perfect."""
    from lodestone.functions import rules as V
    from lodestone.operators import questions as Q
    from lodestone.plans.rules import _items

    said = {b[0]: " ".join(b[3]) for b in V.BENCHMARK} | {"NR198_002": "không áp dụng phương pháp khoán"}
    answers = spark.createDataFrame([(k, v, "198-2025-QH15", 10, "6") for k, v in said.items()], "id string, answer string, top_document string, top_dieu int, top_khoan string")
    aliases = spark.createDataFrame([(k, a) for k, v in V.DOCUMENT_ALIASES.items() for a in v], "name string, alias string")
    flags = Q.evaluated(_items(spark, "/root/testdata/sf0.001").filter("id like '%_00_'"), answers, aliases)
    got = {r["metric"]: (r["n_true"], r["n_items"]) for r in Q.summary(flags).collect()}
    assert got == {m: (6, 6) for m in Q.FLAGS} | {"keyword_match": (5, 6), "perfect": (5, 6)}
    assert rows(Q.by_category(flags), "category", "n_perfect", "n_items") == [("cross_document", 3, 3), ("resolution", 2, 3)]
    assert [r["line"] for r in Q.report(flags).filter("section = 'breakdown'").collect()] == ["keyword_match: 1"]


def test_bm25_pushes_nothing_but_needed_columns(spark):
    from lodestone.plans.retrieval import bm25_topk

    plan = bm25_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_the_entry_imports_without_a_session():
    import subprocess
    import sys

    from conftest import ROOT

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"], cwd=ROOT, check=True)


def test_chunk_rows_fall_back(spark):
    from lodestone.operators.store import chunk_rows

    df = spark.createDataFrame([("", None, "c1", "nội dung", "A", 5), ("7", "văn bản", "c2", "x", "A", 5), (None, "", "", None, None, None)], "id string, text string, chunk_id string, content string, ma_van_ban string, dieu int")
    assert [(r["id"], r["text"]) for r in chunk_rows(df).collect()] == [("c1", "nội dung"), ("7", "văn bản"), ("_", "")]
    assert [(r["id"], r["text"]) for r in chunk_rows(df.select("ma_van_ban", "dieu").limit(1)).collect()] == [("A_5", "")]


def law_engine(spark, **limits):
    from lodestone.config import Settings
    from lodestone.engine import Engine

    said = {1: "hóa đơn điện tử của hộ kinh doanh", 2: "nộp thuế theo quý", 3: "chậm nộp tiền thuế", 4: "xin chào"}
    rows_ = [(i, f"c{i}", "108_2025_QH15" if i % 2 else "68_2026_ND_CP", "Luật" if i % 2 else "Nghị định", "luật" if i % 2 else "nghị_định", 5 + i % 3, None, None, 1, f"Điều {5 + i % 3}. Tiêu đề", said.get(i, f"văn bản số {i}"), "còn_hiệu_lực" if i < 20 else "hết_hiệu_lực") for i in range(1, 41)]
    chunks = spark.createDataFrame(rows_, "doc_id long, chunk_id string, ma_van_ban string, ten_van_ban string, loai_van_ban string, dieu int, khoan int, diem string, level int, tieu_de_dieu string, text string, trang_thai_hieu_luc string").withColumn("chu_de", F.lit(None).cast("string"))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 41)], "vec_id long, v array<double>")
    return Engine(spark, chunks, vectors, Settings(**limits))


def test_retrieve_and_ask_as_calls(spark):
    engine = law_engine(spark, top_k=3)
    asked = spark.createDataFrame([(1, "hóa đơn điện tử"), (2, "văn bản số 30"), (3, "  ")], "query_id long, question string")
    vectors = spark.createDataFrame([(1, [1.0, 1.0]), (2, [30.0, 1.0])], "query_id long, q array<double>")
    hits = engine.retrieve(asked, queries=vectors)
    first = {r["query_id"]: r["doc_id"] for r in hits.filter("rank = 1").collect()}
    assert first[1] == 1 and first[2] == 30 and hits.filter("query_id = 1").count() == 3
    assert engine.retrieve(asked, top_k=1, queries=vectors).groupBy("query_id").count().agg(F.max("count")).first()[0] == 1
    kept = engine.retrieve(asked, filters={"trang_thai_hieu_luc": "còn_hiệu_lực", "chu_de": "all", "other": 1}, queries=vectors)
    assert kept.filter("doc_id >= 20 and not added").count() == 0 and kept.filter("query_id = 2").count() > 0
    seen = {}
    engine.fused(asked, queries=vectors, observed=seen)
    assert set(seen) == {"structured", "exact", "bm25", "dense"} and seen["bm25"].get["n_rows"] > 0 and seen["dense"].get["first"]["rank"] == 1

    def answer(prompts):
        return ["không phải nộp thuế" if "phải nộp thuế" in p.rsplit("Câu hỏi", 1)[1] else p.split("[", 1)[1].split("]")[0] for p in prompts]

    more = asked.unionByName(spark.createDataFrame([(4, "có phải nộp thuế không văn bản"), (5, "zzzz")], asked.schema))
    got = {r["query_id"]: r for r in engine.ask(more, lambda: answer, queries=vectors).collect()}
    from lodestone.engine import SOURCE
    from lodestone.functions import rules

    assert set(got) == {1, 2, 4, 5} and got[1]["answer"] == "Luật | Điều 6" and got[4]["answer"] == rules.GUARD_ANSWER and got[5]["answer"] == rules.EMPTY_ANSWER
    assert [s["doc_id"] for s in got[1]["sources"]][0] == 1 and set(got[1]["sources"][0].asDict()) == {"rank", "doc_id", *SOURCE, "score", "retrieval_source"}


def test_settings_bound_the_flow(spark):
    wide, narrow = law_engine(spark, top_k=4, max_context_chars=10_000), law_engine(spark, top_k=2, max_context_chars=60, candidates_per_list=20)
    asked = spark.createDataFrame([(1, "văn bản số 30")], "query_id long, question string")
    n = [e.sources(e.retrieve(asked)).first() for e in (wide, narrow)]
    assert [len(r["sources"]) for r in n] == [4, 2] and n[0]["n_blocks"] == 4 and n[1]["n_blocks"] == 1 and len(n[1]["context"]) <= 60


def test_rule_tables_are_read_at_run_time(spark):
    from lodestone.operators import legal as L
    from lodestone.operators import ruled as U

    c, q = flow(spark, [(1, "A", 5, None, None, 1, "luật", None, "Mẫu mới"), (2, "B", 6, None, None, 1, "luật", None, "khác"), (3, "C", 6, 2, None, 2, "luật", None, "x")], [(1, "điều 6"), (2, "câu hỏi hiếm")])
    hits = spark.createDataFrame([(i, d, float(d), d) for i in (1, 2) for d in (1, 2, 3)], "query_id long, doc_id long, score double, rank int")
    table = spark.createDataFrame([U._row("any", 1.0, says="mẫu"), U._row("any", 0.5, code="B", dieu=6), U._row("dieu", 0.25, same="dieu", khoan=2), U._row("dieu", 0.25, same="unknown")], U.BOOSTS)
    got = {(r["query_id"], r["doc_id"]): r["boost"] for r in U.boosts(hits, c, L.boost(q), table).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.5, (1, 3): 0.25, (2, 1): 1.0, (2, 2): 0.5, (2, 3): 0.0}
    assert U.boosts(hits, c, L.boost(q), table.limit(0)).filter("boost <> 0").count() == 0
    topics = q.withColumn("legal_topic", F.lit("t"))
    older = spark.createDataFrame([("t", "A", "B"), ("u", "A", "C")], U.SUPERSEDED)
    assert rows(U.without_older(hits.filter("query_id = 1"), c, topics, older), "doc_id") == [(1,), (3,)]
    places = spark.createDataFrame([("HIẾM", 6, 2, 9), ("HIẾM", 6, None, 3)], U.PRIORITIES)
    out = rows(U.prioritised(hits, c, q, places), "query_id", "place", "doc_id")
    assert out == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 3), (2, 2, 2), (2, 3, 1)]


def test_paced_calls_retry_and_keep_errors(spark):
    import time

    from lodestone.operators import models as M

    df = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "id int, prompt string").coalesce(1)

    def make():
        turns = {}

        def call(prompts):
            p = prompts[0]
            turns[p] = turns.get(p, 0) + 1
            if p == "p1" and turns[p] < 3 or p == "p4":
                raise OSError("busy")
            return [f"{p} {turns[p]}"]

        return call

    pace = M.Pace(rate=20, retries=2, wait=0.01, error="error")
    start = time.time()
    got = {r["id"]: (r["answer"], r["error"]) for r in M.answered(df, make, pace=pace).collect()}
    assert got[1] == ("p1 3", None) and got[4] == (None, "OSError: busy") and got[0] == ("p0 1", None) and time.time() - start > 9 / 20
    with pytest.raises(Exception, match="busy"):
        M.answered(df, make, pace=M.Pace(retries=1, wait=0.01)).collect()


def test_table_functions_give_the_rows_of_the_operators(spark):
    from lodestone.functions import tables
    from lodestone.operators import news as N
    from lodestone.operators import segment as S

    assert set(tables.register(spark)) == set(tables.FUNCTIONS)
    odd = [("x", 1, "Điều 7. Lạ\u00a0 1. Một\r\n 02. hai\n99999999999. ba: a) x\nĐ) y\nb)\n\x0bc) \u2003z"), ("y", 1, "\x01 Điều 8. \n\n\n"), ("z", 1, "Điều 9. Chỉ tiêu đề\nlời dẫn\n1. a-\n b")]
    pages = spark.createDataFrame(LAW + odd, "doc string, page int, text string").withColumn("doc", F.crc32("doc"))
    S.articles(pages).select("doc", "pos", "text").createOrReplaceTempView("test_articles")
    got = spark.sql("SELECT * FROM lodestone_clauses(TABLE(test_articles) PARTITION BY doc ORDER BY pos)")
    columns = ("doc", "pos", "head", "k", "no", "khoan", "clause")
    key = lambda df, c: sorted(map(str, (tuple(r[x] for x in c) for r in df.collect())))
    clauses = S.clauses(S.articles(pages))
    assert key(got, columns) == key(clauses, columns) and got.count() > 8
    got.createOrReplaceTempView("test_clauses")
    columns = ("doc", "pos", "k", "khoan", "p", "diem", "said")
    assert key(spark.sql("SELECT * FROM lodestone_points(TABLE(test_clauses) PARTITION BY doc)"), columns) == key(S.points(clauses), columns)
    news = spark.createDataFrame([(1, "T", "T\n" + "a" * 1000 + "\n" + "b" * 900 + "\r\n\u00a0c  d\n"), (2, None, "x"), (3, "y", None)], "news_id long, title string, content string")
    news.createOrReplaceTempView("test_news")
    want = news.select("news_id", F.posexplode(N.chunks(F.col("title"), F.col("content"))).alias("chunk_index", "chunk"))
    assert key(spark.sql("SELECT * FROM lodestone_news_chunks(TABLE(test_news) PARTITION BY (news_id), 1800)"), ("news_id", "chunk_index", "chunk")) == key(want, ("news_id", "chunk_index", "chunk"))


def read_layer(content):
    if content == b"bad":
        raise ValueError("no pages")
    return content.decode().split("|")


def read_image(content, page):
    if page == 3:
        raise OSError("dark")
    return f"seen {page}"


def test_files_as_data_sources(spark, tmp_path):
    from lodestone.sources import files

    files.register(spark)
    feeds = tmp_path / "feeds"
    (feeds / "a").mkdir(parents=True)
    item = "<item><title>Tin &amp; {0} &ndash; x</title><link>u{0}</link><description>&lt;b&gt;M &amp;ocirc;&lt;/b&gt;</description></item>"
    doc = "<rss><channel><title>Nguồn</title>{}</channel></rss>"
    (feeds / "a" / "1.xml").write_text(doc.format(item.format(1)) + "\n" + doc.format("<item>").replace("</channel>", "") + doc.format(item.format(2) + "<item><title>không</title></item>") + " \n")
    (feeds / "2.xml").write_text(doc.format("".join(item.format(i) for i in range(100, 9000))))  # over several blocks
    (feeds / "3.xml").write_text("")
    (feeds / "_SUCCESS").write_text("x")
    got = spark.read.format("lodestone_feeds").option("partition_mb", "0.5").load(str(feeds))
    assert got.rdd.getNumPartitions() == 2 and got.count() == 8903
    small = {r["doc"]: r for r in got.filter("file like '%1.xml'").collect()}
    assert (small[0]["title"], small[0]["url"], small[0]["summary"], small[0]["source_name"]) == ("Tin & 1 - x", "u1", "M ô", "Nguồn") and small[1]["error"].startswith("ParseError") and small[2]["url"] == "u2"
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "p.html").write_text("<html><a class=x href=\"/a\">Thu&ocirc;ng <b>b</b></a></HTML><html>no</html><a href=\"b\">tail</a>")
    assert rows(spark.read.format("lodestone_links").load(str(tmp_path / "html")), "doc", "pos", "href", "title") == [(0, 0, "/a", "Thuông b"), (2, 0, "b", "tail")]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.pdf").write_text("x" * 60 + "|short|dark")
    (tmp_path / "pages" / "b.pdf").write_text("bad")
    how = {"layer": "test_engine:read_layer", "recognise": "test_engine:read_image"}
    import os

    spark.sparkContext.addPyFile(os.path.abspath(__file__))
    out = {(os.path.basename(r["file"]), r["page"]): r for r in spark.read.format("lodestone_pages").options(**how).load(str(tmp_path / "pages")).collect()}
    assert [(out["a.pdf", i]["extract_method"], out["a.pdf", i]["text"], out["a.pdf", i]["error"]) for i in (1, 2, 3)] == [("text", "x" * 60, None), ("ocr", "seen 2", None), (None, None, "OSError: dark")]
    assert out["b.pdf", None]["error"] == "ValueError: no pages"
    assert spark.read.format("lodestone_feeds").load(str(tmp_path / "none")).count() == 0


def test_page_files_with_functions(spark, tmp_path):
    from lodestone.sources.feeds import page_files

    (tmp_path / "a.bin").write_bytes(b"x" * 60 + b"|short")
    got = page_files(spark, str(tmp_path), lambda c: c.decode().split("|"), lambda c, i: f"seen {i}")
    assert rows(got, "page", "extract_method", "text") == [(1, "text", "x" * 60), (2, "ocr", "seen 2")]


def test_references_and_addresses_of_html(spark):
    import html
    from urllib.parse import urljoin

    from lodestone.functions import web

    texts = ["Thu&ocirc;ng &#233;&#x1EA5;&#XE9; &amp;amp; A & B &nbsp;x &unknown; &lt;b&gt; &notin; &; &fjlig;", "&amp;lt;", "&", "no", "&#128512;&#xD800;&#0;&#99999999;", ""]
    got = [r["d"] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(web.decoded(F.col("t")).alias("d")).collect()]
    assert got == [html.unescape(t).replace("\u00a0", " ") for t in texts[:4]] + ["😀&#xD800;&#0;&#99999999;", ""]
    base, hrefs = "https://a.vn/a/b/c/d/e/f", ["../../../../../x", "../../../../../../../../x", "x/../..", "./", "..", "a/./b/../c?d=/../e", "x#/../y"]
    joined = {r["h"]: r["u"] for r in spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", web.absolute(F.lit(base), F.col("h")).alias("u")).collect()}
    assert joined == {h: urljoin(base, h) for h in hrefs}


def test_news_stream_keeps_every_version_once(spark, tmp_path):
    from datetime import timedelta

    from lodestone.streaming import news as S

    schema = "title string, url string, source string, at string, content string"
    news = [(f"Tin {i}", f"u{i % 3}", "s", "2026-01-01", f"Nội dung hóa đơn điện tử số {i}") for i in range(6)] + [("Mới", None, "s", "x", "tin mới"), (None, " ", None, None, "không tên"), (None, None, None, None, None)]

    def land(name, rows_):
        spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    land("a", news[:5] + news[:2])
    read = lambda keep=timedelta(days=365): S.to_chunks(spark, str(tmp_path / "in/*"), schema, str(tmp_path / "at"), files=1, keep=keep)
    assert sorted(r["title"] for r in read().collect()) == [f"Tin {i}" for i in range(5)]
    land("b", news[3:] + news[:1])
    got = read()
    want = S.chunked(S.keyed(spark.createDataFrame(news, schema)))
    assert rows(got, "chunk_id", "text") == rows(want, "chunk_id", "text") and got.select("chunk_id").distinct().count() == got.count()
    land("c", news)
    assert read().count() == got.count()
    assert {r["topic"] for r in got.filter("url = 'u0'").collect()} == {"e_invoice"}


def test_the_report_is_written_as_text(spark, tmp_path):
    from lodestone.operators.questions import write_report

    lines = spark.createDataFrame([("failures", 1, "vat 2"), ("summary", 2, "b: 1/2"), ("summary", 1, "a: 2/2"), ("category", 1, "vat: 1/3")], "section string, place int, line string")
    write_report(lines, str(tmp_path / "report"))
    (part,) = (tmp_path / "report").glob("part-*")
    assert part.read_text().splitlines() == ["summary\ta: 2/2", "summary\tb: 1/2", "category\tvat: 1/3", "failures\tvat 2"]


def test_an_engine_is_made_anew_where_its_files_are_gone(spark):
    import shutil

    from lodestone.plans import corpus

    sf = "/root/testdata/sf0.001"
    held = corpus.engine(spark, sf)
    assert held.words.n == held.chunks.count() and corpus.engine(spark, sf) is held
    shutil.rmtree(held.words.path)
    again = corpus.engine(spark, sf)
    assert again is not held and again.words.n == held.words.n
