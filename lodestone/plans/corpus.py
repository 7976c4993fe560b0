"""The driver's tables as what the engine works on: documents as chunks and pages of laws, benchmark texts as questions.

Every document gets a place in a law (code, article, clause, point) and phrases of the law from its id; every benchmark text
begins with one of the forms that questions take. All by column expressions over whole tables, with the same rows in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions import rules as V
from lodestone.sources import table

from . import sql

CODES = ["108_2025_QH15", "68_2026_ND_CP", "70_2025_ND_CP", "18_2023_TT_BTC", "141_2026_ND_CP", "32_2025_TT_BTC"]
NAMES = ["Luật quản lý thuế 108/2025/QH15", "68-2026-ND-CP", "70-2025-ND-CP", "Thông tư 18/2023/TT-BTC", "141-2026-ND-CP", "Thông tư 32/2025/TT-BTC"]
TYPES = ["luật", "nghị_định", "nghị_định", "thông_tư", "nghị_định", "thông_tư"]
TOPICS = ["quản_lý_thuế", "hóa_đơn_chứng_từ", "hộ_kinh_doanh", None]
ISSUERS = ["Quốc hội", "Chính phủ", "Chính phủ", "Bộ Tài chính", "Chính phủ", "Bộ Tài chính"]
SINCE = ["2026-07-01", "2026-01-01", "2025-06-01", "2023-03-21", "2026-01-15", "2025-05-31"]
STATES = ["hết_hiệu_lực", "còn_hiệu_lực", "còn_hiệu_lực", "còn_hiệu_lực"]
CHAPTERS = ["Chương I", "Chương II", "Chương III"]
ARTICLES = [1, 5, 11, 16, 21]
POINTS = ["a", "b", "c", "đ"]
SAID = ["01 tỷ đồng", "sửa đổi", "máy tính tiền", "tiền chậm nộp phạt", "1.000.000.000", "miễn tiền chậm nộp", "hóa đơn điện tử", "", "", "", "không phải nộp thuế"]
#: Documents of the codes above; later ones belong to laws of their own, as many documents each, so no article grows with the table.
OWN = 210
ASKED = [
    "Khoản 2 Điều 5 quy định gì về miễn tiền chậm nộp? ", "hộ kinh doanh dưới 1 tỷ có phải nộp thuế không ", "ngưỡng doanh thu hóa đơn điện tử ", "cho mình biết nội dung điều 1 của luật quản lý thuế ",
    "Nghị định 68/2026 điểm đ khoản 4 điều 11 là gì ", "Thông tư 18 về tiền chậm nộp phạt, mức phạt ", "hóa đơn điện tử khởi tạo từ máy tính tiền: thủ tục ", "khi nào được miễn tiền chậm nộp theo điều 16, chương II ",
    "trách nhiệm đăng ký thuế ", "xin chào ",
]


def _of(values: list, at: Column) -> Column:
    return F.array(*map(F.lit, values))[at.cast("int")]


def _chunk_columns() -> dict[str, Column]:
    i = F.col("doc_id")
    n = F.floor(i / 6)
    khoan = F.nullif(F.pmod(F.floor(i / 30), F.lit(7)), F.lit(0)).cast("int")
    code = _of(CODES, i % 6)
    return {
        "ma_van_ban": F.when(i < OWN, code).otherwise(F.concat_ws("_", code, F.floor(i / OWN).cast("string"))), "ten_van_ban": _of(NAMES, i % 6), "loai_van_ban": _of(TYPES, i % 6), "chu_de": _of(TOPICS, i % 4),
        "co_quan_ban_hanh": _of(ISSUERS, i % 6), "trang_thai_hieu_luc": _of(STATES, i % 4), "ngay_hieu_luc": _of(SINCE, i % 6), "chuong": _of(CHAPTERS, n % 3), "trang_bat_dau": (i % 40 + 1).cast("int"),
        "dieu": _of(ARTICLES, n % 5), "khoan": khoan, "diem": F.when(khoan.isin(2, 4), _of(POINTS, i % 4)), "phrase": _of(V.LEGAL_PHRASES, i % len(V.LEGAL_PHRASES)), "said": _of(SAID, i % len(SAID)),
    }


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (the order of the corpus), chunk_id, code, name, type, topic, source, article and its title, clause, point, level, unit, text, and who issued
    the law, since when and whether it holds, its chapter and page."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("body")).withColumns(_chunk_columns())
    title = F.concat(F.lit("Điều "), F.col("dieu").cast("string"), F.lit(". "), F.col("phrase"))
    d = d.withColumns({"tieu_de_dieu": title, "level": F.when(F.col("diem").isNotNull(), 3).when(F.col("khoan").isNotNull(), 2).otherwise(1)})
    named = lambda label, c: F.concat(F.lit(label), F.col(c).cast("string"))
    text = F.concat_ws("\n", "tieu_de_dieu", named("Khoản ", "khoan"), named("Điểm ", "diem"), F.nullif("said", F.lit("")), "body")
    unit = F.coalesce(F.concat(F.lit("khoản_"), F.col("khoan").cast("string"), F.coalesce(F.concat(F.lit("_điểm_"), "diem"), F.lit(""))), F.lit("toàn_bộ_điều"))
    return d.select(
        "doc_id", F.concat_ws("_", "ma_van_ban", named("dieu", "dieu"), named("khoan", "khoan"), named("diem", "diem"), named("chunk", "doc_id")).alias("chunk_id"), "ma_van_ban", "ten_van_ban", "loai_van_ban",
        "chu_de", "source", "dieu", "tieu_de_dieu", "khoan", "diem", "level", text.alias("text"), "co_quan_ban_hanh", "trang_thai_hieu_luc", "ngay_hieu_luc", "chuong", "trang_bat_dau", unit.alias("don_vi_con"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, question of every benchmark text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(_of(ASKED, F.col("item_id") % len(ASKED)), F.col("text")).alias("question"))


_ENGINES: dict[tuple, Engine] = {}


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v: the vector of a chunk or question is that of its id."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def _whole(held: Engine) -> bool:
    """Whether what the engine has written is still there."""
    made, spark = vars(held), held.spark
    paths = [made[k].path for k in ("words", "phrases", "vectors", "documents") if made.get(k)] + (made["chunks"].inputFiles()[:1] if "chunks" in made else [])
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine over these tables: one a session for as long as their files and those of its indexes stay as they are, so these are made once."""
    files = [table(spark, sf_dir, t).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct() for t in ("documents", "embeddings")]
    state = files[0].unionByName(files[1]).agg(F.count("*"), F.sum(F.xxhash64(*files[0].columns).cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, sf_dir, *state)
    if key not in _ENGINES or not _whole(_ENGINES[key]):
        _ENGINES[key] = Engine(spark, chunks(spark, sf_dir), vectors(spark, sf_dir))
    return _ENGINES[key]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, text: every document as pages of a law, two lines a page, its lines as headings, clauses and points."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("i", "line"))
    i, line = F.col("i"), F.col("line")
    kind = F.pmod(i, F.lit(9))
    number = (F.floor(i / 9) * 2 + 1).cast("int").cast("string")
    head = lambda c: F.concat(c, F.lit(". "), F.left(line, F.lit(30)))
    shown = (
        F.when(kind == 0, F.concat(F.when(i % 18 == 0, F.lit("Chương I\nQUY ĐỊNH CHUNG\n")).otherwise(""), head(F.concat(F.lit("Đ i ề u "), number)), F.lit("\n"), line))
        .when(kind == 1, F.concat(F.lit("1. "), line)).when(kind == 2, F.concat(F.lit("2. "), line, F.lit(" a) "), F.left(line, F.lit(20)), F.lit(" ;\r\nb) khai báo")))
        .when(kind == 3, F.concat(F.lit("đ) "), line)).when(kind == 4, F.concat(F.lit("3. "), line)).when(kind == 5, F.concat(head(F.concat(F.lit("Điêu "), (number.cast("int") + 1).cast("string"))), F.lit(" 1. "), line))
        .when((kind == 8) & (F.col("doc") % 5 == 0), F.concat(F.lit("PHỤ LỤC "), number, F.lit("\n"), line, F.lit("\nMẫu số 0"), number)).otherwise(line)
    )
    rows = lines.select("doc", F.floor(i / 2).cast("int").alias("page"), "i", shown.alias("s"))
    return rows.groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("l")).select("doc", "page", F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("text"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """news_id, title, summary, source, url, at, content: documents as news; the title holds phrases of the law, the summary references."""
    d = table(spark, sf_dir, "documents")
    i, line = F.col("doc_id"), F.element_at(F.split("text", "\n"), 1)
    told = F.concat(_of(list(V.NEWS_WEIGHTS), i % len(V.NEWS_WEIGHTS)), F.lit(" "), F.left(line, F.lit(40)))
    number = F.col("doc_id").cast("string")
    refs = F.concat(F.lit("Nghị định số "), (i % 90 + 10).cast("string"), F.lit("/2026/NĐ-CP; "), F.when(i % 3 == 0, F.lit("luật số 108/2025/QH15, ")).otherwise(""), F.when(i % 4 == 0, F.lit("Công văn số 12/TCT, ")).otherwise(""), F.left(line, F.lit(60)))
    return d.select(i.alias("news_id"), told.alias("title"), refs.alias("summary"), "source", F.concat(F.lit("https://news.example/"), (i % 50).cast("string")).alias("url"), F.when(i % 7 == 0, F.lit("")).when(i % 7 == 1, F.lit("hôm nay")).otherwise(F.concat(F.lit("2026-0"), (i % 9 + 1).cast("string"), F.lit("-15T08:00:00"))).alias("at"), "text", number.alias("number"))


def _pick(values: list, at: str) -> str:
    return "[" + ", ".join("null" if v is None else str(v) if isinstance(v, int) else sql.quoted(v) for v in values) + f"][({at})::integer + 1]"


_CODE = _pick(CODES, "doc_id % 6")
CHUNKS = f"""
c0 as (
  select doc_id, source, text as body, case when doc_id < {OWN} then {_CODE} else {_CODE} || '_' || (doc_id // {OWN}) end as ma_van_ban, {_pick(NAMES, 'doc_id % 6')} as ten_van_ban, {_pick(TYPES, 'doc_id % 6')} as loai_van_ban,
    {_pick(TOPICS, 'doc_id % 4')} as chu_de, {_pick(ARTICLES, '(doc_id // 6) % 5')}::integer as dieu, nullif((doc_id // 30) % 7, 0)::integer as khoan,
    case when (doc_id // 30) % 7 in (2, 4) then {_pick(POINTS, 'doc_id % 4')} end as diem, {_pick(V.LEGAL_PHRASES, f'doc_id % {len(V.LEGAL_PHRASES)}')} as phrase, {_pick(SAID, f'doc_id % {len(SAID)}')} as said,
    {_pick(ISSUERS, 'doc_id % 6')} as co_quan_ban_hanh, {_pick(STATES, 'doc_id % 4')} as trang_thai_hieu_luc, {_pick(SINCE, 'doc_id % 6')} as ngay_hieu_luc, {_pick(CHAPTERS, '(doc_id // 6) % 3')} as chuong, (doc_id % 40 + 1)::integer as trang_bat_dau
  from documents),
chunks as (
  select doc_id, concat_ws('_', ma_van_ban, 'dieu' || dieu, 'khoan' || khoan, 'diem' || diem, 'chunk' || doc_id) as chunk_id, ma_van_ban, ten_van_ban, loai_van_ban, chu_de, source, dieu, 'Điều ' || dieu || '. ' || phrase as tieu_de_dieu, khoan, diem,
    case when diem is not null then 3 when khoan is not null then 2 else 1 end as level, concat_ws(chr(10), 'Điều ' || dieu || '. ' || phrase, 'Khoản ' || khoan, 'Điểm ' || diem, nullif(said, ''), body) as text,
    co_quan_ban_hanh, trang_thai_hieu_luc, ngay_hieu_luc, chuong, trang_bat_dau, coalesce('khoản_' || khoan || coalesce('_điểm_' || diem, ''), 'toàn_bộ_điều') as don_vi_con
  from c0)"""
QUESTIONS = f"questions as (select item_id as query_id, {_pick(ASKED, f'item_id % {len(ASKED)}')} || text as question from benchmark)"
PAGES = """
pl as (select doc_id as doc, generate_subscripts(l, 1) - 1 as i, unnest(l) as line from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l from documents)),
pages_of as (select doc, (i // 2)::integer as page, string_agg(case
    when i % 9 = 0 then case when i % 18 = 0 then 'Chương I' || chr(10) || 'QUY ĐỊNH CHUNG' || chr(10) else '' end || 'Đ i ề u ' || (i // 9 * 2 + 1) || '. ' || left(line, 30) || chr(10) || line
    when i % 9 = 1 then '1. ' || line when i % 9 = 2 then '2. ' || line || ' a) ' || left(line, 20) || ' ;' || chr(13) || chr(10) || 'b) khai báo' when i % 9 = 3 then 'đ) ' || line when i % 9 = 4 then '3. ' || line
    when i % 9 = 5 then 'Điêu ' || (i // 9 * 2 + 2) || '. ' || left(line, 30) || ' 1. ' || line
    when i % 9 = 8 and doc % 5 = 0 then 'PHỤ LỤC ' || (i // 9 * 2 + 1) || chr(10) || line || chr(10) || 'Mẫu số 0' || (i // 9 * 2 + 1) else line end, chr(10) order by i) as text from pl group by 1, 2)"""
NEWS = f"""
news as (select doc_id as news_id, {_pick(list(V.NEWS_WEIGHTS), f'doc_id % {len(V.NEWS_WEIGHTS)}')} || ' ' || left(string_split(text, chr(10))[1], 40) as title,
  'Nghị định số ' || (doc_id % 90 + 10) || '/2026/NĐ-CP; ' || case when doc_id % 3 = 0 then 'luật số 108/2025/QH15, ' else '' end || case when doc_id % 4 = 0 then 'Công văn số 12/TCT, ' else '' end || left(string_split(text, chr(10))[1], 60) as summary,
  source, 'https://news.example/' || (doc_id % 50) as url, case doc_id % 7 when 0 then '' when 1 then 'hôm nay' else '2026-0' || (doc_id % 9 + 1) || '-15T08:00:00' end as at, text from documents)"""
