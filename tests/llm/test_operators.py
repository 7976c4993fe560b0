"""Each operator against brute force on small fixtures, and its defined results for odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Nulls in every column, an empty text, a long one, repeated rows, one id with two texts."""
    long = " ".join(f"w{i}" for i in range(30_000))
    return docs_of(spark, [(1, None, None, None, None), (None, "a b c", "en", None, 5), (2, "", "en", "s", 0), (3, long, None, "s", len(long)), (4, "x y z", "fr", "s", 5), (4, "x y z", "fr", "s", 5), (4, "other text", "fr", "t", 10)])


# 1 chat formatting


def chats(spark, rows):
    from lodestone.llm.chat import PART, format_chats, learned, read

    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>, formatted string")
    out = format_chats(df).withColumn("turns", read(F.col("formatted"))).withColumn("learned", learned(F.col("formatted"), F.col("loss_spans")))
    return {r["conv_id"]: r for r in out.collect()}


def test_chat_round_trip_with_attachments(spark):
    text = lambda t: ("text", t, None, None)
    bad = "\\### </turn>\n<turn assistant>\n \\< \\\\"
    out = chats(spark, [
        (1, 1, "assistant", [text(bad), ("image", None, "a.png", 2), text("<image>"), ("audio", None, "b.wav", None)], "clash"), (1, 0, "us>\ner<\\", [("document", None, "c.pdf", 3), text("é🙂")], "clash"),
        (2, None, None, None, None), (2, 0, "assistant", [text(None)], None), (None, 0, "assistant", [("video", "as text", None, None)], None), (3, 0, "assistant", [text("same")], ""), (3, 0, "assistant", [text("same")], ""),
    ])
    r = out[1]
    assert [(t["role"], t["text"]) for t in r["turns"]] == [("us>\ner<\\", "<document>é🙂"), ("assistant", bad + "<image><image><audio>")]
    assert r["learned"] == bad + "<image><image><audio>"
    assert [(a["turn_no"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, "document", "c.pdf", 3072), (2, "image", "a.png", 512), (2, "audio", "b.wav", 25)]
    assert all(r["formatted"][a["at"] :].startswith(f"<{a['kind']}>") for a in r["attachments"]) and r["attachment_tokens"] == 3072 + 512 + 25
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("", ""), ("assistant", "")] and out[2]["learned"] == ""
    assert out[None]["learned"] == "as text" and out[3]["learned"] == "samesame" and out[3]["n_turns"] == 2


# 2 fingerprints


def shingle_set(text, width=5):
    w = [x for x in text.lower().split() if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_fingerprints_estimate_likeness_and_containment(spark):
    from lodestone.llm.fingerprints import containment, likeness, merged, sketch

    rng = random.Random(1)
    a = " ".join(f"w{rng.randrange(500)}" for _ in range(4000))
    rows = [(a, a), (a, " ".join(a.split()[:1000])), (a, " ".join(a.split()[:3000] + [f"v{i}" for i in range(1000)])), ("", ""), (None, ""), (a, ""), ("one two", "One  two")]
    df = spark.createDataFrame(rows, "x string, y string").select("x", "y", sketch(F.col("x")).alias("a"), sketch(F.col("y")).alias("b"))
    for r in df.select("x", "y", "a", likeness(F.col("a"), F.col("b")).alias("s"), containment(F.col("b"), F.col("a")).alias("c"), (merged(F.col("a"), F.col("b")) == sketch(F.concat_ws(" | ", "x", F.lit(""), "x"))).alias("m")).collect():
        x, y = shingle_set(r["x"] or ""), shingle_set(r["y"])
        assert r["s"] == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0, abs=0.06)
        assert r["c"] == pytest.approx(len(x & y) / len(y) if y else 1.0, abs=0.06)
        assert len(r["a"]) == pytest.approx(len(x) / 4, rel=0.2, abs=1)


def test_sketches_merge(spark):
    from lodestone.llm.fingerprints import merged, shingle_hashes, sketch, _kept

    a, b = " ".join(f"a{i}" for i in range(300)), "b c"
    df = spark.createDataFrame([(a, b), (b, "d e"), (a, "")], "x string, y string")
    both = F.array_union(shingle_hashes(F.col("x")), shingle_hashes(F.col("y")))
    assert all(r["ok"] for r in df.select((merged(sketch(F.col("x")), sketch(F.col("y"))) == _kept(both, 4)).alias("ok")).collect())


def test_op2_against_brute_force(spark):
    from lodestone.llm.fingerprints import op2_fingerprints

    docs = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in op2_fingerprints(spark, SF).collect()}
    err, next_err = [], []
    for i, (k, a) in enumerate(docs):
        b = docs[(i + 1) % len(docs)][1]
        y = shingle_set(b)
        next_err.append(abs(got[k]["near_next"] - len(shingle_set(a) & y) / len(shingle_set(a) | y)))
        e = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        assert got[k]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[k]["n_chars"] == len(a)
        x, y = shingle_set(a), shingle_set(e)
        err.append(abs(got[k]["near_edited"] - len(x & y) / len(x | y)))
    assert np.mean(err) < 0.06 and np.mean(next_err) < 0.01 and max(next_err) < 0.5
    alike = collections.defaultdict(set)
    for k, a in docs:
        alike[a].add(got[k]["fingerprint"])
    assert all(len(v) == 1 for v in alike.values())


def test_next_rows_over_odd_ids(spark):
    from lodestone.llm.fingerprints import with_next

    df = odd_docs(spark).select("doc_id", "text")
    got = with_next(df, "doc_id", ["text"], 4).collect()
    assert len(got) == 7
    at = sorted(((r["doc_id"] if r["doc_id"] is not None else -9, r["text"] or "", r["next_text"] or "") for r in got), key=lambda x: -x[0])
    assert [x[2][:5] for x in at if x[0] in (3, 2, 1)] == ["", "", "a b c"] and at[-1][2] == "other text"
    assert with_next(df.limit(0), "doc_id", ["text"], 4).count() == 0
    one = with_next(df.filter("doc_id = 3"), "doc_id", ["text"], 4).collect()
    assert one[0]["next_text"] == one[0]["text"]


def test_chats_and_fingerprints_of_no_rows_and_clashing_columns(spark):
    from lodestone.llm.chat import PART, format_chats
    from lodestone.llm.fingerprints import fingerprints, with_next

    assert format_chats(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{PART}>")).count() == 0
    assert fingerprints(odd_docs(spark).limit(0)).count() == 0
    out = fingerprints(odd_docs(spark).withColumn("Sketch", F.lit("clash")).withColumn("h", F.lit(1)))
    assert out.count() == 7 and [c.lower() for c in out.columns].count("sketch") == 1 and dict(out.dtypes)["sketch"] == "array<bigint>"
    assert with_next(odd_docs(spark).withColumn("r", F.lit(1)), "doc_id", ["text"], 3).count() == 7


# 3, 4 tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_ids_of_the_library(name, monkeypatch):
    from tokenizers import Tokenizer

    from lodestone.llm import encoding

    monkeypatch.setattr(encoding, "SLICE", 40)
    rng = random.Random(2)
    bits = ["a", "B", "é", " ", "  ", "\n", " \n", "\t", "\r\n", ".", ",", "'s", "don't", "12", "<|endoftext|>", " ", "ß", "İ", "Σ", "é", "\x1c", "日本", "🙂", "hello", "Über", "&&&", "_", "%%%", "a@b.c", "f$$$,"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(15))) for _ in range(1500)] + [" ".join(rng.choice(["hello", "Wörld.", "it's", "end.\nNext", "A1", "cd&&&."]) for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    path = public_tokenizers.path(name)
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    e = encoding.Encoder(path)
    assert [e.encode(t) for t in texts] == want and e.encode(None) == b""


def ids_of(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_places_every_id_once(spark):
    from lodestone.llm.packing import pack

    rows = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd_docs(spark).filter("doc_id is null or doc_id <> 4").withColumn("doc_id", F.col("doc_id") + 10_000_000))
    docs = {r["doc_id"]: ids_of("word_bpe_49k.json", r["text"]) for r in rows.collect()}
    got = pack(rows.repartition(3), public_tokenizers.path("word_bpe_49k.json")).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        ids = docs[r["doc_id"]]
        assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids)
    whole = lambda parts: all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and sorted(parts)[0][0] == 0
    assert set(by_doc) == set(docs) and all(whole(p) and sum(n for _, n in p) == len(docs[k]) for k, p in by_doc.items())
    assert all(whole(p) and sum(n for _, n in p) <= 4096 for p in by_seq.values())
    assert sum(map(len, docs.values())) / (4096 * len(by_seq)) > 0.9
    assert pack(rows.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert pack(odd_docs(spark), public_tokenizers.path("word_bpe_49k.json")).filter("doc_id = 4").count() == 3


def test_windows_are_bounded_and_full():
    from lodestone.llm.packing import Windows

    rng, w, closed = random.Random(3), Windows(100, 4, 10), []
    sizes = [rng.randrange(1, 300) for _ in range(500)]
    for i, n in enumerate(sizes):
        closed += [p for _, p in w.add(n, lambda s, m, i=i: (i, s, m))]
        assert len(w.open) <= 4
    waste = [100 - sum(m for _, _, m in p) for p in closed]
    assert max(waste) < 10
    assert sum(m for p in closed + [p for _, p in w.rest()] for _, _, m in p) == sum(sizes)


def test_orc_round_trip_and_pruning(spark, tmp_path):
    import glob

    from pyarrow import orc

    from lodestone.llm.orc_ids import read_ids, spans, write_ids

    path = str(tmp_path / "ids")
    write_ids(odd_docs(spark), public_tokenizers.path("byte_bpe_50k.json"), path)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd_docs(spark).collect()), key=lambda x: (x[0] is not None, x[0], x[1]))
    ids = [ids_of("byte_bpe_50k.json", t) for _, t in rows]
    starts = np.cumsum([0, *map(len, ids)])[:-1]
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in spans(spark, path).collect()))
    assert got == [(s, d, len(i), crc(i)) for (d, _), i, s in zip(rows, ids, starts)]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in read_ids(spark, path).filter("doc_id = 3")._jdf.queryExecution().toString()
    assert read_ids(spark, path).filter("doc_id = 3").count() == 1
    assert all(orc.ORCFile(f).compression == "ZSTD" for f in glob.glob(f"{path}/*.orc"))
    write_ids(odd_docs(spark).limit(0), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "none"))
    assert spans(spark, str(tmp_path / "none")).count() == 0


def test_orc_files_hold_stripes_indexes_and_bloom_filters(spark, tmp_path, monkeypatch):
    import glob

    from lodestone.llm import orc_ids

    monkeypatch.setattr(orc_ids, "STRIPE", 64 << 10)
    docs = spark.range(24_000).select((F.col("id") * 7).alias("doc_id"), F.concat_ws(" ", *(F.md5(F.concat("id", F.lit(str(k)))) for k in range(2))).alias("text"))
    orc_ids.write_ids(docs.coalesce(1), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "ids"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stripes = 0
    for f in glob.glob(f"{tmp_path}/ids/*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        stripes += reader.getStripes().size()
        assert reader.getRowIndexStride() == orc_ids.STRIDE
        footer = rows.readStripeFooter(reader.getStripes().get(0))
        kinds = {(s.getColumn(), str(s.getKind())) for s in footer.getStreamsList()}
        assert (1, "BLOOM_FILTER_UTF8") in kinds and {(c, "ROW_INDEX") for c in range(6)} <= kinds and not [c for c, k in kinds if k == "BLOOM_FILTER_UTF8" and c != 1]
        assert {str(footer.getColumns(c).getKind()) for c in (1, 2, 3, 5)} == {"DIRECT_V2"}  # run-length integers
        rows.close()
    assert stripes > len(glob.glob(f"{tmp_path}/ids/*.orc")) and orc_ids.read_ids(spark, str(tmp_path / "ids")).filter("doc_id = 7777").count() == 1


def test_token_queries_over_a_whole_table(spark):
    from lodestone.llm.orc_ids import op4_orc_ids
    from lodestone.llm.packing import op3_pack_windows

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    at, want = 0, []
    for k in sorted(docs):
        ids = ids_of("byte_bpe_50k.json", docs[k])
        want.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in op4_orc_ids(spark, SF).collect()) == want
    held = collections.defaultdict(list)
    for r in op3_pack_windows(spark, SF).collect():
        held[r["doc_id"]].append((r["start"], r["length"]))
        ids = ids_of("word_bpe_49k.json", docs[r["doc_id"]])
        assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids)
    for k, parts in held.items():
        assert [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]]
    assert set(held) == set(docs)


# 5 language


def test_language_accuracy_on_held_out_rows(spark):
    from lodestone.llm.language import op5_language_filters

    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op5_language_filters(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.97


def test_language_of_odd_rows(spark):
    from lodestone.llm.language import fit, identify, keep_known, predict

    got = identify(odd_docs(spark).withColumn("score", F.lit("clash"))).collect()
    assert len(got) == 7 and {r["lang_pred"] for r in got if not r["text"]} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    assert identify(odd_docs(spark).limit(0)).count() == 0
    none = fit(odd_docs(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in predict(odd_docs(spark), none).collect()} == {"und"}
    assert keep_known(odd_docs(spark)).columns == odd_docs(spark).columns


def brute_grams(text):
    """Runs of 3 and 4 letters of each word with its borders, without those that hold a border inside."""
    out = collections.Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        w = f" {w} "
        out.update(w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1))
    return out


def hashed(gram):
    from lodestone.llm.language import _MIX, mixed

    h = np.full(1, np.uint64(len(gram)))
    for c in gram:
        h = h * _MIX[0] + np.uint64(0 if c == " " else ord(c))
    return int(mixed(h)[0])


@pytest.mark.parametrize("size", [1, 2, 3, 37, 64, 1 << 20])
def test_grams_are_those_of_each_whole_text(size):
    from lodestone.llm.language import grams

    texts = ["The quick brown fox jumps. " * 20, None, "", "a", "  ...é it's 12 ñandú!", "x" * 9, "?ab", "ΑΣ ΑΣΑ"]
    got = [collections.Counter() for _ in texts]
    for h, owner in grams(texts, size):
        for g, i in zip(h.tolist(), owner.tolist(), strict=True):
            got[i][g] += 1
    assert got == [collections.Counter({hashed(g): n for g, n in brute_grams(t or "").items()}) for t in texts]


def test_filters_hold_what_sets_of_grams_hold(spark):
    """Masks against exact sets of grams by language: no gram is missed, few are held wrongly, and predictions follow from them."""
    from lodestone.llm import language

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    counts = collections.defaultdict(collections.Counter)
    for r in docs.collect():
        if r["lang"] is not None and r["text"] is not None:
            counts[r["lang"]].update(brute_grams(r["text"]))
    filters = language.fit(docs, rows=10**6)
    assert filters.langs == sorted(counts)
    total = {k: sum(c.values()) for k, c in counts.items()}
    share = collections.defaultdict(dict)
    for k, c in counts.items():
        for g, n in c.items():
            if n >= language.LEAST_COUNT:
                share[g][k] = n / total[k]
    own = {k: {g for g, f in share.items() if f.get(k, 0) >= max(f.values()) * language.NEAR_BEST} for k in counts}
    every = sorted({g for c in counts.values() for g in c})
    h = np.array([hashed(g) for g in every], np.uint64)
    rows = language.rows_of(h)
    found = filters.masks[rows[0]] & filters.masks[rows[1]]
    for j, k in enumerate(filters.langs):
        bit = (found[:, 0] >> np.uint64(j)) & np.uint64(1) == 1
        exact = np.array([g in own[k] for g in every])
        assert bit[exact].all() and bit[~exact].mean() < 2 * filters.wrong[j] + 0.01
    texts = [r["text"] for r in docs.limit(60).collect()] + ["", None, "12 ."]
    got, score = filters.predict(texts)
    for t, lang, s in zip(texts, got, score, strict=True):
        held = {k: sum(n for g, n in brute_grams(t or "").items() if g in own[k]) for k in filters.langs}
        if not held or not sum(held.values()):
            assert (lang, s) == ("und", 0.0) if not brute_grams(t or "") else True
        else:
            assert held[lang] >= 0.98 * max(held.values()) and s == pytest.approx(max(held.values()) / sum(held.values()), abs=0.05)


def test_pipeline_keeps_texts_of_languages_that_are_alike(spark):
    """A score that is shared among many languages drops no document."""
    from lodestone.llm.language import keep_known

    base = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").select("doc_id", "text").limit(40)
    docs = base.withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 8).cast("string")))
    assert keep_known(docs).count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()


# 6 nearest neighbours


def test_recall_and_ties(spark):
    from lodestone.llm.ann import nearest, unit

    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    x[100:180] = x[100]  # one vector 80 times
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (9005, [1.0]), (None, [1.0] * 16), (150, [float(v) for v in x[150]])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    u, hits = unit(x), 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -s.round(12)))[:5]
        assert [r for r, _ in found[q]] == list(dict.fromkeys(r for r, _ in found[q])) and len(found[q]) == 5
        assert all(abs(sc - s[v]) < 1e-12 for v, sc in found[q])
        hits += len(set(best) & {v for v, _ in found[q]})
    assert hits / 150 >= 0.9 and len(found) == 30
    assert [v for v, _ in found[100]] == [101, 102, 103, 104, 105] and [v for v, _ in found[150]] == [100, 101, 102, 103, 104]
    small = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert nearest(small, F.col("vec_id") == 0).count() == 2 and nearest(small.limit(0), F.col("vec_id") == 0).count() == 0 and nearest(small, F.lit(False)).count() == 0


def test_search_query_over_a_whole_table(spark):
    from lodestone.llm.ann import op6_learned_partitions, parts_of, unit

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = collections.defaultdict(list)
    for r in sorted(op6_learned_partitions(spark, SF).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = unit(x) @ unit(x)[i]
        s[i] = -9
        best = set(ids[np.argsort(-s)[:5]].tolist())
        found = got[int(ids[i])]
        assert len(found) == 5 and all(abs(sc - s[np.flatnonzero(ids == v)[0]]) < 1e-9 for v, sc in found)
        hits += len(best & {v for v, _ in found})
    assert hits / (5 * len(got)) >= 0.9 and set(got) == set(ids[ids % 50 == 0].tolist())
    assert [parts_of(n) for n in (0, 1, 320_000, 320_001, 10**9)] == [16, 16, 16, 32, 64]


def test_queries_always_get_their_share_of_candidates(spark):
    """A probe that would visit one nearly empty part goes on to others; clashing columns are ignored."""
    from lodestone.llm import ann

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(400, 8)) * 0.01 + np.eye(8)[0], rng.normal(size=(3, 8)) * 0.01 - np.eye(8)[0]])
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, p int, parts int")
    got = collections.Counter(r["query_id"] for r in ann.nearest(df, F.col("vec_id") >= 400, parts=16, target=0.01).collect())
    assert got == {400: 5, 401: 5, 402: 5}


def test_partitions_are_fitted_on_distinct_vectors(spark, monkeypatch):
    from lodestone.llm import ann

    fit, seen = ann.fit, []
    monkeypatch.setattr(ann, "SAMPLE", 50 / ann.LEAST_PARTS)
    monkeypatch.setattr(ann, "fit", lambda x, *a: seen.append(np.unique(x, axis=0)) or fit(x, *a))
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8)).tolist()
    rows = [(i, base[i // 40]) for i in range(2400)]  # 40 copies of each
    ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert len(seen[0]) == 50


# 7 near duplicates


def brute_classes(rows, least=0.8):
    """Classes of (id, text) by weighted Jaccard similarity of all pairs."""
    bags = []
    for _, t in rows:
        w = (t or "").lower().split()
        n = min(5, len(w))
        bags.append(collections.Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else collections.Counter())
    df = collections.Counter(k for b in bags for k in b)
    idf = {k: np.log((1 + len(rows)) / (1 + v)) + 1 for k, v in df.items()}
    at, holders = list(range(len(rows))), collections.defaultdict(list)

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, b in enumerate(bags):
        near = set().union(*(holders[k] for k in b)) if b else {j for j in range(i) if not bags[j]}
        for k in b:
            holders[k].append(i)
        for j in near:
            both = sum(min(v, bags[j][k]) * idf[k] for k, v in b.items() if k in bags[j])
            total = sum(v * idf[k] for k, v in b.items()) + sum(v * idf[k] for k, v in bags[j].items())
            if not total or both / (total - both) >= least:
                p, q = root(i), root(j)
                at[max(p, q)] = min(p, q)
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def test_near_duplicate_classes(spark):
    from lodestone.llm.near_dedup import keep_one, near_duplicates

    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(10_000)}" for _ in range(rng.choice([30, 120, 400]))]
        for k in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(k % 4 * len(w) // 100):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
            rows.append((len(rows), ("  " if k % 2 else " ").join(w).upper() if k % 3 else " ".join(w)))
    rows += [(900, None), (901, ""), (902, "two words"), (903, "two words"), (904, "two other")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    want = brute_classes(rows)
    got = {r["doc_id"]: r for r in near_duplicates(df).collect()}
    assert {k: r["class_id"] for k, r in got.items()} == want
    assert {k for k, r in got.items() if r["kept"]} == set(want.values())
    assert sorted(r["doc_id"] for r in keep_one(df).collect()) == sorted(set(want.values()))


def test_near_pairs_in_a_family_with_a_template(spark):
    """Pairs of near copies among many texts that share a long passage, but are no near copies of each other."""
    from lodestone.llm.near_dedup import near_duplicates

    passage = [f"t{k}" for k in range(1504)]
    rows = []
    for i in range(600):
        own = i - i % 2 if i < 200 else i  # 100 pairs, of a similarity of 0.83; that of other pairs is 0.78
        rows.append((i, " ".join([*(f"u{own}x{k}" for k in range(8)), *passage, *(f"v{i}x{k}" for k in range(24))])))
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 if i < 200 else i for i in range(600)}


def test_all_links_just_above_the_threshold(spark):
    """200 pairs of a similarity just above the threshold among 400 texts that share a passage; all others are just below it."""
    from lodestone.llm.near_dedup import near_duplicates

    passage, rows = [f"t{k}" for k in range(1724)], []
    for i in range(400):
        own = i - i % 2
        rows.append((i, " ".join([*(f"u{own}x{k}" for k in range(5)), *passage, *(f"v{i}x{k}" for k in range(30))])))
    bags = [collections.Counter(tuple(r[1].split()[j : j + 5]) for j in range(len(r[1].split()) - 4)) for r in rows]
    df = collections.Counter(k for b in bags for k in b)
    weight = {k: np.log(401 / (1 + v)) + 1 for k, v in df.items()}
    like = lambda a, b: sum(weight[k] for k in a.keys() & b.keys()) / sum(weight[k] for k in a.keys() | b.keys())
    assert 0.8 <= like(bags[0], bags[1]) < 0.84 and 0.76 < like(bags[0], bags[2]) < 0.8
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(400)}


def test_near_query_over_a_whole_table(spark):
    from lodestone.llm.near_dedup import op7_weighted_minhash

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = brute_classes(docs)
    got = op7_weighted_minhash(spark, SF).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want and {r["doc_id"] for r in got if r["kept"]} == set(want.values())


def test_shingle_weights_with_very_many_shingles(spark):
    """A rare shingle stays rare where millions of others are counted."""
    from lodestone.llm.near_dedup import near_duplicates

    passage = [f"t{k}" for k in range(1004)]
    rows = [(i, " ".join([*passage, *(f"w{i}x{k}" for k in range(300_000 if i < 12 else 70))])) for i in range(14)]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(14)}


def test_vectors_hold_only_shingles_that_can_meet(spark, monkeypatch):
    """Shingles of one document alone are held as their number, so vectors of texts with nothing in common take no room."""
    from lodestone.llm import near_dedup

    seen, written = {}, near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name: seen.setdefault(name, written(df, name)))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(500))) for i in range(40)] + [(i, " ".join(f"s{i // 2}x{k}" for k in range(500)) + f" t{i}") for i in range(40, 60)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 if i >= 40 else i for i in range(60)}
    sizes = {r["d"]: len(r["v"]) for r in seen["signed"].collect()}
    assert max(sizes[i] for i in range(40)) <= 8 and max(sizes[i] for i in range(40, 60)) <= 12 * 500


def test_pairs_compared_in_a_family_about_the_threshold(spark, monkeypatch):
    """Copies of a passage with 3 or 4 words changed: pairs of the former are near copies, others only where their changes meet."""
    from lodestone.llm import near_dedup

    tested, written, rng = [], near_dedup.written, random.Random(3)

    def kept(df, name):
        out = written(df, name)
        tested.extend([out.count()] if name == "tested" else [])
        return out

    monkeypatch.setattr(near_dedup, "written", kept)
    rows = []
    for i in range(400):
        w = [f"b{k}" for k in range(1000)]
        for k, at in enumerate(rng.sample(range(5, 990, 6), 3 + i % 2)):
            w[at] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(0, 400, 2)} == {0} and len(set(got.values())) == 162  # as when all pairs that share a rare shingle were compared
    assert sum(tested) < 30 * len(rows)  # 40,411 then


def test_near_duplicates_of_odd_rows(spark):
    from lodestone.llm.near_dedup import keep_one, near_duplicates

    got = sorted(((r["doc_id"] or -1, r["class_id"] or -1, r["kept"]) for r in near_duplicates(odd_docs(spark)).collect()))
    assert got == [(-1, -1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (4, 4, True)]  # two texts of one id
    kept = keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and len({(r["doc_id"], r["text"]) for r in kept.collect()}) == kept.count()
    assert near_duplicates(odd_docs(spark).limit(0)).count() == 0 and keep_one(odd_docs(spark).limit(0)).count() == 0


def test_draws_agree_as_often_as_weights_overlap():
    from lodestone.llm.near_dedup import icws

    rng = np.random.default_rng(6)
    h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    w = rng.uniform(0.5, 3, 300)
    v = np.where(rng.random(300) < 0.3, 0, w * rng.choice([1, 1, 2], 300))
    at = v > 0
    who, level = icws(np.concatenate([h, h[at]]), np.log(np.concatenate([w, v[at]])).astype(np.float32), [300, at.sum()], 4000)
    same = ((who[0] == who[1]) & (level[0] == level[1])).mean()
    assert same == pytest.approx(np.minimum(w, v).sum() / np.maximum(w, v).sum(), abs=0.03)


# 8 mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2 * sizes[s]
        free -= over
        left = 1.5 * sum(sizes.values()) - sum(target.values())


def test_mix_meets_its_targets(spark):
    from lodestone.llm.mixing import mix, op8_entropy_mix

    rows = op8_entropy_mix(spark, "/root/testdata/sf0.01").collect()
    text = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    sizes, taken = collections.Counter(), collections.Counter()
    for s, n in text.values():
        sizes[s] += n
    want = brute_targets(sizes)
    for r in rows:
        s, n = text[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 2 * n
        taken[s] += r["taken"]
    assert len(rows) == len(text) and all(taken[s] == pytest.approx(t, rel=0.01) for s, t in want.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op8_entropy_mix(spark, "/root/testdata/sf0.01").collect()))
    out = mix(odd_docs(spark).withColumn("target", F.lit("clash")))
    assert out.count() == 7 and {r["copies"] for r in out.filter("size = 0").collect()} == {1} and out.agg(F.max("copies")).first()[0] <= 2


def test_mix_of_no_rows(spark):
    from lodestone.llm.mixing import mix, mixed

    assert mix(odd_docs(spark).limit(0)).count() == 0 and mixed(odd_docs(spark)).columns == odd_docs(spark).columns


def test_rates_are_an_exponential_tilt(spark):
    from lodestone.llm.mixing import _rate, solve

    cells = spark.createDataFrame([("a", s, 10) for s in (5, 50, 500)] + [("b", 7, 100)], "k string, size long, c long")
    sources = spark.createDataFrame([("a", 5550, 450.0, 7000.0), ("b", 700, 7.0, 300.0)], "k string, source_size long, scale double, target double")
    dual = solve(cells, sources)
    out = cells.join(dual, "k").withColumn("r", _rate(2)).collect()
    assert sum(r["c"] * r["size"] * r["r"] for r in out if r["k"] == "a") == pytest.approx(7000, rel=1e-6)
    tilt = [np.log(r["r"] / (2 - r["r"])) / r["size"] for r in out if r["k"] == "a"]
    assert np.allclose(tilt, tilt[0])


# 9 lines


def brute_lines(docs, least=50):
    seen, out = set(), {}
    for i, text in docs:
        own, kill, mine = text.split("\n"), set(), []
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                run = tuple(own[a:b])
                if run in seen and sum(len(x.split()) for x in run) >= least:
                    kill.update(range(a, b))
            seen.update(tuple(own[a:b]) for b in range(a + 1, len(own) + 1))
        out[i] = "\n".join(x for j, x in enumerate(own) if j not in kill)
    return out


def test_line_runs_against_brute_force(spark):
    from lodestone.llm.line_dedup import dedup_lines

    rng = random.Random(7)
    kinds = ["a b c " * 5, "x " * 30, "y " * 60, "z", "", "q r s t " * 4, "u " * 20]
    rows = [(i, "\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)).collect()}
    want = brute_lines(rows)
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_lines"] == len(dict(rows)[k].split("\n")) and (r["n_chars"] == len(want[k]) if r["n_removed"] else r["n_chars"] == 1) for k, r in got.items())


def test_line_query_over_a_whole_table(spark):
    from lodestone.llm.line_dedup import op9_line_runs

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert {r["doc_id"]: r["text"] for r in op9_line_runs(spark, SF).collect()} == brute_lines(docs)


def test_line_dedup_of_odd_rows(spark):
    from lodestone.llm.line_dedup import dedup_lines, drop_copied_lines

    out = dedup_lines(odd_docs(spark).withColumn("n_lines", F.lit("clash")).withColumn("d", F.lit(1)))
    assert out.count() == 7 and out.filter("n_removed > 0").count() == 0 and out.filter("text is null").count() == 1
    assert dedup_lines(odd_docs(spark).limit(0)).count() == 0
    six = docs_of(spark, [(1, "\n".join(["w " * 30] * 6), "en", "s", 1)])
    assert dedup_lines(six).first()["text"] == "w " * 30  # copies that overlap
    long = "w " * 60
    twice = docs_of(spark, [(2, long, "en", "s", 1), (1, long, "en", "s", 1), (None, "k " * 55 + "\n" + long, "en", "s", 1)])
    assert {r["doc_id"] for r in drop_copied_lines(twice).collect()} == {None}


# 10 pages


def test_extraction_of_pages(spark):
    import html
    import re

    from lodestone.llm.html_text import best_region, extract, op10_html_text

    for r, p in zip(sorted(op10_html_text(spark, SF).collect()), sorted(spark.read.parquet(f"{SF}/pages.parquet").collect())):
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner.replace("<b>", "").replace("</b>", ""))).split())
        assert (r["page_id"], r["text"], r["n_chars"]) == (p["page_id"], want, len(want))
    assert extract("<div class=header>Site</div><div><h1>Hello</h1><p>Some main <b>te</b>xt &amp; &lt;b&gt; here.</p><div class=advert>Buy</div><ul><li>x <a href=y>y</a></li></ul></div><div class=comments><p>no</p></div><form>n<input></form>") == "Hello Some main text & <b> here. x y"
    assert [extract(x) for x in (None, "", "<nav>a b</nav>", "<!-- open", "<script>x", "<p")] == [""] * 6
    assert best_region([-1.0, 2.0, -1.0, 2.0, -5.0, 3.0]) == (1, 4)
    assert best_region([-1.0]) == (0, 0)


def test_extraction_of_unclosed_elements_and_wrappers():
    from lodestone.llm.html_text import extract

    story = "<p>The first river was wide and held for long.</p>" * 30
    said = " ".join(["The first river was wide and held for long."] * 30)
    for block in ("aside", "nav", "div class=comments"):
        many = "".join(f"<p class=x>note {i}" for i in range(100))
        deep = "".join(f"<div class=x>note {i}" for i in range(100))
        for inner in (many, deep):
            tail = "" if block.startswith("div") and inner is deep else story
            page = f"<body><article>{story}<{block}>{inner}</{block.split()[0]}>{tail}</article></body>"
            assert extract(page) == (f"{said} {said}" if tail else said)
    for tag in ("button", "select", "svg", "math", "object", "canvas", "noscript"):
        assert extract(f"<article>{story}<{tag}>{story}</article>").startswith(said) and extract(f"<div><{tag}></div><article>{story}</article>") == said
    foot = "<footer><p>Words at the end.</p></footer>"
    assert extract(f"<body class='has-sidebar'><article>{story}</article>{foot}</body>") == said
    for name in ("with-header", "search-results"):
        assert extract(f"<body><div class='{name}'><div class='page-sidebar'><h1>Told</h1>{story}</div></div>{foot}</body>") == f"Told {said}"
    assert extract(f"<body><article><h1>Told</h1>{story}</article><div class=comments>{story * 9}</div></body>") == f"Told {said}"


def test_names_with_unknown_words_only_lower_the_score():
    from lodestone.llm.html_text import extract

    story = "<p>The first river was wide and held for long.</p>" * 20
    said = " ".join(["The first river was wide and held for long."] * 20)
    aside = "<p>Some other words.</p>"
    for name in ("share-price", "ad-tech", "promoCode", "follow_up", "legal-history"):
        assert extract(f"<body><nav><a href=/>Home</a></nav><article>{story}<section class='{name}'>{story}</section>{story}</article></body>") == f"{said} {said} {said}"
    for name in ("related-articles", "ad-slot", "comment-list", "share-buttons", "site-footer", "promo"):
        assert extract(f"<body><article>{story}<div class='{name}'>{aside}</div>{story}</article><div class={name}>{aside}</div></body>") == f"{said} {said}"


def test_extraction_of_odd_rows(spark):
    from lodestone.llm.html_text import extract_text

    df = spark.createDataFrame([(1, None, None, "clash"), (None, "u", "<p>a&nbsp; b", "c"), (2, "u", "<p>x</p>" * 5000, "c"), (2, "u", "", "c")], "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["n_chars"]): r["text"] for r in extract_text(df).collect()}
    assert got[(1, 0)] == "" and got[(None, 3)] == "a b" and got[(2, 0)] == "" and (2, 9999) in got
    assert extract_text(df.limit(0)).count() == 0


# 11 language model scores


def lm_tokens(text):
    import re

    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w] + ["\n"]


def brute_scores(docs, weights):
    """n_tokens, n_known, train_tokens, base_score, score of each (doc_id, text), by dictionaries."""
    one, two, three, n_docs = collections.Counter(), collections.Counter(), collections.Counter(), 0
    grams = lambda text: [tuple(p) for w in [["", "", *lm_tokens(text)]] for p in zip(w, w[1:], w[2:], strict=False)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, text in docs:
        if not held(i):
            n_docs += 1
            for g in grams(text):
                one[g[2]] += 1
                two[g[1:]] += 1
                three[g] += 1
    n, v, out = sum(one.values()), len(one), []
    for i, text in docs:
        base = score = 0.0
        for at, (a, b, c) in enumerate(grams(text)):
            base += np.log10((one[c] + 1) / (n + v + 1))
            pair, word = (n_docs, n_docs) if at == 0 else (two[a, b], one[b])
            k = pair.bit_length() if pair else 64 + word.bit_length() if word else 128
            p = [three[a, b, c] / pair if pair else 0, two[b, c] / word if word else 0, one[c] / max(n, 1), 1 / (v + 1)]
            score += np.log10(np.dot(weights[k], p))
        words = lm_tokens(text)
        out.append((held(i), len(words), sum(one[w] > 0 for w in words), n, round(base, 6), round(score, 6)))
    return out


def lm_scores(monkeypatch, run):
    """The rows of a run, and the weights that it learned."""
    from lodestone.llm import ngram_lm

    kept, learned = [], ngram_lm.learned
    monkeypatch.setattr(ngram_lm, "learned", lambda *a, **k: kept.append(learned(*a, **k)) or kept[-1])
    return run().collect(), kept[0] if kept else None


def lm_row(r):
    return (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6))


def test_lm_scores_of_a_whole_table(spark, monkeypatch):
    from lodestone.llm.ngram_lm import op11_deleted_interpolation

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows, weights = lm_scores(monkeypatch, lambda: op11_deleted_interpolation(spark, SF))
    want = dict(zip((i for i, _ in docs), brute_scores(docs, weights), strict=True))
    assert {r["doc_id"]: lm_row(r) for r in rows} == want
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.85 * sum(r["base_score"] for r in held)  # far likelier than by words alone
    assert np.allclose(weights.sum(1), 1) and (weights[:, 3] > 0).all()


def test_lm_scores_of_odd_rows_and_texts_in_pieces(spark, monkeypatch):
    from lodestone.llm.ngram_lm import score

    rows = [(r["doc_id"], r["text"]) for r in odd_docs(spark).collect()] + [(7, "\n\t \x0b"), (8, "a b c a b c d"), (10, "x" * 300 + " y"), (19, "A b C")]
    rows += [(100 + i, "a b c " * (i % 5)) for i in range(60)]
    df = spark.createDataFrame([(i, t, "clash", 1.0, 1) for i, t in rows], "doc_id long, text string, held_out string, score double, block int")
    key = lambda i, r: (str(i), r)
    for sizes in ({}, {"size": 7, "piece": 50, "slice_keys": 64}):
        got, weights = lm_scores(monkeypatch, lambda sizes=sizes: score(df, **sizes))
        assert sorted(key(r["doc_id"], lm_row(r)) for r in got) == sorted(key(i, w) for (i, _), w in zip(rows, brute_scores(rows, weights), strict=True))
    assert score(df.limit(0)).count() == 0
    alone = score(df.filter("doc_id = 19")).first()  # remainder 2: nothing is learned from
    assert zlib.crc32(b"19") % 7 == 2 and (alone["held_out"], alone["n_known"], alone["train_tokens"], alone["base_score"]) == (True, 0, 0, 0.0) and alone["score"] < 0


def test_lm_weights_maximise_the_likelihood(spark):
    from lodestone.llm.ngram_lm import STEPS, learned

    rng = random.Random(2)
    cells = [(5, rng.randrange(-40, 0), rng.randrange(-60, -10), rng.randrange(-90, -40), rng.randrange(1, 50)) for _ in range(200)]
    weights = learned(spark.createDataFrame(cells, "bucket int, three int, two int, one int, n long"), {"kept_words": 1000}, rounds=300, tolerance=1e-7)[5]
    p = np.array([[2 ** (x / STEPS) for x in c[1:4]] + [1 / 1001] for c in cells])
    n = np.array([c[4] for c in cells])
    best = (n * np.log(p @ weights)).sum()
    for _ in range(200):
        other = np.abs(weights + np.array([rng.gauss(0, 0.05) for _ in range(4)]))
        assert (n * np.log(p @ (other / other.sum()))).sum() <= best + 5  # the few prior tokens aside


# 12 centroids


def brute_lloyd(vectors, clusters=8, rounds=10, size=64):
    kept = [(i, [int(np.floor(1024.0 * float(c))) for c in v]) for i, v in vectors if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), [c.to_bytes(4, "little", signed=True) for c in r[1]]))
    centroids = [v for _, v in order[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if groups[k] else c for k, c in enumerate(centroids)]
    at = [(i, *nearest(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, d, k in at:
        inertia[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), k, d, inertia[k], sum(inertia.values()), sha[k]) for i, d, k in at)


def lloyd_rows(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_lloyd_against_brute_force(spark):
    from lodestone.llm.lloyd import MOST, lloyd, op12_lloyd

    data = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert lloyd_rows(op12_lloyd(spark, SF)) == brute_lloyd(data)
    rng = random.Random(4)
    one = [float(rng.gauss(0, 3)) for _ in range(64)]
    odd = [(i, [rng.gauss(0, 2) for _ in range(64)]) for i in range(20)] + [(3, one), (3, one), (None, one), (None, [1.0] * 64), (50, None), (51, []), (52, [1.0] * 63), (53, [1.0] * 63 + [None]), (54, [1.0] * 63 + [float("nan")]), (55, [float("inf")] * 64), (56, [0.0] * 64), (57, [-1e4] * 64)]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in odd], "vec_id long, embedding array<double>, cluster string, v int")
    assert lloyd_rows(lloyd(df)) == brute_lloyd(odd)
    few = [x for x in odd if x[0] in (3, None)]
    assert lloyd_rows(lloyd(df.filter("vec_id = 3 or vec_id is null"))) == brute_lloyd(few)
    assert lloyd(df.limit(0)).count() == 0 and lloyd(df.filter("vec_id = 52")).count() == 0
    far = lloyd(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>"), clusters=1, rounds=0).collect()
    assert sorted(r["distance"] for r in far) == [0, 64 * (2 * MOST) ** 2]  # held, not out of 64 bits


# 13 filters


def brute_audit(docs, labels):
    import itertools
    import re

    marks = collections.defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            marks[i] = [marks[i][0] or int(quality == 1), marks[i][1] or int(toxic == 1)]
    least, out = {}, collections.Counter()
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    orders, parts = ["".join(p) for p in itertools.permutations("ABCDE")], set()
    for i, text, lang in docs:
        text, part = text or "", lang or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > least[text]), strict=True) if bad}
        parts.add(part)
        good, toxic = marks[i] if i is not None else (0, 0)
        for order in orders:
            first = next((s for s, f in enumerate(order, 1) if f in fails), 9)
            for step, f in enumerate(order, 1):
                key = (part, order, step)
                for what, n in (("kept", step < first), ("removed", step == first), ("redundant", step > first and f in fails), ("unique", fails == {f}), ("good", good * (step == first)), ("toxic", toxic * (step == first))):
                    out[(*key, what)] += int(n)
                if step == first:
                    for o in orders:
                        out[(part, o, o.index(f) + 1, "shapley")] += 1
    return sorted((p, o, s, *(out[p, o, s, w] for w in ("kept", "removed", "redundant", "unique", "good", "toxic", "shapley"))) for p in parts for o in orders for s in range(1, 6))


def audit_rows(df):
    return sorted((r["part"], r["filter_order"], r["step"], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect())


def test_audit_against_brute_force(spark):
    from lodestone.llm.filter_audit import audit

    rng = random.Random(6)
    plain = [" ".join(f"w{rng.randrange(400)}" for _ in range(250)) for _ in range(6)]
    texts = [*plain, "x " * 250, "short", "UPPER " * 210, plain[0] + " #", "", None, "é" * 30 + " A", "w " * 40_000, " \t"]
    docs = [(rng.randrange(40) if rng.random() < 0.9 else None, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for _ in range(300)]
    docs += [(i, "hot copy", "en") for i in range(1000, 1400)] + [(5, "tie", "en"), (5, "tie", "en"), (6, "tie", "fr"), (None, "lone", "fr"), (None, "lone", "fr"), (9, "lone", "fr")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(30)] + [(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None)]
    ldf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ddf = spark.createDataFrame([(*d, 1, "c", 0) for d in docs], "doc_id long, text string, lang string, mask int, part string, fp int")
    want = brute_audit(docs, labels)
    for n in (1, 4, 60):  # in 60 ranges the copies go on over many
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert audit_rows(audit(ddf, ldf)) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert audit(ddf.limit(0), ldf).count() == 0 and audit_rows(audit(ddf, ldf.limit(0))) == brute_audit(docs, [])


def test_texts_of_one_fingerprint_stay_apart(spark, monkeypatch):
    from lodestone.llm import filter_audit

    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *a: F.lit(7).cast("long") + 0 * F.length(a[0]))
    docs = [(i, t, "en") for i, t in enumerate("a b a c b c d a".split())]
    for n in (1, 3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = {r["doc_id"]: r["mask"] & 16 for r in filter_audit.masks(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == {0: 0, 1: 0, 2: 16, 3: 0, 4: 16, 5: 16, 6: 0, 7: 16}


def test_copies_of_a_group_are_near_in_a_large_table(spark):
    """Texts of a group share 500 of 610 shingles of each two; other documents have nothing in common with them."""
    from lodestone.llm.near_dedup import near_duplicates

    passage = [f"t{k}" for k in range(504)]
    rows = [(i, " ".join([*passage, *(f"v{i}x{k}" for k in range(55))])) for i in range(20)] + [(i, f"f{i} a b c d") for i in range(20, 20_000)]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 20 else i for i in range(20_000)}
