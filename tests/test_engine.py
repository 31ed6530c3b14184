"""Golden rows and invariants of the engine's operators, and every query against its SQL."""

import json
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from momentsift.functions import text as tx
from momentsift.operators import answers as an
from momentsift.operators import evaluation as ev
from momentsift.operators import frames as fr
from momentsift.operators import fulltext as ft
from momentsift.operators import fusion as fu
from momentsift.operators import segments as sg
from momentsift.operators import understanding as un
from momentsift.operators import vectors as ve
from momentsift.plans import registry
from momentsift.sources import readers, sinks
from momentsift.streaming import ingest

QUERIES, SQL = registry.queries(), registry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert name in SQL
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def candidates(spark):
    """Videos take turns, every score lower than the one before, keyframes ``step`` seconds apart."""

    def make(videos, images, step):
        out, score = [], 1.0
        for k in range(images):
            for v in range(videos):
                score -= 0.0001
                out.append((1, len(out) + 1, f"V{v:02d}", k + 1, round(k * step * 25), k * step, score))
        return spark.createDataFrame(out, "query_id long, rank int, video_id string, n int, frame_idx long, pts_time double, score double")

    return make


@pytest.mark.parametrize(("v", "k", "step", "kept"), [(60, 10, 2.0, 120), (60, 10, 30.0, 500), (5, 4, 2.0, 5)])
def test_dedupe_and_budget(candidates, v, k, step, kept):
    hits = candidates(v, k, step).where("rank <= 500")
    thin = fu.thin_out(hits, 10.0)
    assert thin.count() == kept
    assert fu.close_pairs(thin, 10.0).count() == 0
    assert rows(fu.thin_out(thin, 10.0).orderBy("rank")) == rows(thin.orderBy("rank"))
    kept_rows, counts = an.budget(an.answers_single(thin))
    assert kept_rows.count() == min(100, kept)
    total = counts.first()
    assert total["kept"] + total["duplicates"] + total["overflow"] == min(100, kept)


def test_window_border(spark):
    data = [(1, 1, "A", 0.0), (1, 2, "A", 10.0), (1, 3, "A", 9.9), (1, 4, "A", 20.1), (1, 5, "B", 9.9), (1, 6, "A", 30.05)]
    df = spark.createDataFrame(data, "query_id long, rank int, video_id string, pts_time double")
    tags = {r["rank"]: r["tag"] for r in fu.tag_by_window(df, 10.0).collect()}
    assert tags == {1: "kept", 2: "kept", 3: "near", 4: "kept", 5: "kept", 6: "near"}
    capped = {r["rank"]: r["tag"] for r in fu.tag_by_window(df, 10.0, cap=2).collect()}
    assert capped == {1: "kept", 2: "kept", 3: "cap", 4: "cap", 5: "kept", 6: "cap"}
    report = fu.dedupe_report(fu.tag_by_window(df, 10.0, cap=2)).first()
    assert tuple(report) == (1, 6, 3, 0, 3)


def test_fusion(spark):
    data = [("clip", "A", 1, 100), ("clip", "B", 2, 100), ("clip", "A", 3, 100), ("ocr", "B", 1, 100), ("asr", "C", 1, 7)]
    df = spark.createDataFrame([(1, s, v, r, f, f, f / 25, 1.0) for s, v, r, f in data], "query_id long, source string, video_id string, rank int, frame_idx long, n long, pts_time double, score double")
    fused = {r["video_id"]: r for r in fu.fuse_hits(df, ("clip", "ocr", "asr"), {"clip": 1.0, "ocr": 0.45}).collect()}
    assert fused["A"]["score"] == pytest.approx(1 / 61) and fused["B"]["score"] == pytest.approx(1 / 62 + 0.45 / 61) and fused["C"]["score"] == pytest.approx(1 / 61)
    assert [fused[v]["rank"] for v in "BAC"] == [1, 2, 3] and fused["B"]["source"] == "clip+ocr"
    ranks = {r["video_id"]: r["ranks"] for r in fu.weighted_rrf(df, {}).collect()}
    assert ranks == {"A": "clip:1", "B": "clip:2,ocr:1", "C": "asr:1"}
    modes = fu.source_mix(df, {"clip": ("clip",), "all": ("clip", "ocr", "asr")}, ("clip", "ocr", "asr"), {}).groupBy("mode").count()
    assert dict(rows(modes)) == {"clip": 2, "all": 3}


def test_intervals(spark):
    frames = spark.createDataFrame([("A", k, k * 25, float(k)) for k in range(30)], "video_id string, n int, frame_idx long, pts_time double")
    spans = spark.createDataFrame([("A", 1, 3.0, 5.0, 0.5), ("A", 2, 0.0, 29.0, 0.1), ("A", 3, 5.5, 5.6, 1.0), ("B", 4, 0.0, 9.0, 1.0)], "video_id string, seg int, start double, end_sec double, score double")
    got = Counter((r["seg"], r["n"]) for r in fu.expand_intervals(spans, frames, 8, cell=2.0).collect())
    assert got == Counter([(1, n) for n in (3, 4, 5)] + [(2, n) for n in range(8)])


def test_sequences(candidates):
    found, short = an.answers_sequence(candidates(60, 6, 12.0), 4)
    got = found.collect()
    assert len(got) == 60 and all(r["frame_ids"] == sorted(r["frame_ids"]) and len(r["frame_ids"]) == 4 for r in got)
    assert short.first()["short_videos"] == 0
    assert an.answers_sequence(candidates(5, 3, 12.0), 4)[0].count() == 0


def test_lines(spark):
    data = [(1, 1, "L21_V001", [1500], None, "kis"), (1, 2, "L21_V001", [3450], 'màu, "xanh"', "qa"), (1, 3, "L21_V001", [10, 20, 30], None, "trake"), (1, 4, "A", [-1], None, "kis"), (1, 5, "A", [1], " ", "qa"), (1, 6, "", [1], None, "kis"), (1, 7, "A", [], None, "kis")]
    df = spark.createDataFrame(data, "query_id long, rank int, video_id string, frame_ids array<long>, answer string, task string")
    got = {r["rank"]: (r["line"], r["violation"]) for r in an.to_lines(df).collect()}
    assert got[1] == ("L21_V001,1500", None) and got[2] == ('L21_V001,3450,"màu, ""xanh"""', None) and got[3] == ("L21_V001,10,20,30", None)
    assert [got[k][1] for k in (4, 5, 6, 7)] == ["negative frame", "no answer", "no video", "no frame"]
    back = {r["rank"]: r for r in readers.parse_submission_lines(an.to_lines(df.where("rank <= 3")).join(df.select("rank", "task"), "rank")).collect()}
    # ranks restart in each file, and each task is a file here
    assert {r["answer"] for r in readers.parse_submission_lines(an.to_lines(df.where("rank = 2")).withColumn("task", F.lit("qa"))).collect()} == {'màu, "xanh"'}
    assert back


def test_budget_counts(spark):
    data = [(1, k + 1, "A", [k % 4], " Yes " if k % 2 else "yes") for k in range(12)]
    df = spark.createDataFrame(data, "query_id long, rank int, video_id string, frame_ids array<long>, answer string")
    kept, counts = an.budget(df, 3)
    assert [r["frame_ids"] for r in kept.orderBy("rank").collect()] == [[0], [1], [2]]
    assert tuple(counts.first()) == (1, 3, 6, 3)


def test_scores(spark):
    one = spark.range(1)
    s = lambda c: one.select(c.alias("x")).first()["x"]
    moment = lambda v, f: s(ev.score_moment(F.lit(v), F.lit(f), F.lit("A"), F.lit(500), F.lit(510)))
    assert [moment("A", 505), moment("A", 600), moment("B", 505), moment("A", 510)] == [1, 0, 0, 1]
    events = lambda e: F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in e])
    four = events([(95, 105), (145, 155), (195, 205), (245, 255)])
    frames = lambda *f: F.array(*map(F.lit, f))
    assert s(ev.score_sequence(F.lit("A"), frames(101, 156, 203, 251), F.lit("A"), four)) == 0.75
    assert s(ev.score_sequence(F.lit("B"), frames(101, 156, 203, 251), F.lit("A"), four)) == 0
    assert s(ev.score_sequence(F.lit("A"), frames(2923), F.lit("A"), events([(2922, 2925), (2962, 2972)]))) == 0.5
    assert s(ev.score_sequence(F.lit("A"), frames(1), F.lit("A"), F.array().cast("array<struct<s:int,e:int>>"))) == 0
    scored = spark.createDataFrame([(1, 1, 0.5), (1, 3, 0.8), (1, 15, 0.6)], "query_id long, rank int, r double")
    got = ev.recall_at_k(scored, spark.createDataFrame([(1,), (2,)], "query_id long")).orderBy("query_id").collect()
    assert got[0]["r_at_1"] == 0.5 and got[0]["r_at_5"] == got[0]["r_at_100"] == 0.8 and got[0]["final"] == pytest.approx(0.74) and got[1]["final"] == 0
    match = lambda a, b, c=None: s(ev.answer_match(F.lit(a), F.lit(b), F.lit(c).cast("double")))
    assert match("  Màu XANH!!  ", "màu xanh") and match("má", "má") and not match("má", "ma") and match("x", "y", 0.80) and not match("x", "y", 0.79) and not match("", "y", 1.0)
    assert match("", None)


def test_normalisation(spark):
    one = spark.range(1)
    s = lambda c: one.select(c.alias("x")).first()["x"]
    assert s(tx.fold(F.lit("ĐƯỜNG Nguyễn ﬁn Å"))) == "đuong nguyen fin a" and s(tx.fold_d(F.lit("Đường"))) == "duong"
    assert s(tx.normal_answer(F.lit("Năm (5) người."))) == "năm 5 người" and s(tx.normal_answer(F.lit(None).cast("string"))) == ""
    assert s(tx.has_diacritics(F.lit("né"))) and not s(tx.has_diacritics(F.lit("đ plain ß")))
    assert s(tx.squeeze(F.lit("  a \n b "))) == "a b"


@pytest.mark.parametrize(("text", "n"), [("(1) a (2) b (3) c (4)", 4), ("( 1 ) x ( 2 )", 2), ("(5) men", None), ("(1655-1735)", None), ("(2) (3) (4)", None), ("(1) only", None), ("", None), (None, None)])
def test_milestones(spark, text, n):
    assert spark.range(1).select(un.count_milestones(F.lit(text).cast("string")).alias("x")).first()["x"] == n


def test_milestone_priority(spark):
    six = F.array(*[F.lit("s")] * 6)
    none = F.lit(None).cast("array<string>")
    text = F.lit("(1) (2) (3) (4) (5) (6)")
    got = [tuple(spark.range(1).select(*un.resolve_milestones(F.lit(d).cast("int"), st, t)).first()) for d, st, t in ((3, six, text), (None, six, F.lit("")), (None, none, text), (None, none, F.lit("x")), (0, none, F.lit("x")))]
    assert got == [(3, "declared"), (6, "stages"), (6, "text"), (4, "default"), (4, "default")]


def test_keywords(spark):
    """Exact lists: cues and end words, phrases that another character drops, years and their neighbours, runs of names, pieces inside words."""
    cases = {
        'biển hiệu "Phở Hà Nội" và BURBERRY năm 2005': ["burberry", "pho ha noi"],
        "dòng chữ Mạc Cửu 1655-1735, phía sau": ["1655-1735", "mac cuu", "mac cuu 1655-1735"],
        "chữ màu xanh trên nền": [],
        "chữ đặt Huế đặt gần. biển 24": ["đat hue"],
        "CHỮ Sông Hương (cũ), bảng tên\n Nguyễn Huệ bên 2001": ["nguyen hue"],
        "mang tên Lê-Lợi 20052006 - 2007 phía": ["2005", "2006 - 2007", "le-loi 20052006 - 2007"],
        "bảng  ghi Huế, hiệu Đà Lạt và Hà Nội": ["ha noi", "đa lat", "đa lat va ha noi"],
        "khẩu hiệu TP-HCM 19": ["tp-hcm", "tp-hcm 19"],
        "xchữ abcDefg Hij klm.": ["abcdefg hij klm", "defg hij"],
        "chữ - biển Nha Trang": ["nha trang"],
        "chữ": [],
        "": [],
        None: [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["k"] for r in df.select("t", un.extract_keywords(F.col("t")).alias("k")).collect()}
    assert got == {t: sorted(k) for t, k in cases.items()}


@pytest.fixture
def few_buckets(monkeypatch):
    monkeypatch.setattr(ft, "BUCKETS", 8)


TEXTS = [(1, "TP-HCM mưa lớn, PHÁ án"), (2, "phá TP HCM"), (3, "HCM TP"), (4, "thời sự 19h"), (5, "thời tiết"), (6, "")]


def search(spark, index, q, **k):
    return {r["doc_id"]: r["score"] for r in ft.bm25(spark.createDataFrame([(1, q)], "query_id long, text string"), index, 10, key="doc_id", **k).collect()}


def test_full_text(spark, tmp_path, few_buckets):
    index = ft.TextIndex(spark, str(tmp_path / "index")).build(spark.createDataFrame(TEXTS, "doc_id long, text string"), "doc_id")
    found = lambda q, **k: set(search(spark, index, q, **k))
    assert found("TP-HCM PHÁ") == {1, 2}
    assert found("THỜI SỰ") == {4} and found("THỜI SỰ XYZ") == {4, 5} and found("THỜI SỰ XYZ", fallback=False) == set()
    assert found("   ") == set() and found("\"quote\" injection'--") == set()
    assert found("sự --", fallback=False) == set()
    idf, avg = math.log((6 - 1 + 0.5) / 1.5), (6 + 3 + 2 + 3 + 2 + 0) / 6
    assert search(spark, index, "tiết")[5] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg)), abs=1e-8)


def test_index_grows_and_reads_only_asked_files(spark, tmp_path, few_buckets):
    """Appended documents score as in a full rebuild, replaced ones too; a search opens the files of its terms' buckets; old segments count until a new one is whole."""
    new = [(7, "mưa TP mới"), (8, None), (9, "sự phá án phá")]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    index = ft.TextIndex(spark, str(tmp_path / "grown")).build(frame(TEXTS), "doc_id").append(frame(new), "doc_id")
    whole = ft.TextIndex(spark, str(tmp_path / "whole")).build(frame(TEXTS + new), "doc_id")
    asked = ("TP-HCM PHÁ", "phá án mới")
    assert len(index.segments()) == 2
    for q in asked:
        assert search(spark, index, q) == search(spark, whole, q) != {}
    assert rows(index.term_statistics().orderBy("term")) == rows(whole.term_statistics().orderBy("term")) and index.totals() == whole.totals()

    changed = [(1, "án TP"), (10, "phá")]
    index.append(frame(changed), "doc_id")
    again = ft.TextIndex(spark, str(tmp_path / "again")).build(frame([r for r in TEXTS + new if r[0] != 1] + changed), "doc_id")
    assert len(index.segments()) == 1
    for q in asked:
        assert search(spark, index, q) == search(spark, again, q)
    index.append(frame([(11, "tp")]), "doc_id").merge()
    assert len(index.segments()) == 1 and set(search(spark, index, "tp")) >= {1, 11}
    index.remove_replaced()
    assert set(search(spark, index, "tp")) >= {1, 11} and len(os.listdir(index.path)) == 1

    terms = frame([(0, "phá")]).select(tx.terms(F.col("text"))[0].alias("term"))
    found = index.postings(terms)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    kept = index._table("postings")
    assert kept.join(terms, "term").select("bucket").distinct().count() == 1 and kept.select("bucket").distinct().count() > 3

    os.remove(f"{index.path}/{index.segments()[0]}/totals/_SUCCESS")
    with pytest.raises(ValueError, match="no index"):
        index.totals()


def test_keywords_by_positions(spark, tmp_path, few_buckets):
    """The same as looking into the folded text, for words, parts of words, phrases, odd separators, several segments."""
    texts = [(1, "Phở Hà Nội 2005"), (2, "phohanoi ab"), (3, None), (4, "ha, noi ha noi"), (5, "(ha noi)"), (6, "xha noiy-ha  noi"), (7, "ha\nnoi ha"), (8, "ab-ab-ab cab"), (9, "...")]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    index = ft.TextIndex(spark, str(tmp_path / "index")).build(frame(texts[:5]), "doc_id", fold=tx.fold).append(frame(texts[5:]), "doc_id", fold=tx.fold)
    keywords = ["pho ha noi", "hano", "a", "pho", "--", "ha noi", "ha, noi", "(ha", "noi)", "a noi", "a  no", "noi ha", "ab-ab", "b-a", "-ab ", "ab c", "ha\nn", "zz", "ha noi ", "oi 20", "noiy-h", ""]
    folded = {r["doc_id"]: r["t"] for r in frame(texts).select("doc_id", tx.fold(F.col("text")).alias("t")).collect()}
    want = {(k, d) for k in keywords for d, t in folded.items() if t and k in t and any(c.isalnum() for c in k)}
    got = {(r["keyword"], r["key"]) for r in ft.keyword_hits(spark.createDataFrame([(k,) for k in keywords], "keyword string"), index).collect()}
    assert got == want
    found = ft.keyword_search(spark.createDataFrame([(1, "ha noi"), (1, "ab"), (1, "ab"), (2, "zz"), (3, None)], "query_id long, keyword string"), index, 3, ["key"]).collect()
    assert [(r["query_id"], r["rank"], r["key"], r["score"]) for r in found] == [(1, 1, 1, 2), (1, 2, 2, 2), (1, 3, 4, 2)]


def test_repeats_and_tiers(spark):
    data = [("A", float(k), k + 1.0, t) for k, t in enumerate(["x", "x", "x", "y", "x", "x", "x", "x"])] + [("B", 0.0, 1.0, "hãy subscribe Đi")]
    df = spark.createDataFrame(data, "video_id string, start double, end_sec double, text string")
    kept, cut = sg.cap_repeats(df)
    assert [r["start"] for r in kept.where("video_id = 'A'").orderBy("start").collect()] == [0, 1, 3, 4, 5] and dict(rows(cut)) == {"A": 3, "B": 0}
    left, log = sg.purge_tier1(df, ["subscribe di"], ["x"])
    assert rows(left.where("video_id = 'B'").select("text")) == [("",)] and rows(log) == [("B", 1, 0, "subscribe di")]


def test_frame_checks(spark):
    good = spark.createDataFrame([("A", 1, 0.0, 25.0, 0), ("A", 2, 4.0, 25.0, 100), ("A", 3, 12.52, 25.0, 313)], "video_id string, n int, pts_time double, fps double, frame_idx long")
    assert fr.check_frame_map(good).where("not ok").count() == 0
    bad = good.unionByName(good.limit(1)).withColumn("frame_idx", F.col("frame_idx") + 5)
    assert {r["check"] for r in fr.check_frame_map(bad).where("not ok").collect()} == {"duplicate_keys", "max_drift"}
    asked = spark.createDataFrame([("A", 2.0), ("A", 8.26), ("A", -1.0), ("A", 99.0), ("Z", 1.0)], "video_id string, t double")
    assert {r["t"]: r["n"] for r in fr.nearest_by_time(asked, good).collect()} == {2.0: 1, 8.26: 2, -1.0: 1, 99.0: 3, 1.0: None}
    with pytest.raises(Exception, match="several frame rates in A"):
        fr.require_constant_fps(good.withColumn("fps", F.col("n").cast("double"))).collect()


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 16)).astype(np.float32)
    np.save(tmp_path / "V01.npy", m)
    v = readers.read_vector_files(spark, str(tmp_path), 16)
    assert v.count() == 300
    q = spark.createDataFrame([(k, m[k].tolist()) for k in range(5)], "query_id long, embedding array<float>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for block in (1024, 2):
        got = ve.knn_topk(v, q, 7, block=block).collect()
        for k in range(5):
            want = np.argsort(-(unit.astype(float) @ unit[k].astype(float)), kind="stable")[:7] + 1
            assert [r["n"] for r in sorted((r for r in got if r["query_id"] == k), key=lambda r: r["rank"])] == want.tolist()
    with pytest.raises(ValueError, match="zero or not finite"):
        ve.knn_topk(v, spark.createDataFrame([(1, [0.0] * 16)], "query_id long, embedding array<float>"), 3)
    assert ve.self_cosine(v, v.where("n <= 20").select("video_id", "n")).where("ok").count() == 20


def test_keyframe_csv(spark, tmp_path):
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "L01_V001.csv").write_text("﻿n,pts_time,fps,frame_idx\n1,0.0,25.0,0\n2,4.0,25.0,100.0\n3,12.52,25.0,313\n", "utf-8")
    table, rejects = readers.read_keyframe_csv(spark, str(tmp_path / "ok"))
    assert rows(table.orderBy("n"))[1] == ("L01_V001", 2, 4.0, 25.0, 100) and rejects.count() == 0
    (tmp_path / "blank").mkdir()
    (tmp_path / "blank" / "L01_V002.csv").write_text("n,pts_time,fps,frame_idx\n1,,25.0,0\n2,4.0,25.0,100\n")
    assert readers.read_keyframe_csv(spark, str(tmp_path / "blank"), strict=False)[0].count() == 1
    assert readers.read_keyframe_csv(spark, str(tmp_path / "blank"), strict=False)[1].count() == 1
    with pytest.raises(Exception, match="blank or malformed cell in L01_V002"):
        readers.read_keyframe_csv(spark, str(tmp_path / "blank"))[0].collect()
    (tmp_path / "order").mkdir()
    (tmp_path / "order" / "L01_V003.csv").write_text("pts_time,n,fps,frame_idx\n0.0,1,25.0,0\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_keyframe_csv(spark, str(tmp_path / "order"))[0].collect()


def test_sinks_and_readers(spark, tmp_path):
    frames = spark.createDataFrame([("A", 1, 0.0, 25.0, 0), ("A", 2, 4.0, 25.0, 100)], "video_id string, n int, pts_time double, fps double, frame_idx long")
    sinks.write_frame_map(frames, f"{tmp_path}/map")
    assert readers.as_frame_map(spark.read.parquet(f"{tmp_path}/map")).count() == 2
    with pytest.raises(ValueError, match="duplicate_keys"):
        sinks.write_frame_map(frames.unionByName(frames), f"{tmp_path}/map")
    assert spark.read.parquet(f"{tmp_path}/map").count() == 2
    with pytest.raises(ValueError, match="lacks columns: fps"):
        readers.as_frame_map(frames.drop("fps"))

    os.makedirs(f"{tmp_path}/ocr")
    with open(f"{tmp_path}/ocr/L01_V001.jsonl", "w", encoding="utf-8") as f:
        f.write(json.dumps({"n": 1, "text": "Ă", "boxes": [{"text": "a", "bbox": [1, 2, 3, 4], "conf": 0.9}]}) + "\nnot json\n" + json.dumps({"n": None, "text": " ", "frame_idx": 5}) + "\n")
    got = readers.read_ocr_jsonl(spark, f"{tmp_path}/ocr").orderBy("frame_idx").collect()
    assert [(r["video_id"], r["n"], r["frame_idx"]) for r in got] == [("L01_V001", 1, 0), ("L01_V001", None, 5)]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_ocr_for_index(spark, f"{tmp_path}/ocr").collect()

    os.makedirs(f"{tmp_path}/subs")
    with open(f"{tmp_path}/subs/query-q1-qa.csv", "w", encoding="utf-8") as f:
        f.write('L1,20,"a, b"\n\nL2,30,c\n')
    with open(f"{tmp_path}/subs/query-q2-trake.csv", "w", encoding="utf-8") as f:
        f.write("L1,1,2,3\n")
    got = {(r["query_id"], r["rank"]): (r["task"], r["video_id"], r["frame_ids"], r["answer"]) for r in readers.read_submissions(spark, f"{tmp_path}/subs").collect()}
    assert got == {("q1", 1): ("qa", "L1", [20], "a, b"), ("q1", 2): ("qa", "L2", [30], "c"), ("q2", 1): ("trake", "L1", [1, 2, 3], None)}

    with open(f"{tmp_path}/queries.jsonl", "w", encoding="utf-8") as f:
        f.write(json.dumps({"id": "7", "loai_truy_van": "mô_tả", "cau_hoi": "tìm"}) + "\n" + json.dumps({"query_id": "8", "task": "qa"}) + "\n")
    got = {r["query_id"]: (r["task"], r["error"]) for r in readers.read_queries(spark, f"{tmp_path}/queries.jsonl").collect()}
    assert got == {"7": ("kis", None), "8": ("qa", "empty text")}
    with open(f"{tmp_path}/queries.jsonl", "a", encoding="utf-8") as f:
        f.write("{broken\n")
    with pytest.raises(Exception, match="not JSON"):
        readers.read_queries(spark, f"{tmp_path}/queries.jsonl").collect()

    lines = spark.createDataFrame([("q1", "kis", k, f"A,{k}") for k in range(1, 6)], "query_id string, task string, rank int, line string")
    sinks.write_submission(lines, f"{tmp_path}/out")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out/query-q1-kis.csv").collect()] == [f"A,{k}" for k in range(1, 6)]
    sinks.append_log(lines.limit(1), f"{tmp_path}/log")
    sinks.append_log(lines.limit(2), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 3
    sinks.write_scores(lines, f"{tmp_path}/scores")
    assert spark.read.option("header", True).csv(f"{tmp_path}/scores").count() == 5


def test_streams(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")

    def add(name, *records):
        with open(f"{tmp_path}/in/{name}.jsonl", "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r) + "\n" for r in records)

    def run():
        ingest.ingest_speech(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", ["license"], ["@"]).awaitTermination()
        return {(r["start"], r["end_sec"], r["tier"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    add("a", {"video_id": "A", "start": -1.0, "end": 2.0, "text": "hello"}, {"video_id": "A", "start": 3.0, "end": 2.0, "text": "x@y"}, {"video_id": "A", "start": 4.0, "end": 5.0, "text": "License"}, {"video_id": "A", "start": 6.0, "end": 7.0, "text": " "})
    assert run() == {(0.0, 2.0, None), (3.0, 3.0, 2)}
    add("b", {"video_id": "B", "start": 8.0, "end": 9.0, "text": "new"})
    assert run() == {(0.0, 2.0, None), (3.0, 3.0, 2), (8.0, 9.0, None)}


def test_no_python_in_plans(spark, sf_dir):
    """Only vector search and vector files leave the JVM."""
    for name in ("F5_fuse_hits", "F7_time_window_dedupe", "T8_bm25_or_fallback", "E5_purge_tier1", "G7_mode_comparison", "B8_nearest_by_time"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert ("MapInPandas" in QUERIES["F17_end_to_end"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString())


def test_submission_round_trip(spark, tmp_path):
    """Named files, in order of rank, with more frames than any fixed width; malformed lines fail."""
    many = ",".join(map(str, range(200)))
    lines = [("a b", "kis", 2, "V1,8"), ("a b", "kis", 1, "V1,7"), ("7", "trake", 1, f"V2,{many}"), ("8", "qa", 1, 'V3,9,"x, ""y"""')]
    path = str(tmp_path / "out")
    sinks.write_submission(spark.createDataFrame(lines, "query_id string, task string, rank int, line string"), path)
    assert {f for f in os.listdir(path) if f.endswith(".csv") and not f.startswith(".")} == {"query-a b-kis.csv", "query-7-trake.csv", "query-8-qa.csv"}
    assert (tmp_path / "out" / "query-7-trake.csv").read_text() == f"V2,{many}\n"
    df = spark.createDataFrame(lines, "query_id string, task string, rank int, line string")
    got = {(r["query_id"], r["rank"]): (r["video_id"], r["frame_ids"], r["answer"]) for r in readers.parse_submission_lines(df).collect()}
    assert got["7", 1] == ("V2", list(range(200)), None) and got["8", 1] == ("V3", [9], 'x, "y"') and got["a b", 1] == ("V1", [7], None)
    for bad in ("V,,7,8", "V,x", ",7"):
        df = spark.createDataFrame([("1", "trake", 1, bad)], "query_id string, task string, rank int, line string")
        with pytest.raises(Exception, match="malformed line"):
            readers.parse_submission_lines(df).collect()


def test_lines_of_split_files(spark, tmp_path):
    """Lines keep the order of their file over splits of 64 bytes, with a byte order mark, carriage returns and blanks."""
    lines = [f"V{k:03d},{k}" if k % 7 else "" for k in range(1, 200)]
    (tmp_path / "query-a b+c-kis.csv").write_bytes(("\ufeff" + "\r\n".join(lines) + "\r\n").encode())
    (tmp_path / "query-2-kis.csv").write_text("W1,5")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "64")
        found = readers.numbered_lines(spark, str(tmp_path))
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = sorted((r["row"], r["value"]) for r in found.where("file like '%a b+c-kis.csv'").collect())
        ranked = {(r["query_id"], r["rank"]): r["frame_ids"] for r in readers.read_submissions(spark, str(tmp_path)).collect()}
    finally:
        for n, v in kept.items():
            spark.conf.set(n, v)
    assert got == list(enumerate(lines, 1))
    whole = [k for k in range(1, 200) if k % 7]
    assert ranked == {("a b+c", r): [k] for r, k in enumerate(whole, 1)} | {("2", 1): [5]}


def test_manifests_stream_their_groups(spark):
    """Digests over sorted rows across batches; null keys and texts, ties, groups without a text, an empty table."""
    from hashlib import sha256

    data = [("A", float(k % 50), k, "e", f"t{k}", k + 1.0) for k in range(300)] + [("B", 1.0, 1, "e", None, 2.0), (None, 1.0, 1, None, "x", 2.0)]
    schema = "video_id string, start double, seg int, engine string, text string, end_sec double"
    df = spark.createDataFrame(data, schema).repartition(7)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {r["video_id"]: (r["rows"], r["sha256"]) for r in sg.segment_manifest(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    text = "\n".join(t for _, _, t in sorted((s, n, t) for v, s, n, _, t, _ in data if v == "A"))
    want = {"A": (300, text), "B": (1, ""), None: (1, "x")}
    assert got == {k: (n, sha256(t.encode()).hexdigest()) for k, (n, t) in want.items()}
    assert sg.segment_manifest(df.limit(0)).collect() == []


def test_compatibility_forms_are_folded(spark):
    import unicodedata

    cases = ["１２ ½ … ㎏ ①", "ﬁne Ǆ", "Phở", "x²"]
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in df.select("t", tx.fold(F.col("t")).alias("f")).collect():
        assert r["f"] == "".join(c for c in unicodedata.normalize("NFKD", r["t"]) if not unicodedata.combining(c)).lower()


def test_search_without_queries(spark):
    v = spark.createDataFrame([("V", 1, [1.0, 0.0]), ("V", 2, None)], "video_id string, n int, embedding array<double>")
    assert ve.knn_topk(v, spark.createDataFrame([], "query_id long, embedding array<double>"), 5).count() == 0
    assert ve.knn_topk(v, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>"), 5).count() == 1


def test_running_best_of_a_task(spark):
    """Many batches, more equal vectors than ranks: the smallest keys, and no more rows a task than queries x k."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8)).round(1)
    data = [(f"V{k % 7}", k, base[k % 40 if k % 3 else 0].tolist()) for k in range(3000)]
    v = spark.createDataFrame(data, "video_id string, n int, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(k, base[k].tolist()) for k in range(6)], "query_id long, embedding array<double>")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = ve.knn_topk(v, q, 9).collect()
        unit = base / np.linalg.norm(base, axis=1, keepdims=True)
        rows_out = ve._knn_block(v, list(range(6)), unit[:6], 9, ("video_id", "n")).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert rows_out <= 3 * 6 * 9
    m = np.array([d[2] for d in data])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for k in range(6):
        s = np.round(m @ unit[k], 9)
        want = sorted(range(3000), key=lambda i: (-s[i], data[i][0], data[i][1]))[:9]
        assert [(r["video_id"], r["n"]) for r in sorted((r for r in found if r["query_id"] == k), key=lambda r: r["rank"])] == [data[i][:2] for i in want]


def test_thinning_is_linear_and_greedy(spark):
    """15,000 candidates of one video, borders, missing times and caps, against a plain greedy loop; groups over many batches."""
    import random

    rng = random.Random(7)
    data = [(1, k + 1, "A", None if k % 997 == 5 else rng.choice([round(rng.random() * 60_000, 1), rng.randrange(6000) * 10.0])) for k in range(15_000)]
    data += [(q, k + 1, v, float(k * 3)) for q in (1, 2) for v in "BC" for k in range(40)]
    df = spark.createDataFrame(data, "query_id long, rank int, video_id string, pts_time double").repartition(5)
    for cap in (None, 30):
        want = {}
        for q, v in {(d[0], d[2]) for d in data}:
            cells, n = {}, 0
            for _, r, _, t in sorted(d for d in data if (d[0], d[2]) == (q, v)):
                near = t is not None and any(abs(x - t) < 10.0 - 1e-9 for c in (-1, 0, 1) for x in cells.get(int(t // 10) + c, []))
                tag = "cap" if cap is not None and n >= cap else "near" if near else "kept"
                if tag == "kept":
                    n += 1
                    if t is not None:
                        cells.setdefault(int(t // 10), []).append(t)
                want[q, v, r] = tag
        assert {(r["query_id"], r["video_id"], r["rank"]): r["tag"] for r in fu.tag_by_window(df, 10.0, cap).collect()} == want
    assert fu.tag_by_window(df.where("false"), 10.0).count() == 0
    assert {r["tag"] for r in fu.tag_by_window(df, 0.0).collect()} == {"kept"}


def test_sequences_from_a_wide_pool(candidates, spark):
    """Only the pool's hits count, each query has its own number of moments."""
    hits = candidates(4, 50, 12.0)
    hits = hits.unionByName(hits.withColumn("query_id", F.lit(2).cast("long")))
    moments = spark.createDataFrame([(1, 3), (2, 5)], "query_id long, milestones int")
    rows_, short = an.answers_sequence(hits, moments, pool=14)
    got = {(r["query_id"], r["video_id"]): r["frame_ids"] for r in rows_.collect()}
    assert {k[0] for k in got} == {1} and len(got) == 4 and all(len(f) == 3 and f == sorted(f) for f in got.values())
    assert dict(rows(short)) == {1: 0, 2: 4}
    assert an.answers_sequence(hits, moments, pool=20)[0].where("query_id = 2").count() == 4
