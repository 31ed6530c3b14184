"""Users and conversations of five digits share the names of videos: the same rows as the SQL then."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from momentsift.sources import readers, sinks


@pytest.fixture(scope="module")
def shared_dir(spark, sf_dir, tmp_path_factory):
    """The small tables twice, the first with users from 1000 on, the second from 10000 on."""
    out = str(tmp_path_factory.mktemp("shared"))
    c = duckdb.connect()
    twice = "(VALUES (0, 1000), (1, 10000)) x(r, shift)"
    c.execute(f"COPY (SELECT t.* REPLACE (event_id + 1000000 * r AS event_id, user_id + shift AS user_id, ts + to_milliseconds(r * 1234567) AS ts, value + r * 0.001 AS value) FROM '{sf_dir}/events.parquet' t, {twice}) TO '{out}/events.parquet'")
    c.execute(f"COPY (SELECT t.* REPLACE (conv_id + shift AS conv_id) FROM '{sf_dir}/conversations.parquet' t, {twice}) TO '{out}/conversations.parquet'")
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"COPY (SELECT * FROM '{sf_dir}/{t}.parquet') TO '{out}/{t}.parquet'")
    return out


def _differ(spark, shared_dir, name):
    c = duckdb.connect()
    for t in ("events", "conversations", "documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{shared_dir}/{t}.parquet'")
    plain = lambda v: round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list | tuple) else v
    result = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted(map(repr, map(plain, result.fetchall())))
    got = sorted(map(repr, map(plain, map(tuple, entry.queries()[name](spark, shared_dir).select(*[f"`{n}`" for n in names]).collect()))))
    return got, want


@pytest.mark.parametrize("name", ["B15_duplicate_frames", "B6_check_frame_map", "C2_l2_normalise", "E15_rejected_rows", "F10_close_pairs", "F11_score_cut", "F12_asset_status", "F13_answers_single"])
def test_frames_are_numbered_within_users(spark, shared_dir, name):
    got, want = _differ(spark, shared_dir, name)
    assert want and got == want


def test_every_row_of_a_repeated_key_has_its_status(spark, shared_dir):
    got, want = _differ(spark, shared_dir, "B12_compare_with_source")
    assert any("repeated" in r for r in want) and got == want


def test_a_time_asked_by_several_conversations_is_one_row(spark, shared_dir):
    got, want = _differ(spark, shared_dir, "B8_nearest_by_time")
    assert want and got == want


def test_ties_in_n_go_by_explicit_columns(spark):
    from momentsift.operators import frames as fr

    rows = [("V1000", 1, float(i), (25.0, 29.97, 30.0)[i % 3], 7) for i in (5, 3, 8, 1, 2)]
    for order in (rows, rows[::-1]):
        f = spark.createDataFrame(order, "video_id string, n int, pts_time double, fps double, frame_idx bigint").coalesce(1)
        assert fr.fps_per_video(f).first()["fps"] == 25.0
        assert fr.reverse_lookup(f).first()["pts_time"] == 8.0


def test_a_frame_map_of_shared_names_is_written(spark, shared_dir):
    got, want = _differ(spark, shared_dir, "S12_write_frame_map")
    assert want and got == want


def test_a_frame_map_with_a_repeated_key_is_refused_still(spark, tmp_path):
    rows = [("V1000", 1, 0.0, 25.0, 0, 7), ("V1000", 1, 1.0, 25.0, 25, 8)]
    f = spark.createDataFrame(rows, "video_id string, n int, pts_time double, fps double, frame_idx bigint, event_id bigint")
    with pytest.raises(ValueError, match="duplicate_keys: 1"):
        sinks.write_frame_map(f, str(tmp_path / "a"))
    sinks.write_frame_map(f, str(tmp_path / "b"), key=("event_id",))
    with pytest.raises(ValueError, match="duplicate_keys: 1"):
        sinks.write_frame_map(f.unionByName(f.limit(1)), str(tmp_path / "c"), key=("event_id",))


def test_no_name_stands_for_another_video(spark, sf_dir, tmp_path):
    """A user whose video is called V9999."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (user_id + 9990 AS user_id) FROM '{sf_dir}/events.parquet' WHERE user_id < 10) TO '{tmp_path}/events.parquet'")
    c.execute(f"COPY (SELECT * REPLACE (9999 AS user_id) FROM '{tmp_path}/events.parquet') TO '{tmp_path}/named.parquet'")
    (tmp_path / "named.parquet").rename(tmp_path / "events.parquet")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = sorted(map(tuple, entry.queries()["G3_rscore_trake"](spark, str(tmp_path)).select("video_id", "g", "r").collect()))
    want = sorted(c.execute(entry.oracle_sql()["G3_rscore_trake"]).fetchall())
    assert any(g % 7 == 6 for _, g, _ in want) and got == want


@pytest.fixture(scope="module")
def interleaved_dir(spark, sf_dir, shared_dir, tmp_path_factory):
    """As ``shared_dir``, but vectors belong to users of both copies, and some of their values are nearly nothing."""
    out = str(tmp_path_factory.mktemp("interleaved"))
    c = duckdb.connect()
    twice = "(VALUES (0, 1000), (1, 10000)) x(r, shift)"
    c.execute(f"COPY (SELECT t.* REPLACE (event_id * 2 + r AS event_id, user_id + shift AS user_id, ts + to_milliseconds(r * 1234567) AS ts) FROM '{sf_dir}/events.parquet' t, {twice}) TO '{out}/events.parquet'")
    c.execute(f"COPY (SELECT * REPLACE (list_transform(embedding, lambda x, i: CASE WHEN i = 5 AND vec_id % 3 = 0 THEN CAST(-1e-8 AS FLOAT) ELSE x END) AS embedding) FROM '{sf_dir}/embeddings.parquet') TO '{out}/embeddings.parquet'")
    for t in ("conversations", "documents", "benchmark"):
        c.execute(f"COPY (SELECT * FROM '{shared_dir}/{t}.parquet') TO '{out}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", ["C5_embedding_agreement", "S9_read_vector_files"])
def test_vectors_of_shared_names_stay_apart(spark, interleaved_dir, name):
    got, want = _differ(spark, interleaved_dir, name)
    assert want and got == want


def test_pages_of_five_digits_keep_their_documents(spark, sf_dir, tmp_path):
    c = duckdb.connect()
    c.execute(f"COPY (SELECT t.* REPLACE (page_id + shift AS page_id) FROM '{sf_dir}/pages.parquet' t, (VALUES (1000), (10000), (10001)) x(shift)) TO '{tmp_path}/pages.parquet'")
    c.execute(f"COPY (SELECT * REPLACE (user_id + 990 AS user_id) FROM '{sf_dir}/events.parquet') TO '{tmp_path}/events.parquet'")
    for t in ("events", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    rows = lambda r: sorted(map(str, map(tuple, r)))
    want = rows(c.execute(entry.oracle_sql()["S10_read_media_info"]).fetchall())
    assert rows(entry.queries()["S10_read_media_info"](spark, str(tmp_path)).select("kind", "video_id", "title").collect()) == want


def test_media_files_of_one_document_several_or_none(spark, tmp_path):
    for name, body in {"a b+c": '{\n "title": "one"\n}\n', "several": '{"title": "x\\u001ey"}\x1e{"title"\x1e{"title": "z"}\x1e\n', "blank": " \n\t\x1e\n"}.items():
        (tmp_path / f"{name}.json").write_text(body)
    media, bad = readers.read_media_info(spark, str(tmp_path))
    assert sorted(tuple(r) for r in media.select("video_id", "title").collect()) == [("a b+c", "one"), ("several", "x\x1ey"), ("several", "z")]
    assert sorted(r["video_id"] for r in bad.collect()) == ["blank", "several"]


def test_bad_rows_of_shared_names(spark, interleaved_dir):
    got, want = _differ(spark, interleaved_dir, "E15_isolate_bad_rows")
    assert want and got == want


def test_texts_of_good_rows_move_once_and_alone(spark, interleaved_dir):
    """Frames of a repeated key, and texts, would grow each other's shuffle."""
    plan = entry.queries()["E15_isolate_bad_rows"](spark, interleaved_dir)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    with_text = [line for line in plan.splitlines() if "FileScan" in line and "text" in line]
    assert len(with_text) == 1 and "ShuffledHashJoin" in plan
    above = plan[: plan.index(with_text[0])].splitlines()
    depth, path = with_text[0].index("FileScan"), []
    for line in reversed(above):  # the operators that the text passes
        at = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if at < depth:
            path.append(line.strip(" :+-*()0123456789"))
            depth = at
    assert sum(p.startswith("Exchange") for p in path) == 1 and not any(p.startswith("Sort ") or "SortMergeJoin" in p for p in path)


def test_segments_of_one_name_are_scored_together(spark, shared_dir):
    got, want = _differ(spark, shared_dir, "T9_bm25_speech")
    assert want and got == want


def test_rows_of_shared_names_do_not_depend_on_their_order(spark):
    from momentsift.operators import fusion as fu
    from momentsift.operators import segments as sg

    said = [("V1000", 1, 0.0, 9.0, t, float(len(t))) for t in ("b", "aa", "c", "dddd")]
    shown = [("V1000", 1, 5.0, i) for i in (7, 3, 9)]
    got = set()
    for order in (1, -1):
        s = spark.createDataFrame(said[::order], "video_id string, seg long, start double, end_sec double, text string, score double").coalesce(1)
        f = spark.createDataFrame(shown[::order], "video_id string, n int, pts_time double, frame_idx long").coalesce(1)
        intervals = sorted(tuple(r)[3:] for r in fu.expand_intervals(s, f, most=4).select("video_id", "seg", "n", "frame_idx", "score").collect())
        got.add((tuple(intervals), sg.stratified_sample(s, 1, F.lit("g")).first()["text"]))
    assert got == {(((3, 1.0), (3, 1.0), (3, 2.0), (3, 4.0)), "aa")}
