"""Queries of candidate fusion, dedupe and answer assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentsift.operators import answers as an
from momentsift.operators import fusion as ops
from momentsift.operators.fulltext import bm25
from momentsift.operators.vectors import knn_topk
from momentsift.params import DEFAULT

from . import bindings as b
from .registry import query
from .text_queries import MILESTONES, _bm25_sql, resolve_milestones
from .vector_queries import KNN

sql = b.sql
ORDER = ("clip", "ocr")
MODES = {"clip": ("clip",), "ocr": ("ocr",), "clip+ocr": ("clip", "ocr")}
W = b.WINDOW_SEC

RANKED = "ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, video_id, n) AS rank FROM candidates) WHERE rank <= 500)"
BEST = """best AS (SELECT query_id, source, video_id, frame_idx, min(rank) AS rank, arg_min(n, rank) AS n, arg_min(pts_time, rank) AS pts_time, arg_min(score, rank) AS score FROM ranked GROUP BY 1, 2, 3, 4)"""
PARTS = "parts AS (SELECT *, CASE source WHEN 'clip' THEN 1.0::DOUBLE WHEN 'ocr' THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank) AS part, CASE source WHEN 'clip' THEN 0 WHEN 'ocr' THEN 1 ELSE 2 END AS place FROM best)"
FUSED = """fused AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, best_rank, video_id, frame_idx) AS rank, video_id, n, frame_idx, pts_time, score, source FROM (
  SELECT query_id, video_id, frame_idx, round(sum(part ORDER BY source), 12) AS score, string_agg(source, '+' ORDER BY source) AS source, arg_min(n, place) AS n, arg_min(pts_time, place) AS pts_time,
    min(place) AS place, arg_min(rank, place) AS best_rank FROM parts GROUP BY 1, 2, 3))"""
ALL = f"{RANKED}, {BEST}, {PARTS}, {FUSED}"


def _fold(cap: str) -> str:
    return f"""folded AS (SELECT query_id, video_id, list_reduce(list([{{'r': rank, 'p': pts_time, 'tag': 'kept'}}] ORDER BY rank), lambda acc, x: list_concat(acc, [{{'r': x[1].r, 'p': x[1].p,
  'tag': CASE WHEN len(list_filter(acc, lambda a: a.tag = 'kept')) >= {cap} THEN 'cap' WHEN len(list_filter(acc, lambda a: a.tag = 'kept' AND abs(a.p - x[1].p) < 86400 - 1e-9)) > 0 THEN 'near' ELSE 'kept' END}}])) AS l
  FROM fused GROUP BY 1, 2), tags AS (SELECT query_id, video_id, unnest(l, recursive := true) FROM folded), tagged AS (SELECT f.*, t.tag FROM fused f JOIN tags t ON f.query_id = t.query_id AND f.video_id = t.video_id AND f.rank = t.r)"""


KEPT = f"WITH {ALL}, {_fold('1000000')}, kept AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, video_id, n, frame_idx, pts_time, score, source FROM tagged WHERE tag = 'kept')"


def ranked(spark, sf_dir):
    return ops.top_candidates(b.candidates(spark, sf_dir))


def fused(spark, sf_dir):
    return ops.fuse_hits(ranked(spark, sf_dir), ORDER, DEFAULT.weights)


def kept(spark, sf_dir):
    return ops.thin_out(fused(spark, sf_dir), W)


def _records(spark, sf_dir):
    f, e = b.frames(spark, sf_dir), F.col("event_id")
    n = F.when(e % 13 != 0, F.when(e % 17 == 0, F.col("n") + 100_000).otherwise(F.col("n")))
    return f.select((e % 10).alias("query_id"), "video_id", n.alias("n"), F.col("value").alias("score"), F.when(e % 3 != 0, F.col("frame_idx")).alias("frame_idx"), F.when(e % 5 != 0, F.col("pts_time")).alias("pts_time"))


_RECORDS = """records AS (SELECT event_id % 10 AS query_id, video_id, CASE WHEN event_id % 13 <> 0 THEN CASE WHEN event_id % 17 = 0 THEN n + 100000 ELSE n END END AS n, value AS score,
  CASE WHEN event_id % 3 <> 0 THEN frame_idx END AS frame_idx, CASE WHEN event_id % 5 <> 0 THEN pts_time END AS pts_time FROM frames),
  joined AS (SELECT r.query_id, r.video_id, r.n, r.score, CASE WHEN r.frame_idx IS NOT NULL AND r.pts_time IS NOT NULL THEN r.frame_idx ELSE f.frame_idx END AS frame_idx,
    CASE WHEN r.frame_idx IS NOT NULL AND r.pts_time IS NOT NULL THEN r.pts_time ELSE f.pts_time END AS pts_time FROM records r LEFT JOIN frames f ON r.video_id = f.video_id AND r.n = f.n)"""


@query("F1_resolve_hits", sql(f"WITH {_RECORDS} SELECT * FROM joined WHERE n IS NOT NULL AND frame_idx IS NOT NULL AND pts_time IS NOT NULL", "frames"))
def resolve_hits(spark, sf_dir):
    return ops.resolve_hits(_records(spark, sf_dir), b.frames(spark, sf_dir))[0]


@query("F1_unresolved", sql(f"WITH {_RECORDS} SELECT query_id, video_id, n, score FROM joined WHERE n IS NULL OR frame_idx IS NULL OR pts_time IS NULL", "frames"))
def unresolved(spark, sf_dir):
    return ops.resolve_hits(_records(spark, sf_dir), b.frames(spark, sf_dir))[1]


@query(
    "F2_expand_intervals",
    sql(
        """SELECT video_id, seg, n, frame_idx, pts_time, score FROM (SELECT s.video_id, s.seg, f.n, f.frame_idx, f.pts_time, CAST(length(s.text) AS DOUBLE) AS score,
        row_number() OVER (PARTITION BY s.video_id, s.seg ORDER BY f.pts_time, f.n) AS k FROM speech s JOIN frames f ON s.video_id = f.video_id AND f.pts_time BETWEEN s.start AND s.end_sec) WHERE k <= 8""",
        "frames", "speech",
    ),
)
def expand_intervals(spark, sf_dir):
    s = b.speech(spark, sf_dir).withColumn("score", F.length("text").cast("double"))
    return ops.expand_intervals(s, b.frames(spark, sf_dir), cell=b.DAY)


@query("F3_rank_in_source", sql(f"WITH {RANKED}, {BEST} SELECT * FROM best", "candidates"))
def rank_in_source(spark, sf_dir):
    return ops.rank_in_source(ranked(spark, sf_dir))


@query(
    "F4_weighted_rrf",
    sql(f"WITH {RANKED}, {BEST}, {PARTS} SELECT query_id, video_id, frame_idx, round(sum(part ORDER BY source), 12) AS score, string_agg(source || ':' || rank, ',' ORDER BY source) AS ranks FROM parts GROUP BY 1, 2, 3", "candidates"),
)
def weighted_rrf(spark, sf_dir):
    return ops.weighted_rrf(ranked(spark, sf_dir), DEFAULT.weights)


@query("F5_fuse_hits", sql(f"WITH {ALL} SELECT * FROM fused", "candidates"))
def fuse_hits(spark, sf_dir):
    return fused(spark, sf_dir)


@query(
    "F6_source_mix",
    sql(
        f"""WITH {RANKED}, {BEST}, {PARTS}, modes(mode, src) AS (VALUES ('clip', 'clip'), ('ocr', 'ocr'), ('clip+ocr', 'clip'), ('clip+ocr', 'ocr')),
        per AS (SELECT mode, query_id, video_id, frame_idx, round(sum(part ORDER BY source), 12) AS score, string_agg(source, '+' ORDER BY source) AS source, arg_min(n, place) AS n, arg_min(pts_time, place) AS pts_time,
          min(place) AS place, arg_min(rank, place) AS best_rank FROM parts JOIN modes ON source = src GROUP BY 1, 2, 3, 4)
        SELECT mode, query_id, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, place, best_rank, video_id, frame_idx) AS rank, video_id, n, frame_idx, pts_time, score, source FROM per""",
        "candidates",
    ),
)
def source_mix(spark, sf_dir):
    return ops.source_mix(ranked(spark, sf_dir), MODES, ORDER, DEFAULT.weights)


@query("F7_time_window_dedupe", sql(f"{KEPT} SELECT * FROM kept", "candidates"))
def time_window_dedupe(spark, sf_dir):
    return kept(spark, sf_dir)


@query("F8_cap_per_video", sql(f"WITH {ALL}, {_fold('2')} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, video_id, n, frame_idx, pts_time, score, source FROM tagged WHERE tag = 'kept'", "candidates"))
def cap_per_video(spark, sf_dir):
    return ops.thin_out(fused(spark, sf_dir), W, cap=2)


@query(
    "F9_dedupe_report",
    sql(f"WITH {ALL}, {_fold('2')} SELECT query_id, count(*) AS given, count(*) FILTER (tag = 'kept') AS kept, count(*) FILTER (tag = 'near') AS dropped_near, count(*) FILTER (tag = 'cap') AS dropped_cap FROM tagged GROUP BY 1", "candidates"),
)
def dedupe_report(spark, sf_dir):
    return ops.dedupe_report(ops.tag_by_window(fused(spark, sf_dir), W, cap=2))


@query(
    "F10_close_pairs",
    sql(
        f"""WITH {ALL} SELECT a.query_id, a.video_id, a.rank AS rank_a, b.rank AS rank_b, abs(a.pts_time - b.pts_time) AS distance FROM fused a JOIN fused b ON a.query_id = b.query_id AND a.video_id = b.video_id
        AND a.rank < b.rank AND abs(a.pts_time - b.pts_time) < 86400 - 1e-9""",
        "candidates",
    ),
)
def close_pairs(spark, sf_dir):
    return ops.close_pairs(fused(spark, sf_dir), W)


@query("F11_score_cut", sql(f"WITH {ALL} SELECT * FROM fused WHERE source <> 'clip' OR score >= 0.004", "candidates"))
def score_cut(spark, sf_dir):
    return ops.score_cut(fused(spark, sf_dir), 0.004)


@query(
    "F12_asset_status",
    sql(
        f"""WITH {ALL} SELECT status, count(*) AS hits FROM (SELECT CASE WHEN i.n IS NOT NULL THEN 'has_image' WHEN v.video_id IS NOT NULL THEN 'no_image' ELSE 'no_video' END AS status FROM fused f
        LEFT JOIN (SELECT DISTINCT video_id, n FROM ocr WHERE doc_id % 2 = 0) i ON f.video_id = i.video_id AND f.n = i.n LEFT JOIN (SELECT DISTINCT video_id FROM speech) v ON f.video_id = v.video_id) GROUP BY 1""",
        "candidates", "ocr", "speech",
    ),
)
def asset_status(spark, sf_dir):
    images = b.ocr(spark, sf_dir).where("doc_id % 2 = 0")
    return ops.asset_status(fused(spark, sf_dir), images, b.speech(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("hits"))


_ANSWERS = "answers AS (SELECT item_id AS query_id, text AS answer FROM benchmark)"


def _answers(spark, sf_dir):
    return b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer"))


@query("F13_answers_single", sql(f"{KEPT}, {_ANSWERS} SELECT kept.query_id, rank, video_id, [frame_idx] AS frame_ids, answer FROM kept LEFT JOIN answers USING (query_id) WHERE rank <= 100", "candidates"))
def answers_single(spark, sf_dir):
    return an.answers_single(kept(spark, sf_dir), _answers(spark, sf_dir))


_SEQUENCE = """firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS k FROM fused),
  seqs AS (SELECT query_id, video_id, min(rank) AS best, count(*) AS have, list(frame_idx ORDER BY pts_time, rank) AS frame_ids FROM firsts WHERE k <= 3 GROUP BY 1, 2)"""


@query("F14_answers_sequence", sql(f"WITH {ALL}, {_SEQUENCE} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank, video_id, frame_ids, CAST(NULL AS VARCHAR) AS answer FROM seqs WHERE have = 3", "candidates"))
def answers_sequence(spark, sf_dir):
    return an.answers_sequence(fused(spark, sf_dir), 3)[0]


@query("F14_short_videos", sql(f"WITH {ALL}, {_SEQUENCE} SELECT query_id, count(*) FILTER (have < 3) AS short_videos FROM seqs GROUP BY 1", "candidates"))
def short_videos(spark, sf_dir):
    return an.answers_sequence(fused(spark, sf_dir), 3)[1]


_POOL = f"""{_bm25_sql("doc_id", "documents", "a OR (any_all = 0 AND n_tok > 1)", DEFAULT.sequence_candidates).replace("SELECT query_id, rank, key AS doc_id", ", pool AS (SELECT query_id, rank, key AS doc_id", 1)}),
  wanted AS ({MILESTONES}), placed AS (SELECT p.query_id, p.rank, milestones, video_id, frame_idx, pts_time, row_number() OVER (PARTITION BY p.query_id, video_id ORDER BY p.rank) AS k
    FROM pool p JOIN ocr USING (doc_id) JOIN wanted w ON w.item_id = p.query_id),
  seqs AS (SELECT query_id, video_id, milestones, min(rank) AS best, count(*) AS have, list(frame_idx ORDER BY pts_time, rank) AS frame_ids FROM placed WHERE k <= milestones GROUP BY 1, 2, 3)"""


@query("F14_wide_pool", sql(f"{_POOL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank, video_id, frame_ids FROM seqs WHERE have = milestones", "text_queries", "ocr", "records"))
def wide_pool(spark, sf_dir):
    """Whole passages searched with the pool of sequences, as many moments a video as each record asks for."""
    hits = bm25(b.text_queries(spark, sf_dir), b.text_index(spark, sf_dir, "documents"), DEFAULT.sequence_candidates, key="doc_id")
    placed = hits.join(b.ocr(spark, sf_dir).select("doc_id", "video_id", "n", "frame_idx", "pts_time"), "doc_id")
    moments = resolve_milestones(spark, sf_dir).select(F.col("item_id").alias("query_id"), "milestones")
    return an.answers_sequence(placed, moments)[0].select("query_id", "rank", "video_id", "frame_ids")


def _rows(spark, sf_dir):
    """One row per ranked candidate of both sources; frames found by both come twice."""
    r = ranked(spark, sf_dir)
    rows = r.select("query_id", (F.col("rank") * 2 + F.when(F.col("source") == "ocr", 1).otherwise(0)).alias("rank"), "video_id", F.array("frame_idx").alias("frame_ids"))
    return rows.withColumn("answer", F.lit(None).cast("string"))


_ROWS = """rows_ AS (SELECT query_id, rank * 2 + CASE WHEN source = 'ocr' THEN 1 ELSE 0 END AS rank, video_id, frame_idx FROM ranked),
  keyed AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame_idx ORDER BY rank) AS nth FROM rows_),
  placed AS (SELECT *, sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS place FROM keyed),
  judged AS (SELECT *, max(CASE WHEN nth = 1 AND place <= 300 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, video_id, frame_idx) AS accepted FROM placed)"""


@query("F15_budget", sql(f"WITH {RANKED}, {_ROWS} SELECT query_id, CAST(place AS INTEGER) AS rank, video_id, [frame_idx] AS frame_ids, CAST(NULL AS VARCHAR) AS answer FROM judged WHERE nth = 1 AND place <= 300", "candidates"))
def budget(spark, sf_dir):
    return an.budget(_rows(spark, sf_dir), 300)[0]


@query("F15_budget_counts", sql(f"WITH {RANKED}, {_ROWS} SELECT query_id, count(*) FILTER (nth = 1 AND place <= 300) AS kept, count(*) FILTER (nth > 1 AND accepted = 1) AS duplicates, count(*) FILTER (accepted = 0) AS overflow FROM judged GROUP BY 1", "candidates"))
def budget_counts(spark, sf_dir):
    return an.budget(_rows(spark, sf_dir), 300)[1]


@query(
    "F16_to_row",
    sql(
        f"""{KEPT}, {_ANSWERS} SELECT query_id, rank, CASE WHEN violation IS NULL THEN video_id || ',' || frame_idx || CASE WHEN task = 'qa' THEN ',' || CASE WHEN regexp_matches(answer, '[,"\n\r]')
          THEN '"' || replace(answer, '"', '""') || '"' ELSE answer END ELSE '' END END AS line, violation FROM (
          SELECT query_id, rank, video_id, frame_idx, answer, task, CASE WHEN frame_idx < 0 THEN 'negative frame' WHEN task = 'qa' AND coalesce(trim(answer), '') = '' THEN 'no answer' END AS violation FROM (
            SELECT query_id, rank, video_id, CASE WHEN rank % 9 = 0 THEN -frame_idx ELSE frame_idx END AS frame_idx, CASE WHEN rank % 7 <> 0 THEN replace(answer, chr(10), ' ') END AS answer, CASE WHEN rank % 2 = 0 THEN 'qa' ELSE 'kis' END AS task
            FROM kept LEFT JOIN answers USING (query_id) WHERE rank <= 100))""",
        "candidates",
    ),
)
def to_row(spark, sf_dir):
    rows = an.answers_single(kept(spark, sf_dir), _answers(spark, sf_dir))
    rows = rows.withColumns({
        "frame_ids": F.when(F.col("rank") % 9 == 0, F.transform("frame_ids", lambda f: -f)).otherwise(F.col("frame_ids")),
        "answer": F.when(F.col("rank") % 7 != 0, F.replace("answer", F.lit("\n"), F.lit(" "))),
        "task": F.when(F.col("rank") % 2 == 0, "qa").otherwise("kis"),
    })
    return an.to_lines(rows)


_RUN = f"""{KNN}, folded AS (SELECT query_id, video_id, list_reduce(list([{{'r': rank, 'p': pts_time}}] ORDER BY rank), lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: abs(a.p - x[1].p) < 86400 - 1e-9)) > 0
  THEN acc ELSE list_concat(acc, x) END) AS l FROM knn GROUP BY 1, 2), tags AS (SELECT query_id, video_id, unnest(l, recursive := true) FROM folded),
  kept AS (SELECT k.query_id, row_number() OVER (PARTITION BY k.query_id ORDER BY k.rank) AS rank, k.video_id, k.frame_idx FROM knn k JOIN tags t ON k.query_id = t.query_id AND k.video_id = t.video_id AND k.rank = t.r)"""


def _searched(spark, sf_dir):
    v = b.vectors(spark, sf_dir)
    return knn_topk(v, b.vector_queries(spark, sf_dir), 100, ("video_id", "n", "frame_idx", "pts_time"))


@query("F17_end_to_end", sql(f"WITH {_RUN} SELECT query_id, rank, video_id || ',' || frame_idx AS line FROM kept WHERE rank <= 100", "vectors", "vector_queries"))
def end_to_end(spark, sf_dir):
    """Vectors to submission lines: search, dedupe in time, answers, budget, lines; all queries in one plan."""
    hits = ops.thin_out(_searched(spark, sf_dir), W)
    rows, _ = an.budget(an.answers_single(hits))
    return an.to_lines(rows.withColumn("task", F.lit("kis"))).where("violation is null").select("query_id", "rank", "line")


@query(
    "F18_run_summary",
    sql(f"WITH {_RUN} SELECT query_id, candidates, after_dedupe, least(after_dedupe, 100) AS rows, true AS gate, after_dedupe < 100 AS short FROM (SELECT query_id, count(*) AS candidates FROM knn GROUP BY 1) JOIN (SELECT query_id, count(*) AS after_dedupe FROM kept GROUP BY 1) USING (query_id)", "vectors", "vector_queries"),
)
def run_summary(spark, sf_dir):
    found = _searched(spark, sf_dir)
    hits = ops.thin_out(found, W)
    rows, _ = an.budget(an.answers_single(hits))
    return an.run_summary(found, hits, rows, ops.close_pairs(hits, W))


@query("F19_export_picks", sql("SELECT query_id, rank, video_id || ',' || frame_idx AS line FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, n) AS rank FROM candidates) WHERE rank <= 100", "candidates"))
def export_picks(spark, sf_dir):
    return an.export_picks(b.candidates(spark, sf_dir))
