"""Queries of the scoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentsift.operators import evaluation as ops
from momentsift.operators import fusion as fu
from momentsift.operators.vectors import dot, norm

from . import bindings as b
from .fusion_queries import KNN, _searched
from .registry import query

sql = b.sql

SCORED = f"{KNN}, scored AS (SELECT query_id, rank, CASE WHEN video_id = gt_video_id AND frame_idx BETWEEN gt_start AND gt_end THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM knn JOIN truth USING (query_id))"
R_AT = ", ".join(f"coalesce(max(CASE WHEN rank <= {k} THEN r END), 0.0::DOUBLE) AS r_at_{k}" for k in ops.KS)
FINALS = f"per AS (SELECT query_id, {R_AT} FROM truth LEFT JOIN scored USING (query_id) GROUP BY 1), finals AS (SELECT *, round((r_at_1 + r_at_5 + r_at_20 + r_at_50 + r_at_100) / 5, 9) AS final FROM per)"
VIEWS = ("vectors", "vector_queries", "truth")


def _scored(spark, sf_dir):
    rows = _searched(spark, sf_dir).join(b.truth(spark, sf_dir), "query_id")
    r = ops.score_moment(F.col("video_id"), F.col("frame_idx"), F.col("gt_video_id"), F.col("gt_start"), F.col("gt_end"))
    return rows.select("query_id", "rank", r.alias("r"))


@query("G1_rscore_kis", sql(f"WITH {SCORED} SELECT * FROM scored", *VIEWS))
def rscore_kis(spark, sf_dir):
    return _scored(spark, sf_dir)


_PAIRS = """pairs AS (SELECT d.doc_id, d.text AS given, CASE WHEN d.doc_id % 4 = 0 THEN '  ' || d.text || ' !' WHEN d.doc_id % 4 = 1 THEN '' ELSE p.text END AS wanted, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c
  FROM documents d JOIN documents p ON p.doc_id = d.doc_id + 1 JOIN embeddings x ON x.vec_id = d.doc_id JOIN embeddings y ON y.vec_id = d.doc_id + 1),
  norms AS (SELECT *, trim(regexp_replace(regexp_replace(nfc_normalize(lower(given)), '[.,!?;:''"()\\[\\]{}]', '', 'g'), '\\s+', ' ', 'g')) AS ng, trim(regexp_replace(regexp_replace(nfc_normalize(lower(wanted)), '[.,!?;:''"()\\[\\]{}]', '', 'g'), '\\s+', ' ', 'g')) AS nw FROM pairs),
  matched AS (SELECT doc_id, CASE WHEN ng = nw THEN true WHEN ng = '' OR nw = '' THEN false ELSE round(c, 9) >= 0.3 END AS match FROM norms)"""


def _matched(spark, sf_dir):
    docs, emb = b.table(spark, sf_dir, "documents").select("doc_id", "text"), b.table(spark, sf_dir, "embeddings")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    x = emb.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("x"))
    y = emb.select((F.col("vec_id") - 1).alias("doc_id"), F.col("embedding").alias("y"))
    rows = docs.join(after, "doc_id").join(x, "doc_id").join(y, "doc_id")
    wanted = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("  "), F.col("text"), F.lit(" !"))).when(F.col("doc_id") % 4 == 1, "").otherwise(F.col("next"))
    cosine = F.round(dot(F.col("x"), F.col("y")) / (norm(F.col("x")) * norm(F.col("y"))), 9)
    return rows.select("doc_id", ops.answer_match(F.col("text"), wanted, cosine, 0.3).alias("match"))


@query("G4_answer_match", f"WITH {_PAIRS} SELECT doc_id, match FROM matched")
def answer_match(spark, sf_dir):
    return _matched(spark, sf_dir)


@query("G2_rscore_qa", sql(f"WITH {_PAIRS} SELECT doc_id, CASE WHEN n % 3 = 0 THEN 0.0::DOUBLE WHEN match THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM matched JOIN frames ON doc_id = event_id", "frames"))
def rscore_qa(spark, sf_dir):
    rows = _matched(spark, sf_dir).join(b.frames(spark, sf_dir), F.col("doc_id") == F.col("event_id"))
    moment = ops.score_moment(F.col("video_id"), F.col("frame_idx"), F.col("video_id"), F.col("frame_idx"), F.when(F.col("n") % 3 == 0, F.col("frame_idx") - 1).otherwise(F.col("frame_idx")))
    return rows.select("doc_id", ops.score_question(moment, F.col("match")).alias("r"))


_SEQ = """seqs AS (SELECT video_id, n // 5 AS g, list(frame_idx ORDER BY n) AS f FROM frames GROUP BY 1, 2)"""


@query(
    "G3_rscore_trake",
    sql(
        f"""WITH {_SEQ} SELECT video_id, g, CASE WHEN g % 7 = 6 THEN 0.0::DOUBLE ELSE len(list_filter(f, lambda x, i: i <= len(f) - g % 3 AND (x + i * 40) BETWEEN x AND x + 100)) / len(f)::DOUBLE END AS r FROM seqs""",
        "frames",
    ),
)
def rscore_trake(spark, sf_dir):
    """Events around every five keyframes; the frames given for them drift by 40 a place, and some are missing."""
    groups = b.frames(spark, sf_dir).groupBy("video_id", F.floor(F.col("n") / 5).alias("g")).agg(F.array_sort(F.collect_list(F.struct("n", "frame_idx"))).alias("l"))
    events = F.transform("l", lambda x: F.struct(x["frame_idx"].alias("s"), (x["frame_idx"] + 100).alias("e")))
    given = F.slice(F.transform("l", lambda x, i: x["frame_idx"] + (i + 1) * 40), F.lit(1), F.greatest(F.lit(0), F.size("l") - F.col("g").cast("int") % 3))
    video = F.when(F.col("g") % 7 == 6, F.concat(F.lit("not "), F.col("video_id"))).otherwise(F.col("video_id"))  # any name may be that of a video
    return groups.select("video_id", "g", ops.score_sequence(video, given, F.col("video_id"), events).alias("r"))


@query("G5_recall_at_k", sql(f"WITH {SCORED}, {FINALS} SELECT * FROM finals", *VIEWS))
def recall_at_k(spark, sf_dir):
    return ops.recall_at_k(_scored(spark, sf_dir), b.truth(spark, sf_dir))


@query("G6_baseline", sql(f"WITH {SCORED}, {FINALS} SELECT count(*) AS queries, round(avg(final), 9) AS mean_final FROM finals WHERE query_id % 4 <> 0", *VIEWS))
def baseline(spark, sf_dir):
    scored = _scored(spark, sf_dir).where("query_id % 4 <> 0")
    return ops.baseline(ops.recall_at_k(scored, b.truth(spark, sf_dir)), scored)[0]


@query("G6_without_submission", sql("SELECT query_id FROM truth WHERE query_id % 4 = 0", "truth"))
def without_submission(spark, sf_dir):
    scored = _scored(spark, sf_dir).where("query_id % 4 <> 0")
    return ops.baseline(ops.recall_at_k(scored, b.truth(spark, sf_dir)), scored)[1]


MODES = ("clip", "late", "clip+late")
_MODES = f"""{SCORED}, m AS (SELECT 'clip' AS mode, query_id, rank, r FROM scored UNION ALL SELECT 'late', query_id, rank + 7, r FROM scored WHERE query_id % 5 <> 0
  UNION ALL SELECT 'clip+late', query_id, greatest(1, rank - 3), r FROM scored WHERE query_id % 9 <> 0),
  mper AS (SELECT mode, query_id, {R_AT} FROM m GROUP BY 1, 2), mfinals AS (SELECT mode, query_id, CASE query_id % 3 WHEN 0 THEN 'kis' WHEN 1 THEN 'qa' ELSE 'trake' END AS task,
  round((r_at_1 + r_at_5 + r_at_20 + r_at_50 + r_at_100) / 5, 9) AS final FROM mper)"""


def _mode_finals(spark, sf_dir):
    """The search, the same later, and a better one, as three modes of which some queries are missing."""
    s = _scored(spark, sf_dir)
    modes = s.withColumn("mode", F.lit("clip"))
    modes = modes.unionByName(s.where("query_id % 5 <> 0").select("query_id", (F.col("rank") + 7).alias("rank"), "r", F.lit("late").alias("mode")))
    modes = modes.unionByName(s.where("query_id % 9 <> 0").select("query_id", F.greatest(F.lit(1), F.col("rank") - 3).alias("rank"), "r", F.lit("clip+late").alias("mode")))
    task = F.element_at(F.array(F.lit("kis"), F.lit("qa"), F.lit("trake")), (F.col("query_id") % 3 + 1).cast("int"))
    return ops.recall_at_k(modes, modes, ("mode", "query_id")).select("mode", "query_id", task.alias("task"), "final")


@query(
    "G7_mode_comparison",
    sql(
        f"""WITH {_MODES}, wide AS (SELECT query_id, coalesce(max(final) FILTER (mode = 'clip'), 0) AS clip, coalesce(max(final) FILTER (mode = 'late'), 0) AS late, coalesce(max(final) FILTER (mode = 'clip+late'), 0) AS "clip+late" FROM mfinals GROUP BY 1)
        SELECT *, round("clip+late" - clip, 9) AS diff, CASE WHEN "clip+late" > clip THEN 'gain' WHEN "clip+late" < clip THEN 'loss' ELSE 'same' END AS change FROM wide""",
        *VIEWS,
    ),
)
def mode_comparison(spark, sf_dir):
    return ops.mode_comparison(_mode_finals(spark, sf_dir), MODES)


@query(
    "G8_by_task_rollup",
    sql(f"WITH {_MODES} SELECT mode, task, round(sum(final), 9) AS final, count(*) AS queries FROM mfinals GROUP BY 1, 2 UNION ALL SELECT mode, 'total', round(sum(final), 9), count(*) FROM mfinals GROUP BY 1", *VIEWS),
)
def by_task_rollup(spark, sf_dir):
    return ops.by_task(_mode_finals(spark, sf_dir))


@query(
    "G9_acceptance",
    sql(
        f"""WITH {_MODES}, t AS (SELECT mode, round(sum(final), 9) AS total FROM mfinals GROUP BY 1), o AS (SELECT arg_max(mode, (total, mode)) FILTER (NOT contains(mode, '+')) AS best_single, max(total) FILTER (NOT contains(mode, '+')) AS single_total,
        arg_max(mode, (total, mode)) FILTER (contains(mode, '+')) AS best_fused, max(total) FILTER (contains(mode, '+')) AS fused_total FROM t) SELECT *, fused_total >= single_total AND fused_total > 0 AS accepted FROM o""",
        *VIEWS,
    ),
)
def acceptance(spark, sf_dir):
    return ops.acceptance(_mode_finals(spark, sf_dir))


@query(
    "G10_check_submission",
    sql(
        """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, n) AS rank FROM candidates),
        rows_ AS (SELECT query_id, rank, video_id, CASE WHEN rank % 40 = 0 THEN frame_idx + 100000 ELSE frame_idx END AS f, CASE WHEN query_id = 3 AND rank = 5 THEN 2 ELSE 1 END AS width FROM ranked WHERE rank <= CASE WHEN query_id < 5 THEN 120 ELSE 90 END),
        known AS (SELECT video_id, frame_idx, arg_max(pts_time, n) AS pts_time FROM coarse GROUP BY 1, 2),
        each AS (SELECT query_id, rank, video_id, f FROM rows_ UNION ALL SELECT query_id, rank, video_id, f FROM rows_ WHERE width = 2), timed AS (SELECT e.*, pts_time FROM each e LEFT JOIN known k ON e.video_id = k.video_id AND e.f = k.frame_idx)
        SELECT query_id, 'too_many_rows' AS problem, count(*) AS found FROM rows_ GROUP BY 1 HAVING count(*) > 100 UNION ALL SELECT query_id, 'mixed_widths', count(DISTINCT width) FROM rows_ GROUP BY 1 HAVING count(DISTINCT width) > 1
        UNION ALL SELECT query_id, 'repeated_rows', count(*) - count(DISTINCT (video_id, f, width)) FROM rows_ GROUP BY 1 HAVING count(*) > count(DISTINCT (video_id, f, width))
        UNION ALL SELECT query_id, 'unknown_frame', count(*) FROM timed WHERE pts_time IS NULL GROUP BY 1
        UNION ALL SELECT a.query_id, 'close_pair', count(*) FROM timed a JOIN timed b ON a.query_id = b.query_id AND a.video_id = b.video_id AND a.rank < b.rank AND abs(a.pts_time - b.pts_time) < 86400 - 1e-9 GROUP BY 1""",
        "candidates",
    ),
)
def check_submission(spark, sf_dir):
    ranked = fu.top_candidates(b.candidates(spark, sf_dir).withColumn("source", F.lit("both")), 120)
    f = F.when(F.col("rank") % 40 == 0, F.col("frame_idx") + 100_000).otherwise(F.col("frame_idx"))
    ids = F.when((F.col("query_id") == 3) & (F.col("rank") == 5), F.array(f, f)).otherwise(F.array(f))
    rows = ranked.where(F.col("rank") <= F.when(F.col("query_id") < 5, 120).otherwise(90)).select("query_id", "rank", "video_id", ids.alias("frame_ids"))
    return ops.check_submission(rows, b.coarse(spark, sf_dir), b.WINDOW_SEC)
