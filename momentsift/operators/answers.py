"""Answers from ranked hits: rows of single moments and sequences, the row budget, lines, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentsift.params import DEFAULT

#: Quotes doubled inside quotes, white space kept, as common CSV writers do.
CSV = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _by_query():
    return Window.partitionBy("query_id")


def answers_single(hits: DataFrame, answers: DataFrame | None = None, limit: int = DEFAULT.limit) -> DataFrame:
    """query_id, rank, video_id, frame_ids, answer: a row for each hit up to the limit; ``answers`` has query_id, answer."""
    rows = hits.where(F.col("rank") <= limit).select("query_id", "rank", "video_id", F.array("frame_idx").alias("frame_ids"))
    return rows.withColumn("answer", F.lit(None).cast("string")) if answers is None else rows.join(answers.select("query_id", "answer"), "query_id", "left")


def answers_sequence(hits: DataFrame, moments: int | DataFrame, pool: int = DEFAULT.sequence_candidates) -> tuple[DataFrame, DataFrame]:
    """The first hits of each video among the best ``pool`` of its query, in order of time, videos by their best hit; and how many videos had too few.

    ``moments``: how many hits a sequence has, or a table of query_id,
    milestones. A video's first hits are a bounded selection for each key, made
    before and after the shuffle; no list of a video's hits is ever ranked whole.
    """
    per_video = Window.partitionBy("query_id", "video_id").orderBy("rank")
    near = hits.where(F.col("rank") <= pool)
    if isinstance(moments, int):
        near, most = near.withColumn("_want", F.lit(moments)), moments
    else:
        near = near.join(moments.select("query_id", F.col("milestones").alias("_want")), "query_id")
        most = moments.agg(F.max("milestones")).first()[0] or 0
    first = near.withColumn("_at", F.row_number().over(per_video)).where(F.col("_at") <= most).where(F.col("_at") <= F.col("_want"))
    listed = F.array_sort(F.collect_list(F.struct("pts_time", "rank", "frame_idx")))
    per = first.groupBy("query_id", "video_id", "_want").agg(F.min("rank").alias("_best"), F.count("*").alias("_have"), listed.alias("_l"))
    whole = per.where(F.col("_have") == F.col("_want")).withColumn("rank", F.row_number().over(_by_query().orderBy("_best")))
    rows = whole.select("query_id", "rank", "video_id", F.transform("_l", lambda x: x["frame_idx"]).alias("frame_ids"), F.lit(None).cast("string").alias("answer"))
    return rows, per.groupBy("query_id").agg(F.count_if(F.col("_have") < F.col("_want")).alias("short_videos"))


def answer_key() -> Column:
    return F.struct(F.col("video_id"), F.col("frame_ids"), F.lower(F.trim(F.coalesce("answer", F.lit("")))))


def budget(rows: DataFrame, limit: int = DEFAULT.limit) -> tuple[DataFrame, DataFrame]:
    """Rows without repeated keys up to the limit, ranked anew; and per query kept, duplicates, overflow.

    A row counts as a duplicate if its key was accepted before it, as overflow
    otherwise.
    """
    keyed = rows.withColumn("_key", answer_key())
    keyed = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id", "_key").orderBy("rank")))
    first = F.col("_nth") == 1
    keyed = keyed.withColumn("_place", F.sum(F.when(first, 1).otherwise(0)).over(_by_query().orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    accepted = F.max(F.when(first & (F.col("_place") <= limit), 1).otherwise(0)).over(Window.partitionBy("query_id", "_key"))
    keyed = keyed.withColumn("_accepted", accepted)
    kept = keyed.where(first & (F.col("_place") <= limit)).select("query_id", F.col("_place").cast("int").alias("rank"), "video_id", "frame_ids", "answer")
    counts = keyed.groupBy("query_id").agg(
        F.count_if(first & (F.col("_place") <= limit)).alias("kept"),
        F.count_if(~first & (F.col("_accepted") == 1)).alias("duplicates"),
        F.count_if(F.col("_accepted") == 0).alias("overflow"),
    )
    return kept, counts


def to_lines(rows: DataFrame) -> DataFrame:
    """query_id, rank, line, violation. rows also has ``task``; the line is null where a rule is broken."""
    violation = (
        F.when(F.coalesce(F.trim("video_id"), F.lit("")) == "", "no video")
        .when(F.coalesce(F.size("frame_ids"), F.lit(0)) < 1, "no frame")
        .when(F.exists("frame_ids", lambda f: f < 0), "negative frame")
        .when((F.col("task") == "qa") & (F.coalesce(F.trim("answer"), F.lit("")) == ""), "no answer")
    )
    quoted = lambda c: F.to_csv(F.struct(c), CSV)
    parts = F.concat(F.array(quoted(F.col("video_id"))), F.transform("frame_ids", lambda f: f.cast("string")), F.when(F.col("task") == "qa", F.array(quoted(F.col("answer")))).otherwise(F.array().cast("array<string>")))
    return rows.select("query_id", "rank", F.when(violation.isNull(), F.array_join(parts, ",")).alias("line"), violation.alias("violation"))


def run_summary(candidates: DataFrame, kept: DataFrame, rows: DataFrame, close: DataFrame, limit: int = DEFAULT.limit) -> DataFrame:
    """Per query: candidates, after_dedupe, rows, gate (no close pair), short (fewer rows than the limit)."""
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    out = count(candidates, "candidates")
    for df, name in ((kept, "after_dedupe"), (rows, "rows"), (close, "_close")):
        out = out.join(count(df, name), "query_id", "left")
    out = out.fillna(0, ["after_dedupe", "rows", "_close"])
    return out.select("query_id", "candidates", "after_dedupe", "rows", (F.col("_close") == 0).alias("gate"), (F.col("rows") < limit).alias("short"))


def export_picks(picks: DataFrame, limit: int = DEFAULT.limit) -> DataFrame:
    """query_id, rank, line: the best picks as video and frame."""
    order = _by_query().orderBy(F.desc("score"), "video_id", "n")
    best = picks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.select("query_id", "rank", F.to_csv(F.struct("video_id", "frame_idx"), CSV).alias("line"))
