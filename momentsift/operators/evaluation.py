"""Scoring of submissions: per-row scores, recall at k, comparison of modes, file checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentsift.functions.text import normal_answer, same_text
from momentsift.operators.frames import reverse_lookup
from momentsift.operators.fusion import close_pairs
from momentsift.params import DEFAULT

KS = (1, 5, 20, 50, 100)


def score_moment(row_video: Column, frame: Column, gt_video: Column, start: Column, end: Column) -> Column:
    """1 where the video is right and the frame lies in the range, ends included."""
    return F.when((row_video == gt_video) & frame.between(start, end), 1.0).otherwise(0.0)


def score_question(moment: Column, answers_match: Column) -> Column:
    """A right moment with a matching answer; the answer is looked at only where the moment is right."""
    return F.when(moment == 0, 0.0).when(F.coalesce(answers_match, F.lit(False)), 1.0).otherwise(0.0)


def score_sequence(row_video: Column, frames: Column, gt_video: Column, events: Column) -> Column:
    """Share of the events (array of struct s, e) whose frame, by position, lies in them; missing frames miss."""
    hit = F.zip_with(events, F.slice(frames, F.lit(1), F.size(events)), lambda e, f: F.when(F.coalesce(f.between(e["s"], e["e"]), F.lit(False)), 1.0).otherwise(0.0))
    # zip_with pads the shorter side, which is the frames' after the slice.
    share = F.aggregate(hit, F.lit(0.0), lambda a, x: a + x) / F.size(events)
    return F.when((row_video == gt_video) & (F.size(events) > 0), share).otherwise(0.0)


def answer_match(given: Column, wanted: Column, cosine: Column, least: float = DEFAULT.answer_cosine) -> Column:
    """Equal after normalisation; else, if neither is empty, near enough by their embeddings."""
    a, b = normal_answer(given), normal_answer(wanted)
    return F.when(same_text(a, b), True).when((a == "") | (b == ""), False).otherwise(F.coalesce(cosine >= least, F.lit(False)))


def recall_at_k(scored: DataFrame, queries: DataFrame, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """scored: group, rank, r -> r_at_k for each k and their mean, final; queries without rows score 0."""
    best = [F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("r"))), F.lit(0.0)).alias(f"r_at_{k}") for k in KS]
    per = scored.groupBy(*group).agg(*best)
    all_ = queries.select(*group).distinct().join(per, list(group), "left").fillna(0.0)
    total = sum((F.col(f"r_at_{k}") for k in KS), F.lit(0.0))
    return all_.withColumn("final", F.round(total / len(KS), 9))


def score_by_task(rows: DataFrame) -> Column:
    """rows carry task and the three scores; another task fails the job."""
    known = F.col("task").isin("kis", "qa", "trake")
    return F.when(F.col("task") == "kis", F.col("r_moment")).when(F.col("task") == "qa", F.col("r_question")).when(F.col("task") == "trake", F.col("r_sequence")).otherwise(
        F.when(known, 0.0).otherwise(F.raise_error(F.concat(F.lit("unknown task "), F.col("task"))).cast("double"))
    )


def baseline(finals: DataFrame, submitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean final over queries that have a submission, and the queries that have none."""
    have = submitted.select("query_id").distinct()
    mean = finals.join(have, "query_id").agg(F.count("*").alias("queries"), F.round(F.avg("final"), 9).alias("mean_final"))
    return mean, finals.join(have, "query_id", "left_anti").select("query_id")


def mode_comparison(finals: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """finals: mode, query_id, final -> a column for each mode, 0 where missing, and last minus first."""
    wide = finals.groupBy("query_id").pivot("mode", list(modes)).agg(F.first("final")).fillna(0.0)
    diff = F.round(F.col(f"`{modes[-1]}`") - F.col(f"`{modes[0]}`"), 9)
    return wide.withColumn("diff", diff).withColumn("change", F.when(diff > 0, "gain").when(diff < 0, "loss").otherwise("same"))


def by_task(finals: DataFrame) -> DataFrame:
    """mode, task, final -> sums per mode and task, and per mode over all tasks (task 'total')."""
    sums = finals.rollup("mode", "task").agg(F.round(F.sum("final"), 9).alias("final"), F.count("*").alias("queries"), F.grouping("task").alias("_g"))
    return sums.where("mode is not null").select("mode", F.when(F.col("_g") == 1, "total").otherwise(F.col("task")).alias("task"), "final", "queries")


def acceptance(finals: DataFrame) -> DataFrame:
    """Best single and best fused mode by total, and whether fusing is at least as good and not zero."""
    total = finals.groupBy("mode").agg(F.round(F.sum("final"), 9).alias("total")).withColumn("fused", F.contains("mode", F.lit("+")))
    best = lambda fused, c, name: F.max_by(F.when(F.col("fused") == fused, F.col(c)), F.when(F.col("fused") == fused, F.struct("total", "mode"))).alias(name)
    one = total.agg(best(False, "mode", "best_single"), best(False, "total", "single_total"), best(True, "mode", "best_fused"), best(True, "total", "fused_total"))
    return one.withColumn("accepted", (F.col("fused_total") >= F.col("single_total")) & (F.col("fused_total") > 0))


def check_submission(rows: DataFrame, frames: DataFrame, window: float, limit: int = DEFAULT.limit) -> DataFrame:
    """rows: query_id, rank, video_id, frame_ids -> query_id, problem, found for everything wrong with a file."""
    per = rows.groupBy("query_id").agg(
        F.count("*").alias("rows"), F.count_distinct(F.size("frame_ids")).alias("widths"), (F.count("*") - F.count_distinct(F.struct("video_id", "frame_ids"))).alias("repeated")
    )
    rule = lambda name, bad, value: F.when(bad, F.struct(F.lit(name).alias("problem"), value.cast("long").alias("found")))
    listed = F.array(
        rule("too_many_rows", F.col("rows") > limit, F.col("rows")), rule("mixed_widths", F.col("widths") > 1, F.col("widths")), rule("repeated_rows", F.col("repeated") > 0, F.col("repeated"))
    )
    shape = per.select("query_id", F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("x")).select("query_id", "x.problem", "x.found")
    each = rows.select("query_id", "rank", "video_id", F.explode("frame_ids").alias("frame_idx"))
    timed = each.join(reverse_lookup(frames).select("video_id", "frame_idx", "pts_time"), ["video_id", "frame_idx"], "left")
    unknown = timed.where("pts_time is null").groupBy("query_id").agg(F.count("*").alias("found")).select("query_id", F.lit("unknown_frame").alias("problem"), "found")
    near = close_pairs(timed.where("pts_time is not null"), window).groupBy("query_id").agg(F.count("*").alias("found")).select("query_id", F.lit("close_pair").alias("problem"), "found")
    return shape.unionByName(unknown).unionByName(near)
