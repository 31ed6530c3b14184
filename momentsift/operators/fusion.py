"""Candidates from several sources: resolving, ranking, fusing, thinning out in time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from momentsift.params import DEFAULT, EPSILON

HIT = ("query_id", "video_id", "n", "frame_idx", "pts_time", "score")


def resolve_hits(records: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records: query_id, video_id, n, score, frame_idx, pts_time -> hits, and the records that no keyframe explains.

    Where frame_idx or pts_time is missing, both come from the keyframe table.
    """
    known = frames.select("video_id", "n", F.col("frame_idx").alias("_frame"), F.col("pts_time").alias("_pts"))
    joined = records.join(known, ["video_id", "n"], "left")
    whole = F.col("frame_idx").isNotNull() & F.col("pts_time").isNotNull()
    joined = joined.withColumns({"_f": F.when(whole, F.col("frame_idx")).otherwise(F.col("_frame")), "_p": F.when(whole, F.col("pts_time")).otherwise(F.col("_pts"))})
    good = F.col("video_id").isNotNull() & F.col("n").isNotNull() & F.col("_f").isNotNull() & F.col("_p").isNotNull()
    hits = joined.where(good).select("query_id", "video_id", "n", "score", F.col("_f").alias("frame_idx"), F.col("_p").alias("pts_time"))
    return hits, joined.where(~good).select("query_id", "video_id", "n", "score")


def expand_intervals(intervals: DataFrame, frames: DataFrame, most: int = DEFAULT.frames_per_interval, cell: float = 60.0) -> DataFrame:
    """intervals: video_id, seg, start, end_sec, score -> the first keyframes inside each, both ends included.

    An interval is laid over all time cells that it touches, a keyframe lies in
    one, so the range join becomes a hash join by video and cell.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    laid = intervals.where("start <= end_sec").select("video_id", "seg", "start", "end_sec", "score", F.explode(F.sequence(at("start"), at("end_sec"))).alias("_cell"))
    placed = frames.select("video_id", "n", "frame_idx", "pts_time", at("pts_time").alias("_cell"))
    inside = laid.join(placed, ["video_id", "_cell"]).where("pts_time >= start and pts_time <= end_sec").drop("_cell")
    first = Window.partitionBy("video_id", "seg").orderBy("pts_time", "n", "frame_idx", "score")  # the last two tell videos of one name apart
    return inside.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= most).select("video_id", "seg", "n", "frame_idx", "pts_time", "score")


def top_candidates(hits: DataFrame, k: int = DEFAULT.candidates) -> DataFrame:
    """Rank within query and source by score, the best k kept."""
    order = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "video_id", "n")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_in_source(ranked: DataFrame, group: tuple[str, ...] = ("query_id", "source")) -> DataFrame:
    """The best rank of each frame in each source; ranks keep their numbers."""
    best = lambda c: F.min_by(c, "rank").alias(c)
    return ranked.groupBy(*group, "video_id", "frame_idx").agg(F.min("rank").alias("rank"), best("n"), best("pts_time"), best("score"))


def source_weight(weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col("source") == name, F.lit(w)).otherwise(out)
    return out


def weighted_rrf(ranked: DataFrame, weights: dict[str, float], k: int = DEFAULT.rrf_k, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Sum of weight / (k + rank) over the sources that have a frame, added in order of the source's name; and the ranks by source."""
    best = rank_in_source(ranked, (*group, "source")).withColumn("_part", source_weight(weights) / (k + F.col("rank")))
    parts = F.array_sort(F.collect_list(F.struct("source", "_part", "rank")))
    per = best.groupBy(*group, "video_id", "frame_idx").agg(parts.alias("_parts"))
    total = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["_part"])
    ranks = F.array_join(F.transform("_parts", lambda p: F.concat_ws(":", p["source"], p["rank"].cast("string"))), ",")
    return per.select(*group, "video_id", "frame_idx", F.round(total, 12).alias("score"), ranks.alias("ranks"))


def fuse_hits(ranked: DataFrame, order: tuple[str, ...], weights: dict[str, float], k: int = DEFAULT.rrf_k, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """group, rank, video_id, n, frame_idx, pts_time, score, source: fused by RRF.

    n and pts_time come from the first source, in ``order``, that has the
    frame; the label names all its sources. Equal scores are ordered by that
    source and its rank.
    """
    place = F.lit(len(order))
    for i, name in enumerate(order):
        place = F.when(F.col("source") == name, F.lit(i)).otherwise(place)
    best = rank_in_source(ranked, (*group, "source")).withColumns({"_place": place, "_part": source_weight(weights) / (k + F.col("rank"))})
    per = best.groupBy(*group, "video_id", "frame_idx").agg(
        F.array_sort(F.collect_list(F.struct("source", "_part"))).alias("_parts"),
        F.min(F.struct("_place", "rank", "n", "pts_time")).alias("_first"),
    )
    total = F.round(F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["_part"]), 12)
    named = per.select(
        *group, "video_id", "frame_idx", "_first.n", "_first.pts_time", F.col("_first._place").alias("_place"), F.col("_first.rank").alias("_rank"),
        total.alias("score"), F.array_join(F.transform("_parts", lambda p: p["source"]), "+").alias("source"),
    )
    by_score = Window.partitionBy(*group).orderBy(F.desc("score"), "_place", "_rank", "video_id", "frame_idx")
    return named.withColumn("rank", F.row_number().over(by_score)).drop("_place", "_rank")


def source_mix(ranked: DataFrame, modes: dict[str, tuple[str, ...]], order: tuple[str, ...], weights: dict[str, float], k: int = DEFAULT.rrf_k) -> DataFrame:
    """``fuse_hits`` for several sets of sources in one job: mode is one more key."""
    of = F.filter(F.array(*[F.when(F.col("source").isin(*names), F.lit(mode)) for mode, names in modes.items()]), lambda m: m.isNotNull())
    return fuse_hits(ranked.withColumn("mode", F.explode(of)), order, weights, k, ("mode", "query_id"))


def tag_by_window(ranked: DataFrame, window: float, cap: int | None = None, group: tuple[str, ...] = ("query_id", "video_id")) -> DataFrame:
    """Every candidate with a tag: kept, near (a kept one of its video is closer than ``window``) or cap.

    Greedy by rank: the candidates of a query and video stream by in order of
    rank, past a map of the kept ones by stretches of time just under one
    window, each of which can hold one kept candidate only. So a candidate looks
    into three of them, the time is linear, and no list of a video is gathered.
    Exactly one window apart is kept; a candidate without a time is never near.
    """
    reach = window - EPSILON
    schema = StructType([*ranked.schema.fields, StructField("tag", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, n = None, {}, 0
        for batch in batches:
            names = list(zip(*[batch.column(c).to_pylist() for c in group], strict=True))
            tags = []
            for name, at in zip(names, batch.column("pts_time").to_pylist(), strict=True):
                if name != now:
                    now, kept, n = name, {}, 0
                timed = at is not None and math.isfinite(at) and reach > 0
                cell = math.floor(at / reach) if timed else None
                if cap is not None and n >= cap:
                    tags.append("cap")
                elif timed and any(c in kept and abs(kept[c] - at) < reach for c in (cell - 1, cell, cell + 1)):
                    tags.append("near")
                else:
                    tags.append("kept")
                    n += 1
                    if timed:
                        kept[cell] = at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tags, pa.string())], names=[*batch.schema.names, "tag"])

    dealt = ranked.repartition(*group).sortWithinPartitions(*group, "rank")
    return dealt.mapInArrow(run, schema)


def thin_out(ranked: DataFrame, window: float, cap: int | None = None) -> DataFrame:
    """The kept candidates, ranked anew within their query."""
    kept = tag_by_window(ranked, window, cap).where("tag = 'kept'").drop("tag")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def dedupe_report(tagged: DataFrame) -> DataFrame:
    count = lambda t, name: F.count_if(F.col("tag") == t).alias(name)
    return tagged.groupBy("query_id").agg(F.count("*").alias("given"), count("kept", "kept"), count("near", "dropped_near"), count("cap", "dropped_cap"))


def close_pairs(ranked: DataFrame, window: float) -> DataFrame:
    """Pairs of one query and video closer than ``window``, joined by stretches of that length: query_id, video_id, rank_a, rank_b, distance."""
    cell = F.floor(F.col("pts_time") / window)
    a = ranked.select("query_id", "video_id", F.col("rank").alias("rank_a"), F.col("pts_time").alias("_a"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    b = ranked.select("query_id", "video_id", F.col("rank").alias("rank_b"), F.col("pts_time").alias("_b"), cell.alias("_cell"))
    near = F.abs(F.col("_a") - F.col("_b"))
    both = a.join(b, ["query_id", "video_id", "_cell"]).where((F.col("rank_a") < F.col("rank_b")) & (near < window - EPSILON))
    return both.select("query_id", "video_id", "rank_a", "rank_b", near.alias("distance"))


def score_cut(fused: DataFrame, least: float, only: str = "clip") -> DataFrame:
    """Drops low scores, but only of hits that come from ``only`` alone."""
    return fused.where((F.col("source") != only) | (F.col("score") >= least))


def asset_status(hits: DataFrame, images: DataFrame, videos: DataFrame) -> DataFrame:
    """Each hit with has_image, no_image (its video is loaded) or no_video."""
    i = images.select("video_id", "n").distinct().withColumn("_image", F.lit(True))
    v = videos.select("video_id").distinct().withColumn("_video", F.lit(True))
    status = F.when(F.col("_image"), "has_image").when(F.col("_video"), "no_image").otherwise("no_video")
    return hits.join(i, ["video_id", "n"], "left").join(v, "video_id", "left").withColumn("status", status).drop("_image", "_video")
