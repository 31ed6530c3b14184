"""Writers. What must be valid is checked before anything is written."""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentsift.operators.frames import KEY, check_frame_map

from .files import file_paths, folder_names, remove, rename, replace_table


def write_frame_map(frames: DataFrame, path: str, strict: bool = True, key: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    """Writes the table sorted by key within its files, and returns the checks of what was written; strict refuses a table with a problem.

    The table is written beside the old one and checked there; only then it takes its place.
    Where videos share names, ``key`` names the columns that tell keyframes apart.
    """
    spark = frames.sparkSession

    def check(staged: str) -> None:
        problems = [f"{r['check']}: {r['found']}" for r in check_frame_map(spark.read.parquet(staged), key=key).where("not ok").collect()]  # a row a rule
        if problems and strict:
            raise ValueError("frame map not written: " + "; ".join(problems))

    replace_table(spark, path, lambda staged: frames.repartition("video_id").sortWithinPartitions("video_id", "n").write.parquet(staged), check)
    return check_frame_map(spark.read.parquet(path), key=key)


def submission_file_name() -> F.Column:
    return F.concat(F.lit("query-"), F.col("query_id").cast("string"), F.lit("-"), F.col("task"), F.lit(".csv"))


def write_submission(lines: DataFrame, path: str) -> None:
    """lines: query_id, task, rank, line. A file query-<id>-<task>.csv for each query and task, its lines in order of rank, without header.

    The order of a file's lines is one that the writer knows, so no sort follows
    that could lose it. Spark writes a folder for each file; when all are there,
    the files get their names beside the old submission, which they then replace
    as a whole: a failed job leaves the old one.
    """
    spark = lines.sparkSession
    named = lines.where("line is not null").select(submission_file_name().alias("file"), "rank", "line")
    dealt = named.repartition("file").sortWithinPartitions("file", "rank").select("file", "line")

    def write(staged: str) -> None:
        dealt.write.option("lineSep", "\n").option("maxRecordsPerFile", 0).partitionBy("file").text(f"{staged}/_parts")
        for folder in folder_names(spark, f"{staged}/_parts"):
            parts = file_paths(spark, f"{staged}/_parts/{folder}")
            if len(parts) != 1:
                raise OSError(f"{folder} has {len(parts)} parts")
            rename(spark, parts[0], f"{staged}/{unquote(folder.removeprefix('file='))}")
        remove(spark, f"{staged}/_parts")

    replace_table(spark, path, write)


def run_log(summary: DataFrame, rows: DataFrame, top: int = 10) -> DataFrame:
    """Each query's summary with its first rows, rounded."""
    first = rows.where(F.col("rank") <= top).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "video_id", "frame_idx", F.round("pts_time", 3).alias("pts_time"), F.round("score", 4).alias("score")))).alias("top")
    )
    return summary.join(first, "query_id", "left")


def write_run_log(summary: DataFrame, rows: DataFrame, path: str, top: int = 10) -> None:
    replace_table(summary.sparkSession, path, lambda staged: run_log(summary, rows, top).write.json(staged))


def write_scores(scores: DataFrame, path: str) -> None:
    replace_table(scores.sparkSession, path, lambda staged: scores.write.option("header", True).csv(staged))


def write_manifest(manifest: DataFrame, path: str) -> None:
    replace_table(manifest.sparkSession, path, lambda staged: manifest.write.option("header", True).csv(staged))


def write_segments(segments: DataFrame, path: str, order: tuple[str, ...] = ("start", "end_sec")) -> None:
    """JSON lines, a folder for each video, in order of time; a job that fails anywhere leaves the old files."""
    dealt = segments.repartition("video_id").sortWithinPartitions("video_id", *order)
    replace_table(segments.sparkSession, path, lambda staged: dealt.write.partitionBy("video_id").json(staged))


def append_log(records: DataFrame, path: str) -> None:
    """New files whose names go by time, so that the last records are found without opening the rest; they appear when all are written."""
    append_lines(records.select(F.to_json(F.struct("*")).alias("value")), path)


def append_lines(lines: DataFrame, path: str) -> None:
    """``append_log`` of lines (value) that are records already; the order of partitions and of their rows is kept."""
    spark, at = lines.sparkSession, f"{time.time_ns():020d}"
    staged = f"{path}/_staged-{at}"
    try:
        lines.write.text(staged)
        for k, part in enumerate(file_paths(spark, staged)):
            rename(spark, part, f"{path}/log-{at}-{k:06d}.json")
    finally:
        remove(spark, staged)


def write_vector_files(vectors: DataFrame, path: str, dim: int, order: tuple[str, ...] = ("n",)) -> None:
    """vectors: video_id, n, embedding -> a folder video_id=<id> with one float32 .npy matrix for each video, its rows in order of n, or of ``order``.

    A file's bytes stream by in order and leave as the lines that they happen to
    have; one line end follows the matrix, which readers of the format ignore.
    """
    # By a window, not by a join: under a join a repartition by its key is dropped, and adaptive reads may then spread a video over tasks.
    count = F.count("*").over(Window.partitionBy("video_id"))
    header = F.concat(F.lit("{'descr': '<f4', 'fortran_order': False, 'shape': ("), count.cast("string"), F.lit(f", {dim}), }}"))
    schema = "video_id string, place long, line binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest, place = None, b"", 0
        out: list[tuple[str, int, bytes]] = []

        def given() -> pa.RecordBatch:
            names, places, lines = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.binary())], names=["video_id", "place", "line"])

        for batch in batches:
            for name, head, row in zip(*(batch.column(c).to_pylist() for c in ("video_id", "head", "embedding")), strict=True):
                if name != now:
                    if now is not None:
                        out.append((now, place, rest))
                    text = head.encode()
                    size = -(-(len(text) + 11) // 64) * 64
                    now, place, rest = name, 0, b"\x93NUMPY\x01\x00" + (size - 10).to_bytes(2, "little") + text.ljust(size - 11) + b"\n"
                if len(row) != dim:
                    raise ValueError(f"{name}: a vector of {len(row)} values, not {dim}")
                *lines, rest = (rest + np.array(row, "<f4").tobytes()).split(b"\n")
                out += [(name, place + k, x) for k, x in enumerate(lines)]
                place += len(lines)
            if out:
                yield given()
        if now is not None:
            out.append((now, place, rest))
            yield given()

    rows = vectors.where("video_id is not null").select("video_id", *order, header.alias("head"), "embedding").sortWithinPartitions("video_id", *order)
    lines = rows.mapInArrow(run, schema).sortWithinPartitions("video_id", "place").select("video_id", F.col("line").cast("string").alias("line"))
    replace_table(vectors.sparkSession, path, lambda staged: lines.write.option("lineSep", "\n").option("maxRecordsPerFile", 0).partitionBy("video_id").text(staged))


def sink_order(rows: DataFrame) -> DataFrame:
    """Place of each line in its file."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
