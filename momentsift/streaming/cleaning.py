"""Cleaning of speech over a stream: what a batch query finds by windows is kept as state for each video.

State of a video: the last text that was kept or cut, the length of its run, how
many rows were removed as first-tier and left, and whether a text was left. It
lives in the stream's checkpoint, so a restarted stream goes on with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from momentsift.operators.segments import cap_repeats, hallucination_tier, has_text, with_silent_markers
from momentsift.params import DEFAULT
from momentsift.sources.readers import SPEECH

#: Rows that are kept, and with each batch one row of what is known of a video (kind 'video').
CLEANED = "kind string, video_id string, start double, end_sec double, text string, removed long, cut long, left long, seen long"
STATE = "text string, run long, removed long, cut long, left long, seen long"


def clean_batch(segments: DataFrame, tier1: list[str], tier2: list[str], most: int = DEFAULT.repeats) -> DataFrame:
    """The batch query that the stream equals: rows with text that are not first-tier, at most ``most`` of a run of equal texts, and a marker for each video left without any."""
    spoken = segments.where(has_text()).where(F.coalesce(hallucination_tier(F.col("text"), tier1, tier2)[0], F.lit(0)) != 1)
    kept = cap_repeats(spoken, most)[0].select("video_id", "start", "end_sec", "text")
    blank = segments.select("video_id", F.lit(0.0).alias("start"), F.lit(0.0).alias("end_sec"), F.lit("").alias("text")).distinct()
    return with_silent_markers(kept.unionByName(blank))


def clean_stream(segments: DataFrame, tier1: list[str], tier2: list[str], most: int = DEFAULT.repeats) -> DataFrame:
    """``CLEANED`` rows of a stream of segments (video_id, start, end_sec, text) whose files come in order of time.

    A batch may hold any rows of a video; they are taken in order of start and
    end. Rows of one video never wait for others, and no batch is kept.
    """
    tiered = segments.select("video_id", "start", "end_sec", "text", F.coalesce(hallucination_tier(F.col("text"), tier1, tier2)[0], F.lit(0)).alias("tier"), has_text().alias("spoken"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, run, removed, cut, left, seen = state.get if state.exists else (None, 0, 0, 0, 0, 0)
        rows = pd.concat(batches).sort_values(["start", "end_sec"], kind="stable")
        kept = []
        for start, end, text, tier, spoken in rows[["start", "end_sec", "text", "tier", "spoken"]].itertuples(index=False):
            seen += 1
            if not spoken:
                continue
            if tier == 1:
                removed += 1
                continue
            run = run + 1 if text == last else 1
            last = text
            if run > most:
                cut += 1
                continue
            left += 1
            kept.append(("segment", key[0], start, end, text, None, None, None, None))
        state.update((last, run, removed, cut, left, seen))
        kept.append(("video", key[0], None, None, None, removed, cut, left, seen))
        columns = [c.split()[0] for c in CLEANED.split(", ")]
        out = pd.DataFrame(kept, columns=columns)
        yield out.astype({c: "Int64" for c in ("removed", "cut", "left", "seen")} | {c: "float64" for c in ("start", "end_sec")})

    return tiered.groupBy("video_id").applyInPandasWithState(step, CLEANED, STATE, "append", "NoTimeout")


def ingest_cleaned(spark: SparkSession, source: str, target: str, checkpoint: str, tier1: list[str], tier2: list[str], most: int = DEFAULT.repeats, files_at_once: int = 1000) -> StreamingQuery:
    """New JSON-lines files under ``source``, in order of their age, cleaned and appended as Parquet to ``target``; stops when all are read."""
    stream = spark.readStream.schema(SPEECH).option("maxFilesPerTrigger", files_at_once).json(source).withColumnRenamed("end", "end_sec")
    cleaned = clean_stream(stream, tier1, tier2, most)
    return cleaned.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cleaned_segments(rows: DataFrame) -> DataFrame:
    """What a stream has written (``CLEANED``) -> kept segments, and a blank marker for every video that no text was left of so far."""
    kept = rows.where("kind = 'segment'").select("video_id", "start", "end_sec", "text")
    silent = rows.where("kind = 'video'").groupBy("video_id").agg(F.max("left").alias("left")).where("left = 0")
    return kept.unionByName(silent.select("video_id", F.lit(0.0).alias("start"), F.lit(0.0).alias("end_sec"), F.lit("").alias("text")))


def cleaning_log(rows: DataFrame) -> DataFrame:
    """video_id, seen, removed, cut, left after the last batch of each video."""
    newest = Window.partitionBy("video_id").orderBy(F.desc("seen"))
    return rows.where("kind = 'video'").withColumn("_at", F.row_number().over(newest)).where("_at = 1").select("video_id", "seen", "removed", "cut", "left")
