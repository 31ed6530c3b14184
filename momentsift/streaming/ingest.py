"""Structured Streaming ingestion of speech files and search logs.

Takes what is new since the last run and stops: resuming is the checkpoint's
work, so no list of finished files is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from momentsift.operators.segments import hallucination_tier
from momentsift.sources.readers import HISTORY, SPEECH, indexable_texts


def clean_speech(segments: DataFrame, tier1: list[str], tier2: list[str]) -> DataFrame:
    """Segments with text, clamped times, and their tier; first-tier rows go."""
    tier, pattern = hallucination_tier(F.col("text"), tier1, tier2)
    start = F.greatest(F.col("start"), F.lit(0.0))
    rows = indexable_texts(segments.withColumnRenamed("end", "end_sec")).withColumn("start", start)
    rows = rows.withColumns({"end_sec": F.greatest("start", "end_sec"), "tier": tier, "pattern": pattern})
    return rows.where(F.coalesce(F.col("tier"), F.lit(0)) != 1)


def ingest_speech(spark: SparkSession, source: str, target: str, checkpoint: str, tier1: list[str], tier2: list[str]) -> StreamingQuery:
    """New JSON-lines files under ``source``, cleaned and appended as Parquet to ``target``."""
    stream = spark.readStream.schema(SPEECH).json(source)
    return clean_speech(stream, tier1, tier2).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_history(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """New log records appended to ``target``; malformed lines are left out."""
    stream = spark.readStream.schema(HISTORY + ", _corrupt_record string").json(source)
    good = stream.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return good.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
