"""From raw documents to packed training sequences, one operator a stage.

``run`` writes what each stage returns as Parquet into the folder that the
cluster shares and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from momentsift.llm.common import Scratch, table, written
from momentsift.llm.queries import drop_contaminated, drop_toxic, keep_one_copy, keep_one_similar, pack

STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", keep_one_copy),
    ("n-gram Jaccard join", keep_one_similar),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Trained scores, similarity components and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        now = Scratch(spark)
        docs = now.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            before.clear()  # the stage before is read no more
        before = now
    name, stage = STAGES[-1]
    docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    if before is not None:
        before.clear()
    return docs
