"""What one task must write stays in one task when Spark turns joins into broadcasts at run time."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from momentsift.sources import readers, sinks


@pytest.fixture
def late_broadcasts(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    # Files are larger than this, what is grouped from them is smaller.
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_pending_work_of_names_in_several_input_files(spark, sf_dir, tmp_path, late_broadcasts):
    path = str(tmp_path / "conversations.parquet")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id < 40")
    twice = rows.withColumn("conv_id", F.col("conv_id") + 1000).unionByName(rows.withColumn("conv_id", F.col("conv_id") + 10000))
    long = F.concat_ws(" ", "text", *[F.sha2(F.concat_ws(":", "conv_id", "turn", F.lit(k)), 512) for k in range(8)])
    twice.withColumn("text", long).repartition(8, F.xxhash64("conv_id", "turn")).write.parquet(path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    for t in ("events", "documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = [r[0] for r in c.execute(entry.oracle_sql()["E13_pending_work"]).fetchall()]
    got = [r[0] for r in entry.queries()["E13_pending_work"](spark, str(tmp_path)).collect()]
    assert want and got == want


def test_vector_files_of_videos_in_several_partitions(spark, tmp_path, late_broadcasts):
    rows = spark.range(4000).select(F.concat(F.lit("V"), F.col("id") % 7).alias("video_id"), (F.floor(F.col("id") / 7) + 1).cast("int").alias("n"), F.array(F.lit(10.0).cast("float"), *[F.rand(k).cast("float") for k in range(15)]).alias("embedding"))
    rows.repartition(8).write.parquet(str(tmp_path / "in"))
    vectors = spark.read.parquet(str(tmp_path / "in"))
    sinks.write_vector_files(vectors, str(tmp_path / "out"), 16)
    assert len(list((tmp_path / "out").glob("video_id=*/part-*"))) == 7
    again = {(r["video_id"], r["n"] + 1): r["embedding"] for r in readers.read_vector_files(spark, str(tmp_path / "out"), 16, readers.FOLDER, "part-*").collect()}
    lines = {(r["video_id"], r["n"]): r["embedding"] for r in vectors.collect()}
    first = min(n for _, n in again) - min(n for _, n in lines)
    assert {(v, n - first): e for (v, n), e in again.items()} == lines
