"""Index lists of more than one block, with the block size that tasks really have."""

import numpy as np
from pyspark.sql import functions as F

from momentsift.llm import jaccardjoin as j


def test_candidates_of_a_list_of_several_blocks(spark, tmp_path):
    n = 2 * j.LIST + 800
    each = spark.range(n).select(F.explode(F.array(F.lit(7).cast("long"), F.col("id") % 3000 + 100)).alias("token"), F.col("id").alias("node"), (F.col("id") % 20 + 30).cast("int").alias("size"))
    early = (F.col("token") == 7) & (F.col("node") % 40 == 0)
    postings = each.withColumn("rest", F.when(early, F.col("size") - 1).otherwise(F.floor(F.col("size") / 2)).cast("int"))
    j.index_lists(postings).write.parquet(str(tmp_path / "lists"))
    lists = spark.read.parquet(str(tmp_path / "lists"))
    assert lists.where("token = 7").agg(F.count_distinct("block"), F.count_if("many")).first() == (3, n)
    got = j.candidate_pairs(lists.withColumn("class", F.floor(F.col("node") / 1000)), 9, 4)
    ids = np.arange(0, n, 40)
    size = ids % 20 + 30
    ok = (9 * (np.minimum(size[:, None], size[None, :]) - 1) >= 4 * (size[:, None] + size[None, :])) & (ids[:, None] // 1000 != ids[None, :] // 1000) & (ids[:, None] < ids[None, :])
    want = {(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(ok), strict=True)}
    assert want and {(r["x"], r["y"]) for r in got.collect()} == want


def test_components_of_texts_that_share_a_passage_by_thousands(spark):
    """Lists of several blocks from texts: after a short passage one more word keeps texts apart, after a long one all link."""
    short, long = "one two three four five six", " ".join(f"w{k}" for k in range(16))
    many = j.LIST + 500
    rows = [(i, f"{long} e{i}") for i in range(many)] + [(i, f"{short} e{i // 2}") for i in range(many, many + 900)]
    want = {i: (13, 0) if i < many else (3, max(i // 2 * 2, many)) for i, _ in rows}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
