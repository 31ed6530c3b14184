"""Folding asks its map for each different character that grows, not for each character of a text."""

import unicodedata

from pyspark.sql import functions as F

from momentsift.functions import text as tx


def test_characters_that_grow(spark):
    texts = ["plain ASCII", "", None, "½ … ﬁ ﬁ ㍿ Ǆ", "é½é…é" * 50, "x" * 100_000 + "…"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    folded = rows.select("i", tx.fold(F.col("text")).alias("f"))
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if unicodedata.category(c) != "Mn").lower()
    assert {r["i"]: r["f"] for r in folded.collect()} == {i: None if t is None else plain(t) for i, t in enumerate(texts)}
    assert "split(" not in folded._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_are_tried_between_the_first_and_the_last_only(spark):
    assert tx._ranges("½…é").startswith(r"[\x{bd}-\x{2026}&&[")
