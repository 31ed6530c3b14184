"""Overlaps with the benchmark against every stretch of every alignment, and stages over columns of any name."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from momentsift.llm import decontaminate, queries


def best_stretch(doc, item):
    """Equal words of the best stretch with at least ten words (or the item, if shorter) of which three of four are equal: all stretches of all alignments are tried."""
    best, least = 0, min(10, len(item))
    for shift in range(-len(item) + 1, len(doc)):
        pairs = [doc[k + shift] == item[k] for k in range(len(item)) if 0 <= k + shift < len(doc)]
        for a in range(len(pairs)):
            same = 0
            for b in range(a, len(pairs)):
                same += pairs[b]
                if b - a + 1 >= least and 4 * same >= 3 * (b - a + 1):
                    best = max(best, same)
    return best


def words(rng, n):
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


def judged(spark, docs, items, **k):
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "h1", "items", "overlap", "n_items")})
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    return {r["doc_id"]: r["overlap"] for r in decontaminate.contamination(d, b, **k).collect()}


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 50])
def test_more_copied_text_hides_no_copy(spark, block):
    """Twelve equal words, then two of three: found however long the copy is."""
    rng = random.Random(1)
    item = words(rng, 90)
    copy = [w if k < 12 or k % 3 else f"x{k}" for k, w in enumerate(item)]
    docs = [words(rng, 30) + copy[:n] + words(rng, 30) for n in (12, 20, 40, 60, 90)] + [words(rng, 100)]
    got = judged(spark, docs, [item, words(rng, 60)], block_words=block)
    assert [got[k] for k in range(5)] == [best_stretch(d, item) for d in docs[:5]] and all(got[k] >= 12 for k in range(5)) and got[5] == 0


def test_overlaps_equal_every_stretch(spark):
    """Drawn copies of parts of items with substitutions of any density: the same overlaps as by trying everything."""
    rng = random.Random(2)
    items = [words(rng, n) for n in (12, 25, 40, 60)]
    docs = []
    for k in range(160):
        item = rng.choice(items)
        a = rng.randrange(len(item) - 8)
        part = item[a : a + rng.randrange(8, 61)]
        rate = rng.choice([0, 0.1, 0.2, 0.25, 0.3, 0.4])
        docs.append(words(rng, rng.randrange(5)) + [w if rng.random() >= rate else f"s{k}" for w in part] + words(rng, rng.randrange(5)))
    got = judged(spark, docs, items)
    want = {k: max(best_stretch(d, i) for i in items) for k, d in enumerate(docs)}
    assert got == want and 40 < sum(v > 0 for v in want.values()) < 160


CLASHING = ("name", "_row", "_name", "_ROW_", "rank", "kept", "best", "stays", "node", "a", "b", "id", "h1", "key")


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """Every stage that filters returns its rows with all columns as they were, and judges as without them."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, text), (2, text), (3, text + " sixteen"), (4, "other words stand here alone and nothing else does"), (None, None), (6, ""), (6, ""), (7, "short")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    wide = plain.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHING})
    for stage in (queries.keep_one_copy, queries.keep_one_similar, queries.drop_contaminated, queries.drop_toxic):
        narrow = Counter(tuple(r) for r in stage(spark, plain, sf_dir).collect())
        got = stage(spark, wide, sf_dir)
        assert got.columns == wide.columns
        found = got.collect()
        assert Counter((r["doc_id"], r["text"]) for r in found) == narrow
        for r in found:
            assert all(r[c] == f"{c}{'-' if r['doc_id'] is None else r['doc_id']}" for c in CLASHING)
        assert stage(spark, wide.where("false"), sf_dir).count() == 0
    assert {r["doc_id"] for r in queries.keep_one_copy(spark, wide, sf_dir).collect()} == {2, 3, 4, 6, 7}
    assert {r["doc_id"] for r in queries.keep_one_similar(spark, wide, sf_dir).collect()} == {1, 4, None, 6, 7}
    packed = queries.pack(spark, wide, sf_dir)
    assert packed.count() == len(rows)
