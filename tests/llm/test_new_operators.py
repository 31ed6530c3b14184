"""Language scores, Merkle manifests and ranked lexical search against plain versions, on given tables and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentsift.llm import lexsearch, lmscore, merkle, mixing

from .test_operators import AWKWARD


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward texts with columns whose names clash with those inside, a null id and repeated rows."""
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}", None, i) for i, t in enumerate(AWKWARD)]
    rows += [(None, "no id\nat all", "s1", "en", None), (3, "word", None, "", 5), (3, "word", None, "", 5), (90, "\n\n", "", "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    extra = {c: F.lit(c) for c in ("id", "g", "lo", "n", "path", "level", "bucket", "row", "fold", "word", "rank", "item", "term", "score")}
    return df.withColumns(extra)


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def same(got, want):
    key = lambda r: tuple(map(str, r))
    return sorted(got, key=key) == sorted(want, key=key)


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    trees = {}
    for g, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels_of([leaf(r) for r in members])
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = levels_of([trees[g][-1][0] for g in order])
    for at, g in enumerate(order):
        for k, row in enumerate(groups[g]):
            even = zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 2 == 0
            now = leaf((*row[:4], row[4].replace("\n", "") if even and row[4] is not None else row[4]))
            siblings = []
            for levels, place in ((trees[g], k), (top, at)):
                for nodes in levels[:-1]:
                    run, mine = nodes[place // 3 * 3 : place // 3 * 3 + 3], place % 3
                    siblings += run[:mine] + run[mine + 1 :]
                    now = h(*run[:mine], now, *run[mine + 1 :])
                    place //= 3
            yield (row[0], leaf(row), trees[g][-1][0], top[-1][0], h(*siblings), now, now == top[-1][0])


@pytest.mark.parametrize("which", ["docs", "given"])
def test_manifest(which, request):
    df = request.getfixturevalue(which)
    want = list(manifest([tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]))
    got = [tuple(r) for r in merkle.tampered_manifest(df).collect()]
    assert same(got, want)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 10, 82, 250])
def test_manifest_of_any_size(spark, n):
    """Last runs of one, two and three nodes, a lone leaf, groups that end in the middle of a stratum; tampering is found where it is."""
    rows = [(k, "hot" if k % 5 else f"g{k % 4}", "x", k, f"t{k}\n" if k % 2 else f"t{k}") for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    got = [tuple(r) for r in merkle.tampered_manifest(df).collect()]
    assert same(got, list(manifest(rows)))
    assert all(r[-1] == (k % 2 == 0 or zlib.crc32(str(k).encode()) % 2 == 1) for r in got for k in [r[0]])


def test_manifest_columns(spark):
    """Other fields, groups and carried columns; paths lead from every leaf to the root."""
    df = spark.createDataFrame([(k, k % 2, f"v{k}", None) for k in range(20)], "k long, half long, v string, path string")
    got = merkle.manifest(df, ("v", "path"), "k", "half", {"again": merkle.leaf_digest([F.col("v"), F.col("path")])})
    assert got.columns == ["k", "half", "leaf", "subroot", "root", "path", "again"] and got.count() == 20
    assert got.where(F.col("again") == F.col("leaf")).where(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == 20
    assert got.select("root").distinct().count() == 1 and got.select("half", "subroot").distinct().count() == 2


# Ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(documents, items, k=20):
    """documents: (id, text), items: (id, text) -> item_id, rank, doc_id, score."""
    counted = [(i, Counter(terms(t))) for i, t in documents]
    sizes = [sum(c.values()) for _, c in counted]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    for item, text in items:
        found = []
        for (doc, c), size in zip(counted, sizes, strict=True):
            if not size:
                continue
            m, score = 100 - 25 + 25 * size * n // total, 0
            for t in terms(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(found)[:k], 1):
            yield item, rank, doc, -score


ITEMS = [(1, "word ELEVEN ten ten"), (2, "lorem ipsum 1.2.3.4 nothing"), (3, None), (4, " -- "), (5, "ünïcödé İstanbul 12³½ ΣΑΣ x"), (5, "two words"), (None, "the x" + "x" * 59_999)]


@pytest.mark.parametrize("block", [1_000_000, 1])
def test_ranked_documents(spark, docs, block):
    items = spark.createDataFrame(ITEMS, "item_id int, text string").withColumns({"doc_id": F.lit(1), "score": F.lit(2)})
    got = [tuple(r) for r in lexsearch.ranked_documents(docs, items, block_chars=block).select("item_id", "rank", "doc_id", "score").collect()]
    want = list(ranking([tuple(r) for r in docs.select("doc_id", "text").collect()], ITEMS))
    assert same(got, want) and {r[0] for r in got} >= {1, 2, 5, None}


def test_ranked_documents_given(spark, given, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = [tuple(r) for r in lexsearch.ranked_documents(given, items).select("item_id", "rank", "doc_id", "score").collect()]
    assert same(got, list(ranking([tuple(r) for r in given.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])))


def test_ranked_documents_ties_and_empty(spark, docs):
    """More equal documents than ranks over many tasks: the smallest ids, null last; a heap that is cut down on the way."""
    many = spark.createDataFrame([(None if k == 7 else 500 - k, "same text twice") for k in range(500)], "doc_id long, text string").repartition(9)
    items = spark.createDataFrame([(1, "text")], "item_id long, text string")
    other = many.unionByName(spark.createDataFrame([(9999, "something else")] * 3, "doc_id long, text string"))
    held, lexsearch.HELD = lexsearch.HELD, 30
    try:
        got = lexsearch.ranked_documents(other, items, k=20).orderBy("rank").collect()
    finally:
        lexsearch.HELD = held
    assert [r["doc_id"] for r in got] == list(range(1, 21)) and len({r["score"] for r in got}) == 1
    assert lexsearch.ranked_documents(docs.where("false"), items).count() == 0
    assert lexsearch.ranked_documents(docs, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexsearch.ranked_documents(docs, items.where("false")).count() == 0


# Language scores


def base_scores(rows):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for i, t in rows]
    c = Counter(x for i, w in tokens if fold(i) != 1 for x in w)
    n, v = sum(c.values()), len(c)
    return [(i, fold(i) == 1, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for i, w in tokens]


@pytest.mark.parametrize(("which", "head"), [("docs", 65_536), ("docs", 2), ("given", 65_536), ("given", 100)])
def test_language_scores(which, head, request):
    df = request.getfixturevalue(which)
    got = lmscore.language_scores(df, head=head).collect()
    want = base_scores([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert same([(*tuple(r)[:5], round(r["base_score"], 4)) for r in got], want)
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) and r["bits_per_byte"] >= 0 for r in got)


def test_language_scores_tell_texts_apart(spark, given):
    """On the held-out rows the model needs fewer bits than letters alone would, a text reads better than its letters backwards, and copies score alike."""
    rows = [r["text"] for r in given.where("length(text) between 200 and 2000").limit(300).collect()]
    held = [k for k in range(100_000, 101_000) if zlib.crc32(str(k).encode()) % 5 == 1][:40]
    train = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 5 != 1][: len(rows) - 20]
    data = list(zip(train, rows[:-20], strict=False)) + list(zip(held, [t for text in rows[-20:] for t in (text, text[::-1])], strict=True)) + [(held[0], rows[-20])]
    got = {}
    for r in lmscore.language_scores(spark.createDataFrame(data, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    better = sum(got[held[k]][0]["bits_per_byte"] < got[held[k + 1]][0]["bits_per_byte"] for k in range(0, 40, 2))
    assert better >= 18
    assert len({round(r["score"], 9) for r in got[held[0]]}) == 1
    assert np.mean([got[k][0]["bits_per_byte"] for k in held[::2]]) < 4.7


def test_language_scores_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lmscore.language_scores(empty).count() == 0
    only = [k for k in range(50) if zlib.crc32(str(k).encode()) % 5 == 1][:2]
    got = lmscore.language_scores(spark.createDataFrame([(only[0], "a b"), (only[1], "")], "doc_id long, text string")).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) for r in got} == {(3, 0, 0, True), (1, 0, 0, True)}


def small_mixture(frequent):
    codes = mixing.Codes(np.array([5.0, 3, 1, 1]))
    m = mixing.Mixture(codes, 2, 6, frequent)
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 4, 600)
    first = np.zeros(600, bool)
    first[::30] = True
    counts = mixing.BitCounts(m)
    counts.add(symbols, first)
    return m, symbols, first, counts.counts()


@pytest.mark.parametrize("frequent", [range(0), range(0, 2)])
def test_mixture_is_a_distribution(frequent):
    """The probabilities of all next symbols add up to one, with weights that adapt, and counts are those of a plain loop."""
    m, symbols, first, table = small_mixture(frequent)
    want = np.zeros_like(table)
    hashes = m.contexts(symbols, first)
    for k, s in enumerate(symbols):
        for at in range(m.codes.first[s], m.codes.first[s + 1]):
            for c in hashes:
                want[m.codes.bit[at], c[k] ^ m.hashed_node[at]] += 1
            want[m.codes.bit[at], m.own_node[at]] += 1
    assert (table == want).all()
    m.set_counts(*table)
    met = np.zeros((2, mixing.GATES, mixing.BUCKETS))
    _, bits = m.run(symbols, np.arange(0, 601, 30), False, met)
    m.set_learnt(m.learnt(bits, met))
    assert met.sum() == bits
    kept, mixing.CHUNK = mixing.CHUNK, 4
    try:
        start = symbols[:13]
        whole = [m.run(np.append(start, s), np.array([0, 14]), True)[0][0] for s in range(4)]
        before = m.run(start, np.array([0, 13]), True)[0][0]
        lanes = m.run(np.concatenate([start, symbols[:5]]), np.array([0, 13, 13, 18]), True)[0]
    finally:
        mixing.CHUNK = kept
    assert sum(2**x for x in whole) == pytest.approx(2**before, rel=1e-4)
    assert lanes[0] == pytest.approx(before, rel=1e-5) and lanes[1] == 0


def test_codes():
    c = mixing.Codes(np.array([8.0, 4, 2, 1, 1]))
    assert np.diff(c.first).tolist() == [1, 2, 3, 4, 4] and c.nodes == 4
    words = ["".join(map(str, c.bit[a:b])) for a, b in zip(c.first, c.first[1:], strict=False)]
    assert len(set(words)) == 5 and not any(a != b and b.startswith(a) for a in words for b in words)
