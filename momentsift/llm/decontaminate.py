"""Benchmark decontamination by spaced-seed hashing.

A fixed mask ignores some positions of a window of words, so a substituted word
at an ignored position leaves the hash alone. Hashes of all masks over the
benchmark items are joined with those over every window of every document; each
hit is extended along its diagonal and verified with substitutions allowed. The
benchmark is the stated query set: it is taken in blocks of bounded size, each
block against all rows.

No overlap that verifies goes without a hit. At most a quarter of its words are
substituted, so of the fours of words it is cut into, one has a substitution at
most, and the other three words of it stand as 111, 1101 or 1011.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, input_rows, map_rows, some_texts, written

#: 1: the word at this place counts. Together they hit every four words with one substitution at most, as MIN_EQUAL asks.
MASKS = ("111", "1101", "1011")
#: Words a verified overlap needs (or the whole item, if shorter), share of equal words. Items under five words verify by equality only.
MIN_OVERLAP, MIN_EQUAL = 10, 0.75
#: Items shorter than this verify by equality only.
SHORT = 5
#: What one block of benchmark items may hold: hashes that are broadcast at once.
BLOCK_WORDS = 1_000_000
#: Score of a substituted word where an equal one scores 1: a stretch with a sum of 0 or more has MIN_EQUAL equal words.
SUBSTITUTION = -round(MIN_EQUAL / (1 - MIN_EQUAL))
TABLE_BITS = 22
#: Hits, or words of their items, that are looked at together.
MAX_HITS = 1 << 20
MAX_KEPT = 200_000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…—–¿¡"
_ODD = np.random.default_rng(8).integers(1, 1 << 63, 16, np.uint64) | np.uint64(1)


class NormalHashes(dict):
    """Word -> hash of its lower-case form without punctuation at its ends; 0 for mere punctuation."""

    def __missing__(self, word: str) -> int:
        plain = word.strip(_EDGE).lower()
        h = self[word] = (xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) | 1) if plain else 0
        return h


def word_hashes(text: str, known: NormalHashes) -> np.ndarray:
    if len(known) > MAX_KEPT:
        known.clear()
    words = text.split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return h[h != 0]


def masks_for(length: int) -> list[np.ndarray]:
    """Places that count; an item shorter than every mask has one of its own, all ones."""
    fit = [np.flatnonzero(np.array(list(m)) == "1") for m in MASKS if len(m) <= length]
    return fit or [np.arange(length)]


def _hash(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    count = len(words) - int(places[-1])
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(count, np.uint64(int(places @ (1 << np.arange(len(places), dtype=np.int64)))))
    for k, p in enumerate(places):
        h = h + words[p : p + count] * _ODD[k]
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _runs(sizes: np.ndarray) -> list[slice]:
    """Slices over ``sizes`` whose sums stay near MAX_HITS."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // MAX_HITS)) + 1
    ends = [0, *cuts.tolist(), len(sizes)]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of starts[k], starts[k] + 1, ... of sizes[k] numbers, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Seeds:
    """All masked hashes of one block of items, sorted, with a table that rules most windows out."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.words = [w for _, w in items]
        self.ids = [i for i, _ in items]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(self.words)
        self.need = MIN_EQUAL * np.minimum(MIN_OVERLAP, self.size)
        masks: dict[tuple[int, ...], list[int]] = {}
        for k, w in enumerate(self.words):
            for m in masks_for(len(w)):
                masks.setdefault(tuple(m.tolist()), []).append(k)
        self.tables = []
        for places, members in masks.items():
            places = np.array(places)
            hashes = [_hash(self.words[k], places) for k in members]
            h = np.concatenate(hashes)
            item = np.repeat(members, [len(x) for x in hashes])
            at = np.concatenate([np.arange(len(x)) for x in hashes])
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << TABLE_BITS, bool)
            seen[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            self.tables.append((places, h[order], item[order], at[order], seen))

    def diagonals(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and document place less item place of all hits whose diagonal has as many equal words as an overlap needs."""
        found = []
        for places, h, item, at, seen in self.tables:
            doc = _hash(words, places)
            maybe = np.flatnonzero(seen[(doc >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            if len(maybe):
                lo = np.searchsorted(h, doc[maybe], "left")
                n = np.searchsorted(h, doc[maybe], "right") - lo
                maybe, lo, n = maybe[n > 0], lo[n > 0], n[n > 0]
                for run in _runs(n):
                    k = _ranges(lo[run], n[run])
                    found.append(np.unique((item[k] << 32) + (np.repeat(maybe[run], n[run]) - at[k] + (1 << 31))))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.unique(np.concatenate(found))
        item, diagonal = found >> 32, (found & ((1 << 32) - 1)) - (1 << 31)
        enough = [self._equal(words, item[run], diagonal[run]) >= self.need[item[run]] for run in _runs(self.size[item])]
        enough = np.concatenate(enough)
        return item[enough], diagonal[enough]

    def _equal(self, words: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        size = self.size[item]
        place = _ranges(diagonal, size)
        equal = self.flat[_ranges(self.start[item], size)] == words[np.clip(place, 0, len(words) - 1)]
        return np.add.reduceat(equal & (place >= 0) & (place < len(words)), np.cumsum(size) - size, dtype=np.int64)

    def overlaps(self, words: np.ndarray) -> dict[int, int]:
        """Item id -> equal words of its best verified overlap."""
        best: dict[int, int] = {}
        for k, diagonal in zip(*(x.tolist() for x in self.diagonals(words)), strict=True):
            got = verified_overlap(words, self.words[k], diagonal)
            if got > best.get(self.ids[k], 0):
                best[self.ids[k]] = got
        return best


def verified_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> int:
    """Equal words of the stretch of the alignment with the most of them that is long enough and has ``MIN_EQUAL`` equal words; 0 if none has.

    For each end, the earliest start with no larger sum of scores gives the
    longest such stretch, so equal words beyond a poor part never hide others.
    """
    a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    equal = doc[a + diagonal : b + diagonal] == item[a:b]
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, SUBSTITUTION))])
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    same = np.concatenate([[0], np.cumsum(equal)])
    if len(item) < SHORT:
        return len(item) if same[-1] == len(item) else 0
    long = np.arange(len(total)) - start >= min(MIN_OVERLAP, len(item))
    return int(((same - same[start]) * long).max())


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """Lists of (id, word hashes), each of about ``block_words`` words; streamed, one block in memory at a time."""
    known, block, size = NormalHashes(), [], 0
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).dropna(subset="t").orderBy("i").toLocalIterator():
        w = word_hashes(r["t"], known)
        if len(w):
            block.append((r["i"], w))
            size += len(w)
            if size >= block_words:
                yield block
                block, size = [], 0
    if block:
        yield block


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per row: ``id_col``, contaminated, n_items, overlap (equal words of the longest), item_ids.

    Null and empty texts are clean; texts of any length are read whole;
    repeated rows are judged each. Items without words are passed over; those
    of one id, or of null ids, count once. Columns other than id and text are
    ignored, whatever their names; an empty table gives no rows, an empty
    benchmark marks none.
    """
    kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, id_col), (benchmark, item_col)))
    rows = input_rows(docs, id_col, text_col)
    # What a row is, for the results of several blocks: the same id and text have the same results.
    rows = rows.select(F.xxhash64("id", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "id").alias("h2"), "id", "text")
    schema = f"h1 long, h2 long, id {kind}, n_items long, overlap long, items array<{item_kind}>"
    found = held = None
    for block in item_blocks(benchmark, item_col, item_text_col, block_words):
        if held is not None:  # there are more: what came before is written, so that one block is held at a time
            found = _with_hits(found, held, rows, schema)
        held = block
    if found is None:
        out = _judged(rows, held, schema) if held is not None else rows.select("h1", "h2", "id", *[F.lit(0).cast("long").alias(c) for c in ("n_items", "overlap")], F.array().cast(f"array<{item_kind}>").alias("items"))
    else:
        found = _with_hits(found, held, rows, schema)
        each = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))  # a row has one list for each block
        found = found.groupBy("h1", "h2").agg(F.max("overlap").alias("overlap"), each.alias("items"))
        out = rows.select("h1", "h2", "id").join(found, ["h1", "h2"], "left").withColumn("n_items", F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long"))
    return out.select(
        F.col("id").alias(id_col),
        (F.col("n_items") > 0).alias("contaminated"),
        "n_items",
        F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"),
        F.coalesce(F.array_join(F.transform("items", lambda i: i.cast("string")), ",", "null"), F.lit("")).alias("item_ids"),
    )


def _with_hits(found: DataFrame | None, block: list[tuple[object, np.ndarray]], rows: DataFrame, schema: str) -> DataFrame:
    hits = _judged(rows, block, schema).where("n_items > 0").dropDuplicates(["h1", "h2"]).select("h1", "h2", "overlap", "items")
    hits = written(hits, "hits")
    return hits if found is None else found.unionByName(hits)


def _judged(rows: DataFrame, block: list[tuple[object, np.ndarray]], schema: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def make():
        with np.errstate(over="ignore"):
            seeds, known = Seeds(shared.value), NormalHashes()

        def step(batch: pa.RecordBatch) -> dict:
            n, overlap, items = [], [], []
            with np.errstate(over="ignore"):
                for text in some_texts(batch.column("text")):
                    found = seeds.overlaps(word_hashes(text, known))
                    n.append(len(found))
                    overlap.append(max(found.values(), default=0))
                    items.append(sorted(found, key=lambda i: (i is None, i)))
            return {c: batch.column(c) for c in ("h1", "h2", "id")} | {"n_items": n, "overlap": overlap, "items": items}

        return step

    return map_rows(rows, schema, make)


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found; each block of items is one filter."""
    for block in item_blocks(benchmark, item_col, item_text_col, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            with np.errstate(over="ignore"):
                seeds, known = Seeds(shared.value), NormalHashes()

            def keep(texts):
                with np.errstate(over="ignore"):
                    return [not seeds.overlaps(word_hashes(t, known)) for t in texts]

            return keep

        docs = filter_rows(docs, text_col, make)
    return docs
