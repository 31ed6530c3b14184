"""Ranked lexical search of stated items in all documents, without a document index.

The terms of a block of items make one Aho-Corasick automaton, each guarded by
a boundary on both sides, so that only whole terms match. Two scans of the
texts run it: the first counts documents, terms and document frequencies, the
second counts tf of each text, adds up the scores of the items to which the
automaton's outputs map, and keeps the best of each task. Nothing but counts
and the best rows of each task leaves a task, and no text moves.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, input_rows, release_memory, some_texts

#: Documents of an item's ranking; characters of the terms of one block, which bounds what a task is sent.
TOP, BLOCK_CHARS = 20, 1_000_000
#: Candidates that a task holds before it comes down to the best; cells of a table of scores; parts of an item's last ranking.
HELD, CELLS, PARTS = 400_000, 1_000_000, 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z lowered; every ASCII character but letters and digits is the boundary.
_NORMAL = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in _LOWER)


def normal(text: str) -> bytes:
    """UTF-8 of the terms with one or more spaces around each; multi-byte characters have no ASCII bytes."""
    return b" " + text.encode().translate(_NORMAL) + b" "


class Block:
    """Some items: their terms, and for each term the items that hold it, how often."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        self.ids = [i for i, _ in items]
        number: dict[bytes, int] = {}
        places: list[dict[int, int]] = []
        for k, (_, terms) in enumerate(items):
            for term, times in Counter(terms).items():
                t = number.setdefault(term, len(number))
                if t == len(places):
                    places.append({})
                places[t][k] = times
        self.terms = list(number)
        self.start = np.cumsum([0, *map(len, places)])
        self.item = np.array([k for p in places for k in p], np.int64)
        self.times = np.array([n for p in places for n in p.values()], np.int64)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, term in enumerate(self.terms):
            found.add_word(f" {term.decode('latin-1')} ", k)
        found.make_automaton()
        return found


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[Block]:
    """Items with terms in blocks of about ``block_chars`` characters of terms; streamed, one block in memory at a time."""
    block, size = [], 0
    rows = items.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).dropna(subset="t").orderBy("i", "t")
    for r in rows.toLocalIterator():
        terms = normal(r["t"]).split()
        if terms:
            block.append((r["i"], terms))
            size += sum(map(len, set(terms)))
            if size >= block_chars:
                yield Block(block)
                block, size = [], 0
    if block:
        yield Block(block)


def _scanned(automaton, texts: Iterator[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each text: its number of terms, the block's terms in it, and their tf."""
    for text in texts:
        plain = normal(text)
        seen = Counter(map(itemgetter(1), automaton.iter(plain.decode("latin-1"))))
        yield len(plain.split()), np.fromiter(seen.keys(), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen))


def statistics(rows: DataFrame, block) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all terms, and the document frequencies of the block's terms."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches):
        automaton, df, docs, terms = block.value.automaton(), np.zeros(len(block.value.terms), np.int64), 0, 0
        for batch in batches:
            for n, seen, _ in _scanned(automaton, some_texts(batch.column("text"))):
                docs, terms = docs + (n > 0), terms + n
                df[seen] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], held])), pa.array(np.concatenate([[docs, terms], df[held]]))], schema=schema)
        release_memory()

    sums = {r["term"]: r["n"] for r in rows.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return sums.get(-1, 0), sums.get(-2, 0), np.array([sums.get(k, 0) for k in range(len(block.value.terms))], np.int64)


class _Best:
    """The best ``k`` (score, then smaller id, null last) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.zeros(items, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        row, item = np.nonzero((scores > 0) & (scores >= self.floor))
        self.parts.append((item, scores[row, item], ids[row], null[row]))
        self.held += len(row)
        if self.held > HELD:
            self.parts = [self.rows()]
            self.held = len(self.parts[0][0])

    def rows(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        item, score, ids, null = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, null, -score, item))
        item, score, ids, null = item[order], score[order], ids[order], null[order]
        place = np.arange(len(item)) - np.searchsorted(item, item, "left")
        last = place == self.k - 1
        self.floor[item[last]] = score[last]
        kept = place < self.k
        return item[kept], score[kept], ids[kept], null[kept]


def best_of_block(rows: DataFrame, block, k: int, kind: str) -> DataFrame:
    """item, item_id, id, score: the best k of each task, for each item of the block."""
    docs, terms, df = statistics(rows, block)
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    fields = f"item long, item_id {kind}, id long, score long"
    schema = arrow_schema(rows.sparkSession, fields)

    def run(batches):
        b = block.value
        automaton, best = b.automaton(), _Best(len(b.ids), k)
        count = np.diff(b.start)
        step = max(1, CELLS // len(b.ids))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                some = batch.slice(a, step)
                scores = np.zeros((some.num_rows, len(b.ids)), np.int64)
                for line, (n, seen, tf) in enumerate(_scanned(automaton, some_texts(some.column("text")))):
                    if len(seen):
                        m = 100 - 25 + (25 * n * docs) // terms
                        part = weight[seen] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
                        size = count[seen]
                        at = np.repeat(b.start[seen] - np.cumsum(size) + size, size) + np.arange(size.sum())
                        np.add.at(scores[line], b.item[at], np.repeat(part, size) * b.times[at])
                ids = some.column("id")
                best.add(scores, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        item, score, ids, null = best.rows()
        for a in range(0, len(item), 10_000):
            part = slice(a, a + 10_000)
            named = [b.ids[x] for x in item[part].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(item[part]), pa.array(named, type=schema.field("item_id").type), pa.array(ids[part], mask=null[part]), pa.array(score[part])], schema=schema
            )
        release_memory()

    return rows.mapInArrow(run, fields)


def ranked_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """item_id, rank (from 1), ``id_col`` (an integer), score: the k best documents of each item with a score above 0.

    Null and empty texts have no terms; whole texts of any length are scanned.
    Repeated rows are documents each; equal scores go by ascending id, null
    last. Rows of ``items`` are items each, also with a repeated or null id;
    those without terms, an empty table of documents or of items give no rows.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = input_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text")
    kind = items.schema[item_col].dataType.simpleString()
    scratch, first, out = Scratch(spark), 0, None
    for part in item_blocks(items, item_col, item_text_col, block_chars):
        block = spark.sparkContext.broadcast(part)
        found = best_of_block(rows, block, k, kind)
        found = found.withColumn("part", F.spark_partition_id() % PARTS).withColumn("item", F.col("item") + first)
        for within in (["item", "part"], ["item"]):
            order = Window.partitionBy(*within).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = scratch.written(found.select("item_id", "rank", F.col("id").alias(id_col), "score"), "ranked", last=True)
        first += len(part.ids)
        block.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.select(F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0).cast("long").alias("score")).where("false")
    return out


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
lens AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0), total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lens),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2, 3),
tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, total GROUP BY term, n_docs),
parts AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))) AS s FROM tfs JOIN w USING (term) JOIN lens USING (r), total),
scores AS (SELECT item, item_id, r, doc_id, CAST(sum(times * s) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY 1, 2, 3, 4)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20"""
