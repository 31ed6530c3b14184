"""Scores of whole texts under a language model that mixes bit predictors online.

The tokens of a text are its words, A-Z lowered, and one end. Frequent words
are symbols of their own, all others one escape symbol followed by their
letters (``mixing``: Huffman bits, hashed contexts, gated weights, a refining
table). What is learnt comes from all training rows: the counts of every word
(a table, joined, never sent whole to anyone), the counts of bits in hashed
contexts, summed in slices over all tasks, and the weights, learnt online on
one fold of the training rows against the counts of the others. A text is then
read with weights that go on adapting to it alone. Letters of the words that
are no symbols are scored once a word, where the words meet their counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_fold, input_rows, map_rows, release_memory, some_texts
from .mixing import BUCKETS, GATES, BitCounts, Codes, Mixture
from .vocab import groups_by_bytes

#: Remainder of the crc32 of an id that is held out; that of the training rows on which weights are learnt.
HELD_OUT, WEIGHTS_FOLD = 1, 0
#: Words that are symbols of their own, at most; steps of the logarithm by which they are cut off.
HEAD, STEPS = 65_536, 32
#: Times that a symbol's word is seen at least: what rarer words leave to the escape stands for the words yet unseen.
LEAST = 3
#: Preceding symbols and bits of a table, for words and for letters; together they bound what is broadcast (about 35 MB).
WORD_ORDERS, WORD_BITS, LETTER_ORDERS, LETTER_BITS = 2, 19, 4, 18
#: The most frequent words, the last of which is a context of its own.
FREQUENT = 32
#: Distinct words that a task counts before it hands them on; bytes of texts that it holds as numbers at a time.
KEPT_WORDS, TEXT_BYTES = 400_000, 2 << 20
#: Slots of a slice, as tasks send their counts.
SLICE = 1024
#: Symbols: words outside the head, the end of a text; the end of a word among letters.
OTHER, END, STOP = 0, 1, 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = bytes.maketrans(_UPPER.encode(), _LOWER.encode())


def words_of(text: str) -> list[bytes]:
    """Words between spaces and the controls from tab to carriage return, A-Z lowered, as UTF-8."""
    return text.encode().translate(_TO_LOWER).split()


def word_counts(training: DataFrame) -> DataFrame:
    """word, n over the texts of ``training``; a task counts in a dictionary that it hands on before it grows large."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def given(seen: Counter) -> Iterator[pa.RecordBatch]:
        words, counts = list(seen.keys()), list(seen.values())
        seen.clear()
        for a in range(0, len(words), 50_000):
            part = pa.array(words[a : a + 50_000], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part, pa.array(counts[a : a + 50_000], pa.int64())], schema=schema)

    def run(batches):
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in some_texts(batch.column("text")):
                seen.update(words_of(text))
                if len(seen) > KEPT_WORDS:
                    yield from given(seen)
        yield from given(seen)
        release_memory()

    return training.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(words: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most``: all above a count that a histogram of logarithms gives."""
    words, level = words.where(F.col("n") >= LEAST), F.floor(F.log2("n") * STEPS)
    levels = sorted(((r["level"], r["c"]) for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total, cut = 0, None
    for at, c in levels:
        total += c
        if total > most:
            break
        cut = at
    if cut is None:
        return []
    return sorted(((r["word"].encode(), r["n"]) for r in words.where(level >= cut).collect()), key=lambda x: (-x[1], x[0]))


class Language:
    """The codes of words and letters, and the two mixtures over them."""

    def __init__(self, head: list[tuple[bytes, int]], others: int, texts: int):
        self.head = [w for w, _ in head]
        self.counts = np.array([others, texts, *[n for _, n in head]], np.float64)
        letters = Counter(b for w, _ in head for b in w)
        self.words = Mixture(Codes(self.counts + 0.5), WORD_ORDERS, WORD_BITS, range(2, 2 + min(FREQUENT, len(head))))
        self.letters = Mixture(Codes(np.array([letters[b] + 0.5 for b in range(256)] + [len(head) + 1.0])), LETTER_ORDERS, LETTER_BITS)

    def numbers(self) -> dict[bytes, int]:
        return {w: k + 2 for k, w in enumerate(self.head)}


def _as_symbols(texts: list[str], numbers: dict[bytes, int]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    words = [words_of(t) for t in texts]
    offsets = np.cumsum([0, *[len(w) + 1 for w in words]])
    symbols = np.full(offsets[-1], END, np.int64)
    for w, a in zip(words, offsets.tolist(), strict=False):
        symbols[a : a + len(w)] = np.fromiter((numbers.get(x, OTHER) for x in w), np.int64, len(w))
    return words, symbols, offsets


def _as_letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.cumsum([0, *[len(w) + 1 for w in words]])
    symbols = np.full(offsets[-1], STOP, np.int64)
    symbols[np.delete(np.arange(offsets[-1]), offsets[1:] - 1)] = np.frombuffer(b"".join(words), np.uint8)
    return symbols, offsets


def _text_groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    for a, b in groups_by_bytes(batch.column("text"), TEXT_BYTES):
        yield a, b, batch.column("text").slice(a, b - a).to_pylist()


def _word_groups(batch: pa.RecordBatch, head: set[bytes]) -> Iterator[list[bytes]]:
    column = batch.column("text")
    for a in range(0, len(column), 4000):
        yield [w for w in (t.encode() for t in some_texts(column.slice(a, 4000))) if w not in head]


def _summed(parts: DataFrame, dtype) -> dict[int, np.ndarray]:
    """part -> sum of its arrays over all tasks; every part is added up as it streams through the task that it is dealt to."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                array = np.frombuffer(data.as_buffer(), dtype)
                if part in sums:
                    sums[part] += array
                else:
                    sums[part] = array.copy()
        for part, array in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([array.tobytes()], pa.binary())], names=["part", "data"])

    return {r["part"]: np.frombuffer(r["data"], dtype) for r in parts.repartition("part").mapInArrow(run, "part long, data binary").collect()}


def _emitted(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    def run(batches):
        for part, array in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([array.tobytes()], pa.binary())], names=["part", "data"])
        release_memory()

    return rows.mapInArrow(run, "part long, data binary")


def bit_counts(language: Language, training: DataFrame, words: DataFrame) -> None:
    """Counts bits in hashed contexts: of the tokens of all training texts, of the letters of all their words outside the head.

    The mixtures get the counts of the folds on which weights are not learnt;
    ``all_counts`` keeps those of all.
    """
    shared = training.sparkSession.sparkContext.broadcast(language)
    names = ("words", "letters")
    first = {"words": 0, "letters": 2 * (-(-2 * language.words.slots // SLICE))}

    def slices(name: str, counted: list[BitCounts]) -> Iterator[tuple[int, np.ndarray]]:
        """Of two tables (fold of the weights or not) what isn't zero, in slices."""
        for fold in (0, 1):
            flat = counted[fold].counts().ravel()
            per = -(-flat.size // SLICE)
            for k in range(per):
                piece = flat[k * SLICE : (k + 1) * SLICE]
                if piece.any():
                    yield first[name] + fold * per + k, piece

    def of_texts(batches):
        own = shared.value
        numbers, counted = own.numbers(), [BitCounts(own.words), BitCounts(own.words)]
        for batch in batches:
            folds = batch.column("fold").to_numpy()
            for a, b, texts in _text_groups(batch):
                _, symbols, offsets = _as_symbols(texts, numbers)
                apart = np.repeat(folds[a:b] == WEIGHTS_FOLD, np.diff(offsets))
                begins = np.zeros(len(symbols), bool)
                begins[offsets[:-1]] = True
                for fold, mine in ((0, ~apart), (1, apart)):
                    counted[fold].add(symbols[mine], begins[mine])
        yield from slices("words", counted)

    def of_words(batches):
        own = shared.value
        head, counted = set(own.head), [BitCounts(own.letters), BitCounts(own.letters)]
        for batch in batches:
            for group in _word_groups(batch, head):
                for fold in (0, 1):
                    mine = [w for w in group if _weights_word(w) == bool(fold)]
                    symbols, offsets = _as_letters(mine)
                    begins = np.zeros(len(symbols), bool)
                    begins[offsets[:-1]] = True
                    counted[fold].add(symbols, begins)
        yield from slices("letters", counted)

    parts = _emitted(training.select("fold", "text"), of_texts).unionByName(_emitted(words.select(F.col("word").alias("text")), of_words))
    found = _summed(parts, np.int32)
    shared.destroy()
    language.all_counts = {}
    for name in names:
        size = 2 * getattr(language, name).slots
        per = -(-size // SLICE)
        tables = np.zeros((2, size), np.int32)
        for fold in (0, 1):
            for k in range(per):
                piece = found.get(first[name] + fold * per + k)
                if piece is not None:
                    tables[fold, k * SLICE : (k + 1) * SLICE] = piece
        language.all_counts[name] = tables.sum(0).reshape(2, -1)
        getattr(language, name).set_counts(*tables[0].reshape(2, -1))


def _weights_word(word: bytes) -> bool:
    import zlib

    return zlib.crc32(word) % 5 == WEIGHTS_FOLD


def mixing_weights(language: Language, training: DataFrame, words: DataFrame) -> None:
    """Learns weights and refining tables online in every task, averaged over the bits of all; then all counts take effect."""
    counts = language.__dict__.pop("all_counts")
    shared = training.sparkSession.sparkContext.broadcast(language)

    def learnt(mixture: Mixture, sequences: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        met, bits = np.zeros((2, GATES, BUCKETS)), 0
        for symbols, offsets in sequences:
            bits += mixture.run(symbols, offsets, False, met)[1]
        return mixture.learnt(bits, met)

    def copied(mixture: Mixture) -> Mixture:
        """With weights of its own, as workers and what is broadcast live on."""
        new = Mixture.__new__(Mixture)
        new.__dict__ |= mixture.__dict__ | {"weights": mixture.weights.copy()}
        return new

    def of_texts(batches):
        own = shared.value
        numbers = own.numbers()
        yield 0, learnt(copied(own.words), (_as_symbols(texts, numbers)[1:] for batch in batches for _, _, texts in _text_groups(batch)))

    def of_words(batches):
        own = shared.value
        head = set(own.head)
        groups = ([w for w in g if _weights_word(w)] for batch in batches for g in _word_groups(batch, head))
        yield 1, learnt(copied(own.letters), (_as_letters(g) for g in groups if g))

    parts = _emitted(training.where(F.col("fold") == WEIGHTS_FOLD).select("text"), of_texts).unionByName(_emitted(words.select(F.col("word").alias("text")), of_words))
    found = _summed(parts, np.float64)
    shared.destroy()
    for k, name in enumerate(("words", "letters")):
        mixture = getattr(language, name)
        if k in found:
            mixture.set_learnt(found[k])
        mixture.set_counts(*counts[name])


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per row: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    base_score is the sum of log10 of smoothed word shares, score the log10
    probability of the text's tokens under the mixture, bits_per_byte the same
    in bits over the UTF-8 bytes of the text and its end. Null and empty texts
    are the end alone; whole texts of any length are read; repeated rows are
    scored each and count each in training; a null id counts as an empty text
    for its fold. Without training rows every count is zero. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = input_rows(docs, id_col, text_col).withColumn("fold", crc_fold(F.col("id")).cast("int"))
    training = rows.where(F.col("fold") != HELD_OUT)
    words = scratch.written(word_counts(training), "words")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    texts = training.count()
    total, distinct = sums["n"] + texts, sums["v"] + (texts > 0)
    most = head_words(words, head)
    language = Language(most, sums["n"] - sum(n for _, n in most), texts)
    bit_counts(language, training, words)
    mixing_weights(language, training, words)
    shared = spark.sparkContext.broadcast(language)
    of_all = float(np.log10(total + 0.5 * (distinct + 1)))

    def make():
        own = shared.value
        numbers = own.numbers()
        known = own.counts > 0
        base = np.log10(own.counts + 0.5)
        known[OTHER], base[OTHER] = False, 0.0

        def step(batch):
            out = {c: [] for c in ("n_tokens", "n_known", "base", "bits", "others", "times")}
            for _, _, texts in _text_groups(batch):
                words_, symbols, offsets = _as_symbols(texts, numbers)
                out["n_tokens"] += np.diff(offsets).tolist()
                out["n_known"] += np.add.reduceat(known[symbols].astype(np.int64), offsets[:-1]).tolist()
                out["base"] += np.add.reduceat(base[symbols], offsets[:-1]).tolist()
                out["bits"] += own.words.run(symbols, offsets, True)[0].tolist()
                for w, a in zip(words_, offsets.tolist(), strict=False):
                    seen = Counter(w[k] for k in np.flatnonzero(symbols[a : a + len(w)] == OTHER).tolist())
                    out["others"].append([x.decode() for x in seen])
                    out["times"].append(list(seen.values()))
            return {c: batch.column(c) for c in ("row", "id", "fold", "n_bytes")} | out

        return step

    schema = f"row long, id {kind}, fold int, n_bytes long, n_tokens long, n_known long, base double, bits double, others array<string>, times array<long>"
    named = rows.select(F.monotonically_increasing_id().alias("row"), "id", "fold", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    parts = scratch.written(map_rows(named, schema, make), "scored")

    def make_spelt():
        own = shared.value

        def step(batch):
            n = batch.column("n").fill_null(0).to_numpy().astype(np.float64)
            times = batch.column("times").to_numpy()
            words_ = batch.column("word").dictionary_encode()
            symbols, offsets = _as_letters([w.encode() for w in words_.dictionary.to_pylist()])
            bits = own.letters.run(symbols, offsets, True)[0][words_.indices.to_numpy()]
            return {"row": batch.column("row"), "n_known": np.where(n > 0, times, 0), "base": times * np.log10(n + 0.5), "bits": times * bits}

        return step

    others = parts.select("row", F.explode(F.arrays_zip("others", "times")).alias("x")).select("row", F.col("x.others").alias("word"), F.col("x.times").alias("times"))
    spelt = map_rows(others.join(words, "word", "left"), "row long, n_known long, base double, bits double", make_spelt)
    spelt = spelt.groupBy("row").agg(*[F.sum(c).alias(f"more_{c}") for c in ("n_known", "base", "bits")])
    both = parts.drop("others", "times").join(spelt, "row", "left")
    sum_of = lambda c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))
    out = both.select(
        F.col("id").alias(id_col), (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", sum_of("n_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (sum_of("base") - F.col("n_tokens") * of_all).alias("base_score"), (sum_of("bits") * float(np.log10(2))).alias("score"), (-sum_of("bits") / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
    out = Scratch(spark).written(out, "scores", last=True)
    shared.destroy()
    scratch.clear()
    return out
