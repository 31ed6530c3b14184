"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams and of itself, so an
unseen spelling shares most of its vectors with the words it resembles. A bag
is a window of a few words; the mean of its words goes through a linear softmax
of two classes, and vectors and softmax are trained jointly in numpy. A label
belongs to a whole document, so a document is as toxic as its most toxic bag,
in training (after a first pass over all bags) as in scoring: one insult in a
long text isn't averaged away. The last steps of training fit scale and bias of
the softmax to these bags, so that a score is the probability of the label; a
text without words is the empty bag, whose mean is zero and which is never
called toxic. Training reads a bounded sample of labelled rows; scoring reads
every word of every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, filter_rows, input_rows, map_rows, release_memory

#: Labelled rows of each class that training reads at most, and their words; rows that would exceed these are passed over whole.
SAMPLE_PER_CLASS, SAMPLE_WORDS = 4000, 4_000_000
WINDOW, STRIDE = 4, 2
BUCKETS, DIM = 1 << 17, 16
NGRAMS = (3, 4, 5, 6)
EPOCHS, RATE, DECAY = 12, 0.2, 3e-3
#: Worst bags of a toxic document that teach in the first epochs; one in later ones.
BAGS = (64, 4, 2)
MIN_DOCS = 4
#: Bias of a model without labels of both classes.
UNKNOWN = 5.0
MAX_KEPT = 200_000
_WORD = re.compile(r"\w+")


@dataclass
class Model:
    vectors: np.ndarray  # (BUCKETS, DIM)
    weights: np.ndarray  # (DIM, 2)
    bias: np.ndarray  # (2,)

    def word_weights(self) -> np.ndarray:
        """What each bucket adds to the toxic logit less the other: all that scoring needs."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of every word, and the number of subwords of each word.

    All words lie in one array with a boundary character around each; n-grams
    are hashed at every place of it at once and those that cross from one word
    into the next are dropped.
    """
    codes = np.frombuffer(("\x02" + "\x02".join(words) + "\x02").encode("utf-32-le"), np.uint32).astype(np.uint64)
    edges = np.flatnonzero(codes == 2)
    owner = np.cumsum(codes == 2) - 1
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        for n in NGRAMS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, 1469598103934665603 + n, np.uint64)
            for j in range(n):
                h = (h ^ codes[j : j + len(h)]) * np.uint64(1099511628211)
            inner = np.searchsorted(edges, np.arange(len(h)) + 1)  # the first edge after the first character
            keep = edges[np.minimum(inner, len(edges) - 1)] >= np.arange(len(h)) + n - 1
            keep &= ~((codes[: len(h)] == 2) & (np.arange(len(h)) == edges[-1]))
            buckets.append(h[keep])
            owners.append(owner[: len(h)][keep])
        # The whole word: a sum of its characters' mixed codes by place.
        place = (np.arange(len(codes)) - edges[np.minimum(owner, len(edges) - 1)]).astype(np.uint64)
        mixed = (codes + place * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed[edges] = 0
        whole = np.add.reduceat(mixed, edges[:-1]) if len(edges) > 1 else np.zeros(0, np.uint64)
    buckets.append(whole)
    owners.append(np.arange(len(words)))
    h = np.concatenate(buckets)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    owner_all = np.concatenate(owners)
    order = np.argsort(owner_all, kind="stable")
    return (h[order] >> np.uint64(47)).astype(np.int64) % BUCKETS, np.bincount(owner_all, minlength=len(words))


def window_starts(n: int) -> np.ndarray:
    """First words of the overlapping windows that cover n words (each WINDOW long, or n if that is less)."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def subwords_in_parts(words: list[str], part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """``subwords`` of a long list, without its scratch arrays for all of it at once."""
    done = [subwords(words[a : a + part]) for a in range(0, len(words), part)]
    return np.concatenate([g.astype(np.int32) for g, _ in done]), np.concatenate([n for _, n in done])


def train(rows: Iterable[tuple[str, int]], seed: int = 7) -> Model:
    """Fits vectors and softmax to (text, label) with Adagrad on mini-batches of windows; at most SAMPLE_WORDS words of each class."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32))
    model.weights[:, 1] = rng.normal(0, 0.3, DIM)
    model.weights[:, 0] = -model.weights[:, 1]
    vocabulary: dict[str, int] = {}
    parts, toxic, taken = [], [], [0, 0]
    for text, y in rows:  # ids at once: the words of all texts would not fit beside each other
        words = words_of(text)
        if taken[y] + len(words) <= SAMPLE_WORDS:
            taken[y] += len(words)
            parts.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
            toxic.append(y)
    if not vocabulary or len(set(toxic)) < 2:
        model.vectors[:], model.bias[0] = 0, UNKNOWN  # calls nothing toxic
        return model
    grams, sizes = subwords_in_parts(list(vocabulary))
    first = np.concatenate([[0], np.cumsum(sizes)])
    lengths = np.array([len(d) for d in parts])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate(parts)
    del parts, vocabulary
    starts = [window_starts(n) for n in lengths.tolist()]
    owner = np.repeat(np.arange(len(lengths)), [len(x) for x in starts])
    left = np.concatenate(starts) + begins[owner]
    spans = np.stack([left, left + np.minimum(WINDOW, lengths[owner])], 1)
    n_docs, n_words = len(lengths), len(sizes)
    label = np.array(toxic, np.int64)
    # Subwords of fewer than MIN_DOCS documents stay zero vectors: they would only be learnt by heart.
    pairs = np.unique(np.repeat(np.arange(n_docs), lengths) * n_words + flat) % n_words
    per_word = np.bincount(pairs, minlength=n_words)
    support = np.bincount(grams, np.repeat(per_word, sizes), BUCKETS)
    rare = support < MIN_DOCS
    model.vectors[rare] = 0
    g_vectors, g_weights, g_bias = np.full(BUCKETS, 1e-3, np.float32), np.full((DIM, 2), 1e-3), np.full(2, 1e-3)

    def word_logits() -> np.ndarray:
        w = model.word_weights()[grams]
        return np.add.reduceat(w, first[:-1]) / sizes

    def window_logits() -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(word_logits()[flat])])
        return (total[spans[:, 1]] - total[spans[:, 0]]) / (spans[:, 1] - spans[:, 0])

    for epoch in range(EPOCHS):
        scores = window_logits()
        order = np.lexsort((-scores, owner))
        rank = np.empty(len(order), np.int64)
        starts = np.searchsorted(owner[order], np.arange(n_docs))
        rank[order] = np.arange(len(order)) - starts[owner[order]]
        positive = label[owner] == 1
        # Toxic documents teach by ever fewer of their worst windows; clean ones by their worst and a few others.
        chosen = np.where(positive, rank < (BAGS[epoch] if epoch < len(BAGS) else 1), (rank < 3) | (rng.random(len(rank)) < max(0.05, 20_000 / len(rank))))
        index = rng.permutation(np.flatnonzero(chosen))
        share = max(1, positive[index].sum()) / len(index)
        for batch in np.array_split(index, max(1, len(index) // min(256, max(16, len(index) // 64)))):
            w_pos = [np.arange(*spans[i]) for i in batch]
            counts = np.array([len(p) for p in w_pos])
            words = flat[np.concatenate(w_pos)]
            window_of = np.repeat(np.arange(len(batch)), counts)
            n_grams = sizes[words]
            g = grams[np.repeat(first[words] - np.concatenate([[0], np.cumsum(n_grams)[:-1]]), n_grams) + np.arange(n_grams.sum())]
            scale = np.repeat(1.0 / (n_grams * counts[window_of]), n_grams).astype(np.float32)
            edge = np.searchsorted(np.repeat(window_of, n_grams), np.arange(len(batch)))
            mean = np.add.reduceat(model.vectors[g] * scale[:, None], edge)
            logits = mean @ model.weights + model.bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            y = label[owner[batch]]
            p[np.arange(len(batch)), y] -= 1
            p *= np.where(y == 1, 0.5 / share, 0.5 / (1 - share))[:, None] / len(batch)  # both classes weigh the same
            d_mean = p @ model.weights.T
            d_w, d_b = mean.T @ p, p.sum(0)
            g_weights += d_w**2
            g_bias += d_b**2
            model.weights -= (RATE * d_w / np.sqrt(g_weights)).astype(np.float32)
            model.bias -= (RATE * d_b / np.sqrt(g_bias)).astype(np.float32)
            d_vec = d_mean[np.repeat(window_of, n_grams)] * scale[:, None]
            by = np.argsort(g, kind="stable")
            unique, begin = np.unique(g[by], return_index=True)
            step = np.add.reduceat(d_vec[by], begin)
            g_vectors[unique] += (step**2).mean(1)
            step = (RATE * step / np.sqrt(g_vectors[unique])[:, None]).astype(np.float32)
            model.vectors[unique] -= np.where(rare[unique, None], 0, step + DECAY * model.vectors[unique])
    # Scale and bias, on what a document counts as.
    worst = np.zeros(n_docs)
    scores = window_logits()
    some = np.flatnonzero(lengths)
    worst[some] = np.maximum.reduceat(scores, np.searchsorted(owner, some))
    scale, shift = fit_probability(worst, label)
    model.weights *= scale
    model.bias[:] = 0, shift
    return model


def fit_probability(score: np.ndarray, label: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Scale and shift of a logistic curve, by Newton steps; ``ridge`` bounds the scale where the classes are separable."""
    x = np.stack([score, np.ones(len(score))], 1)
    hold = ridge * np.diag([1.0, 0.0])

    def loss(w):
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - label * z) + w @ hold @ w / 2)

    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold + 1e-9 * np.eye(2), x.T @ (p - label) + hold @ w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


class Scorer(dict):
    """Word -> logit, for words seen by this task."""

    def __init__(self, weights: np.ndarray, offset: float):
        super().__init__()
        self.weights, self.offset = weights, offset

    def learn(self, docs: list[list[str]]) -> None:
        if len(self) > MAX_KEPT:
            self.clear()
        new = [w for w in set().union(*docs) if w not in self]
        for a in range(0, len(new), 100_000):
            some = new[a : a + 100_000]
            grams, sizes = subwords(some)
            sums = np.add.reduceat(self.weights[grams].astype(np.float64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            self.update(zip(some, (sums / sizes).tolist(), strict=True))

    def scores(self, texts: list[str]) -> list[float]:
        docs = [words_of(t) for t in texts]
        self.learn(docs)
        return [self.score(d) for d in docs]

    def score(self, words: list[str]) -> float:
        n, logit = len(words), -abs(self.offset) - 1e-6
        if n:
            total = np.concatenate([[0.0], np.cumsum(np.fromiter(map(self.__getitem__, words), np.float64, n))])
            starts = window_starts(n)
            logit = ((total[np.minimum(starts + WINDOW, n)] - total[starts]) / min(WINDOW, n)).max() + self.offset
        return 1 / (1 + float(np.exp(-np.clip(logit, -50, 50))))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Text and label of at most ``per_class`` rows of each class outside the held-out fold, in hash order.

    The label rows are few and narrow, so the sample is drawn from them; its
    ids, bounded by ``per_class``, are what is broadcast.
    """
    kind = docs.schema[id_col].dataType
    known = labels.select(F.col(id_col).cast(kind).alias("id"), F.col(label_col).cast("int").alias("y")).dropna()
    known = known.where(crc_fold(F.col("id")) != 0).groupBy("id").agg(F.max("y").alias("y"))
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    return input_rows(docs, id_col, text_col).join(F.broadcast(ids), "id").select("id", "y", "text")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col="doc_id", text_col="text", label_col="toxic") -> tuple[np.ndarray, float]:
    """Trains in one task, on a sample that ``per_class`` bounds; what comes back is a weight for each bucket.

    Repeated rows of one id are read once; without labels of both classes the
    model calls nothing toxic.
    """
    rows = training_sample(docs, labels, per_class, id_col, text_col, label_col).groupBy("id").agg(F.max("y").alias("y"), F.max("text").alias("text"))

    def run(batches):
        texts = (r for df in batches for r in zip(df["text"], df["y"], strict=True))
        model = train(texts)
        yield pd.DataFrame({"weights": [model.word_weights().tobytes()], "offset": [model.offset()]})
        del model, texts
        release_memory()

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("text", "y")
    fitted = one.mapInPandas(run, "weights binary, offset double").head()
    if fitted is None:
        return np.zeros(BUCKETS, np.float32), -UNKNOWN
    return np.frombuffer(fitted["weights"], np.float32), fitted["offset"]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """One row per row: ``id_col``, held_out, score, predicted.

    Labels are used for training only, and only of rows outside the held-out
    fold; a null id counts as held out. Null and empty texts get the score of
    the empty bag. Texts of any length are scored whole, repeated rows each;
    columns other than the two are ignored, whatever their names; an empty
    table gives no rows.
    """
    scored = score_rows(docs, fit(docs, labels, per_class, id_col, text_col), id_col, text_col)
    return scored.select(
        id_col, (crc_fold(F.col(id_col)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def score_rows(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats, whatever the input

    def make():
        scorer = Scorer(*shared.value)

        def step(batch):
            column, scores = batch.column("text"), []
            for a in range(0, len(column), 500):
                scores += scorer.scores(column.slice(a, 500).to_pylist())
            return {"id": batch.column("id"), "score": scores}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(input_rows(docs, id_col, text_col), f"id {kind}, score double", make).withColumnRenamed("id", id_col)


def clean_rows(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below one half."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(*shared.value)
        return lambda texts: [s < 0.5 for s in scorer.scores(texts)]

    return filter_rows(docs, text_col, make)
