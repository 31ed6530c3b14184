"""Vector tables: checks, normalisation, exact top-k search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentsift.sources.scratch import scratch_path

#: Queries that one pass over the vectors answers; more are taken in blocks.
QUERY_BLOCK = 1024


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Unit vectors as doubles; the norm is computed once per row. A zero vector stays zero."""
    with_norm = vectors.withColumn("_norm", norm(F.col(column)))
    unit = F.transform(column, lambda x: F.when(F.col("_norm") > 0, x.cast("double") / F.col("_norm")).otherwise(F.lit(0.0)))
    return with_norm.withColumn(column, unit).drop("_norm")


def check_vectors(vectors: DataFrame, expected: DataFrame, dim: int) -> DataFrame:
    """problem, video_id, n_rows: wrong dimension, values that aren't finite, zero norm, and counts that differ from ``expected`` (video_id, rows)."""
    v = F.col("embedding")
    infinite = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    problem = (
        F.when(v.isNull() | (F.size(v) != dim), "wrong_dim").when(infinite, "not_finite").when(norm(v) == 0, "zero_norm")
    )
    rows = vectors.select("video_id", problem.alias("problem")).where("problem is not null").groupBy("problem", "video_id").agg(F.count("*").alias("n_rows"))
    have = vectors.groupBy("video_id").agg(F.count("*").alias("have"))
    diff = expected.join(have, "video_id", "full").select("video_id", (F.coalesce("have", F.lit(0)) - F.coalesce("rows", F.lit(0))).alias("n_rows")).where("n_rows <> 0")
    return rows.unionByName(diff.select(F.lit("row_count").alias("problem"), "video_id", "n_rows"))


def _query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[list, np.ndarray]]:
    ids, vecs = [], []
    for r in queries.orderBy("query_id").toLocalIterator():
        v = np.array(r["embedding"], np.float64)
        if not np.isfinite(v).all() or not np.linalg.norm(v):
            raise ValueError(f"query {r['query_id']} has a vector that is zero or not finite")
        ids.append(r["query_id"])
        vecs.append(v / np.linalg.norm(v))
        if len(ids) == block:
            yield ids, np.array(vecs)
            ids, vecs = [], []
    if ids:
        yield ids, np.array(vecs)


def knn_topk(vectors: DataFrame, queries: DataFrame, k: int, key: tuple[str, ...] = ("video_id", "n"), block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, key, score (cosine): the exact top-k of every query.

    The stated query set is taken in blocks of bounded size, each against all
    vectors: matrix products over the batches of a task, which keeps its best k
    of each query as it goes, then the best k of all tasks. Ties are broken by
    the key. Several blocks are answered one after the other, so that one is
    held at a time.
    """
    vectors = vectors.where("embedding is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *key)

    def best(ids: list, matrix: np.ndarray, rows: DataFrame) -> DataFrame:
        found = _knn_block(rows, ids, matrix, k, key)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", *key, "score")

    out = held = None
    for ids, matrix in _query_blocks(queries, block):
        if held is not None:  # there are more: what came before is written
            path = scratch_path(vectors.sparkSession, "knn")
            best(*held, vectors).write.parquet(path)
            done = vectors.sparkSession.read.parquet(path)
            out = done if out is None else out.unionByName(done)
        held = (ids, matrix)
    if held is None:  # no queries, no hits
        return best([], np.zeros((0, 0)), vectors.where("false"))
    last = best(*held, vectors)
    return last if out is None else out.unionByName(last)


class _RunningBest:
    """The best ``k`` of each query over the batches of a task; the k-th score so far is the floor for what comes."""

    def __init__(self, queries: int, k: int, key: tuple[str, ...]):
        self.k, self.key, self.floor = k, list(key), np.full(queries, -np.inf)
        self.parts: list[pd.DataFrame] = []
        self.held, self.room = 0, max(4 * queries * k, 50_000)

    def add(self, scores: np.ndarray, rows: pd.DataFrame) -> None:
        if scores.shape[1] > self.k:  # what the batch itself rules out; ties at the border all pass
            border = np.maximum(self.floor, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        else:
            border = self.floor
        q, v = np.nonzero(scores >= border[:, None])
        self.parts.append(rows.iloc[v].reset_index(drop=True).assign(_q=q, score=scores[q, v]))
        self.held += len(q)
        if self.held > self.room:
            self.parts = [self.rows()]
            self.held = len(self.parts[0])

    def rows(self) -> pd.DataFrame:
        every = pd.concat(self.parts, ignore_index=True).sort_values(["_q", "score", *self.key], ascending=[True, False, *[True] * len(self.key)], ignore_index=True)
        place = every.groupby("_q").cumcount()
        last = every[place == self.k - 1]
        self.floor[last["_q"].to_numpy()] = last["score"].to_numpy()
        return every[place < self.k].reset_index(drop=True)


#: Vectors of one matrix product, and rows of a batch that is given back.
STEP = 2_000


def _knn_block(vectors: DataFrame, ids: list, matrix: np.ndarray, k: int, key: tuple[str, ...]) -> DataFrame:
    """The best k of each task for each query: at most tasks x queries x k rows."""
    shared = vectors.sparkSession.sparkContext.broadcast((np.array(ids), matrix))
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shared.value
        best = _RunningBest(len(names), k, key)
        for df in batches:
            for a in range(0, len(df), STEP):
                some = df.iloc[a : a + STEP]
                m = np.stack(some["embedding"].to_numpy()).astype(np.float64)
                if m.shape[1] != q.shape[1]:
                    raise ValueError(f"vectors have dimension {m.shape[1]}, queries {q.shape[1]}")
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                best.add(q @ m.T, some[list(key)])
        if best.parts:
            out = best.rows()
            for a in range(0, len(out), STEP):
                some = out.iloc[a : a + STEP]
                yield some[list(key)].assign(query_id=names[some["_q"].to_numpy()], score=some["score"].to_numpy())

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", query_id long, score double"
    return vectors.select(*key, "embedding").mapInPandas(run, schema)


def self_cosine(vectors: DataFrame, sample: DataFrame, k: int = 10, key: tuple[str, ...] = ("video_id", "n")) -> DataFrame:
    """For sampled keys: the cosine of a vector with itself as stored, and whether it passes.

    Passes when its own score is at least 0.999 and it is among its top k, or
    when what outranks it is within 1e-4 (a copy of the same image). The own
    score is computed directly; the search only gives the ranks.
    """
    chosen = vectors.join(sample, list(key)).withColumn("query_id", F.xxhash64(*key))
    v = F.col("embedding")
    chosen = chosen.select("query_id", *[F.col(c).alias(f"q_{c}") for c in key], "embedding", (dot(v, v) / (norm(v) * norm(v))).alias("own_score"))
    hits = knn_topk(vectors, chosen.select("query_id", "embedding"), k, key)
    own = F.lit(True)
    for c in key:
        own = own & (F.col(c) == F.col(f"q_{c}"))
    asked = chosen.drop("embedding")
    per = asked.join(hits, "query_id", "left").groupBy(*[F.col(f"q_{c}").alias(c) for c in key]).agg(F.max("score").alias("top"), F.max("own_score").alias("own_score"), F.min(F.when(own, F.col("rank"))).alias("own_rank"))
    ok = F.coalesce((F.col("own_score") >= 0.999) & (F.col("own_rank").isNotNull() | (F.col("top") - F.col("own_score") <= 1e-4)), F.lit(False))
    return per.select(*key, F.round("own_score", 6).alias("own_score"), F.col("own_rank").cast("int").alias("own_rank"), ok.alias("ok"))


def agreement(a: DataFrame, b: DataFrame, key: list[str], least: float = 0.99) -> DataFrame:
    """Mean, smallest and largest cosine between two embeddings of the same keys."""
    x, y = F.col("embedding"), F.col("other")
    both = a.select(*key, "embedding").join(b.select(*key, F.col("embedding").alias("other")), key)
    cosine = dot(x, y) / (norm(x) * norm(y))
    one = both.select(cosine.alias("c")).agg(F.count("*").alias("pairs"), F.avg("c").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    return one.select("pairs", *[F.round(c, 6).alias(n) for c, n in (("m", "mean_cosine"), ("lo", "min_cosine"), ("hi", "max_cosine"))], (F.col("m") >= least).alias("passes"))
