"""The corpus operators as registered queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate
from . import toxicity as toxicity_ops
from .common import Scratch, table
from .exactdedup import EXACT_SQL, exact_groups
from .htmltext import main_texts
from .jaccardjoin import jaccard_components
from .lmscore import language_scores
from .lexsearch import RANKED_SQL, ranked_documents
from .merkle import MANIFEST_SQL, tampered_manifest
from .packing import packed_documents
from .pii import pii_spans
from .secrets import secret_spans
from .tokencount import token_counts, tokenizer_path
from .urlfilter import JUDGE_SQL, judge_urls

TOKENIZER = "word_bpe_49k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_ops.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op6_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccardjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op11_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_manifest(table(spark, sf_dir, "documents"))


def op13_lexsearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_pii, op2_packing, op3_toxicity, op4_exactdedup, op5_urlfilter,
        op6_htmltext, op7_secrets, op8_decontaminate, op9_jaccardjoin, op10_tokencount,
        op11_lmscore, op12_merkle, op13_lexsearch, pipeline,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_exactdedup": EXACT_SQL, "op5_urlfilter": JUDGE_SQL, "op12_merkle": MANIFEST_SQL, "op13_lexsearch": RANKED_SQL}


# The stages of corpus_pipeline.py: each takes (spark, docs, sf_dir); all but the last return the columns of ``docs``.
# Rows with null or repeated ids are judged one by one, null texts count as empty, an empty table gives no rows.

#: Dropped rows up to this many are broadcast, so that no text moves; more are joined.
BROADCAST_ROWS = 250_000


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named_rows(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name``: 128 bits of all columns of a row. Rows that are equal in every column are the same row."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn(name, F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns[::-1]).alias("b")))


def one_of_each(docs: DataFrame, stays: Column, groups: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of each group, with the columns of ``docs``, whatever their names.

    ``groups`` gets (rank, text), where rank is ``stays`` and the row's name,
    and returns rank and best, the rank of the row that stays in its group. The
    rows that go are left out by an anti join; rows that are equal in every
    column and stay come down to one. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    row, name = unused(docs, "_row"), unused(docs, "_name")
    rows = named_rows(docs, row)
    judged = groups(rows.select(F.struct(stays.alias("stays"), F.col(row).alias("row")).alias("rank"), "text"))
    judged = scratch.written(judged.select(F.col("rank.row").alias(name), (F.col("rank") == F.col("best")).alias("kept")), "judged", last=True)
    gone = judged.where("not kept").select(name).distinct()
    same = judged.where("kept").groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(name)
    met = F.col(row) == F.col(name)

    def small(names: DataFrame) -> DataFrame:
        return F.broadcast(names) if names.count() <= BROADCAST_ROWS else names

    rows = rows.join(small(gone), met, "left_anti")
    if same.isEmpty():
        return rows.drop(row)
    same = small(same)
    once = rows.join(same, met, "left_semi").dropDuplicates([row])
    return rows.join(same, met, "left_anti").unionByName(once).drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below one half; labels are learnt from the rows of ``docs`` outside the held-out fold.

    Null and empty texts have the score of an empty text; long ones are read
    whole; rows are judged one by one, repeated and null ids too, and keep all
    their columns; an empty table stays empty.
    """
    return toxicity_ops.clean_rows(docs, toxicity_ops.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, with the largest id; null ids come last, equal ids go by the other columns.

    Null counts as empty, so of null and empty texts one row stays; columns of
    any name are kept; texts of any length are compared whole; an empty table
    stays empty.
    """
    groups = lambda rows: exact_groups(rows, "rank").select("rank", F.col("keep_id").alias("best"))
    return one_of_each(docs, F.struct(F.col("doc_id").isNotNull(), "doc_id"), groups)


def keep_one_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row, with the smallest id; null ids come last. Texts without words link with nothing and stay.

    Rows that are equal in every column come down to one, those without words
    too. Columns of any name are kept; whole texts are compared; an empty table
    stays empty.
    """
    groups = lambda rows: jaccard_components(rows, "rank").select("rank", F.col("component_id").alias("best"))
    return one_of_each(docs, F.struct(F.col("doc_id").isNull(), "doc_id"), groups)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no item of the benchmark is found.

    Null and empty texts are clean; whole texts are searched; rows are judged
    one by one, repeated and null ids too, and keep all their columns; an empty
    table stays empty, an empty benchmark drops nothing.
    """
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence; repeated rows are packed each.

    Null and empty texts are one piece, the end id; null ids stay null; other
    columns are left out; an empty table gives no rows.
    """
    return packed_documents(docs, tokenizer_path(TOKENIZER))
