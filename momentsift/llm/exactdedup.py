"""Exact dedup by content-defined chunk recipes.

A text is cut where its own content says so, so equal passages give equal
chunks wherever they stand. Distinct chunks are gathered once (combined on the
map side) to verify that a chunk's 64-bit hash belongs to one chunk text only;
where it doesn't, the chunk's SHA-256 is its identifier. A document is then the
ordered list of its chunk identifiers, and equal lists are equal texts: long
documents never move as wholes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A chunk ends at the first line or sentence end after MIN_CHUNK characters; where none comes within MAX_CHUNK, at the
#: first white space, or else where one of a few characters follows itself; and at MAX_CHUNK in text without any of these.
MIN_CHUNK, MAX_CHUNK = 384, 4096
ENDS = (r"(?:\n|[.!?] |[\u3002\uff01\uff1f])", r"\s", "(?:aa|ee|tt|00|11|ff|AA|\\+\\+|//|\u7684)")
CHUNK = "(?s)" + "|".join(f".{{{MIN_CHUNK},{MAX_CHUNK}}}?{end}" for end in ENDS) + f"|.{{1,{MAX_CHUNK}}}"


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_sha256, recipe (array of chunk identifiers); one row per row, no text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    chunk_rows = rows.select(F.explode(chunks_of(F.col("text"))).alias("chunk"))
    distinct = chunk_rows.select(F.xxhash64("chunk").alias("h"), "chunk").groupBy("h", "chunk").agg(F.count("*").alias("uses"))
    shared = distinct.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h")
    shared = {r["h"] for r in shared.limit(MAX_SHARED + 1).collect()}
    if len(shared) > MAX_SHARED:  # adversarial input: every chunk goes by its SHA-256
        name = lambda c: F.sha2(c, 256)
    elif shared:
        name = lambda c: F.when(F.xxhash64(c).isin(sorted(shared)), F.sha2(c, 256)).otherwise(F.hex(F.xxhash64(c)))
    else:
        name = lambda c: F.hex(F.xxhash64(c))
    return rows.select(
        "id", F.sha2("text", 256).alias("text_sha256"), F.transform(chunks_of(F.col("text")), name).alias("recipe")
    )


#: Hashes with several chunk texts that are told apart by name; 64-bit hashes of ordinary text have none.
MAX_SHARED = 1000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and equal each other. Of equal texts the row with
    the largest id stays; where that id itself is repeated with the same text,
    every such row is marked kept (they can't be told apart). Null ids never
    win against others. Texts of any length are read whole; columns other than
    the two are ignored, whatever their names; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    named = scratch.written(recipes(docs, id_col, text_col).select("id", "text_sha256", "recipe"), "recipes", last=True)
    groups = named.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    several = groups.where("group_size > 1").select(F.col("recipe").alias("r"), "keep_id", "group_size")
    several = scratch.written(several, "groups", last=True)  # a plain table: Spark can split a group that is large
    joined = named.join(several, F.col("recipe") == F.col("r"), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        "text_sha256",
    )


EXACT_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size
      FROM documents WINDOW w AS (PARTITION BY coalesce(text, '')))
"""
