"""Token counts of whole texts.

Batch encoding in Arrow functions that return lengths only: texts of an Arrow
batch are taken in groups balanced by bytes, every text is split at boundaries
that no token spans, and the library encodes each distinct piece once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_rows, map_rows
from .vocab import groups_by_bytes, pieces_of

#: Ids a sequence may have.
LIMIT = 2048


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row: ``id_col``, n_bytes, n_tokens, over_limit.

    Null and empty texts count 0 tokens; repeated rows are counted each; a null
    id stays null; other columns are ignored; an empty table gives no rows.
    """

    def make():
        pieces = pieces_of(path, True)

        def step(batch):
            counts = []
            for a, b in groups_by_bytes(batch.column("text")):
                cut = [pieces.cut(t) for t in batch.column("text").slice(a, b - a).to_pylist()]
                pieces.learn(cut)
                counts += [sum(map(pieces.__getitem__, c)) for c in cut]
            return {"id": batch.column("id"), "n_bytes": batch.column("n_bytes"), "n_tokens": counts}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    rows = input_rows(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = map_rows(rows, f"id {kind}, n_bytes long, n_tokens long", make)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
