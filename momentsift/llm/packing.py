"""Best-fit packing of tokenised documents into fixed-size sequences.

Minimum bin slack over the histogram of lengths: for each bin, the largest
length that is left is placed and a bitset subset-sum table over the lengths
still available gives the fullest feasible combination, which is removed as
often as the counts allow. Lengths are at most the size of a bin, so the
histogram and the plan stay small however many pieces there are; only they
reach the driver. The pieces themselves are ranked within their length by
hashed sub-groups of bounded size, so no length, however common, needs one
task, and take the places that the plan has for their rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import input_rows, map_rows, written
from .vocab import groups_by_bytes, pieces_of

#: Tokens of a sequence, the id that ends a document, pieces of a sub-group.
CAPACITY = 2048
END_ID = 0
GROUP_ROWS = 2_000


def fullest(lengths: list[int], counts: list[int], room: int) -> dict[int, int]:
    """Of ``lengths`` (ascending), each at most ``counts`` times: the combination with the largest sum <= room.

    Bit s of ``reach[i]`` tells that some combination of the first i lengths has
    sum s. Read backwards it prefers large pieces, which leaves the small ones,
    that fit anywhere, for later bins.
    """
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for length, count in zip(lengths, counts, strict=True):
        bits, left, step = reach[-1], min(count, room // length), 1
        while left > 0:
            step = min(step, left)
            bits |= (bits << (length * step)) & mask
            left -= step
            step *= 2
        reach.append(bits)
    total = reach[-1].bit_length() - 1
    chosen: dict[int, int] = {}
    for i in range(len(lengths) - 1, -1, -1):
        if total == 0:
            break
        length = lengths[i]
        for n in range(min(counts[i], total // length), -1, -1):
            if reach[i] >> (total - n * length) & 1:
                if n:
                    chosen[length] = n
                total -= n * length
                break
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pieces of one bin by length, how many such bins) until nothing is left."""
    left = {k: v for k, v in histogram.items() if v > 0}
    plan = []
    while left:
        seed = max(left)
        left[seed] -= 1
        lengths = sorted(k for k in left if left[k] and k <= capacity - seed)
        bin_ = fullest(lengths, [left[k] for k in lengths], capacity - seed) if lengths else {}
        left[seed] += 1
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(left[k] // n for k, n in bin_.items())
        plan.append((bin_, times))
        for k, n in bin_.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Length -> rows (first rank, first bin, pieces in a bin, first offset in a bin), by rank."""
    seen: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first_bin = 0
    for bin_, times in plan:
        offset = 0
        for length in sorted(bin_, reverse=True):
            n = bin_[length]
            rows.setdefault(length, []).append((seen.get(length, 0), first_bin, n, offset))
            seen[length] = seen.get(length, 0) + n * times
            offset += n * length
        first_bin += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def cut_documents(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """Pieces: id, piece, start, length, ids_crc32, row (tells repeated rows of one id apart)."""

    def make():
        pieces = pieces_of(path, False)
        end = np.array([END_ID], "<u4").tobytes()

        def step(batch):
            ids = batch.column("id").to_pylist()
            out = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32")}
            for a, b in groups_by_bytes(batch.column("text")):
                cut = [pieces.cut(t) for t in batch.column("text").slice(a, b - a).to_pylist()]
                pieces.learn(cut)
                for doc_id, c in zip(ids[a:b], cut, strict=True):
                    data = pieces.joined(c) + end
                    for k, start in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[start : start + 4 * capacity]
                        for name, value in zip(out, (doc_id, k, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            out[name].append(value)
            return out

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    return map_rows(input_rows(docs, id_col, text_col), schema, make)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to a table with ``length`` and ``ids_crc32``; reads it twice, so pass a written one."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    where = places(plan_bins(histogram, capacity))
    groups = {k: -(-v // group_rows) for k, v in histogram.items()}
    spark = pieces.sparkSession
    sizes = spark.createDataFrame(list(groups.items()) or [(0, 1)], "length long, n_groups long")
    keyed = pieces.join(F.broadcast(sizes), "length").withColumn(
        "part", F.pmod(F.xxhash64(*[c for c in columns if c != "length"]), F.col("n_groups"))
    )
    before = keyed.groupBy("length", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy(*[c for c in columns if c != "length"])
    ranked = keyed.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "part"])
    ranked = ranked.select(*columns, (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        for df in batches:
            sequence, offset = np.zeros(len(df), np.int64), np.zeros(len(df), np.int64)
            for length, index in df.groupby("length").indices.items():
                rows, rank = where[length], df["rank"].to_numpy()[index]
                at = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
                nth = rank - at[:, 0]
                sequence[index] = at[:, 1] + nth // at[:, 2]
                offset[index] = at[:, 3] + nth % at[:, 2] * length
            yield pd.DataFrame({c: df[c] for c in columns} | {"sequence_id": sequence, "offset": offset})

    return ranked.mapInPandas(place, schema)


def packed_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the end id alone. Repeated rows are
    packed each. Only documents longer than ``capacity`` are cut. An empty
    table gives no rows.
    """
    pieces = written(cut_documents(docs, path, id_col, text_col, capacity), "pieces")
    return pack_pieces(pieces, capacity).withColumnRenamed("id", id_col)
