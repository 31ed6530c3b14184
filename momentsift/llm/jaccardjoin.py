"""N-gram Jaccard join: which texts share at least 80 % of their word shingles.

Set-relation skipping, as Spark jobs:

* Equal sets are one node; copies never enter the join.
* Nodes that share a min-hash band follow the node that shares most bands with
  others, their hub, and are compared with it. Of a node that is like its hub
  only the difference is kept: shingles that one has and the other lacks.
* Answers inside a hub's group are derived from these differences. With d and e
  shingles of difference, c of them common, two sets differ by d + e - 2c
  shingles. Sets that link with the hub are one class, and no two others can
  link with c = 0; so only differences that share a shingle are looked up, in
  index lists of the rarest shingles of each difference (prefix filter).
* Answers between groups come from index lists of the rarest shingles of each
  whole set. In both kinds of lists a pair is skipped where the positions leave
  too few shingles to reach the bound, and pairs of one class or group too.
  Lists are sorted by size and dealt in blocks: pairs of blocks that size,
  position or class rule out are never joined, and no task holds a whole list.
* Every remaining pair is verified: on the shared differences in a group, on
  the full sets between groups.

The filters are exact: every pair over the threshold is answered. Counts of
shingles over all texts only change the order in which shingles are indexed.
Sets are of 64-bit shingle hashes; nodes are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, input_rows, release_memory, some_texts
from .components import connected_components

WORDS = 5
BANDS, ROWS = 8, 4
#: A set at least so similar to its hub is described by how it differs from it.
RELATED = 0.35
#: log2 of counting buckets, and of those in a row when counts are added up (they only order the index).
BUCKET_BITS, SLICE_BITS = 22, 12
#: Slots of the table that preselects texts to be compared; its size is what is broadcast at most.
SLOTS = 1 << 20
#: Sets that are compared with one set in one run, entries of a block of an index list, of a step within.
RUN, LIST, STEP = 2000, 4096, 512
MAX_KEPT = 200_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_BINS = np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(64 - (BANDS * ROWS - 1).bit_length())


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Text -> sorted distinct hashes of its shingles."""

    def __init__(self):
        self.hashes = WordHashes()

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        if len(self.hashes) > MAX_KEPT:
            self.hashes.clear()
        w = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        if n < WORDS:
            h = np.uint64(n)
            for j in range(n):
                h = h + w[j] * _MIX[j]
            return _finish(np.array([h], np.uint64))
        h = w[: n - WORDS + 1] * _MIX[0]
        for j in range(1, WORDS):
            h = h + w[j : n - WORDS + 1 + j] * _MIX[j]
        return np.unique(_finish(h))


def node_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def bands_of(tokens: np.ndarray) -> np.ndarray:
    """One-permutation min-hashes: the first token of each equal stretch of the hash range, four stretches to a band.

    A stretch without tokens counts as 0; a band of such stretches only, as
    short texts have, is left out.
    """
    first = np.searchsorted(tokens, _BINS)
    some = np.append(first[1:], len(tokens)) > first
    low = np.where(some, tokens[np.minimum(first, len(tokens) - 1)], 0).reshape(BANDS, ROWS)
    mixed = _finish((low * _MIX[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return mixed[some.reshape(BANDS, ROWS).any(1)].view(np.int64)


def prefix_length(n: int) -> int:
    """Two linked sets share one at least of so many entries of each."""
    return n - (4 * n + 4) // 5 + 1


def _sets(docs: DataFrame) -> DataFrame:
    """Row id, rid, n, key, bands; and rows with a slice of the counts of a task's shingles where is_row is false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, counts = Shingler(), np.zeros(1 << BUCKET_BITS, np.int32)
        for batch in batches:
            n, keys, bands = [], [], []
            with np.errstate(over="ignore"):
                for text in some_texts(batch.column("text")):
                    t = shingle(text)
                    n.append(len(t))
                    keys.append(node_key(t) if len(t) else None)
                    bands.append(bands_of(t) if len(t) else None)
                    np.add.at(counts, (t >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([True] * len(n)), batch.column("id"), batch.column("rid"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())],
                names=names,
            )
        slices = np.minimum(counts, 255).astype(np.uint8).reshape(-1, 1 << SLICE_BITS)
        some = np.flatnonzero(slices.any(1))
        k = len(some)
        if k:
            yield pa.RecordBatch.from_arrays(
                [pa.array([False] * k), pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64())), pa.array(some, pa.int32()), pa.array([x.tobytes() for x in slices[some]], pa.binary())],
                names=names,
            )
        del shingle, counts, slices
        release_memory()

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["is_row", "id", "rid", "n", "key", "bands", "slice", "counts"]
    id_type = to_arrow_type(docs.schema["id"].dataType)
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"is_row boolean, id {kind}, rid long, n long, key binary, bands array<long>, slice int, counts binary")


def _weights(found: DataFrame) -> np.ndarray:
    """For each bucket how often its shingles occur, in steps of an eighth of a power of two: a table of fixed size."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                c = np.frombuffer(c, np.uint8)
                sums[k] = sums[k] + c if k in sums else c.astype(np.int64)
        if sums:
            steps = [np.minimum(255, np.round(8 * np.log2(x + 1.0))).astype(np.uint8).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(steps, pa.binary())], names=["slice", "counts"])

    out = np.zeros((1 << (BUCKET_BITS - SLICE_BITS), 1 << SLICE_BITS), np.uint8)
    for r in found.where("not is_row").select("slice", "counts").repartition("slice").mapInArrow(run, "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint8)
    return out.ravel()


def _short(key):
    """A signed 64-bit name of a key for the index lists; pairs of names are joined back to all keys they stand for."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def _hub_pairs(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, first): each node b that shares a band, with the hub of its bands and with the hub that this leads to in a few steps (first)."""
    banded = nodes.select("key", F.explode("bands").alias("hash"))
    sizes = banded.groupBy("hash").agg(F.count("*").alias("size")).where("size > 1")
    crowded = banded.join(sizes, "hash")
    weights = crowded.groupBy("key").agg(F.sum("size").alias("weight"))
    crowded = scratch.written(crowded.join(weights, "key").select("hash", F.struct("weight", "key").alias("member")), "bands")
    hubs = crowded.groupBy("hash").agg(F.max("member").alias("hub"))
    leads = crowded.join(hubs, "hash").groupBy(F.col("member.key").alias("b")).agg(F.max("hub")["key"].alias("a"))
    leads = scratch.written(leads, "leads")
    far = leads
    for _ in range(2):
        step = far.select(F.col("b").alias("a"), F.col("a").alias("next"))
        far = far.join(step, "a").select("b", F.col("next").alias("a"))
        far = scratch.written(far, "leads")
    both = far.select("a", "b", F.lit(True).alias("first")).unionByName(leads.select("a", "b", F.lit(False).alias("first")))
    return both.where("a <> b").groupBy("a", "b").agg(F.max("first").alias("first"))


def compared(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``pairs`` (node keys a and b, and other columns) with n_a, n_b, linked, and diff: what one has and the other lacks, if they are related.

    The texts of a's partners come to runs of bounded length, behind the text
    of a itself, so a set moves once for each pair that it is b of.
    """
    pairs = scratch.written(pairs, "pairs")
    name = nodes.select("key", "rid")
    runs = pairs.groupBy("a").agg((F.floor((F.count("*") - 1) / RUN) + 1).alias("runs"))
    heads = runs.join(name.withColumnRenamed("key", "a"), "a").select("rid", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"), F.col("a").alias("key"))
    members = pairs.join(runs, "a").join(name.withColumnRenamed("key", "b"), "b").select("rid", "a", F.pmod(F.xxhash64("b"), F.col("runs")).alias("run"), F.col("b").alias("key"))
    plan = scratch.written(heads.unionByName(members), "plan")
    slot = F.pmod(F.col("rid"), F.lit(SLOTS)).alias("slot")
    some = docs.withColumn("slot", slot).join(F.broadcast(plan.select(slot).distinct()), "slot", "left_semi")
    texts = some.select("rid", "text").join(plan.hint("shuffle_hash"), "rid").select("a", "run", "key", "text")
    texts = texts.repartition("a", "run").sortWithinPartitions("a", "run", F.col("key") != F.col("a"), "key")

    def run(batches):
        shingle, head, mine, last = Shingler(), None, None, None
        for batch in batches:
            out = {k: [] for k in ("a", "b", "n_a", "n_b", "linked", "diff")}
            columns = (batch.column("a").to_pylist(), batch.column("run").to_pylist(), batch.column("key").to_pylist(), some_texts(batch.column("text"), 100))
            with np.errstate(over="ignore"):
                for a, k, key, text in zip(*columns, strict=True):
                    if (a, k, key) == last:
                        continue
                    t = shingle(text)
                    if node_key(t) != key:  # another row of the same rid
                        continue
                    last = (a, k, key)
                    if a == key:
                        head, mine = (a, k), t
                        continue
                    if head != (a, k):
                        raise RuntimeError("a run without its first set")
                    diff = np.setxor1d(mine, t, assume_unique=True)
                    total = len(mine) + len(t)
                    common = (total - len(diff)) // 2
                    for name_, v in zip(out, (a, key, len(mine), len(t), 180 * common >= 80 * total, diff.view(np.int64) if common >= RELATED * (total - common) else None), strict=True):
                        out[name_].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))
        del shingle, mine
        release_memory()

    types = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
    done = texts.mapInArrow(run, "a binary, b binary, n_a long, n_b long, linked boolean, diff array<long>")
    return scratch.written(done, "compared")


def _postings(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """token, node, size, rest for the rarest shingles of each set, once for each task that holds the set."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        weight, sent, shingle = shared.value, set(), Shingler()
        for batch in batches:
            tokens, nodes, sizes, lengths = [], [], [], []
            with np.errstate(over="ignore"):
                for text in some_texts(batch.column("text")):
                    t = shingle(text)
                    if not len(t):
                        continue
                    key = node_key(t)
                    if key in sent:
                        continue
                    if len(sent) < MAX_KEPT:
                        sent.add(key)
                    k = prefix_length(len(t))
                    tokens.append(t[np.argsort(weight[t >> np.uint64(64 - BUCKET_BITS)], kind="stable")[:k]])
                    nodes.append(key[:8])
                    sizes.append(len(t))
                    lengths.append(k)
            if nodes:
                each = np.repeat(np.arange(len(nodes)), lengths)
                node = np.frombuffer(b"".join(nodes), ">i8").astype(np.int64)[each]
                size = np.array(sizes, np.int32)[each]
                first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                rest = size - (np.arange(len(each)) - first[each]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(node), pa.array(size), pa.array(rest)], names=["token", "node", "size", "rest"])
        del sent, shingle
        release_memory()

    return docs.select("text").mapInArrow(run, "token long, node long, size int, rest int")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Column chunks of whole groups from batches sorted by ``keys``."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        if rest is not None:
            now = {k: np.concatenate([rest[k], v]) for k, v in now.items()}
        change = _starts(now, keys)
        cut = int(change[-1])
        if cut:
            yield {k: v[:cut] for k, v in now.items()}
        rest = {k: v[cut:] for k, v in now.items()}
    if rest is not None:
        yield rest


def _starts(columns: dict[str, np.ndarray], keys: tuple[str, ...]) -> np.ndarray:
    """Where groups of equal keys begin."""
    new = np.ones(len(columns[keys[0]]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= columns[k][1:] != columns[k][:-1]
    return np.flatnonzero(new)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by token, size and node, with their block of the list and whether the list has more than one.

    Drops lists of one node, which are nearly all, and repeated entries.
    """
    rest, out = None, 0  # entries of the last list so far; its blocks that are gone
    batches = (b for b in batches if b.num_rows)
    while True:
        batch = next(batches, None)
        if batch is None and rest is None:
            return
        now = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names} if batch is not None else rest
        if batch is not None and rest is not None:
            now = {k: np.concatenate([rest[k], v]) for k, v in now.items()}
        new = np.ones(len(now["token"]), bool)
        new[1:] = (now["token"][1:] != now["token"][:-1]) | (now["node"][1:] != now["node"][:-1])
        now = {k: v[new] for k, v in now.items()}
        start = _starts(now, ("token",))
        total = len(now["token"])
        cut = int(start[-1]) if batch is not None else total
        sizes = np.diff(np.append(start, total))
        place = np.arange(total) - np.repeat(start, sizes)
        before = np.where(np.arange(total) < sizes[0], out, 0)
        block, many = before + place // LIST, np.repeat((sizes > LIST), sizes) | (before > 0)
        keep = (np.repeat(sizes > 1, sizes) | (before > 0)) & (np.arange(total) < cut)
        if batch is not None and total - cut > 2 * LIST:  # the last list is long: its full blocks go
            more = (total - cut - 1) // LIST * LIST
            keep[cut : cut + more] = many[cut:] = True
            out, cut = (out if cut == 0 else 0) + more // LIST, cut + more
        elif cut:
            out = 0
        if keep.any():
            columns = {k: v[keep] for k, v in now.items()} | {"block": block[keep].astype(np.int32), "many": many[keep]}
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))
        if batch is None:
            return
        rest = {k: v[cut:] for k, v in now.items()}


def index_lists(postings: DataFrame) -> DataFrame:
    """``postings`` (token, node, size, rest, and others of fixed width) with block and many."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in postings.schema)
    return postings.repartition("token").sortWithinPartitions("token", "size", "node").mapInArrow(_blocks, f"{kinds}, block int, many boolean")


def _block_pairs(c: dict[str, np.ndarray], rests: int, sizes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of the pairs of one block (or between the sides of two) that position, size and class allow, step against step."""
    size, rest, node, group, side = c["size"].astype(np.int64), c["rest"].astype(np.int64), c["node"], c["class"], c["side"]
    across = bool(side.any())
    for a in range(0, len(size), STEP):
        b = min(a + STEP, len(size))
        for x in range(a, len(size), STEP):
            y = min(x + STEP, len(size))
            if rests * min(rest[a:b].max(), rest[x:y].max()) < sizes * (size[a:b].min() + size[x:y].min()):
                continue
            if group[a] == group[x] and (group[a:b] == group[a]).all() and (group[x:y] == group[a]).all():
                continue
            i, j = np.arange(a, b)[:, None], np.arange(x, y)[None, :]
            # The first entry that a linked pair shares comes so early that what follows can reach the bound.
            ok = (j > i) & (group[i] != group[j]) & (node[i] != node[j]) & (rests * np.minimum(rest[i], rest[j]) >= sizes * (size[i] + size[j]))
            if across:
                ok &= side[i] != side[j]
            p, q = np.nonzero(ok)
            if len(p):
                yield node[a + p], node[x + q]


def candidate_pairs(lists: DataFrame, rests: int, sizes: int) -> DataFrame:
    """Distinct (x, y), x < y, of the pairs in ``lists`` (with a class) where rests * min(rest) >= sizes * (sum of sizes) and classes differ."""
    entry = ["token", "node", "size", "rest", "class"]
    dealt = lists.where("not many").select(*entry, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("side"))
    if not lists.where("many").isEmpty():
        many = lists.where("many")
        heads = many.groupBy("token", "block").agg(F.min("size").alias("size"), F.max("rest").alias("rest"), F.min("class").alias("low"), F.max("class").alias("high"))
        p, q = (heads.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("size", "rest", "low", "high")], F.col("block").alias(k)) for k in "ij")
        possible = (F.col("i") <= F.col("j")) & (rests * F.least("rest_i", "rest_j") >= sizes * (F.col("size_i") + F.col("size_j")))
        possible &= F.greatest("high_i", "high_j") > F.least("low_i", "low_j")
        # Under another name: both sides come from ``many``, so Spark couldn't tell which token is meant.
        blocks = p.join(q, "token").where(possible).select(F.col("token").alias("of"), "i", "j")
        for k, side in (("i", False), ("j", True)):
            met = many.join(blocks.where("i < j") if side else blocks, (F.col("token") == F.col("of")) & (F.col("block") == F.col(k)))
            dealt = dealt.unionByName(met.select(*entry, "i", "j", F.lit(side).alias("side")))

    def run(batches):
        keys = ("token", "i", "j")
        for c in _whole_groups(batches, keys):
            edges = np.append(_starts(c, keys), len(c["token"]))
            several = np.minimum.reduceat(c["class"], edges[:-1]) != np.maximum.reduceat(c["class"], edges[:-1])
            for k in np.flatnonzero(several):
                one = {name: v[edges[k] : edges[k + 1]] for name, v in c.items()}
                for x, y in _block_pairs(one, rests, sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])

    return dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "size").mapInArrow(run, "x long, y long").distinct()


def relations(near: DataFrame) -> DataFrame:
    """key, hub, n, n_hub, linked, diff: each set by one hub that it is related to, the one that others are led to where it can be."""
    chosen = near.where("diff is not null").groupBy("b").agg(F.max(F.struct("first", "a", "n_a", "n_b", "linked", "diff")).alias("r"))
    return chosen.select(F.col("b").alias("key"), F.col("r.a").alias("hub"), F.col("r.n_b").alias("n"), F.col("r.n_a").alias("n_hub"), "r.linked", "r.diff")


def links_within(related: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of the links between sets of one hub that aren't both linked with it.

    With ``size`` = 9 * differences - shingles, two sets link if their
    differences share (size + size) / 18 shingles. The least size is the hub's,
    so a set needs to look for partners only with so many shared as that, or as
    a set that isn't linked with the hub, leaves to it.
    """
    hub = _short(F.col("hub"))
    named = related.select("key", hub.alias("hub"), F.size("diff").cast("long").alias("d"), (9 * F.size("diff") - F.col("n")).alias("size"), "n", "n_hub", "linked")
    tokens = related.select("key", hub.alias("hub"), F.explode("diff").alias("t")).select("key", F.xxhash64("hub", "t").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    lists = tokens.join(shared, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("list"))
    lists = scratch.written(named.join(lists, "key").withColumn("list", F.col("list.token")), "differences")
    need = F.when(F.col("linked"), F.floor((F.col("size") + F.col("n_hub")) / 18) + 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("n_hub")) / 18)))
    alone = F.col("d") - F.size("list")  # shingles of its own come first
    taken = F.slice("list", F.lit(1), F.greatest(F.lit(0), F.col("d") - need + 1 - alone).cast("int"))
    node = _short(F.col("key"))
    postings = lists.select(
        node.alias("node"), "size", "d", alone.alias("alone"), F.when(F.col("linked"), F.col("hub")).otherwise(node).alias("class"), F.posexplode(taken).alias("place", "token")
    ).select("token", "node", F.col("size").cast("int"), (F.col("d") - F.col("alone") - F.col("place")).cast("int").alias("rest"), "class")
    pairs = candidate_pairs(scratch.written(index_lists(postings), "lists"), 18, 1)
    x, y = (lists.select(node.alias(k), F.col("key").alias(f"key_{k}"), F.col("hub").alias(f"hub_{k}"), F.col("size").alias(f"size_{k}"), F.col("list").alias(f"list_{k}")) for k in "xy")
    both = pairs.join(x, "x").join(y, "y").where("hub_x = hub_y")
    both = both.where(18 * F.size(F.array_intersect("list_x", "list_y")) >= F.col("size_x") + F.col("size_y"))
    return both.select(F.col("key_x").alias("a"), F.col("key_y").alias("b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id_col``, n_shingles, component_id, n_equal.

    component_id is the smallest id reachable by links, the row's own included;
    n_equal counts the rows with the same set. Null and empty texts, and texts
    without words, have no shingles and link with nothing. Texts of any length
    are read whole. Repeated rows are equal sets. A null id never is a
    component's smallest id unless all its rows have null ids. Columns other
    than the two are ignored, whatever their names; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = input_rows(docs, id_col, text_col)
    rows = rows.select("id", F.xxhash64("id", "text").alias("rid"), "text")
    found = scratch.written(_sets(rows), "jaccard", last=True)
    sets = found.where("is_row").select("id", "n", "key", "rid", "bands")
    nodes = sets.where("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.min("rid").alias("rid"), F.first("bands").alias("bands"), F.count("*").alias("equal"))
    nodes = scratch.written(nodes, "nodes")
    # Inside the groups of a hub.
    pairs = scratch.written(_hub_pairs(nodes, scratch), "near")
    near = compared(rows, nodes, pairs.select("a", "b"), scratch)
    related = scratch.written(relations(near.join(pairs, ["a", "b"])), "related")
    # Between them.
    lists = scratch.written(index_lists(_postings(rows, _weights(found))), "lists")
    hub_of = related.select(_short(F.col("key")).alias("node"), _short(F.col("hub")).alias("class")).dropDuplicates(["node"])
    lists = lists.join(hub_of, "node", "left").withColumn("class", F.coalesce("class", "node"))
    named = nodes.select("key", _short(F.col("key")).alias("name"))
    across = candidate_pairs(lists, 9, 4)
    across = across.join(named.select(F.col("name").alias("x"), F.col("key").alias("a")), "x").join(named.select(F.col("name").alias("y"), F.col("key").alias("b")), "y").select("a", "b")
    links = near.where("linked").select("a", "b").unionByName(links_within(related, scratch))
    links = links.unionByName(compared(rows, nodes, across, scratch).where("linked").select("a", "b"))
    roots = connected_components(scratch.written(links, "links"), scratch)
    component = nodes.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "id", "equal", F.coalesce("root", "key").alias("root"))
    smallest = component.groupBy("root").agg(F.min("id").alias("component_id"))
    member = scratch.written(component.join(smallest, "root").select("key", "component_id", "equal"), "members", last=True)
    scratch.clear()
    return sets.join(member, "key", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("equal", F.lit(1)).cast("long").alias("n_equal"),
    )
