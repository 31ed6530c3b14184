"""Merkle manifest of a dataset: a hash tree for each group of rows, and one over the groups.

Every node carries the interval of leaf ranks that it covers (nested intervals).
Levels are taken in strata of ``STRATUM``: within one, nodes are filed under the
bucket that an ancestor at the top of the stratum would cover, so that items and
their ancestors meet by (group, bucket) with at most ``FAN ** STRATUM`` items a
bucket, whatever the size of the group, and containment of intervals tells which
ancestors are an item's own. What an ancestor's children cover without the
child that contains the item (the difference of the intervals) are the siblings.
Paths are put together from the top: a bucket takes the path of the node that
covers it. A few joins by bucket do for any number of levels.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Children of a node, levels of a stratum.
FAN, STRATUM = 3, 4
#: The columns of ``documents`` that a leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each as its UTF-8 byte count, a colon and itself; null is a dash."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[part(v) for v in values]), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(F.array_join(x["left"], ""), acc, F.array_join(x["right"], "")), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(F.array_join(x["left"], ""), F.array_join(x["right"], ""))), ""), 256)


def ranked(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Adds lo (0, 1, ... in ``order`` within g) and n, the rows of g; ``rows`` has g and is read twice.

    Rows are dealt by ranges of g and ``order``, counted in each range, and the
    counts of earlier ranges added, so no group is sorted as a whole.
    """
    place = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    place = place.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    place = scratch.written(place, "ranked")
    counts = place.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    ahead = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("g", "part", (F.coalesce(F.sum("c").over(ahead), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy("g")).alias("n"))
    return place.join(counts, ["g", "part"]).withColumn("lo", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _levels(n: Column, top: int) -> Column:
    """Levels above the leaves of a group of ``n``."""
    return reduce(add, [(n > FAN**k).cast("int") for k in range(top)], F.lit(0))


class HashTree:
    """The trees of all groups: ``leaves`` has g, n, lo and digest, and is read several times."""

    def __init__(self, leaves: DataFrame, scratch: Scratch):
        n = leaves.agg(F.max("n")).first()[0] or 0
        top = next(k for k in range(64) if FAN**k >= n)
        items = leaves.select("g", "n", "lo", F.col("lo").alias("hi"), F.lit(0).alias("level"), "digest")
        self.strata: list[tuple[DataFrame, DataFrame, int]] = []
        for base in range(0, max(top, 1), STRATUM):
            width = FAN ** (base + STRATUM)
            now, nodes = self._in_buckets(items, width).where(F.col("n") > FAN**base), None
            for level in range(base + 1, min(base + STRATUM, max(top, 1)) + 1):
                now = now.where(F.col("n") > FAN ** (level - 1)).groupBy("g", "n", "bucket", F.expr(f"lo div {FAN**level}").alias("run"))
                now = now.agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids")).select(
                    "g", "n", "bucket", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), F.lit(level).alias("level"),
                    F.sha2(F.concat_ws("", F.col("kids")["digest"]), 256).alias("digest"), "kids",
                )
                nodes = now if nodes is None else nodes.unionByName(now)
            nodes = scratch.written(nodes, "nodes")
            self.strata.append((items, nodes, width))
            last = F.least(F.lit(base + STRATUM), _levels(F.col("n"), top))
            items = items.unionByName(nodes.select(items.columns)).where(F.col("level") == last)
        #: g, digest: what remains of each group.
        self.roots = items.select("g", "digest")

    @staticmethod
    def _in_buckets(items: DataFrame, width: int) -> DataFrame:
        return items.withColumn("bucket", F.expr(f"lo div {width}"))

    def paths(self, leaves: DataFrame, keep: list[str], upper: DataFrame, scratch: Scratch) -> DataFrame:
        """The rows of ``leaves`` (g, lo, columns to ``keep``) with path: level, left and right siblings from the leaf up.

        ``upper`` has g, path and columns that all rows of a group get: the path goes on with it.
        """
        above = upper.withColumn("bucket", F.lit(0).cast("long"))
        shared = [c for c in upper.columns if c not in ("g", "path")]
        for k in range(len(self.strata) - 1, -1, -1):
            items, nodes, width = self.strata[k]
            rows = leaves.select("g", "lo", F.col("lo").alias("hi"), *keep) if k == 0 else items.select("g", "lo", "hi")
            kept = keep if k == 0 else []
            i, a = self._in_buckets(rows, width).alias("i"), nodes.alias("a")
            inside = (F.col("i.g") == F.col("a.g")) & (F.col("i.bucket") == F.col("a.bucket")) & (F.col("a.lo") <= F.col("i.lo")) & (F.col("i.hi") <= F.col("a.hi"))
            left = F.transform(F.filter("a.kids", lambda x: x["hi"] < F.col("i.lo")), lambda x: x["digest"])
            right = F.transform(F.filter("a.kids", lambda x: x["lo"] > F.col("i.hi")), lambda x: x["digest"])
            met = i.join(a, inside, "left").select("i.*", F.when(F.col("a.level").isNotNull(), F.struct(F.col("a.level").alias("level"), left.alias("left"), right.alias("right"))).alias("step"))
            own = met.groupBy("g", "bucket", "lo").agg(F.array_sort(F.collect_list("step")).alias("own"), *[F.first(c).alias(c) for c in kept])
            whole = own.join(above, ["g", "bucket"]).select("g", "lo", *kept, *shared, F.concat("own", "path").alias("path"))
            if k:
                below = self.strata[k - 1][2]
                above = scratch.written(whole.select("g", F.expr(f"lo div {below}").alias("bucket"), "path", *shared), "paths")
        return whole


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: id_col, group_col, leaf, subroot, root, path, and the columns that ``carry`` computes from a row.

    A leaf covers ``fields``; leaves of a group ascend by id (null first; equal
    ids by leaf, so rows equal in all fields are interchangeable), groups by
    name (null first, UTF-8 bytewise). ``path`` lists level, left and right
    siblings up to the root; of a group alone, or a leaf alone, it has fewer
    steps. Null and empty fields differ; other columns of ``docs`` are ignored,
    whatever their names; an empty table gives no rows.
    """
    carry = carry or {}
    scratch = Scratch(docs.sparkSession)
    group = F.col(f"`{group_col}`").cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), group), F.lit("")).alias("g"), F.col(f"`{id_col}`").alias("id"),
        leaf_digest([F.col(f"`{c}`") for c in fields]).alias("digest"), *[v.alias(f"carry_{k}") for k, v in carry.items()],
    )
    keep = ["id", "digest", *[f"carry_{k}" for k in carry]]
    leaves = scratch.written(ranked(scratch.written(leaves, "leaves"), ["id", "digest"], scratch), "leaves")
    tree = HashTree(leaves, scratch)
    roots = scratch.written(tree.roots, "subroots")
    groups = roots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    groups = scratch.written(ranked(groups, ["name"], scratch), "groups")
    over = HashTree(groups, scratch)
    root = over.roots.first()
    end = groups.select("g").distinct().select("g", F.array().cast("array<struct<level:int,left:array<string>,right:array<string>>>").alias("path"))
    tops = over.paths(groups, ["name", "digest"], end, scratch).select(F.col("name").alias("g"), "path", F.col("digest").alias("subroot"))
    out = tree.paths(leaves, keep, scratch.written(tops, "tops"), scratch).select(
        F.col("id").alias(id_col), F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias(group_col), F.col("digest").alias("leaf"), "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"), "path", *[F.col(f"carry_{k}").alias(k) for k in carry],
    )
    out = Scratch(docs.sparkSession).written(out, "manifest", last=True)
    scratch.clear()
    return out


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` checked against a copy in which every row whose crc32 of the id is even lost its line ends.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Null ids count as empty text (even).
    """
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    changed = even & F.contains("text", F.lit("\n"))
    fields = [F.regexp_replace("text", "\n", "") if c == "text" else F.col(c) for c in FIELDS]
    rows = manifest(docs, carry={"altered": F.when(changed, leaf_digest(fields))})
    root = folded(F.coalesce("altered", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_H = "sha256(string_agg(digest, '' ORDER BY pos))"
_LEAF = " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS)
#: The same rows by recursion over the levels of all trees, first of the sources, then over them.
MANIFEST_SQL = f"""WITH RECURSIVE digits AS (SELECT rowid_, doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS s FROM (SELECT row_number() OVER () AS rowid_, * FROM documents)),
crc AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(s) + 1), lambda i: [CAST(ascii(s[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END)) AS c FROM digits),
leaves AS (SELECT *, sha256({_LEAF}) AS leaf, CASE WHEN c % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t, coalesce('+' || source, '') AS g FROM crc),
placed AS (SELECT *, sha256({_LEAF.replace("text", "t")}) AS altered, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
nodes AS (SELECT g, 0 AS level, n, pos, leaf AS digest FROM placed UNION ALL SELECT g, level + 1, (n + 2) // 3, up, {_H} FROM (SELECT *, pos // 3 AS up FROM nodes WHERE n > 1) x GROUP BY g, level, n, up),
subs AS (SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, n, pos, digest FROM subs UNION ALL SELECT level + 1, (n + 2) // 3, up, {_H} FROM (SELECT *, pos // 3 AS up FROM tops WHERE n > 1) x GROUP BY level, n, up),
walk AS (SELECT rowid_, g, 0 AS part, 0 AS level, n, pos, altered AS acc, '' AS proof FROM placed UNION ALL (
  WITH step AS (SELECT w.rowid_, w.g, w.part, w.level, w.n, w.pos, string_agg(CASE WHEN x.pos = w.pos THEN w.acc ELSE x.digest END, '' ORDER BY x.pos) AS run, any_value(w.proof) || coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos <> w.pos), '') AS proof
    FROM walk w JOIN (SELECT 0 AS part, g, level, pos, digest FROM nodes UNION ALL SELECT 1, NULL, level, pos, digest FROM tops) x
      ON x.part = w.part AND (x.part = 1 OR x.g = w.g) AND x.level = w.level AND x.pos // 3 = w.pos // 3 WHERE w.n > 1 GROUP BY w.rowid_, w.g, w.part, w.level, w.n, w.pos)
  SELECT rowid_, g, part, level + 1, (n + 2) // 3, pos // 3, sha256(run), proof FROM step
  UNION ALL SELECT w.rowid_, w.g, 1, 0, s.n, s.pos, w.acc, w.proof FROM walk w JOIN subs s ON s.g = w.g WHERE w.part = 0 AND w.n = 1))
SELECT b.doc_id, b.leaf, s.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = r.digest AS verified
FROM placed b JOIN walk w ON w.rowid_ = b.rowid_ AND w.part = 1 AND w.n = 1 JOIN subs s ON s.g = b.g JOIN tops r ON r.n = 1"""
