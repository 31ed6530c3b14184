"""URL filters: pattern rules indexed by their rarest literal token.

The tokens of a URL fetch the rules filed under them; only those rules run
their regular expression. How rare a rule's tokens are is counted over all
URLs. Rules are a table: few of them become a literal map in one pass over the
rows, more are joined by token. Everything is a DataFrame expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched against host + path; every token in ``tokens`` occurs in whatever it matches."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    is_host: bool = True


def host_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """Fits a host and its subdomains where the path starts with ``path``."""
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(host + path, verdict, pattern, tuple(tokens_in(host)))


def tokens_in(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def word_rule(verdict: str, word: str) -> Rule:
    """Fits URLs that have ``word`` as a whole token of host or path."""
    return Rule(word, verdict, rf"(?i)(?:^|[^a-z0-9]){re.escape(word)}(?:$|[^a-z0-9])", (word,), False)


#: The rules of the contract, and words that the method itself blocks where no host rule fits.
HOST_RULES = (
    host_rule("allow", "com"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
WORD_RULES = tuple(word_rule("block", w) for w in ("casino", "porn", "xxx", "phishing", "malware", "adserver", "doubleclick"))


#: Rules up to this many are looked up in place; more are joined. Both give the same rows.
LITERAL_RULES = 500


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.concat(host, path)), "[^a-z0-9]+"), lambda t: t != ""))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """name, verdict, pattern, tokens, is_host: what ``judge_urls`` takes, and what a stored list of rules holds."""
    rows = [(r.name, r.verdict, r.pattern, list(r.tokens), r.is_host) for r in rules]
    return spark.createDataFrame(rows, "name string, verdict string, pattern string, tokens array<string>, is_host boolean")


def filed_rules(urls: DataFrame, rules: DataFrame, few: bool) -> DataFrame:
    """token, rule (is_host, size, name, verdict, pattern): each rule under its rarest token; ties: the first in its own order.

    Tokens are counted before they move, so a common one is a few rows. Where
    the rules are few their tokens are broadcast and others are not counted.
    """
    mine = rules.select(
        F.struct("is_host", F.length("name").alias("size"), "name", "verdict", "pattern").alias("rule"), F.posexplode("tokens").alias("place", "token")
    )
    found = urls.select(F.explode("tokens").alias("token"))
    if few:
        found = found.join(F.broadcast(mine.select("token").distinct()), "token", "left_semi")
    found = found.groupBy("token").agg(F.count("*").alias("n"))
    ranked = mine.join(found, "token", "left").select("rule", "token", F.struct(F.coalesce("n", F.lit(0)), "place").alias("by"))
    return ranked.groupBy("rule").agg(F.min_by("token", "by").alias("token"))


def _best(rule: Column) -> Column:
    return F.struct(rule["is_host"].alias("is_host"), rule["size"].alias("size"), rule["name"].alias("name"), rule["verdict"].alias("verdict"))


def fit_in_place(parts: DataFrame, filed: DataFrame) -> DataFrame:
    """Adds ``fit``, the best rule that fits, with the index as a literal map: nothing moves. For few rules only."""
    index: dict[str, list] = {}
    for r in filed.collect():
        index.setdefault(r["token"], []).append(r["rule"])
    if not index:
        return parts.withColumn("fit", F.lit(None).cast("struct<is_host: boolean, size: int, name: string, verdict: string>"))
    as_struct = lambda r: F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()])
    filed_map = F.create_map(*[x for t, rs in index.items() for x in (F.lit(t), F.array(*map(as_struct, rs)))])
    candidates = F.flatten(F.filter(F.transform("tokens", lambda t: F.try_element_at(filed_map, t)), lambda c: c.isNotNull()))
    fits = F.filter(candidates, lambda r: F.regexp_like(F.concat("host", "path"), r["pattern"]))
    return parts.withColumn("fit", F.array_max(F.transform(fits, _best)))


def fit_by_join(parts: DataFrame, filed: DataFrame) -> DataFrame:
    """Adds ``fit`` by a join of tokens, for any number of rules: each distinct URL meets the rules filed under its tokens once."""
    urls = parts.select("host", "path", "tokens").distinct()
    candidates = urls.select("host", "path", F.explode("tokens").alias("token")).join(filed, "token")
    fits = candidates.where(F.regexp_like(F.concat("host", "path"), F.col("rule.pattern")))
    fits = fits.groupBy("host", "path").agg(F.max(_best(F.col("rule"))).alias("fit"))
    return parts.join(fits, ["host", "path"], "left")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame | tuple[Rule, ...] = HOST_RULES + WORD_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    literal_rules: int = LITERAL_RULES,
) -> DataFrame:
    """One row per row: ``id_col``, host, path, rule, verdict, word_rule.

    ``rules`` is a table as ``rule_table`` makes it, of any size, or a tuple.
    The longest host rule that fits decides; else a word rule; else ``default``.
    Rules of equal length are told apart by name, then verdict. Null URLs and
    those without ``://`` have empty host and path and get ``default``. Long
    URLs are read whole; other columns of ``pages``, whatever their names, are
    not read. Repeated rows are judged each; an empty table gives no rows, and
    without rules every URL gets ``default``. A rule without tokens never fits.
    """
    if not isinstance(rules, DataFrame):
        rules = rule_table(pages.sparkSession, rules)
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    few = rules.limit(literal_rules + 1).count() <= literal_rules
    judged = (fit_in_place if few else fit_by_join)(parts, filed_rules(parts, rules, few))
    is_host = F.coalesce(F.col("fit.is_host"), F.lit(False))
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.when(is_host, F.col("fit.name")).alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.lit(default)).alias("verdict"),
        F.when(~is_host, F.col("fit.name")).alias("word_rule"),
    )


JUDGE_SQL = """
WITH rest AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM rest
), rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), words(w) AS (VALUES ('casino'), ('porn'), ('xxx'), ('phishing'), ('malware'), ('adserver'), ('doubleclick')
), fit AS (
  SELECT host, path, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) u
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path
), word AS (
  SELECT host, path, max_by(w, (length(w), w)) AS word_rule FROM (SELECT DISTINCT host, path FROM parts) u
  JOIN words ON list_contains(regexp_split_to_array(lower(host || path), '[^a-z0-9]+'), w) GROUP BY host, path
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN fit.verdict WHEN word_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN word_rule END AS word_rule
FROM parts LEFT JOIN fit USING (host, path) LEFT JOIN word USING (host, path)
"""
