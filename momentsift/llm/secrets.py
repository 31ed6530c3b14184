r"""Secret scans: fixed patterns plus a battery of randomness tests.

Base kinds are decided by their patterns. Beyond them, every run of 20 or more
key characters is read in the smallest encoding it fits (hex, base32, base36,
base64) and tested twice:

* Against names and words, whose characters follow each other: how often the
  run changes between lower case, upper case and digits, and how many of its
  letters are rare in the corpus (or, for a hex run, lie in a to f). Both are
  exact binomial tests, which also hold for short runs, combined by Fisher's
  method. Rejections are the discoveries; a Benjamini-Hochberg step within each
  length class controls their false rate.
* Against random text in its encoding: chi-squared uniformity over the
  alphabet, runs above and below its middle, and lag-1 serial correlation. A
  discovery that this rejects is structured, and no secret.

All of it is DataFrame expressions: positions come from the lengths of what
``split`` and ``regexp_extract_all`` return for the same pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # the same spans as [0-9a-f]+ of 24 or more: a run is matched from its start or not at all
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Names for things rather than keys to them.
UUID = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
KINDS = ("assign", "access", "hex", "random")

#: Changes of character class for each character of a name, and p below which the battery calls a run structured.
NAME_CHANGES, STRUCTURED = 0.22, 0.001
#: Letters that are rare in words, and the letters of hex; their shares are counted over all texts, from these shares on of so many letters.
RARE, HEX_LETTERS, PRIOR = "jkqvwxz", "abcdef", (8, 35, 100)
#: False discovery rate, steps of -ln p in the histogram of p-values, largest -ln p told apart.
RATE, STEP, MOST = 0.05, 0.1, 40.0
#: Length classes: 20-27, 28-39, 40-63, 64 and more characters.
CLASS_STARTS = (20, 28, 40, 64)

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encoding -> (pattern a token must fit, alphabet in order). Both base64 forms share places 62 and 63.
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    "HEX": ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    "base32": ("^[A-Z2-7]+$", _UPPER + "234567"),
    "base32_lower": ("^[a-z2-7]+$", _LOWER + "234567"),
    "base36": ("^[0-9a-z]+$", _DIGITS + _LOWER),
    "BASE36": ("^[0-9A-Z]+$", _DIGITS + _UPPER),
    "base64": ("^[A-Za-z0-9+/_-]+$", _UPPER + _LOWER + _DIGITS + "+/"),
}


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans_of(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<s,e,v>> of all matches: start and end in code points, and the text of ``group``."""
    lit = F.lit(pattern)
    hits = F.regexp_extract_all(text, lit, F.lit(0))
    values = hits if group is None else F.regexp_extract_all(text, lit, F.lit(group))
    zipped = let(
        F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps")),
        lambda x: F.arrays_zip(
            F.transform(x["hits"], lambda h: F.length(h)).alias("n"),
            F.transform(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), lambda g: F.length(g)).alias("gap"),
            (x["hits"] if group is None else values).alias("v"),
        ),
    )
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    walk = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.array_append(
                acc["out"],
                F.struct((acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + x["n"]).alias("e"), x["v"].alias("v")),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), walk).otherwise(none)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution (rational approximation, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _encoding(token: Column, value) -> Column:
    """``value(alphabet)`` of the smallest encoding that the token fits."""
    out = F.lit(value(ENCODINGS["base64"][1]))
    for name in ("BASE36", "base36", "base32_lower", "base32", "HEX", "hex"):
        pattern, alphabet = ENCODINGS[name]
        out = F.when(token.rlike(pattern), F.lit(value(alphabet))).otherwise(out)
    return out


def with_structure_p(spans: Column) -> Column:
    """Each span (s, e, v) as (s, e, n, p). p is the smallest of the three p-values, times three: small for structured text.

    Built in steps, each over the array that the step before made, so nothing
    is computed twice.
    """
    step1 = F.transform(
        spans,
        lambda x: F.struct(
            x["s"], x["e"], F.length(x["v"]).cast("double").alias("n"), F.translate(x["v"], "_-", "/+").alias("t"),
            _encoding(x["v"], lambda a: a).alias("alphabet"), _encoding(x["v"], lambda a: "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2)).alias("half"),
        ),
    )
    step2 = F.transform(
        step1,
        lambda x: F.struct(
            x["s"], x["e"], x["n"], F.length(x["alphabet"]).cast("double").alias("k"),
            F.transform(F.split(x["alphabet"], ""), lambda c: F.length(x["t"]) - F.length(F.replace(x["t"], c, F.lit("")))).alias("counts"),
            F.call_function("translate", x["t"], x["alphabet"], x["half"]).alias("bits"),
            F.transform(F.split(x["t"], ""), lambda c: F.position(c, x["alphabet"]) - (F.length(x["alphabet"]) + 1) / 2.0).alias("v"),
        ),
    )
    fewer = lambda x, w: (x["n"] - F.length(F.replace(x["bits"], F.lit(w), F.lit("")))) / len(w)
    step3 = F.transform(
        step2,
        lambda x: F.struct(
            x["s"], x["e"], x["n"], (x["k"] - 1).alias("d"),
            (F.aggregate(x["counts"], F.lit(0.0), lambda a, c: a + c.cast("double") * c) * x["k"] / x["n"] - x["n"]).alias("chi"),
            fewer(x, "1").alias("ones"), (fewer(x, "01") + fewer(x, "10") + 1).alias("runs"),
            F.aggregate(F.zip_with(F.slice(x["v"], F.lit(1), F.size(x["v"]) - 1), F.slice(x["v"], F.lit(2), F.size(x["v"]) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c).alias("product"),
            F.aggregate(x["v"], F.lit(0.0), lambda a, c: a + c * c).alias("energy"),
        ),
    )
    step4 = F.transform(
        step3, lambda x: F.struct(x["s"], x["e"], x["n"], x["d"], x["chi"], x["runs"], (2 * x["ones"] * (x["n"] - x["ones"]) / x["n"] + 1).alias("mean"), x["product"], x["energy"])
    )
    # Wilson-Hilferty: the cube root of chi-squared over its freedom is nearly normal.
    step5 = F.transform(
        step4,
        lambda x: F.struct(
            x["s"], x["e"], x["n"],
            ((F.cbrt(F.greatest(x["chi"], F.lit(0.0)) / x["d"]) - (1 - 2 / (9 * x["d"]))) / F.sqrt(2 / (9 * x["d"]))).alias("z_chi"),
            F.when(x["mean"] > 2, (x["runs"] - x["mean"]) / F.sqrt((x["mean"] - 1) * (x["mean"] - 2) / (x["n"] - 1))).otherwise(F.lit(9.0)).alias("z_runs"),
            F.when(x["energy"] > 0, x["product"] / x["energy"] * F.sqrt(x["n"])).otherwise(F.lit(9.0)).alias("z_serial"),
        ),
    )
    least = lambda x: F.least(upper_tail(x["z_chi"]), 2 * upper_tail(F.abs(x["z_runs"])), 2 * upper_tail(F.abs(x["z_serial"])))
    return F.transform(step5, lambda x: F.struct(x["s"], x["e"], x["n"], F.least(F.lit(1.0), 3 * least(x)).alias("p")))


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, start in enumerate(CLASS_STARTS):
        out = F.when(n >= start, F.lit(i)).otherwise(out)
    return out


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def with_name_counts(spans: Column) -> Column:
    """Each span (s, e, v) as (pairs, changes, letters, rare, hex): what tells a name from a random run."""
    step1 = F.transform(
        spans,
        lambda x: F.struct(
            F.lower(x["v"]).alias("low"), x["v"].rlike("^[0-9a-f+/_-]+$|^[0-9A-F+/_-]+$").alias("hex"),
            F.translate(without(x["v"], "+/_-"), _LOWER + _UPPER + _DIGITS, "l" * 26 + "U" * 26 + "0" * 10).alias("c"),
        ),
    )
    # From upper to lower case there is no change: a capital starts a word.
    fewer = lambda x, w: (F.length(x["c"]) - F.length(F.replace(x["c"], F.lit(w), F.lit("")))) / 2
    return F.transform(
        step1,
        lambda x: F.struct(
            F.greatest(F.length(x["c"]) - 1, F.lit(0)).cast("double").alias("pairs"), sum(fewer(x, w) for w in ("lU", "0U", "U0", "l0", "0l")).alias("changes"),
            (F.length(x["low"]) - F.length(without(x["low"], _LOWER))).cast("double").alias("letters"),
            (F.length(x["low"]) - F.length(without(x["low"], RARE))).cast("double").alias("rare"), x["hex"],
        ),
    )


def binomial_tail(k: Column, n: Column, q: float) -> Column:
    """P(X >= k) for n trials of chance q; beyond 400 trials Chernoff's bound on it."""
    odds = q / (1 - q)
    below = F.aggregate(
        F.sequence(F.lit(0), k.cast("int") - 1),
        F.struct(F.exp(n * F.ln(F.lit(1 - q))).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * (n - i) / (i + 1) * odds).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"],
    )
    share = k / n
    other = F.when(share < 1, (1 - share) * F.ln((1 - share) / (1 - q))).otherwise(0.0)
    bound = F.exp(-n * (share * F.ln(share / q) + other))
    tail = F.when(n <= 400, F.greatest(1 - below, F.lit(1e-15))).otherwise(F.when(share > q, bound).otherwise(1.0))
    return F.when(k < 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def name_p(x: Column, rare: float, hex_letters: float) -> Column:
    """How likely a name is to look so random, by Fisher's method; ``x`` has the counts, the shares are those of the corpus."""
    letters = F.least(binomial_tail(x["rare"], x["letters"], rare), F.when(x["hex"], F.pow(F.lit(hex_letters), x["letters"])).otherwise(F.lit(1.0)))
    changes = binomial_tail(x["changes"], x["pairs"], NAME_CHANGES)
    both = F.greatest(changes, F.lit(1e-100)) * F.greatest(F.least(F.lit(1.0), 2 * letters), F.lit(1e-100))
    return let(both, lambda p: p * (1 - F.ln(p)))


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    low = F.lower("text")
    rows = rows.select(
        "id",
        F.filter(spans_of(F.col("text"), ASSIGN, 2), lambda x: F.length(x["v"]) >= 6).alias("assign"),
        F.filter(spans_of(F.col("text"), ACCESS), lambda x: F.length(x["v"]) >= 20).alias("access"),
        spans_of(F.col("text"), HEX).alias("hex"),
        F.filter(spans_of(F.col("text"), CANDIDATE), lambda x: ~x["v"].rlike(UUID)).alias("candidate"),
        *[(F.length("text") - F.length(without(low, c))).cast("long").alias(k) for k, c in (("n_letters", _LOWER), ("n_rare", RARE), ("n_af", HEX_LETTERS))],
    )
    plain = lambda c: F.transform(c, lambda x: F.struct(x["s"], x["e"]))
    tested = F.zip_with(
        with_structure_p(F.col("candidate")),
        with_name_counts(F.col("candidate")),
        lambda x, y: F.struct(x["s"], x["e"], length_class(x["n"]).alias("class"), (x["p"] < STRUCTURED).alias("structured"), y["pairs"], y["changes"], y["letters"], y["rare"], y["hex"]),
    )
    return rows.select("id", plain("assign").alias("assign"), plain("access").alias("access"), plain("hex").alias("hex"), tested.alias("tested"), "n_letters", "n_rare", "n_af")


def shares(found: DataFrame) -> tuple[float, float]:
    """Of all letters of all texts: the share of rare ones, and of those of hex."""
    n = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rare", "n_af", "n_letters")]).first()
    return (n["n_rare"] + PRIOR[0]) / (n["n_letters"] + PRIOR[2]), (n["n_af"] + PRIOR[1]) / (n["n_letters"] + PRIOR[2])


def with_bins(found: DataFrame) -> DataFrame:
    """``found`` with tested as (s, e, class, structured, bin of -ln p)."""
    rare, hex_letters = shares(found)
    bin_ = lambda p: F.floor(F.least(F.lit(MOST), -F.ln(p)) / STEP).cast("int")
    return found.withColumn("tested", F.transform("tested", lambda x: F.struct(x["s"], x["e"], x["class"], x["structured"], bin_(name_p(x, rare, hex_letters)).alias("bin"))))


def rejected_from(tested: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Length class -> smallest bin of -ln p that Benjamini-Hochberg rejects. The table has class and bin; few rows leave it."""
    counts = tested.groupBy("class", "bin").agg(F.count("*").alias("n"))  # at most 4 x 401 rows
    by_class = Window.partitionBy("class")
    ranked = counts.withColumn("m", F.sum("n").over(by_class)).withColumn("rank", F.sum("n").over(by_class.orderBy(F.desc("bin"))))
    passing = ranked.where(F.exp(-F.col("bin") * STEP) <= rate * F.col("rank") / F.col("m"))
    return {r["class"]: r["bin"] for r in passing.groupBy("class").agg(F.min("bin").alias("bin")).collect()}


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per row: ``id_col``, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Null and empty texts have no spans. Texts of any length are read whole,
    repeated rows each; spans that start together are listed by kind. Columns
    other than the two are ignored, whatever their names; an empty table gives
    no rows.
    """
    found = with_bins(written(_base(docs, id_col, text_col), "secrets"))
    limits = rejected_from(found.select(F.explode("tested").alias("t")).select("t.class", "t.bin"), rate)
    rejects = lambda x: F.coalesce(*[F.when(x["class"] == c, x["bin"] >= b) for c, b in limits.items()], F.lit(False))
    base_arrays = {k: F.col(k) for k in ("assign", "access", "hex")}
    clear = lambda x: ~F.exists(F.concat(*base_arrays.values()), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    random = F.filter("tested", lambda x: rejects(x) & ~x["structured"] & clear(x))
    tag = lambda i, c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))
    found = found.withColumn("random", F.transform(random, lambda x: F.struct(x["s"], x["e"])))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    listed = lambda *cs: F.array_join(
        F.transform(
            F.array_sort(F.concat(*[tag(KINDS.index(c), F.col(c)) for c in cs])),
            lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string")),
        ),
        ",",
    )
    return found.select(
        F.col("id").alias(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(*KINDS[:3]), 256).alias("base_sha256"),
        listed(*KINDS).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
