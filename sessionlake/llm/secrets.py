"""Operator 1. Secret scan: fixed formats, and a battery of randomness tests over long tokens.

All in Spark's own functions; rows never meet, but for a histogram of p-values.

Every run of 16 or more token characters that holds a letter is a candidate (runs of digits alone are not: numbers of
orders, cards and accounts look random too). Its encoding is inferred from its characters (hex, letters of one case,
base 32, base 36, base 64), and its symbols become numbers of that alphabet. Tests:

* chi-squared against a uniform alphabet, turned round: the null hypothesis is text
  whose symbols are as uneven as written language (effect size by encoding), under which
  the statistic has a non-central distribution. The p-value is the chance of a value
  this even. It shrinks with length by itself: short tokens can't prove much.
* runs above and below the alphabet's middle, and lag-1 serial correlation, both
  two-sided, and chi-squared for being more even than chance: a token that fails one of
  them at ``alpha`` is patterned (abcdef..., 0000ffff...).

False-discovery control (Benjamini and Hochberg) runs within each band of lengths,
over all candidates of the table, on a histogram of p-values of fixed size.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .spans import locate, none, overlap

# Fixed formats, as the result's contract states them.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}+"
#: Inferred encodings in the order they are tried: name, pattern, alphabet, effect size (k * sum of squared symbol shares - 1 in written text).
ENCODINGS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 1.2),
    ("letters", "^(?:[a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz", 0.7),
    ("base32", "^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567", 1.2),
    ("base36", "^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 1.3),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 2.2),
)
#: Lower ends of the length bands.
BANDS = (16, 24, 32, 48, 64, 128)
BINS_PER_DECADE, DECADES = 20, 16


def normal_tail(z: Column) -> Column:
    """P(Z > z), to 1e-7 (the five-term rational form of Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    p = F.exp(-a * a / 2) / sqrt(6.283185307179586) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, p).otherwise(1 - p)


def tested(token: Column, alpha: float) -> Column:
    """struct(encoding, n, p) of a token: how likely written text is to look this even; 1 if a pattern shows."""

    def by_encoding(name: str, alphabet: str, effect: float) -> Column:
        k = float(len(alphabet))
        body = F.regexp_replace(token if name == "base64" else F.lower(token), "=+$", "")
        chars = F.filter(F.split(body, ""), lambda c: c != "")
        n = F.length(body).cast("double")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow((F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double"), F.lit(2)))
        chi = k / n * squares - n
        uneven = n * effect
        even = normal_tail((k - 1 + uneven - chi) / F.sqrt(2 * (k - 1) + 4 * uneven))
        middle, spread = (k - 1) / 2, (k * k - 1) / 12
        start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("along"))

        def step(a: Column, c: Column) -> Column:
            v = F.instr(F.lit(alphabet), c) - 1 - middle
            turn = F.when(a["last"].isNull() | ((a["last"] > 0) == (v > 0)), 0.0).otherwise(1.0)
            return F.struct(v.alias("last"), (a["runs"] + turn).alias("runs"), (a["along"] + F.coalesce(a["last"] * v, F.lit(0.0))).alias("along"))

        walk = F.aggregate(chars, start, step, lambda a: F.greatest(F.abs(a["runs"] - (n - 1) / 2) / F.sqrt((n - 1) / 4), F.abs(a["along"]) / spread / F.sqrt(n - 1)))
        too_even = normal_tail((k - 1 - chi) / sqrt(2 * (k - 1)))
        return F.struct(F.lit(name).alias("encoding"), n.cast("int").alias("n"), F.when((2 * normal_tail(walk) < alpha) | (too_even < alpha), 1.0).otherwise(even).alias("p"))

    out = by_encoding(*[ENCODINGS[-1][i] for i in (0, 2, 3)])
    for name, pattern, alphabet, effect in reversed(ENCODINGS[:-1]):
        out = F.when(token.rlike(pattern), by_encoding(name, alphabet, effect)).otherwise(out)
    return out


def band(n: Column) -> Column:
    out = F.lit(BANDS[0])
    for b in BANDS[1:]:
        out = F.when(n >= b, b).otherwise(out)
    return out


def p_bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(10.0**-DECADES))) * BINS_PER_DECADE), F.lit(DECADES * BINS_PER_DECADE)).cast("int")


def base(docs: DataFrame, text: str) -> DataFrame:
    """docs with ``__base``: the fixed formats' spans, by start, then kind as listed."""
    df = locate(docs, "__as", text, "assign", ASSIGN, 1)
    df = locate(df, "__k", text, "access", ACCESS, where=F.col(text).contains("AKIA"))
    df = locate(df, "__h", text, "hex", HEX)
    every = F.concat(F.filter("__as", lambda s: F.length(s["part"]) >= ASSIGN_LEAST), "__k", "__h")
    return df.withColumn("__base", by_start(every)).drop("__as", "__k", "__h")


def by_start(spans: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s.alias("s")))
    return F.when(F.size(spans) > 1, F.transform(F.array_sort(keyed), lambda x: x["s"])).otherwise(spans)


def scan(docs: DataFrame, text: str = "text", alpha: float = 0.005, rate: float = 0.05, keep_text: bool = True) -> DataFrame:
    """docs with ``base_spans`` and ``spans`` (arrays of kind, start, end, value, part, before, after; they replace columns of these names);
    without the text unless keep_text.

    spans are the base ones and those of kind ``random``: candidates that the battery and the false-discovery control
    (``rate``) select and that overlap no base span. Candidates of equal p-value bins are selected together or not at all. Texts are searched once, whole, in
    time linear in their length but for candidates times base spans; what was found is stored (with the text only if that is kept) and read again when the
    histogram is known. A null text counts as empty. Equal texts get equal spans. Any column names of docs may be used. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in ("base_spans", "spans") and (keep_text or c != text)]
    slim = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__t"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    df = locate(base(slim, "__t"), "__c", "__t", "random", TOKEN)
    free = F.filter("__c", lambda c: ~F.exists("__base", lambda b: overlap(b, c)))
    df = df.select("row", F.col("__base").alias("base"), F.when(F.size("__c") > 0, free).otherwise(none()).alias("cand"))
    df = stored(df.withColumn("tests", F.transform("cand", lambda c: tested(c["value"], alpha))))
    seen = df.where(F.size("tests") > 0).select(F.explode("tests").alias("p")).groupBy(band(F.col("p.n")).alias("band"), p_bin(F.col("p.p")).alias("bin")).count()
    down = Window.partitionBy("band").orderBy(F.desc("bin"))
    edge = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)  # the largest p of a bin
    passing = edge <= rate * F.sum("count").over(down) / F.sum("count").over(Window.partitionBy("band"))
    limits = {r["band"]: r["bin"] for r in seen.withColumn("ok", passing).where("ok").groupBy("band").agg(F.min("bin").alias("bin")).collect()}  # a row per band
    spans = F.col("base")
    if limits:
        least = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
        both = F.zip_with("cand", "tests", lambda c, p: F.struct(c.alias("c"), p.alias("p")))
        picked = F.transform(F.filter(both, lambda x: F.coalesce(p_bin(x["p"]["p"]) >= least[band(x["p"]["n"])], F.lit(False))), lambda x: x["c"])
        spans = F.when(F.size("cand") > 0, by_start(F.concat("base", picked))).otherwise(F.col("base"))
    return df.select(*[F.col("row")[c].alias(c) for c in kept], F.col("base").alias("base_spans"), spans.alias("spans"))
