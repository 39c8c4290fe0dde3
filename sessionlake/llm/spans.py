"""Matches of patterns with their places in the text, by Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A span, places in code points, end exclusive; ``part`` is a group of the match, ``before`` and ``after`` are what surrounds it.
SPAN = "array<struct<kind:string,start:int,end:int,value:string,part:string,before:string,after:string>>"
#: Characters kept before a match (back to the match before at most); matches whose places are summed at once.
BEFORE, BLOCK = 24, 256


def none() -> Column:
    return F.array().cast(SPAN)


def locate(df: DataFrame, out: str, text: str, kind: str, pattern: str, part: int = 0, where: Column | None = None) -> DataFrame:
    """df with ``out``: the leftmost non-overlapping matches of a Java pattern that never matches the empty text.

    ``part`` is the number of the group whose text is kept beside the match. Only texts for which ``where``
    holds are searched. The gaps between the matches come from splitting by the same pattern.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn("__hits", hits if where is None else F.when(where, hits))
    some, n = F.coalesce(F.size("__hits") > 0, F.lit(False)), F.size("__hits")
    df = df.withColumns({
        "__gaps": F.when(some, F.split(text, pattern, -1)),
        "__parts": F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(part)) if part else F.col("__hits")),
    })
    widths = F.zip_with(F.slice("__gaps", F.lit(1), n), "__hits", lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    df = df.withColumn("__widths", F.when(some, widths))
    # Running sums, block by block, as an array that grows by one is copied each time.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice("__widths", b * BLOCK + 1, F.lit(BLOCK)))
    ints = F.array().cast("array<int>")

    def sum_block(a: Column, block: Column) -> Column:
        first = F.struct(a["at"].alias("at"), ints.alias("starts"))
        step = lambda r, x: F.struct((r["at"] + x["g"] + x["h"]).alias("at"), F.concat(r["starts"], F.array(r["at"] + x["g"])).alias("starts"))
        return F.aggregate(block, first, step, lambda r: F.struct(r["at"].alias("at"), F.concat(a["parts"], F.array(r["starts"])).alias("parts")))

    starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("parts")), sum_block, lambda a: F.flatten(a["parts"]))
    df = df.withColumns({
        "__s": F.when(some, starts),
        "__b": F.when(some, F.transform(F.slice("__gaps", F.lit(1), n), lambda g: F.right(g, F.lit(BEFORE)))),
        "__a": F.when(some, F.transform(F.slice("__gaps", F.lit(2), n), lambda g: F.left(g, F.lit(1)))),
    })
    around = F.arrays_zip("__s", "__hits", "__parts", "__b", "__a")
    placed = F.transform(around, lambda x: F.struct(F.lit(kind).alias("kind"), x["__s"].alias("start"), (x["__s"] + F.length(x["__hits"])).alias("end"), x["__hits"].alias("value"), x["__parts"].alias("part"), x["__b"].alias("before"), x["__a"].alias("after")))
    return df.withColumn(out, F.when(some, placed).otherwise(none())).drop("__hits", "__gaps", "__parts", "__widths", "__s", "__b", "__a")


def of_kind(spans: Column | str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def said(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in capitals and angle brackets; overlapping spans are replaced as one, by the first one's kind."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        apart = s["start"] >= a["at"]
        kept = F.concat(a["out"], F.array(F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(apart, kept).otherwise(a["out"]).alias("out"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    joined = F.aggregate(ordered, first, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)
