"""Analytics of text tables: friction lines, references, conventions, scripts (N rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SCRIPTS, letters

FRICTION = "Harness friction:"


def friction_lines(texts: DataFrame) -> DataFrame:
    """N23. Distinct lines that begin with the friction mark, by id."""
    line = F.explode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("line")
    return texts.where(F.col("text").contains(FRICTION)).select("id", line).where(F.ltrim("line").startswith(FRICTION)).select("id", F.trim("line").alias("line")).distinct()


def pull_urls(texts: DataFrame, host: str = "github.com") -> DataFrame:
    """N14. Distinct pull requests that a text's URLs name, as owner/name#number."""
    url = rf"https?://{host.replace('.', '[.]')}/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)/pull/([0-9]+)"
    hits = F.arrays_zip(F.regexp_extract_all("text", F.lit(url), F.lit(1)).alias("repo"), F.regexp_extract_all("text", F.lit(url), F.lit(2)).alias("n"))
    return texts.select("id", F.explode(hits).alias("h")).select("id", F.concat("h.repo", F.lit("#"), "h.n").alias("pr")).distinct()


def push_results(outputs: DataFrame) -> DataFrame:
    """N16. (id, repo, branch) of the pushes in command outputs: each update line belongs to the remote named last before it."""
    lines = outputs.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    remote = F.when(F.col("line").startswith("To "), F.trim(F.substring("line", 4, 1 << 20)))
    branch = F.regexp_extract("line", r"^\s*[*+ ]?\s*(?:\[new branch\]|[0-9a-f]+\.\.\.?[0-9a-f]+)\s+\S+ -> (\S+)", 1)
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumns({"repo": F.last(remote, ignorenulls=True).over(w), "branch": branch})
    return rows.where("branch <> '' AND repo IS NOT NULL").select("id", "repo", "branch").distinct()


def conventions(docs: DataFrame, lexicon: Sequence[tuple[str, str, str]], hedges: str = r"(?i)\b(?:maybe|consider|might)\b") -> DataFrame:
    """N24. Per document and convention: present, unknown (only mentioned), or absent.

    lexicon: (convention, kind, pattern) with kind directive, topic or denial. Lines of code blocks and hedged lines don't count; a
    denied line doesn't count for its convention. A line is tested against all patterns in one pass; nothing is joined.
    """
    line = docs.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    fence = F.sum(F.col("line").startswith("```").cast("int")).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    plain = line.withColumn("__f", fence).where(F.col("__f") % 2 == 0).where(~F.col("line").startswith("```") & ~F.col("line").rlike(hedges))
    names = sorted({c for c, _, _ in lexicon})

    def says(c: str, kind: str):
        patterns = [p for n, k, p in lexicon if (n, k) == (c, kind)]
        return F.col("line").rlike("|".join(patterns)) if patterns else F.lit(False)

    rows = plain.groupBy("id").agg(*[F.max(F.when(says(c, "denial"), 0).when(says(c, "directive"), 2).when(says(c, "topic"), 1).otherwise(0)).alias(c) for c in names])
    all_ids = docs.select("id").distinct().join(rows, "id", "left")
    return all_ids.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("convention"), F.coalesce(F.col(c), F.lit(0)).alias("n")) for c in names])).alias("x")).select("id", "x.convention", F.when(F.col("x.n") == 2, "present").when(F.col("x.n") == 1, "unknown").otherwise("absent").alias("status"))


def scripts(docs: DataFrame, covered: Sequence[str] = ("Latin", "Hangul")) -> DataFrame:
    """N25. Letters per script, and whether more than half lie in scripts that aren't covered."""
    every = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    out = docs.select("id", every.alias("letters"), *[letters(F.col("text"), s).alias(s.lower()) for s in SCRIPTS])
    known = sum((F.col(s.lower()) for s in covered), F.lit(0))
    return out.withColumn("unsupported", F.coalesce(2 * (F.col("letters") - known) > F.col("letters"), F.lit(False)))
