"""Projects of paths, sessions and usage events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import glob_regex, within
from .timing import MINUTE

TOKENS = ("new_input", "cache_write", "cache_read", "output", "reasoning_output")
EVIDENCE = ("cwd", "tool_path", "previous_event", "unassigned")
LINK = "struct<bucket:string,project_key:string,rule:string>"


@dataclass(frozen=True)
class Rule:
    """A project's name with its globs over origins and paths."""

    name: str
    origins: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()


def rule_names(rules: Sequence[Rule], value: Column, kind: str) -> Column:
    """Sorted names of the rules one of whose globs matches."""
    hits = [F.when(value.rlike("|".join(map(glob_regex, globs))), r.name) for r in rules if (globs := getattr(r, kind))]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))) if hits else F.array().cast("array<string>")


def link(path: Column, origin: Column, rules: Sequence[Rule]) -> Column:
    """A1. struct(bucket, project_key, rule) of a path: origin rules first, then path rules; several names are ambiguous, none is ``other``.

    Without any rule every path is its own project. Null paths are unassigned.
    """
    by_origin = F.coalesce(rule_names(rules, origin, "origins"), F.array().cast("array<string>"))
    names = F.when(F.size(by_origin) > 0, by_origin).otherwise(F.coalesce(rule_names(rules, path, "paths"), F.array().cast("array<string>")))

    def of(bucket: str, key: Column, rule: Column) -> Column:
        return F.struct(F.lit(bucket).alias("bucket"), key.cast("string").alias("project_key"), rule.cast("string").alias("rule"))

    null = F.lit(None)
    if not rules:
        return F.when(path.isNull(), of("unassigned", null, null)).otherwise(of("project", path, null))
    return (
        F.when(path.isNull(), of("unassigned", null, null))
        .when(F.size(names) > 1, of("unassigned", null, F.lit("ambiguous_rules")))
        .when(F.size(names) == 1, of("project", names[0], names[0]))
        .otherwise(of("other", null, null))
    )


def path_links(paths: DataFrame, rules: Sequence[Rule], checkouts: DataFrame | None = None) -> DataFrame:
    """A1, A2. Distinct paths with their link. ``checkouts`` (root, origin): a path below a root takes the longest root and its origin as evidence.

    The roots are joined by the path's ancestors, an equi join, however many there are.
    """
    distinct = paths.select("path").where("path is not null").distinct()
    if checkouts is None:
        return distinct.select("path", F.lit(None).cast("string").alias("root"), link(F.col("path"), F.lit(None).cast("string"), rules).alias("link"))
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = distinct.withColumn("root", F.explode(ancestors)).join(checkouts, "root")
    best = up.groupBy("path").agg(F.max_by(F.struct("root", "origin"), F.length("root")).alias("c"))
    found = distinct.join(best, "path", "left")
    return found.select("path", F.col("c.root").alias("root"), link(F.coalesce("c.root", "path"), F.col("c.origin"), rules).alias("link"))


def in_scope(path: Column, origin: Column, root: str, own_origin: str | None) -> Column:
    """A3. Whether a path lies in a repository's checkout, or its origin is the repository's."""
    inside = (path == root) | path.startswith(root.rstrip("/") + "/")
    return F.coalesce(inside, F.lit(False)) | (F.coalesce(origin == own_origin, F.lit(False)) if own_origin else F.lit(False))


def session_links(session_paths: DataFrame, links: DataFrame) -> DataFrame:
    """A4. The one project over all of a session's paths, else unassigned."""
    found = session_paths.join(links.select("path", "link"), "path").groupBy("session_id").agg(F.min("link").alias("a"), F.max("link").alias("b"))
    none = F.struct(F.lit("unassigned").alias("bucket"), F.lit(None).cast("string").alias("project_key"), F.lit(None).cast("string").alias("rule"))
    return found.select("session_id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(none).alias("link"))


def event_links(events: DataFrame, until: int, idle_minutes: int) -> DataFrame:
    """A6. Usage events before ``until`` with ``link`` and ``evidence``.

    events: session_id, agent, us, ord, kind (context, tool, usage), reset (contexts), and links of what the event states:
    cwd_link, and path_low and path_high, the least and greatest link of its paths (each null if it states none).
    Contexts that state no directory have a null cwd_link, and those clear it.

    A chain of events without evidence of their own carries its head's link, as gaps and islands: an island starts where an
    event has a link of its own, the idle limit has passed, or an open-format context has been cleared.
    """
    order = ("us", "ord")
    w = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    is_context, is_tool, is_open = F.col("kind") == "context", F.col("kind") == "tool", F.col("agent") == "open"
    clear = is_context & is_open & F.col("cwd_link").isNull()
    rows = events.where(F.col("us") < until).withColumns({
        "__turn": F.sum(F.when(is_context & F.col("reset"), 1).otherwise(0)).over(w),
        "__context": F.last(F.when(is_context, F.struct("cwd_link")), ignorenulls=True).over(w)["cwd_link"],
        "__clears": F.sum(F.when(clear, 1).otherwise(0)).over(w),
    })
    t = Window.partitionBy("session_id", "__turn").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "__command": F.last(F.when(is_tool, F.col("cwd_link")), ignorenulls=True).over(t),
        "__low": F.min(F.when(is_tool, F.col("path_low"))).over(t),
        "__high": F.max(F.when(is_tool, F.col("path_high"))).over(t),
    })
    usage = rows.where("kind = 'usage'")
    cwd = F.when(F.col("agent") == "codex", F.coalesce("__command", "__context")).when(is_open, F.coalesce("cwd_link", "__context")).otherwise(F.col("cwd_link"))
    low, high = F.least("__low", "path_low"), F.greatest("__high", "path_high")
    unassigned = F.struct(F.lit("unassigned").alias("bucket"), F.lit(None).cast("string").alias("project_key"), F.lit(None).cast("string").alias("rule"))
    usage = usage.withColumns({
        "__own": F.when(cwd.isNotNull(), cwd).when(low.isNotNull(), F.when(low == high, low).otherwise(unassigned)),
        "__how": F.when(cwd.isNotNull(), "cwd").when(low.isNotNull(), "tool_path"),
    })
    s = Window.partitionBy("session_id").orderBy(*order)
    gap = F.col("us") - F.lag("us").over(s)
    head = F.col("__own").isNotNull() | F.coalesce(gap >= idle_minutes * MINUTE, F.lit(True)) | (F.col("__clears") != F.lag("__clears").over(s))
    usage = usage.withColumn("__head", head).withColumn("__island", F.sum(F.col("__head").cast("int")).over(s.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first("__own").over(Window.partitionBy("session_id", "__island").orderBy(*order))
    usage = usage.withColumn("__first", first)
    carried = ~F.col("__head") & F.col("__first").isNotNull() & (F.col("__first.bucket") != "unassigned")
    out = usage.withColumns({
        "link": F.when(F.col("__own").isNotNull(), F.col("__own")).when(carried, F.col("__first")).otherwise(unassigned),
        "evidence": F.when(F.col("__own").isNotNull(), F.col("__how")).when(carried, "previous_event").otherwise("unassigned"),
    })
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def total(prefix: str = "") -> Column:
    """Tokens of a row: all kinds but reasoning, unknown ones as 0."""
    out = F.lit(0)
    for c in TOKENS[:-1]:
        out = out + F.coalesce(F.col(prefix + c), F.lit(0))
    return out


def allocations(linked: DataFrame, since: int, until: int, kinds: Sequence[str] = TOKENS) -> DataFrame:
    """A7, A11. Per session and link: events, tokens by kind, events and tokens by evidence, the share that was carried forward,
    and the complete total (null unless every event reports all four kinds)."""
    inside = linked.where(within(F.col("us"), since, until)).withColumn("__t", total())
    known = F.lit(True)
    for c in TOKENS[:-1]:
        known = known & F.col(c).isNotNull()
    out = inside.groupBy("session_id", "link.bucket", "link.project_key", "link.rule").agg(
        F.count("*").alias("events"), F.sum("__t").alias("total"), *[F.sum(c).alias(c) for c in kinds],
        *[F.count_if(F.col("evidence") == e).alias(f"events_{e}") for e in EVIDENCE],
        *[F.coalesce(F.sum(F.when(F.col("evidence") == e, F.col("__t"))), F.lit(0)).alias(f"tokens_{e}") for e in EVIDENCE],
        F.when(F.bool_and(known), F.sum("__t")).alias("complete_total"),
    )
    return out.withColumn("fallback_share", F.when(F.col("total") > 0, F.col("tokens_previous_event") / F.col("total")).otherwise(0.0))


def spend(allocated: DataFrame, kinds: Sequence[str] = TOKENS) -> DataFrame:
    """A8. Tokens per project, with rows for ``unassigned`` and ``other`` even if nothing fell there, and shares of all tokens."""
    spark = allocated.sparkSession
    by = allocated.groupBy("bucket", "project_key", "rule").agg(F.sum("events").alias("events"), F.sum("total").alias("total"), *[F.sum(c).alias(c) for c in kinds])
    fixed = spark.range(1).select(F.explode(F.array(F.lit("unassigned"), F.lit("other"))).alias("bucket"))
    missing = fixed.join(by, "bucket", "left_anti").withColumns({"events": F.lit(0).cast("long"), "total": F.lit(0).cast("long")})
    rows = by.unionByName(missing, allowMissingColumns=True)
    every = by.agg(F.sum("total").alias("__all"))
    return rows.crossJoin(F.broadcast(every)).withColumn("share", F.when(F.col("__all") > 0, F.col("total") / F.col("__all"))).drop("__all")


def coverage_shares(allocated: DataFrame) -> DataFrame:
    """A9. Shares of all tokens that are unassigned, and that rest on each kind of evidence. One row."""
    every = F.sum("total")
    part = lambda c: F.when(every > 0, F.coalesce(c, F.lit(0)) / every)
    return allocated.agg(part(F.sum(F.when(F.col("bucket") == "unassigned", F.col("total")))).alias("unassigned_bucket_share"), *[part(F.sum(f"tokens_{e}")).alias(f"{e}_share") for e in EVIDENCE])


def select_project(allocated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A10. Sessions' tokens from the allocations to the given projects only."""
    kept = allocated.where((F.col("bucket") == "project") & F.col("project_key").isin(*keys))
    return kept.groupBy("session_id").agg(F.sum("events").alias("events"), F.sum("total").alias("total"), *[F.sum(c).alias(c) for c in TOKENS])
