"""Folding events into session tables: deduplication, snapshots, counters, pairs and as-of facts.

Conventions of all operators: instants are BIGINT microseconds in a column ``us``; ``ord`` breaks ties of equal
instants; ``session_id`` names a session. Windows are half-open. Unknown is null, and conflicting evidence is unknown.
Each operator shuffles by session (or by the id it deduplicates) once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("session_id",)


def _ordered(keys: Sequence[str], *order: str | Column) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def first_of_each(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(_ordered(keys, *order))).where("__n = 1").drop("__n")


def exact_dedup(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (*KEYS, "digest")) -> DataFrame:
    """F1. One row per session and digest; the first one wins."""
    return first_of_each(df, keys, *order)


def duplicate_counts(df: DataFrame, keys: Sequence[str] = (*KEYS, "digest")) -> DataFrame:
    """F1. Duplicates that exact_dedup drops, by session."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.groupBy("session_id").agg(F.sum(F.col("n") - 1).alias("duplicates"))


def global_dedup(df: DataFrame, order: Sequence[str], event_id: str = "event_id") -> DataFrame:
    """F2. Rows whose event id has one digest, once; ids with several digests lose all their rows."""
    one = df.groupBy(event_id).agg(F.min("digest").alias("__a"), F.max("digest").alias("__b")).where("__a = __b").select(event_id)
    return first_of_each(df.join(one, event_id, "left_semi"), [event_id], *order)


def tainted_sessions(df: DataFrame, event_id: str = "event_id") -> DataFrame:
    """F2. Sessions that had a row of an id with conflicting digests."""
    bad = df.groupBy(event_id).agg(F.min("digest").alias("__a"), F.max("digest").alias("__b")).where("__a <> __b").select(event_id)
    return df.join(bad, event_id, "left_semi").select("session_id").distinct()


def maximal_snapshot(df: DataFrame, keys: Sequence[str] = (*KEYS, "message"), output: str = "output") -> DataFrame:
    """F3. Of each message the row with the greatest output, then the latest time, then the earliest record."""
    return first_of_each(df, keys, F.desc_nulls_last(output), F.desc_nulls_last("us"), "ord")


def counter_deltas(df: DataFrame, counters: Sequence[str], fresh: tuple[str, str] | None = None) -> DataFrame:
    """F4. Increments of cumulative counters. A drop of any counter is a reset to zero; the first baseline is zero.

    ``fresh`` names (total, part): the delta of part is taken off the delta of total. A row whose fresh delta is negative is
    ``invalid`` but serves as the next baseline. Rows without any increment are dropped.
    """
    w = _ordered(KEYS, "us", "ord")
    before = {c: F.coalesce(F.lag(c).over(w), F.lit(0)) for c in counters}
    reset = F.lit(False)
    for c in counters:
        reset = reset | (F.col(c) < before[c])
    out = df.withColumns({f"__{c}": b for c, b in before.items()} | {"reset": reset})
    out = out.withColumns({f"d_{c}": F.col(c) - F.when(F.col("reset"), 0).otherwise(F.col(f"__{c}")) for c in counters})
    if fresh:
        out = out.withColumn("d_fresh", F.col(f"d_{fresh[0]}") - F.col(f"d_{fresh[1]}"))
    some = F.lit(False)
    for c in counters:
        some = some | (F.col(f"d_{c}") != 0)
    return out.withColumn("invalid", (F.col("d_fresh") < 0) if fresh else F.lit(False)).where(some).drop(*[f"__{c}" for c in counters])


def drop_repeated(df: DataFrame, vector: Sequence[str]) -> DataFrame:
    """F5, L4. Rows whose vector differs from the row before; a vector with a null equals nothing."""
    w = _ordered(KEYS, "us", "ord")
    same = F.lit(True)
    for c in vector:
        same = same & (F.col(c) == F.lag(c).over(w))
    return df.withColumn("__same", F.coalesce(same, F.lit(False))).where("not __same").drop("__same")


def distinct_counts(df: DataFrame, since: int, until: int, kind: str = "kind", event_id: str = "id") -> DataFrame:
    """F6. Distinct ids per session and kind inside the window."""
    return df.where((F.col("us") >= since) & (F.col("us") < until)).groupBy("session_id", kind).agg(F.count_distinct(event_id).alias("n"))


def pair_intervals(starts: DataFrame, ends: DataFrame, keys: Sequence[str] = (*KEYS, "id")) -> DataFrame:
    """F7. Per key the earliest start and the latest end; ``valid`` if both are there in that order."""
    both = starts.select(*keys, F.col("us").alias("s"), F.lit(None).cast("long").alias("e")).unionByName(ends.select(*keys, F.lit(None).cast("long").alias("s"), F.col("us").alias("e")))
    pairs = both.groupBy(*keys).agg(F.min("s").alias("start_us"), F.max("e").alias("end_us"))
    return pairs.withColumn("valid", F.coalesce(F.col("end_us") >= F.col("start_us"), F.lit(False)))


def unpaired(pairs: DataFrame, since: int, until: int) -> DataFrame:
    """F7. Starts and ends inside the window that have no partner, by session."""
    inside = lambda c: (F.col(c) >= since) & (F.col(c) < until)
    return pairs.groupBy("session_id").agg(
        F.count_if(F.col("end_us").isNull() & inside("start_us")).alias("unpaired_starts"),
        F.count_if(F.col("start_us").isNull() & inside("end_us")).alias("unpaired_ends"),
    )


def paired_executions(launches: DataFrame, ends: DataFrame) -> DataFrame:
    """F8. Each id's last end with the last launch before it.

    Both sides: session_id, id, us, ord, cwd, start_us (a start that the record states; null if none). start and cwd are unknown where launch
    and end state different ones; ``mode`` says where the start comes from: explicit, launch, or none.
    """
    end = first_of_each(ends, (*KEYS, "id"), F.desc("us"), F.desc("ord")).select(*KEYS, "id", F.col("us").alias("end_us"), F.col("ord").alias("end_ord"), F.col("cwd").alias("end_cwd"), F.col("start_us").alias("stated"))
    launch = launches.select(*KEYS, "id", F.col("us").alias("launch_us"), F.col("ord").alias("launch_ord"), F.col("cwd").alias("launch_cwd"))
    before = F.struct("launch_us", "launch_ord") < F.struct("end_us", "end_ord")
    both = end.join(launch, [*KEYS, "id"], "left").withColumn("__before", F.coalesce(before, F.lit(False)))
    last = first_of_each(both, (*KEYS, "id"), F.desc("__before"), F.desc_nulls_last("launch_us"), F.desc_nulls_last("launch_ord"))
    last = last.withColumns({c: F.when(F.col("__before"), F.col(c)) for c in ("launch_us", "launch_cwd")})
    conflict = F.col("stated").isNotNull() & F.col("launch_us").isNotNull() & (F.col("stated") != F.col("launch_us"))
    apart = F.col("launch_cwd").isNotNull() & F.col("end_cwd").isNotNull() & (F.col("launch_cwd") != F.col("end_cwd"))
    return last.select(
        *KEYS, "id", "end_us",
        F.when(~conflict, F.coalesce("stated", "launch_us")).alias("start_us"),
        F.when(~apart, F.coalesce("end_cwd", "launch_cwd")).alias("cwd"),
        F.when(conflict, "none").when(F.col("stated").isNotNull(), "explicit").when(F.col("launch_us").isNotNull(), "launch").otherwise("none").alias("mode"),
    )


def value_at(probes: DataFrame, facts: DataFrame, value: str, out: str, conflict_is_null: bool = True) -> DataFrame:
    """F9, F16. Each probe (session_id, us, ord) with the latest fact at or before it.

    Facts that state several values at one instant are unknown (``conflict_is_null``) or give the last by ord.
    """
    if conflict_is_null:
        at = facts.groupBy(*KEYS, "us").agg(F.min(value).alias("__a"), F.max(value).alias("__b"), F.count_if(F.col(value).isNull()).alias("__n"))
        known = at.select(*KEYS, "us", F.struct(F.when((F.col("__a") == F.col("__b")) & (F.col("__n") == 0), F.col("__a")).alias("v")).alias("__fact"))
    else:
        known = facts.groupBy(*KEYS, "us").agg(F.struct(F.max_by(value, "ord").alias("v")).alias("__fact"))
    both = probes.withColumns({"__fact": F.lit(None).cast(known.schema["__fact"].dataType), "__probe": F.lit(1)})
    both = both.unionByName(known.withColumn("__probe", F.lit(0)), allowMissingColumns=True)
    w = _ordered(KEYS, "us", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("__fact", ignorenulls=True).over(w)["v"]).where("__probe = 1").drop("__fact", "__probe")


def in_force(facts: DataFrame, value: str, since: int, until: int) -> DataFrame:
    """F10, A5. Values inside the window, and those of the last instant before it. A row per session and value."""
    before = facts.where(F.col("us") < since)
    last = before.withColumn("__m", F.max("us").over(Window.partitionBy(*KEYS))).where("us = __m").drop("__m")
    inside = facts.where((F.col("us") >= since) & (F.col("us") < until))
    return inside.select(*KEYS, value).union(last.select(*KEYS, value)).where(F.col(value).isNotNull()).distinct()


def conflicts(facts: DataFrame, value: str) -> DataFrame:
    """F11. Sessions and instants that state two values."""
    return facts.groupBy(*KEYS, "us").agg(F.count_distinct(value).alias("n")).where("n > 1").select(*KEYS, "us")


def immutable(starts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """F12. Sessions whose starts agree on all fields, once each."""
    same = F.struct(*[F.struct(F.col(f).isNull().alias("n"), f) for f in fields])
    one = starts.withColumn("__f", same).groupBy(*KEYS).agg(F.min("us").alias("us"), F.min("__f").alias("a"), F.max("__f").alias("b")).where("a = b")
    return one.select(*KEYS, "us", *[F.col(f"a.col{i + 1}.{f}").alias(f) for i, f in enumerate(fields)])


def session_starts(events: DataFrame, cwd: str = "cwd") -> DataFrame:
    """F13. Earliest instant and first known directory of each session."""
    place = F.struct("us", "ord")
    return events.groupBy(*KEYS).agg(F.min("us").alias("start_us"), F.min_by(cwd, F.when(F.col(cwd).isNotNull(), place)).alias("cwd"))


def completion(events: DataFrame, until: int, kind: str = "kind", end: str = "end", resume: str = "resume") -> DataFrame:
    """F14. The last end before ``until`` in arrival order, null if a resume follows it."""
    seen = events.where((F.col("us") < until) & F.col(kind).isin(end, resume))
    last = seen.groupBy(*KEYS).agg(F.max_by(F.struct(kind, "us"), "ord").alias("l"))
    return last.select(*KEYS, F.when(F.col(f"l.{kind}") == end, F.col("l.us")).alias("completed_us"))


def timing_gaps(df: DataFrame) -> DataFrame:
    """F15. Bounds of rows without an instant, from their neighbours in record order; none where the order is violated."""
    w = _ordered(KEYS, "ord")
    low = F.last("us", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    high = F.first("us", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = df.withColumns({"low_us": low, "high_us": high}).where("us is null")
    ok = F.coalesce(F.col("low_us") <= F.col("high_us"), F.lit(True))
    return out.withColumns({"low_us": F.when(ok, F.col("low_us")), "high_us": F.when(ok, F.col("high_us"))})


def coverage(df: DataFrame, flags: dict[str, Column], by: str = "agent") -> DataFrame:
    """F17. Quality counters summed by adapter."""
    return df.groupBy(by).agg(F.count("*").alias("records"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def sessions_in_window(events: DataFrame, pairs: DataFrame, since: int, until: int) -> DataFrame:
    """F18. Sessions with an event in the window, or a valid pair that overlaps it."""
    a = events.where((F.col("us") >= since) & (F.col("us") < until)).select(*KEYS)
    b = pairs.where(F.col("valid") & (F.col("start_us") < until) & (F.col("end_us") > since)).select(*KEYS)
    return a.union(b).distinct()
