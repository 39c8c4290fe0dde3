"""Time measures of sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
DAY = 86_400 * SECOND


def clipped(start: Column, end: Column, since: int, until: int) -> Column:
    """T1. Microseconds of [start, end) inside the window."""
    return F.greatest(F.lit(0), F.least(end, F.lit(until)) - F.greatest(start, F.lit(since)))


def wall(events: DataFrame, since: int, until: int) -> DataFrame:
    """T1. Clipped span of each session's first to last instant, in microseconds."""
    ends = events.groupBy("session_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    return ends.select("session_id", clipped(F.col("a"), F.col("b"), since, until).alias("wall_us"))


def active(events: DataFrame, since: int, until: int, idle_minutes: Sequence[int] = (2, 5, 10)) -> DataFrame:
    """T2. Clipped time of gaps up to each idle limit, between distinct instants. A column per limit."""
    times = events.select("session_id", "us").where("us is not null").distinct()
    gaps = times.withColumn("next", F.lead("us").over(Window.partitionBy("session_id").orderBy("us")))
    part = clipped(F.col("us"), F.col("next"), since, until)
    return gaps.groupBy("session_id").agg(*[F.coalesce(F.sum(F.when(F.col("next") - F.col("us") <= n * MINUTE, part)), F.lit(0)).alias(f"active_{n}m_us") for n in idle_minutes])


def paired_time(pairs: DataFrame, since: int, until: int) -> DataFrame:
    """T3. Pairs that overlap the window (or have no length and lie inside), and their clipped time, by session."""
    inside = (F.col("start_us") < until) & (F.col("end_us") > since) | ((F.col("start_us") == F.col("end_us")) & (F.col("start_us") >= since) & (F.col("start_us") < until))
    ok = pairs.where(F.col("valid") & inside)
    return ok.groupBy("session_id").agg(F.count("*").alias("pairs"), F.sum(clipped(F.col("start_us"), F.col("end_us"), since, until)).alias("paired_us"))


def first_last_minute(events: DataFrame, since: int, until: int) -> DataFrame:
    """T4. First and last instant inside the window, floored to the minute."""
    inside = events.where((F.col("us") >= since) & (F.col("us") < until))
    floor = lambda c: c - c % MINUTE
    return inside.groupBy("session_id").agg(floor(F.min("us")).alias("first_us"), floor(F.max("us")).alias("last_us"))


def per_day(value: Column, since: int, until: int) -> Column:
    """T5. A value by days of the window."""
    return value / ((until - since) / DAY)
