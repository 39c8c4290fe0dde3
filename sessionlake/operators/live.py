"""Trailing-hour views of live sessions, alerts and quotas (L rows), in batch form. sessionlake.streaming has the streaming form of L2 to L5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def last_epoch(requests: DataFrame, identity: str = "model") -> DataFrame:
    """L2. The requests since the last change of a session's identity (in order of ord)."""
    w = Window.partitionBy("session_id").orderBy("ord")
    change = F.coalesce((~F.col(identity).eqNullSafe(F.lag(identity).over(w)) & F.lag("ord").over(w).isNotNull()).cast("int"), F.lit(0))
    rows = requests.withColumn("__c", change).withColumn("__e", F.sum("__c").over(w))
    return rows.withColumn("__m", F.max("__e").over(Window.partitionBy("session_id"))).where("__e = __m").drop("__c", "__e", "__m")


def merged_updates(requests: DataFrame) -> DataFrame:
    """L3. Per session and request id the earliest time and the best-ranked context."""
    return requests.groupBy("session_id", "id").agg(F.min("us").alias("us"), F.max_by("context", F.struct("rank", "ord")).alias("context"))


def trailing_hours(requests: DataFrame, now: int) -> DataFrame:
    """L5. Per session, for the hour before ``now`` and the one before that: calls, tokens and their mean; first and last context; and future events."""
    hour = lambda k: (F.col("us") >= now - k * HOUR) & (F.col("us") < now - (k - 1) * HOUR)
    both = (F.col("us") >= now - 2 * HOUR) & (F.col("us") < now)
    aggregates: list[Column] = []
    for k, name in ((1, "current"), (2, "previous")):
        t = F.sum(F.when(hour(k), F.col("context")))
        aggregates += [F.count_if(hour(k)).alias(f"{name}_calls"), F.coalesce(t, F.lit(0)).alias(f"{name}_tokens"), F.avg(F.when(hour(k), F.col("context"))).alias(f"{name}_mean")]
    order = F.when(both & F.col("context").isNotNull(), F.struct("us", "id"))
    return requests.groupBy("session_id").agg(*aggregates, F.min_by("context", order).alias("first_context"), F.max_by("context", order).alias("last_context"), F.count_if(F.col("us") >= now).alias("future"), F.max(F.when(F.col("us") < now, F.col("us"))).alias("last_us"))


def status(windows: DataFrame, now: int, stale_us: int = HOUR) -> DataFrame:
    """L6. ok, stale or unknown, with a reason; numbers of sessions that aren't ok are null."""
    reason = F.when(F.col("last_us").isNull(), "no_observation").when(now - F.col("last_us") > stale_us, "stale").otherwise("")
    out = windows.withColumns({"status": F.when(reason == "", "ok").when(reason == "stale", "stale").otherwise("unknown"), "reason": reason})
    return out.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in ("current_calls", "current_tokens", "previous_calls", "previous_tokens", "last_context")})


def fleet(windows: DataFrame) -> DataFrame:
    """L7. Totals over sessions; null if any summand is."""
    total = lambda c: F.when(F.bool_and(F.col(c).isNotNull()), F.sum(c)).alias(c)
    return windows.agg(F.count("*").alias("sessions"), total("current_calls"), total("current_tokens"), total("previous_calls"))


def alerts(windows: DataFrame, context: int = 200_000, least_before: int = 10, least_now: int = 30) -> DataFrame:
    """L8. Sessions above the context limit, and those whose calls surge (twice the hour before, from enough calls)."""
    surge = (F.col("previous_calls") >= least_before) & (F.col("current_calls") >= least_now) & (F.col("current_calls") >= 2 * F.col("previous_calls"))
    hits = F.array_compact(F.array(F.when(F.col("last_context") > context, "context"), F.when(surge, "surge")))
    return windows.select("session_id", F.explode(hits).alias("alert"))


def unique_windows(windows: DataFrame, keys: tuple[str, ...] = ("engine", "lane", "session_id")) -> DataFrame:
    """L9. windows with ``duplicate``: whether another row has the same keys."""
    return windows.withColumn("duplicate", F.count("*").over(Window.partitionBy(*keys)) > 1)


def quota_exhaustion(samples: DataFrame, now: int) -> DataFrame:
    """L10. Per account and engine, from its last two samples: slope per hour, seconds to exhaustion, and signal, clear or unknown.

    samples: account, engine, us, ord, used (0 to 100), reset_us. Samples of different resets don't compare.
    """
    w = Window.partitionBy("account", "engine").orderBy("us", "ord")
    rows = samples.withColumns({"u0": F.lag("used").over(w), "t0": F.lag("us").over(w), "r0": F.lag("reset_us").over(w), "__n": F.row_number().over(Window.partitionBy("account", "engine").orderBy(F.desc("us"), F.desc("ord")))}).where("__n = 1")
    ok = F.col("u0").isNotNull() & F.col("r0").eqNullSafe(F.col("reset_us")) & (F.col("us") > F.col("t0")) & (F.col("reset_us") > now)
    slope = (F.col("used") - F.col("u0")) * 3600 / ((F.col("us") - F.col("t0")) / 1e6)
    left = F.when(F.col("used") == 100, 0.0).when(slope > 0, F.greatest(F.lit(0.0), (100 - F.col("used")) * 3600 / slope - (now - F.col("us")) / 1e6))
    out = rows.select("account", "engine", F.when(ok, slope).alias("slope"), F.when(ok, left).alias("seconds"), "reset_us")
    soon = (F.col("seconds") <= 3600) & (F.col("seconds") < (F.col("reset_us") - now) / 1e6)
    return out.select("account", "engine", "slope", "seconds", F.when(F.col("seconds").isNull(), "unknown").when(soon, "signal").otherwise("clear").alias("status"))


def account_alerts(quotas: DataFrame, windows: DataFrame) -> DataFrame:
    """L11. Accounts that signal, with each fresh window that runs on them."""
    return windows.where("status = 'ok'").join(quotas.where("status = 'signal'").select("account", "engine", "seconds"), ["account", "engine"])


def latest_samples(samples: DataFrame) -> DataFrame:
    """L12. The latest sample of each account and engine."""
    return samples.groupBy("account", "engine").agg(F.max_by(F.struct("us", "used"), F.struct("us", "ord")).alias("s")).select("account", "engine", "s.us", "s.used")


def rate_limits(records: DataFrame) -> DataFrame:
    """L13. Quota samples from log records with ``primary`` and ``secondary`` limits (structs of used, window_minutes, reset_us): a row per stated limit."""
    both = F.filter(F.array(F.struct(F.lit("primary").alias("limit"), F.col("primary").alias("l")), F.struct(F.lit("secondary").alias("limit"), F.col("secondary").alias("l"))), lambda x: x["l"].isNotNull() & x["l"]["used"].between(0, 100))
    return records.select("account", "us", F.explode(both).alias("x")).select("account", "us", "x.limit", "x.l.*")
