"""Queries of the fold and timing operators over the bridge views."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fold, timing
from .bridge import SINCE, UNTIL
from .registry import Views, query

DUPS_ORDER = ("us", "l_partkey", "l_suppkey", "cents", "digest")


@query("""
SELECT event_id, session_id, digest, cents FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, event_id, digest ORDER BY us, l_partkey, l_suppkey, cents) AS n FROM dups) WHERE n = 1""")
def exact_dedup(v: Views) -> DataFrame:
    return fold.exact_dedup(v.dups, DUPS_ORDER, ("session_id", "event_id", "digest")).select("event_id", "session_id", "digest", "cents")


@query("SELECT session_id, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT session_id, digest, count(*) AS n FROM dups GROUP BY 1, 2) GROUP BY 1")
def exact_duplicates(v: Views) -> DataFrame:
    return fold.duplicate_counts(v.dups)


@query("""
SELECT event_id, digest, us, cents FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY us, l_partkey, l_suppkey, cents) AS n FROM dups
  WHERE event_id IN (SELECT event_id FROM dups GROUP BY event_id HAVING count(DISTINCT digest) = 1)) WHERE n = 1""")
def global_dedup(v: Views) -> DataFrame:
    return fold.global_dedup(v.dups, DUPS_ORDER).select("event_id", "digest", "us", "cents")


@query("SELECT DISTINCT session_id FROM dups WHERE event_id IN (SELECT event_id FROM dups GROUP BY event_id HAVING count(DISTINCT digest) > 1)")
def tainted_sessions(v: Views) -> DataFrame:
    return fold.tainted_sessions(v.dups)


@query("SELECT session_id, message, output, us, cents FROM (SELECT *, row_number() OVER (PARTITION BY session_id, message ORDER BY output DESC, us DESC, ord) AS n FROM snapshots) WHERE n = 1")
def maximal_snapshot(v: Views) -> DataFrame:
    return fold.maximal_snapshot(v.snapshots).select("session_id", "message", "output", "us", "cents")


@query("""
WITH p AS (SELECT *, coalesce(lag(input) OVER w, 0) AS pi, coalesce(lag(cached) OVER w, 0) AS pc, coalesce(lag(output) OVER w, 0) AS po FROM counters WINDOW w AS (PARTITION BY session_id ORDER BY us, ord)),
d AS (SELECT *, input < pi OR cached < pc OR output < po AS reset FROM p),
e AS (SELECT session_id, ord, reset, input - CASE WHEN reset THEN 0 ELSE pi END AS di, cached - CASE WHEN reset THEN 0 ELSE pc END AS dc, output - CASE WHEN reset THEN 0 ELSE po END AS do_ FROM d)
SELECT session_id, ord, reset, CAST(di AS BIGINT) AS d_input, CAST(dc AS BIGINT) AS d_cached, CAST(do_ AS BIGINT) AS d_output, CAST(di - dc AS BIGINT) AS d_fresh, di - dc < 0 AS invalid FROM e WHERE di <> 0 OR dc <> 0 OR do_ <> 0""")
def counter_deltas(v: Views) -> DataFrame:
    out = fold.counter_deltas(v.counters, ("input", "cached", "output"), ("input", "cached"))
    return out.select("session_id", "ord", "reset", "d_input", "d_cached", "d_output", "d_fresh", "invalid")


@query("""
SELECT session_id, ord, small, flag FROM (SELECT *, lag(small) OVER w AS ps, lag(flag) OVER w AS pf FROM
  (SELECT ord, session_id, us, {div:k:34} AS small, CASE WHEN k % 9 <> 0 THEN k % 2 END AS flag FROM usage) WINDOW w AS (PARTITION BY session_id ORDER BY us, ord))
WHERE NOT coalesce(small = ps AND flag = pf, false)""")
def repeated_vectors(v: Views) -> DataFrame:
    small = v.usage.select("ord", "session_id", "us", F.expr("k div 34").alias("small"), F.when(F.col("k") % 9 != 0, F.col("k") % 2).alias("flag"))
    return fold.drop_repeated(small, ("small", "flag")).select("session_id", "ord", "small", "flag")


@query("SELECT session_id, kind, count(DISTINCT k) AS n FROM ev WHERE us >= $SINCE AND us < $UNTIL GROUP BY 1, 2")
def distinct_events(v: Views) -> DataFrame:
    return fold.distinct_counts(v.ev, SINCE, UNTIL, "kind", "k")


PAIRS = """
WITH b AS (SELECT session_id, id, min(CASE WHEN kind = 'tool_start' THEN us END) AS start_us, max(CASE WHEN kind = 'tool_end' THEN us END) AS end_us FROM pairs GROUP BY 1, 2),
p AS (SELECT *, coalesce(end_us >= start_us, false) AS valid FROM b) """


def tool_pairs(v: Views) -> DataFrame:
    p = v.pairs
    return fold.pair_intervals(p.where("kind = 'tool_start'"), p.where("kind = 'tool_end'"))


@query(PAIRS + "SELECT session_id, id, start_us, end_us, valid FROM p")
def interval_pairs(v: Views) -> DataFrame:
    return tool_pairs(v)


@query(PAIRS + "SELECT session_id, count(*) FILTER (end_us IS NULL AND start_us >= $SINCE AND start_us < $UNTIL) AS unpaired_starts, count(*) FILTER (start_us IS NULL AND end_us >= $SINCE AND end_us < $UNTIL) AS unpaired_ends FROM p GROUP BY 1")
def unpaired_events(v: Views) -> DataFrame:
    return fold.unpaired(tool_pairs(v), SINCE, UNTIL)


@query("""
WITH x AS (SELECT *, CASE WHEN k % 4 <> 0 THEN '/w' || CAST(k % 2 AS STRING) END AS cwd, CASE WHEN k % 6 = 0 THEN us - 1000000 END AS stated FROM pairs),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, id ORDER BY us DESC, ord DESC) AS n FROM x WHERE kind = 'tool_end') WHERE n = 1),
l AS (SELECT * FROM (SELECT s.session_id, s.id, s.us, s.cwd, row_number() OVER (PARTITION BY s.session_id, s.id ORDER BY s.us DESC, s.ord DESC) AS n FROM x s JOIN e ON s.session_id = e.session_id AND s.id = e.id AND (s.us, s.ord) < (e.us, e.ord) WHERE s.kind = 'tool_start') WHERE n = 1)
SELECT e.session_id, e.id, e.us AS end_us,
  CASE WHEN e.stated IS NOT NULL AND l.us IS NOT NULL AND e.stated <> l.us THEN NULL ELSE coalesce(e.stated, l.us) END AS start_us,
  CASE WHEN l.cwd <> e.cwd THEN NULL ELSE coalesce(e.cwd, l.cwd) END AS cwd,
  CASE WHEN e.stated IS NOT NULL AND l.us IS NOT NULL AND e.stated <> l.us THEN 'none' WHEN e.stated IS NOT NULL THEN 'explicit' WHEN l.us IS NOT NULL THEN 'launch' ELSE 'none' END AS mode
FROM e LEFT JOIN l ON l.session_id = e.session_id AND l.id = e.id""")
def execution_pairs(v: Views) -> DataFrame:
    x = v.pairs.withColumns({"cwd": F.when(F.col("k") % 4 != 0, F.concat(F.lit("/w"), (F.col("k") % 2).cast("string"))), "start_us": F.when(F.col("k") % 6 == 0, F.col("us") - 1_000_000)})
    return fold.paired_executions(x.where("kind = 'tool_start'"), x.where("kind = 'tool_end'"))


@query("""
WITH c AS (SELECT session_id, {div:us:3600000000} * 3600000000 AS us, cwd FROM contexts),
f AS (SELECT session_id, us, CASE WHEN count(DISTINCT cwd) = 1 AND count(cwd) = count(*) THEN min(cwd) END AS cwd FROM c GROUP BY 1, 2)
SELECT u.session_id, u.ord, f.cwd FROM usage u ASOF LEFT JOIN f ON u.session_id = f.session_id AND u.us >= f.us""")
def context_at(v: Views) -> DataFrame:
    facts = v.contexts.withColumn("us", F.expr("us div 3600000000 * 3600000000"))
    return fold.value_at(v.usage.select("session_id", "ord", "us"), facts.select("session_id", "us", "ord", "cwd"), "cwd", "cwd").select("session_id", "ord", "cwd")


@query("""
SELECT DISTINCT session_id, cwd FROM contexts c WHERE cwd IS NOT NULL AND (us >= $SINCE AND us < $UNTIL
  OR us = (SELECT max(us) FROM contexts d WHERE d.session_id = c.session_id AND d.us < $SINCE))""")
def context_in_force(v: Views) -> DataFrame:
    return fold.in_force(v.contexts, "cwd", SINCE, UNTIL)


@query("SELECT session_id, {div:us:86400000000} AS us FROM contexts GROUP BY 1, 2 HAVING count(DISTINCT cwd) > 1")
def context_conflicts(v: Views) -> DataFrame:
    return fold.conflicts(v.contexts.withColumn("us", F.expr("us div 86400000000")), "cwd")


@query("SELECT session_id, min(us) AS us, min(a) AS a, min(b) AS b FROM (SELECT session_id || '/' || CAST({div:us:86400000000} AS STRING) AS session_id, us, k % 2 AS a, CASE WHEN k < 40 THEN 1 END AS b FROM models) GROUP BY 1 HAVING count(DISTINCT a) = 1 AND (count(b) = 0 OR (count(b) = count(*) AND count(DISTINCT b) = 1))")
def immutable_dispatch(v: Views) -> DataFrame:
    dispatch = F.concat("session_id", F.lit("/"), F.expr("us div 86400000000").cast("string"))  # a session's starts of one day
    starts = v.models.select(dispatch.alias("session_id"), "us", (F.col("k") % 2).alias("a"), F.when(F.col("k") < 40, F.lit(1)).alias("b"))
    return fold.immutable(starts, ("a", "b"))


@query("SELECT session_id, min(us) AS start_us, arg_min(cwd, (us, ord)) FILTER (cwd IS NOT NULL) AS cwd FROM contexts GROUP BY 1")
def session_starts(v: Views) -> DataFrame:
    return fold.session_starts(v.contexts)


@query("SELECT session_id, CASE WHEN arg_max(kind, ord) = 'tool_end' THEN arg_max(us, ord) END AS completed_us FROM ev WHERE us < $UNTIL AND kind IN ('tool_end', 'model') GROUP BY 1")
def session_completion(v: Views) -> DataFrame:
    return fold.completion(v.ev, UNTIL, "kind", "tool_end", "model")


@query("""
WITH e AS (SELECT session_id, ord, CASE WHEN k % 5 <> 0 THEN us - CASE WHEN k % 50 = 1 THEN 864000000000 ELSE 0 END END AS us FROM ev),
b AS (SELECT *, last_value(us IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, first_value(us IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM e)
SELECT session_id, ord, CASE WHEN lo > hi THEN NULL ELSE lo END AS low_us, CASE WHEN lo > hi THEN NULL ELSE hi END AS high_us FROM b WHERE us IS NULL""")
def timing_gaps(v: Views) -> DataFrame:
    late = F.when(F.col("k") % 50 == 1, 864_000_000_000).otherwise(0)
    e = v.ev.select("session_id", "ord", F.when(F.col("k") % 5 != 0, F.col("us") - late).alias("us"))
    return fold.timing_gaps(e).select("session_id", "ord", "low_us", "high_us")


@query("SELECT u.session_id, u.ord, m.model FROM usage u ASOF LEFT JOIN (SELECT session_id, us, arg_max(model, ord) AS model FROM (SELECT session_id, us, ord, coalesce(model, '?') AS model FROM models) GROUP BY 1, 2) m ON u.session_id = m.session_id AND u.us >= m.us")
def model_at(v: Views) -> DataFrame:
    facts = v.models.withColumn("model", F.coalesce("model", F.lit("?")))
    return fold.value_at(v.usage.select("session_id", "ord", "us"), facts.select("session_id", "us", "ord", "model"), "model", "model", False).select("session_id", "ord", "model")


@query("SELECT agent, count(*) AS records, count(*) FILTER (k % 7 = 0) AS malformed, count(*) FILTER (kind = 'error') AS unknown_kinds FROM ev GROUP BY 1")
def coverage_by_agent(v: Views) -> DataFrame:
    return fold.coverage(v.ev, {"malformed": F.col("k") % 7 == 0, "unknown_kinds": F.col("kind") == "error"})


@query(PAIRS + "SELECT DISTINCT session_id FROM ev WHERE us >= $SINCE AND us < $SINCE + 3600000000 UNION SELECT session_id FROM p WHERE valid AND start_us < $SINCE + 3600000000 AND end_us > $SINCE")
def sessions_in_window(v: Views) -> DataFrame:
    return fold.sessions_in_window(v.ev, tool_pairs(v), SINCE, SINCE + 3_600_000_000)


@query("SELECT session_id, greatest(0, least(max(us), $UNTIL) - greatest(min(us), $SINCE)) AS wall_us FROM ev GROUP BY 1")
def wall_span(v: Views) -> DataFrame:
    return timing.wall(v.ev, SINCE, UNTIL)


@query("""
WITH g AS (SELECT session_id, us, lead(us) OVER (PARTITION BY session_id ORDER BY us) AS nx FROM (SELECT DISTINCT session_id, us FROM ev))
SELECT session_id, """ + ", ".join(f"CAST(coalesce(sum(CASE WHEN nx - us <= {n * 60_000_000} THEN greatest(0, least(nx, $UNTIL) - greatest(us, $SINCE)) END), 0) AS BIGINT) AS active_{n}m_us" for n in (2, 5, 10, 60)) + " FROM g GROUP BY 1")
def active_time(v: Views) -> DataFrame:
    return timing.active(v.ev, SINCE, UNTIL, (2, 5, 10, 60))


@query(PAIRS + "SELECT session_id, count(*) AS pairs, CAST(sum(greatest(0, least(end_us, $UNTIL) - greatest(start_us, $SINCE))) AS BIGINT) AS paired_us FROM p WHERE valid AND start_us < $UNTIL AND (end_us > $SINCE OR (start_us = end_us AND start_us >= $SINCE)) GROUP BY 1")
def paired_durations(v: Views) -> DataFrame:
    return timing.paired_time(tool_pairs(v), SINCE, UNTIL)


@query("SELECT session_id, min(us) - min(us) % 60000000 AS first_us, max(us) - max(us) % 60000000 AS last_us FROM ev WHERE us >= $SINCE AND us < $UNTIL GROUP BY 1")
def minute_bounds(v: Views) -> DataFrame:
    return timing.first_last_minute(v.ev, SINCE, UNTIL)


@query("SELECT agent, count(*) AS events, round(count(*) / 14.0, 6) AS per_day FROM ev WHERE us >= $SINCE AND us < $UNTIL GROUP BY 1")
def daily_rates(v: Views) -> DataFrame:
    inside = v.ev.where((F.col("us") >= SINCE) & (F.col("us") < UNTIL)).groupBy("agent").agg(F.count("*").alias("events"))
    return inside.withColumn("per_day", F.round(timing.per_day(F.col("events"), SINCE, UNTIL), 6))
