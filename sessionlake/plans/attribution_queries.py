"""Queries of the attribution operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution as a

from .bridge import SINCE, UNTIL
from .registry import Views, query

RULES = (a.Rule("alpha", ("*.example/r0", "git.*/r0"), ("/r0*",)), a.Rule("beta", (), ("/r1/s?", "/r1")), a.Rule("gamma", (), ("/r2/s[0]",)), a.Rule("delta", (), ("/r2/*",)))
IDLE = 240

#: A path's link by the same rules, for DuckDB: bucket|key|rule.
LINKED = """CASE WHEN {0} IS NULL THEN NULL WHEN starts_with({0}, '/r0') THEN 'project|alpha|alpha' WHEN {0} = '/r1' OR {0} IN ('/r1/s0', '/r1/s1') THEN 'project|beta|beta'
 WHEN {0} = '/r2/s0' THEN 'unassigned||ambiguous_rules' WHEN starts_with({0}, '/r2/') THEN 'project|delta|delta' ELSE 'other||' END"""

ISLANDS = f"""
WITH e0 AS (
  SELECT session_id, agent, us, ord, 'context' AS kind, k % 3 = 0 AS reset, cwd, NULL AS p1 FROM contexts
  UNION ALL SELECT session_id, agent, us, ord, 'tool', false, CASE WHEN k % 6 = 1 THEN '/r' || CAST(k % 4 AS STRING) END, CASE WHEN k % 5 = 0 THEN '/r' || CAST(k % 3 AS STRING) || '/s1' END FROM pairs WHERE kind = 'tool_start'
  UNION ALL SELECT session_id, agent, us, ord, 'usage', false, CASE WHEN k % 4 = 1 THEN '/r' || CAST(k % 3 AS STRING) || '/s' || CAST(k % 2 AS STRING) END, CASE WHEN k % 9 = 0 THEN '/r1/s0' END FROM usage),
e1 AS (SELECT *, {LINKED.format('cwd')} AS cl, {LINKED.format('p1')} AS pl FROM e0 WHERE us < $UNTIL),
e2 AS (SELECT *, sum(CASE WHEN kind = 'context' AND reset THEN 1 ELSE 0 END) OVER w AS turn,
    last_value(CASE WHEN kind = 'context' THEN coalesce(cl, '') END IGNORE NULLS) OVER w AS cc,
    sum(CASE WHEN kind = 'context' AND agent = 'open' AND cl IS NULL THEN 1 ELSE 0 END) OVER w AS clears FROM e1
  WINDOW w AS (PARTITION BY session_id ORDER BY us, ord ROWS UNBOUNDED PRECEDING)),
e3 AS (SELECT *, last_value(CASE WHEN kind = 'tool' THEN cl END IGNORE NULLS) OVER w AS cmd,
    min(CASE WHEN kind = 'tool' THEN pl END) OVER w AS lo, max(CASE WHEN kind = 'tool' THEN pl END) OVER w AS hi FROM e2
  WINDOW w AS (PARTITION BY session_id, turn ORDER BY us, ord ROWS UNBOUNDED PRECEDING)),
e4 AS (SELECT *, nullif(CASE agent WHEN 'codex' THEN coalesce(cmd, cc) WHEN 'open' THEN coalesce(cl, cc) ELSE cl END, '') AS c, least(lo, pl) AS l2, greatest(hi, pl) AS h2 FROM e3 WHERE kind = 'usage'),
e5 AS (SELECT *, CASE WHEN c IS NOT NULL THEN c WHEN l2 IS NOT NULL THEN CASE WHEN l2 = h2 THEN l2 ELSE 'unassigned||' END END AS own, CASE WHEN c IS NOT NULL THEN 'cwd' WHEN l2 IS NOT NULL THEN 'tool_path' END AS how FROM e4),
e6 AS (SELECT *, own IS NOT NULL OR coalesce(us - lag(us) OVER w >= {IDLE * 60_000_000}, true) OR clears <> lag(clears) OVER w AS head FROM e5 WINDOW w AS (PARTITION BY session_id ORDER BY us, ord)),
e7 AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY us, ord ROWS UNBOUNDED PRECEDING) AS island FROM e6),
e8 AS (SELECT *, first_value(own) OVER (PARTITION BY session_id, island ORDER BY us, ord) AS f FROM e7),
linked AS (SELECT session_id, us, ord, CASE WHEN own IS NOT NULL THEN own WHEN NOT head AND f IS NOT NULL AND NOT starts_with(f, 'unassigned') THEN f ELSE 'unassigned||' END AS link,
  CASE WHEN own IS NOT NULL THEN how WHEN NOT head AND f IS NOT NULL AND NOT starts_with(f, 'unassigned') THEN 'previous_event' ELSE 'unassigned' END AS evidence FROM e8),
parts AS (SELECT l.session_id, l.us, l.ord, l.evidence, split_part(link, '|', 1) AS bucket, nullif(split_part(link, '|', 2), '') AS project_key, nullif(split_part(link, '|', 3), '') AS rule,
  u.new_input, u.cache_write, u.cache_read, u.output, u.reasoning_output, u.total FROM linked l JOIN usage u ON l.ord = u.ord),
alloc AS (SELECT session_id, bucket, project_key, rule, count(*) AS events, CAST(sum(total) AS BIGINT) AS total, CAST(sum(new_input) AS BIGINT) AS new_input, CAST(sum(cache_write) AS BIGINT) AS cache_write,
  CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(output) AS BIGINT) AS output, CAST(sum(reasoning_output) AS BIGINT) AS reasoning_output,
  {', '.join(f"count(*) FILTER (evidence = '{e}') AS events_{e}, CAST(coalesce(sum(total) FILTER (evidence = '{e}'), 0) AS BIGINT) AS tokens_{e}" for e in a.EVIDENCE)},
  CASE WHEN count(cache_write) = count(*) THEN CAST(sum(total) AS BIGINT) END AS complete_total FROM parts WHERE us >= $SINCE AND us < $UNTIL GROUP BY ALL) """


def stated(v: Views) -> DataFrame:
    def s(path: str) -> str:
        return f"CAST({path} AS STRING)"

    base = ("session_id", "agent", "us", "ord")
    contexts = v.contexts.select(*base, F.lit("context").alias("kind"), (F.col("k") % 3 == 0).alias("reset"), "cwd", F.lit(None).cast("string").alias("path"))
    tools = v.pairs.where("kind = 'tool_start'").select(*base, F.lit("tool").alias("kind"), F.lit(False).alias("reset"), F.expr("CASE WHEN k % 6 = 1 THEN '/r' || CAST(k % 4 AS STRING) END").alias("cwd"), F.expr("CASE WHEN k % 5 = 0 THEN '/r' || CAST(k % 3 AS STRING) || '/s1' END").alias("path"))
    usage = v.usage.select(*base, F.lit("usage").alias("kind"), F.lit(False).alias("reset"), F.expr("CASE WHEN k % 4 = 1 THEN '/r' || CAST(k % 3 AS STRING) || '/s' || CAST(k % 2 AS STRING) END").alias("cwd"), F.expr("CASE WHEN k % 9 = 0 THEN '/r1/s0' END").alias("path"), *a.TOKENS)
    return contexts.unionByName(tools).unionByName(usage, allowMissingColumns=True)


def linked(v: Views) -> DataFrame:
    null = F.lit(None).cast("string")
    own = F.when(F.col("path").isNotNull(), a.link(F.col("path"), null, RULES))
    events = stated(v).withColumns({"cwd_link": F.when(F.col("cwd").isNotNull(), a.link(F.col("cwd"), null, RULES)), "path_low": own, "path_high": own})
    return a.event_links(events, UNTIL, IDLE)


@query(ISLANDS + "SELECT session_id, ord, bucket, project_key, rule, evidence FROM parts")
def event_allocation(v: Views) -> DataFrame:
    return linked(v).select("session_id", "ord", "link.bucket", "link.project_key", "link.rule", "evidence")


@query(ISLANDS + "SELECT *, round(CASE WHEN total > 0 THEN tokens_previous_event / total ELSE 0 END, 6) AS fallback_share FROM alloc")
def session_allocation(v: Views) -> DataFrame:
    return a.allocations(linked(v), SINCE, UNTIL).withColumn("fallback_share", F.round("fallback_share", 6))


@query(ISLANDS + """, s AS (SELECT bucket, project_key, rule, CAST(sum(events) AS BIGINT) AS events, CAST(sum(total) AS BIGINT) AS total FROM alloc GROUP BY ALL)
SELECT bucket, project_key, rule, events, total, round(total / (SELECT sum(total) FROM s), 6) AS share FROM s
UNION ALL SELECT b, NULL, NULL, 0, 0, 0.0 FROM (VALUES ('unassigned'), ('other')) t(b) WHERE b NOT IN (SELECT bucket FROM s)""")
def spend_by_project(v: Views) -> DataFrame:
    return a.spend(a.allocations(linked(v), SINCE, UNTIL)).select("bucket", "project_key", "rule", "events", "total", F.round("share", 6).alias("share"))


@query(ISLANDS + "SELECT round(coalesce(sum(total) FILTER (bucket = 'unassigned'), 0) / sum(total), 6) AS unassigned_bucket_share, " + ", ".join(f"round(sum(tokens_{e}) / sum(total), 6) AS {e}_share" for e in a.EVIDENCE) + " FROM alloc")
def attribution_coverage(v: Views) -> DataFrame:
    out = a.coverage_shares(a.allocations(linked(v), SINCE, UNTIL))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(ISLANDS + "SELECT session_id, CAST(sum(events) AS BIGINT) AS events, CAST(sum(total) AS BIGINT) AS total FROM alloc WHERE project_key IN ('alpha', 'delta') GROUP BY 1")
def project_selection(v: Views) -> DataFrame:
    return a.select_project(a.allocations(linked(v), SINCE, UNTIL), ("alpha", "delta")).select("session_id", "events", "total")


@query("WITH p AS (SELECT DISTINCT cwd AS path FROM contexts WHERE cwd IS NOT NULL), l AS (SELECT path, " + LINKED.format("path") + " AS x FROM p) SELECT path, split_part(x, '|', 1) AS bucket, nullif(split_part(x, '|', 2), '') AS project_key, nullif(split_part(x, '|', 3), '') AS rule FROM l")
def project_rules(v: Views) -> DataFrame:
    return a.path_links(v.contexts.withColumnRenamed("cwd", "path"), RULES).select("path", "link.bucket", "link.project_key", "link.rule")


@query("""
WITH p AS (SELECT DISTINCT cwd AS path FROM contexts WHERE cwd IS NOT NULL), r AS (SELECT DISTINCT '/r' || CAST(user_id % 2 AS STRING) || CASE WHEN user_id % 3 = 0 THEN '/s1' ELSE '' END AS root FROM ev),
b AS (SELECT path, arg_max(root, length(root)) AS root FROM p JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY 1),
l AS (SELECT p.path, b.root, CASE WHEN b.root = '/r1/s1' THEN 'alpha' WHEN starts_with(coalesce(b.root, p.path), '/r0') THEN 'alpha' WHEN coalesce(b.root, p.path) IN ('/r1', '/r1/s0') THEN 'beta' WHEN p.path = '/r2/s1' THEN 'delta' END AS project_key FROM p LEFT JOIN b ON p.path = b.path)
SELECT path, root, project_key FROM l""")
def checkout_links(v: Views) -> DataFrame:
    root = F.expr("'/r' || CAST(user_id % 2 AS STRING) || CASE WHEN user_id % 3 = 0 THEN '/s1' ELSE '' END")
    checkouts = v.ev.select(root.alias("root")).distinct().withColumn("origin", F.when(F.col("root") == "/r1/s1", "git.host/r0"))
    return a.path_links(v.contexts.withColumnRenamed("cwd", "path"), RULES, checkouts).select("path", "root", "link.project_key")


@query("WITH f AS (SELECT DISTINCT session_id || '/' || CAST({div:us:86400000000} AS STRING) AS session_id, cwd FROM contexts WHERE cwd IS NOT NULL AND us >= $SINCE), l AS (SELECT session_id, " + LINKED.format("cwd") + " AS x FROM f) SELECT session_id, CASE WHEN min(x) = max(x) THEN split_part(min(x), '|', 1) ELSE 'unassigned' END AS bucket, CASE WHEN min(x) = max(x) THEN nullif(split_part(min(x), '|', 2), '') END AS project_key FROM l GROUP BY 1")
def session_project(v: Views) -> DataFrame:
    day = F.concat("session_id", F.lit("/"), F.expr("us div 86400000000").cast("string"))  # a day of a session stands for a session
    paths = v.contexts.where(f"cwd IS NOT NULL AND us >= {SINCE}").select(day.alias("session_id"), F.col("cwd").alias("path")).distinct()
    return a.session_links(paths, a.path_links(paths, RULES)).select("session_id", "link.bucket", "link.project_key")


@query("SELECT count(*) FILTER (cwd = '/r1/s1' OR starts_with(cwd, '/r1/s1/')) AS inside, count(*) FILTER (cwd = '/r1/s1' OR starts_with(cwd, '/r1/s1/') OR k % 4 = 2) AS in_scope FROM contexts")
def repository_scope(v: Views) -> DataFrame:
    origin = F.when(F.col("k") % 4 == 2, "h/o")
    return v.contexts.agg(F.count_if(a.in_scope(F.col("cwd"), origin, "/r1/s1", None)).alias("inside"), F.count_if(a.in_scope(F.col("cwd"), origin, "/r1/s1", "h/o")).alias("in_scope"))


