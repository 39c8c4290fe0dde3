"""Queries of the delegation estimate and groups: a day of a user's events is a session dispatched by the user of half the number, whose own events are its parent's."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import delegations as d
from .bridge import SINCE, UNTIL, written
from .registry import Views, query

AGENT = "CASE WHEN {0} % 3 = 1 THEN 'codex' ELSE 'claude' END"


def both(columns: str, source: str) -> str:
    """Rows of a view under the user's own session and under the day's."""
    user = f"SELECT {AGENT.format('e.user_id')} AS agent, 'u' || CAST(e.user_id AS STRING) AS session_id, {columns} FROM ev e JOIN {source} s ON e.ord = s.ord"
    day = f"SELECT CASE WHEN {{div:e.user_id:2}} % 3 = 1 THEN 'codex' ELSE 'claude' END, 'u' || CAST(e.user_id AS STRING) || ':' || CAST({{div:e.us:86400000000}} AS STRING), {columns} FROM ev e JOIN {source} s ON e.ord = s.ord"
    return f"{user} UNION ALL {day}"


TABLES = {
    "dses": """SELECT agent, session_id, parent_id, CASE WHEN user_id % 9 <> 4 THEN lo END AS start_us, CASE WHEN user_id % 8 <> 6 THEN hi END AS last_us FROM (
      SELECT user_id, CASE WHEN {div:user_id:2} % 3 = 1 THEN 'codex' ELSE 'claude' END AS agent, 'u' || CAST(user_id AS STRING) || ':' || CAST({div:us:86400000000} AS STRING) AS session_id, 'u' || CAST({div:user_id:2} AS STRING) AS parent_id, min(us) AS lo, max(us) AS hi FROM ev GROUP BY 1, 2, 3, 4
      UNION ALL SELECT user_id, CASE WHEN user_id % 3 = 1 THEN 'codex' ELSE 'claude' END, 'u' || CAST(user_id AS STRING), NULL, min(us), max(us) FROM ev GROUP BY 1, 2, 3)""",
    "dreq": both("s.us, s.ord, CASE WHEN s.k % 17 <> 0 THEN new_input + coalesce(cache_write, 0) + cache_read END AS context, new_input, cache_write, cache_read, CASE WHEN s.k % 13 <> 0 THEN output END AS output", "usage"),
    "duse": both("s.us, s.ord", "usage") + " UNION ALL " + both("s.us, s.ord", "(SELECT ord, us FROM models WHERE model IS NULL)"),
    "dcom": both("CASE WHEN e.user_id % 10 <> 3 THEN s.us END AS us", "contexts"),
    "dgap": both("s.us - 86400000000 AS from_us, CASE WHEN s.k % 22 = 0 THEN s.us END AS to_us", "(SELECT ord, us, k FROM contexts WHERE cwd IS NULL AND agent = 'open')"),
}


@query("WITH " + ", ".join(f"{k} AS ({s})" for k, s in TABLES.items()) + """, c AS (SELECT c.*, p.session_id IS NOT NULL AS found FROM dses c LEFT JOIN dses p ON p.agent = c.agent AND p.session_id = c.parent_id WHERE c.parent_id IS NOT NULL),
pr AS (SELECT c.agent, c.session_id, max(r.us) AS latest FROM c JOIN dreq r ON r.agent = c.agent AND r.session_id = c.parent_id AND r.us <= start_us GROUP BY 1, 2),
px AS (SELECT pr.agent, pr.session_id, latest, CASE WHEN count(DISTINCT context) = 1 AND count(context) = count(*) THEN max(context) END AS p FROM pr JOIN c ON pr.agent = c.agent AND pr.session_id = c.session_id JOIN dreq r ON r.agent = c.agent AND r.session_id = c.parent_id AND r.us = latest GROUP BY 1, 2, 3),
um AS (SELECT DISTINCT u.*, r.ord IS NOT NULL AS has FROM duse u LEFT JOIN dreq r ON u.agent = r.agent AND u.session_id = r.session_id AND u.us = r.us AND u.ord = r.ord),
lu AS (SELECT c.agent, c.session_id, arg_max(um.has, (um.us, um.ord)) AS has FROM c JOIN um ON um.agent = c.agent AND um.session_id = c.parent_id AND um.us <= start_us GROUP BY 1, 2),
cm AS (SELECT c.agent, c.session_id, bool_or(m.us IS NULL) AS unclear, max(m.us) FILTER (m.us <= start_us) AS stop, min(m.us) FILTER (m.us > last_us) AS bound FROM c JOIN dcom m ON m.agent = c.agent AND m.session_id = c.parent_id GROUP BY 1, 2),
x AS (SELECT c.*, px.latest, px.p, lu.has, unclear, stop, bound FROM c LEFT JOIN px ON c.agent = px.agent AND c.session_id = px.session_id LEFT JOIN lu ON c.agent = lu.agent AND c.session_id = lu.session_id LEFT JOIN cm ON c.agent = cm.agent AND c.session_id = cm.session_id),
tl AS (SELECT x.agent, x.session_id, count(*) AS tail FROM x JOIN dreq r ON r.agent = x.agent AND r.session_id = x.parent_id AND r.us > last_us AND (bound IS NULL OR r.us < bound) GROUP BY 1, 2),
un AS (SELECT DISTINCT x.agent, x.session_id, true AS unseen FROM x JOIN um ON um.agent = x.agent AND um.session_id = x.parent_id AND NOT um.has AND um.us > last_us AND (bound IS NULL OR um.us < bound)),
gp AS (SELECT DISTINCT x.agent, x.session_id, true AS gap FROM x JOIN dgap g ON g.agent = x.agent AND g.session_id = x.parent_id AND NOT coalesce(to_us <= last_us, false) AND NOT coalesce(from_us >= bound, false)),
lost AS (SELECT agent, session_id FROM um WHERE NOT um.has UNION SELECT agent, session_id FROM dgap),
own AS (SELECT agent, session_id, count(*) AS n, bool_or(us < $SINCE OR us >= $UNTIL) AS outside, bool_or(context IS NULL OR cache_read IS NULL OR (agent <> 'codex' AND cache_write IS NULL)) AS nokind, arg_min(context, (us, ord)) AS f, arg_max(context, (us, ord)) AS l, sum(context) AS s, (array_agg(output ORDER BY us DESC, ord DESC))[1] AS result, sum(new_input + coalesce(cache_write, 0)) AS fresh, sum(cache_read) AS reused FROM dreq GROUP BY 1, 2),
z AS (SELECT x.*, n, f, l, s, result, fresh, reused, coalesce(tail, 0) AS tail, CASE WHEN NOT found OR start_us IS NULL THEN 'parent_or_dispatch_unobserved' WHEN latest IS NULL THEN 'parent_request_unobserved' WHEN NOT x.has THEN 'parent_latest_request_unobserved' WHEN p IS NULL THEN 'parent_context_unobserved_or_conflicting'
  WHEN unclear THEN 'carry_compaction_time_unobserved' WHEN stop > latest THEN 'parent_context_compacted' WHEN n IS NULL OR outside THEN 'child_scope_incomplete' WHEN lost.session_id IS NOT NULL THEN 'child_requests_incomplete' WHEN nokind THEN 'child_token_kinds_unobserved' WHEN last_us IS NULL THEN 'carry_activity_time_unobserved' WHEN gap OR unseen THEN 'carry_parent_requests_incomplete' WHEN result IS NULL THEN 'carry_returned_result_unobserved' END AS reason
  FROM x LEFT JOIN own ON x.agent = own.agent AND x.session_id = own.session_id LEFT JOIN tl ON x.agent = tl.agent AND x.session_id = tl.session_id LEFT JOIN un ON x.agent = un.agent AND x.session_id = un.session_id LEFT JOIN gp ON x.agent = gp.agent AND x.session_id = gp.session_id LEFT JOIN lost ON x.agent = lost.agent AND x.session_id = lost.session_id)
SELECT agent, session_id, reason, CAST(CASE WHEN reason IS NULL THEN fresh END AS BIGINT) AS actual_fresh, CAST(CASE WHEN reason IS NULL THEN greatest(fresh - f, 0) END AS BIGINT) AS inline_fresh, CAST(CASE WHEN reason IS NULL THEN reused + result * tail END AS BIGINT) AS actual_reused,
 CAST(CASE WHEN reason IS NULL THEN n * (p - f) + f + s - l + (l - f) * tail END AS BIGINT) AS inline_reused, CAST(CASE WHEN reason IS NULL THEN result * tail END AS BIGINT) AS actual_carry, CAST(CASE WHEN reason IS NULL THEN (l - f) * tail END AS BIGINT) AS inline_carry FROM z""")
def delegation_estimates(v: Views) -> DataFrame:
    names = ("ev", "usage", "models", "contexts")
    views = {name: getattr(v, name) for name in names}
    t = {k: v.spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", r"\1 {\2}", written(s, "spark")), **views) for k, s in TABLES.items()}
    return d.delegation_estimates(t["dses"], t["dreq"], t["duse"], t["dcom"], t["dgap"], SINCE, UNTIL)


@query("""WITH a AS (SELECT CASE WHEN {div:user_id:2} % 3 = 1 THEN 'codex' ELSE 'claude' END AS agent, 'u' || CAST(user_id AS STRING) || ':' || CAST({div:us:86400000000} AS STRING) AS session_id, 'u' || CAST({div:user_id:2} AS STRING) AS parent_id, '/r' || CAST(k % 4 AS STRING) AS project, sum(cents) AS total FROM ev GROUP BY 1, 2, 3, 4
 UNION ALL SELECT CASE WHEN user_id % 3 = 1 THEN 'codex' ELSE 'claude' END, 'u' || CAST(user_id AS STRING), NULL, '/r' || CAST(k % 2 AS STRING), sum(cents) FROM ev GROUP BY 1, 2, 3, 4),
g AS (SELECT 'all' AS level, NULL AS g_agent, NULL AS g_project, * FROM a UNION ALL SELECT 'agent', agent, NULL, * FROM a UNION ALL SELECT 'project+agent', agent, project, * FROM a),
s AS (SELECT level, g_agent, g_project, agent, session_id, parent_id, sum(total) AS total FROM g GROUP BY 1, 2, 3, 4, 5, 6),
c AS (SELECT * FROM s WHERE parent_id IS NOT NULL), q AS (SELECT DISTINCT level, g_agent, g_project, agent, parent_id AS session_id FROM c WHERE (agent, parent_id) IN (SELECT agent, session_id FROM a)),
p AS (SELECT q.*, coalesce(s.total, 0) AS total FROM q LEFT JOIN s ON q.level = s.level AND q.g_agent IS NOT DISTINCT FROM s.g_agent AND q.g_project IS NOT DISTINCT FROM s.g_project AND q.agent = s.agent AND q.session_id = s.session_id),
u AS (SELECT level, g_agent, g_project, count(*) AS children, 0 AS parents, sum(total) AS child_total, 0 AS parent_total FROM c GROUP BY 1, 2, 3 UNION ALL SELECT level, g_agent, g_project, 0, count(*), 0, sum(total) FROM p GROUP BY 1, 2, 3)
SELECT level, g_agent AS agent, g_project AS project, CAST(sum(children) AS BIGINT) AS children, CAST(sum(parents) AS BIGINT) AS parents, CAST(sum(child_total) AS BIGINT) AS child_total, round(sum(child_total) / nullif(sum(child_total) + sum(parent_total), 0), 6) AS child_share FROM u GROUP BY 1, 2, 3""")
def delegation_groups(v: Views) -> DataFrame:
    user = lambda n: F.when(F.expr(n) % 3 == 1, "codex").otherwise("claude")
    e = v.ev
    day = e.select(user("user_id div 2").alias("agent"), F.expr("'u' || user_id || ':' || (us div 86400000000)").alias("session_id"), F.expr("'u' || (user_id div 2)").alias("parent_id"), F.expr("'/r' || (k % 4)").alias("project"), "cents")
    own = e.select(user("user_id"), F.expr("'u' || user_id"), F.lit(None).cast("string"), F.expr("'/r' || (k % 2)"), "cents")
    spent = day.union(own).groupBy("agent", "session_id", "parent_id", "project").agg(F.sum("cents").alias("total"))
    return d.delegation_groups(spent).withColumn("child_share", F.round("child_share", 6))
