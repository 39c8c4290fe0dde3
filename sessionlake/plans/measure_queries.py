"""Queries of the report aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import within
from ..operators import fold, timing
from ..operators import measures as m
from .bridge import SINCE, UNTIL
from .registry import Views, query

KINDS = ("new_input", "cache_write", "cache_read", "output", "reasoning_output")
SUMS = ", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}, count(*) - count({k}) AS {k}_unreported" for k in KINDS)
INSIDE = "us >= $SINCE AND us < $UNTIL"

#: Per session: tokens, calls, errors and active time in the window.
PROFILE = f"""
WITH a AS (SELECT session_id, CAST(sum(CASE WHEN nx - us <= 36000000000 THEN greatest(0, least(nx, $UNTIL) - greatest(us, $SINCE)) ELSE 0 END) AS BIGINT) AS active_us
  FROM (SELECT session_id, us, lead(us) OVER (PARTITION BY session_id ORDER BY us) AS nx FROM (SELECT DISTINCT session_id, us FROM ev)) GROUP BY 1),
t AS (SELECT session_id, CAST(sum(total) AS BIGINT) AS total, CAST(sum(cache_read) AS BIGINT) AS cache_read FROM usage WHERE {INSIDE} GROUP BY 1),
c AS (SELECT session_id, count(*) FILTER (kind = 'tool_start') AS calls, count(*) FILTER (kind = 'tool_end' AND k % 10 = 0) AS errors FROM pairs WHERE {INSIDE} GROUP BY 1),
prof AS (SELECT s.session_id, s.agent, s.role, s.parent_id, t.total, t.cache_read, coalesce(c.calls, 0) AS calls, coalesce(c.errors, 0) AS errors, a.active_us
  FROM sessions s JOIN t ON s.session_id = t.session_id LEFT JOIN c ON s.session_id = c.session_id JOIN a ON s.session_id = a.session_id) """


def inside(df: DataFrame) -> DataFrame:
    return df.where(within(F.col("us"), SINCE, UNTIL))


def profiles(v: Views) -> DataFrame:
    active = timing.active(v.ev, SINCE, UNTIL, (600,)).withColumnRenamed("active_600m_us", "active_us")
    tokens = inside(v.usage).groupBy("session_id").agg(F.sum("total").alias("total"), F.sum("cache_read").alias("cache_read"))
    calls = inside(v.pairs).groupBy("session_id").agg(F.count_if(F.col("kind") == "tool_start").alias("calls"), F.count_if((F.col("kind") == "tool_end") & (F.col("k") % 10 == 0)).alias("errors"))
    return v.sessions.drop("user_id").join(tokens, "session_id").join(calls, "session_id", "left").fillna(0, ["calls", "errors"]).join(active, "session_id")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"SELECT count(*) AS events, count(DISTINCT session_id) AS sessions, CAST(sum(total) AS BIGINT) AS total, {SUMS} FROM usage WHERE {INSIDE}")
def report_totals(v: Views) -> DataFrame:
    return m.totals(inside(v.usage))


@query(f"SELECT a.agent, coalesce(events, 0) AS events, coalesce(total, 0) AS total, {', '.join(f'{k}, {k}_unreported' for k in KINDS)} FROM (SELECT DISTINCT agent FROM ev UNION SELECT c_mktsegment FROM customer) a LEFT JOIN (SELECT agent, count(*) AS events, CAST(sum(total) AS BIGINT) AS total, {SUMS} FROM usage WHERE {INSIDE} GROUP BY 1) u ON a.agent = u.agent")
def totals_by_agent(v: Views) -> DataFrame:
    agents = v.ev.select("agent").union(v.table("customer").select("c_mktsegment"))
    return m.by_agent(inside(v.usage), agents)


@query(PROFILE + """SELECT role, count(*) AS sessions, round(count(*) / 14.0, 6) AS sessions_per_day, CAST(sum(total) AS BIGINT) AS total, round(sum(total) / 14.0, 6) AS tokens_per_day, round(median(total), 6) AS median_total,
 CAST(sum(calls) AS BIGINT) AS calls, round(sum(errors) / sum(calls), 6) AS error_rate, round(sum(cache_read) / sum(calls), 6) AS cache_read_per_call, CAST(sum(active_us) AS BIGINT) AS active_us,
 count(*) FILTER (active_us > 36000000000) AS long_sessions, CAST(coalesce(sum(total) FILTER (active_us > 36000000000), 0) AS BIGINT) AS long_total, round(coalesce(sum(total) FILTER (active_us > 36000000000), 0) / sum(total), 6) AS long_share FROM prof GROUP BY 1""")
def role_profile(v: Views) -> DataFrame:
    return rounded(m.role_profile(profiles(v), ["role"], 14.0, 36_000_000_000))


@query(PROFILE + ", r AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY total DESC, session_id) AS r, count(*) OVER (PARTITION BY agent) AS n FROM prof) SELECT agent, count(*) FILTER (r <= (n + 9) // 10) AS top_sessions, CAST(sum(total) FILTER (r <= (n + 9) // 10) AS BIGINT) AS top_total, round(sum(total) FILTER (r <= (n + 9) // 10) / sum(total), 6) AS top_share FROM r GROUP BY 1")
def top_decile(v: Views) -> DataFrame:
    return rounded(m.top_decile(profiles(v), ["agent"]))


MODELS = "SELECT u.*, x.model FROM usage u ASOF LEFT JOIN (SELECT session_id, us, max(model) AS model FROM models GROUP BY 1, 2) x ON u.session_id = x.session_id AND u.us >= x.us"


def with_model(v: Views) -> DataFrame:
    return fold.value_at(v.usage, v.models.select("session_id", "us", "ord", "model"), "model", "model", False)


@query(f"WITH w AS ({MODELS}), s AS (SELECT session_id, array_to_string(list_sort(list_distinct(list(model) FILTER (model IS NOT NULL))), '+') AS models, sum(total) AS total FROM w GROUP BY 1) SELECT coalesce(models, '') AS models, count(*) AS sessions, CAST(sum(total) AS BIGINT) AS total FROM s GROUP BY 1")
def model_sets(v: Views) -> DataFrame:
    return m.model_sets(with_model(v))


TOOLS = "CASE k % 6 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'mcp__x' WHEN 3 THEN 'ns.grep' WHEN 4 THEN 'zzz' END"


@query("""WITH p AS (SELECT session_id, id, min(us) FILTER (kind = 'tool_start') AS s, max(us) FILTER (kind = 'tool_end') AS e, any_value(k % 20 % 4) AS c FROM pairs GROUP BY 1, 2)
SELECT c, count(*) AS paired_calls, CAST(floor(median(e - s)) AS BIGINT) AS median_us, quantile_disc(e - s, 0.9) AS p90_us FROM p WHERE e >= s AND s >= $SINCE AND s < $UNTIL GROUP BY 1""")
def tool_latency(v: Views) -> DataFrame:
    p = v.pairs.withColumn("c", F.col("k") % 20 % 4)
    pairs = fold.pair_intervals(p.where("kind = 'tool_start'"), p.where("kind = 'tool_end'"), ("session_id", "id", "c"))
    ok = pairs.where(F.col("valid") & within(F.col("start_us"), SINCE, UNTIL)).withColumn("took", F.col("end_us") - F.col("start_us"))
    return rounded(m.latency(ok, ["c"]))


@query("WITH p AS (SELECT parent_id, count(*) AS n FROM sessions WHERE parent_id IS NOT NULL GROUP BY 1) SELECT count(*) AS parents, CAST(sum(n) AS BIGINT) AS children, max(n) AS children_max, round(median(n), 6) AS children_median FROM p")
def fan_out(v: Views) -> DataFrame:
    return rounded(m.fan_out(v.sessions))


@query(PROFILE + """SELECT CASE GROUPING(agent) * 2 + GROUPING(role) WHEN 0 THEN 'agent+role' WHEN 1 THEN 'agent' WHEN 2 THEN 'role' ELSE 'all' END AS level, agent, role, count(*) AS sessions, CAST(sum(total) AS BIGINT) AS total, CAST(sum(calls) AS BIGINT) AS calls
FROM prof GROUP BY GROUPING SETS ((), (agent), (role), (agent, role))""")
def profile_groups(v: Views) -> DataFrame:
    return m.breakdowns(profiles(v), [(), ("agent",), ("role",), ("agent", "role")], F.count("*").alias("sessions"), F.sum("total").alias("total"), F.sum("calls").alias("calls"))


REQUESTS = """
WITH q AS (SELECT session_id, us, ord, agent, output, CASE WHEN k % 17 <> 0 THEN new_input + coalesce(cache_write, 0) + coalesce(cache_read, 0) END AS context FROM usage),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us, ord) AS n, us >= $SINCE AND us < $UNTIL AS i FROM q),
per AS (SELECT session_id, count(*) FILTER (i) AS calls, count(*) FILTER (i AND context IS NULL) AS unobserved, CAST(sum(context) FILTER (i) AS BIGINT) AS context_total, median(context) FILTER (i) AS context_median,
  quantile_disc(context, 0.9) FILTER (i) AS context_p90, max(context) FILTER (i) AS context_max, bool_or(i AND n = 1) AS starts, CASE WHEN bool_or(i AND n = 1) THEN max(context) FILTER (n = 1) END AS first_context,
  CASE WHEN bool_or(i AND n = 1) AND count(*) FILTER (n <= 5 AND context IS NULL) = 0 THEN CAST(sum(context) FILTER (n <= 5) AS BIGINT) END AS first_sum FROM n GROUP BY 1 HAVING count(*) FILTER (i) > 0) """


def requests(v: Views) -> DataFrame:
    u = v.usage.withColumn("new_input", F.when(F.col("k") % 17 != 0, F.col("new_input")))
    return u.select("session_id", "us", "ord", "agent", "output", m.context_size().alias("context"))


@query(REQUESTS + "SELECT * FROM per")
def calls_per_session(v: Views) -> DataFrame:
    return m.calls(requests(v), SINCE, UNTIL)


@query(REQUESTS.replace("$SINCE", "0") + """SELECT a.*, b.* FROM (SELECT count(*) AS count, round(median(context), 6) AS context_median, quantile_disc(context, 0.9) AS context_p90, max(context) AS context_max FROM n WHERE i) a,
(SELECT count(*) AS sessions_with_calls, round(median(calls), 6) AS per_session_median, CAST(sum(unobserved) AS BIGINT) AS unobserved, count(*) FILTER (starts) AS start_sessions, round(median(first_context), 6) AS first_context_median, round(median(first_sum), 6) AS first_sum_median, CAST(sum(first_sum) AS BIGINT) AS first_sum_total FROM per) b""")
def pooled_calls(v: Views) -> DataFrame:
    r = requests(v)
    return rounded(m.pooled_calls(r, m.calls(r, 0, UNTIL), 0, UNTIL))


@query(PROFILE + """, ch AS (SELECT session_id, total, true AS c FROM prof WHERE parent_id IS NOT NULL), pa AS (SELECT session_id, total FROM prof WHERE session_id IN (SELECT parent_id FROM prof)),
b AS (SELECT session_id, total FROM ch UNION SELECT session_id, total FROM pa)
SELECT (SELECT count(*) FROM ch) AS children, (SELECT count(*) FROM pa) AS parents, CAST((SELECT sum(total) FROM ch) AS BIGINT) AS child_total, round((SELECT sum(total) FROM ch) / (SELECT sum(total) FROM b), 6) AS child_share""")
def delegation_share(v: Views) -> DataFrame:
    return rounded(m.delegation(profiles(v)))


@query("""WITH RECURSIVE e AS (SELECT session_id, CASE WHEN user_id % 11 = 3 THEN 'u' || CAST((user_id + 11) % 22 AS STRING) ELSE parent_id END AS parent_id FROM sessions),
w AS (SELECT session_id, parent_id AS up, 0 AS depth FROM e UNION ALL SELECT w.session_id, e.parent_id, depth + 1 FROM w JOIN e ON w.up = e.session_id WHERE depth < 40)
SELECT e.session_id, max(depth) FILTER (up IS NULL) AS depth FROM e LEFT JOIN w ON e.session_id = w.session_id GROUP BY 1""")
def nesting_depth(v: Views) -> DataFrame:
    odd = F.when(F.col("user_id") % 11 == 3, F.concat(F.lit("u"), ((F.col("user_id") + 11) % 22).cast("string"))).otherwise(F.col("parent_id"))
    # The view's parents are of any agent, so the agent is left out.
    return m.nesting_depth(v.sessions.withColumn("parent_id", odd).drop("agent")).select("session_id", F.col("depth").cast("int").alias("depth"))


@query(REQUESTS + """, o AS (SELECT session_id, agent, avg(context) AS mean, sum(greatest(context - 2000, 0)) AS a, sum(greatest(context - 10000, 0)) AS b FROM q WHERE context IS NOT NULL GROUP BY 1, 2)
SELECT agent, count(*) AS sessions, round(median(mean), 6) AS mean_median, round(quantile_disc(mean, 0.9), 6) AS mean_p90, CAST(sum(a) AS BIGINT) AS above_2000, CAST(sum(b) AS BIGINT) AS above_10000 FROM o GROUP BY 1""")
def context_exposure(v: Views) -> DataFrame:
    return rounded(m.context_exposure(requests(v), (2000, 10_000), ["agent"]))


@query("WITH r AS (SELECT cache_read / new_input AS r FROM usage WHERE cache_read > 0 AND new_input > 0) SELECT count(*) AS pairs, round(median(r), 6) AS median, round(quantile_disc(r, 0.1), 6) AS p10, round(quantile_disc(r, 0.9), 6) AS p90, round(count(*) FILTER (r < 0.5) / count(*), 6) AS below_half FROM r")
def break_even(v: Views) -> DataFrame:
    out = m.break_even(v.usage.select(F.col("cache_read").alias("reused"), F.col("new_input").alias("fresh")), (0.5,))
    return rounded(out.withColumnRenamed("below_0.5", "below_half"))


@query(f"WITH w AS ({MODELS}), x AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'beta-1' WHEN k % 3 = 1 THEN 'gamma' END AS requested FROM w) SELECT coalesce(model, 'unknown') AS model, CASE WHEN model IS NULL OR requested IS NULL THEN 'unknown' WHEN model = requested THEN 'requested' ELSE 'unrequested' END AS status, count(*) AS events, CAST(sum(total) AS BIGINT) AS total FROM x GROUP BY 1, 2")
def model_status(v: Views) -> DataFrame:
    return m.model_status(with_model(v).withColumn("requested", F.expr("CASE WHEN k % 3 = 0 THEN 'beta-1' WHEN k % 3 = 1 THEN 'gamma' END")))


@query("""WITH e AS (SELECT session_id, CASE WHEN k % 8 <> 0 THEN '/r' || CAST(k % 3 AS STRING) || '/f' || CASE WHEN k % 2 = 0 THEN '.py' ELSE '.md' END END AS target, '/r' || CAST(user_id % 3 AS STRING) AS root FROM ev WHERE kind = 'model'),
o AS (SELECT *, coalesce(NOT starts_with(target, root || '/'), false) AS o FROM e), s AS (SELECT session_id, bool_and(o) AS a FROM o GROUP BY 1)
SELECT count(*) AS edits, count(*) FILTER (o) AS outside, count(*) FILTER (o AND ends_with(target, '.py')) AS outside_scripts, count(*) FILTER (target IS NULL) AS unobserved, (SELECT count(*) FROM s WHERE a) AS sessions_all_outside FROM o""")
def edit_friction(v: Views) -> DataFrame:
    e = v.ev.where("kind = 'model'").selectExpr("session_id", "CASE WHEN k % 8 <> 0 THEN '/r' || CAST(k % 3 AS STRING) || '/f' || CASE WHEN k % 2 = 0 THEN '.py' ELSE '.md' END END AS target", "'/r' || CAST(user_id % 3 AS STRING) AS root")
    return m.edit_friction(e)


HOOKS = """
WITH i AS (SELECT * FROM (SELECT *, 't' || CAST(k % 4 AS STRING) AS tool, row_number() OVER (PARTITION BY session_id, id ORDER BY us, ord) AS n FROM pairs WHERE kind = 'tool_start') WHERE n = 1),
o AS (SELECT * FROM (SELECT *, k % 3 = 0 AS d, row_number() OVER (PARTITION BY session_id, id ORDER BY us, ord) AS n FROM pairs WHERE kind = 'tool_end') WHERE n = 1),
h AS (SELECT i.session_id, i.id, i.us AS called_us, i.ord AS called_ord, i.tool, coalesce(o.us < i.us, false) AS invalid, CASE WHEN o.us >= i.us THEN o.us END AS result_us, CASE WHEN o.us >= i.us THEN o.d END AS denied, i.agent, CAST(i.k % 5 AS STRING) AS reason
  FROM i LEFT JOIN o ON i.session_id = o.session_id AND i.id = o.id) """


def hooks(v: Views) -> DataFrame:
    p = v.pairs.withColumns({"tool": F.concat(F.lit("t"), (F.col("k") % 4).cast("string")), "denied": F.col("k") % 3 == 0})
    return m.hook_calls(p.where("kind = 'tool_start'"), p.where("kind = 'tool_end'"))


@query(HOOKS + "SELECT session_id, id, called_us, tool, invalid, result_us, denied FROM h")
def hook_calls(v: Views) -> DataFrame:
    return hooks(v).select("session_id", "id", "called_us", "tool", "invalid", "result_us", "denied")


@query(HOOKS + """, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY called_us, called_ord) AS rank FROM h),
d AS (SELECT *, (SELECT count(*) FROM r c WHERE c.session_id = r.session_id AND c.called_us <= r.result_us) AS kk FROM r WHERE denied)
SELECT d.session_id, d.called_ord, EXISTS (SELECT 1 FROM r g WHERE g.session_id = d.session_id AND g.tool = d.tool AND NOT g.denied AND g.rank BETWEEN d.kk + 1 AND d.kk + 3) AS recovered,
  coalesce((SELECT min(result_us) FROM r x WHERE x.session_id = d.session_id AND x.denied) < (SELECT min(result_us) FROM r x WHERE x.session_id = d.session_id AND NOT x.denied), true) AS first FROM d""")
def denial_recovery(v: Views) -> DataFrame:
    return m.denial_recovery(hooks(v)).select("session_id", "called_ord", "recovered", "first")


@query(HOOKS + """, c AS (SELECT agent, count(*) AS calls, count(*) FILTER (denied) AS denials, round(100 * count(*) FILTER (denied) / count(*), 6) AS per_100_calls FROM h GROUP BY 1),
t AS (SELECT agent, string_agg(reason || '=' || CAST(n AS STRING), ',' ORDER BY n DESC, reason) AS top_reasons FROM (SELECT agent, reason, count(*) AS n, row_number() OVER (PARTITION BY agent ORDER BY count(*) DESC, reason) AS r FROM h WHERE denied GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1)
SELECT c.*, t.top_reasons FROM c LEFT JOIN t ON c.agent = t.agent""")
def denial_summary(v: Views) -> DataFrame:
    more = v.pairs.where("kind = 'tool_start'").select(F.col("ord").alias("called_ord"), "agent", (F.col("k") % 5).cast("string").alias("reason"))
    return rounded(m.denial_summary(hooks(v).join(more, "called_ord"), ["agent"], 3))


LABELS = """
lab AS (SELECT *, row_number() OVER (ORDER BY ord) AS line FROM (SELECT ord, lpad(session_id, 9, '0') AS prefix, CASE WHEN k % 2 = 0 THEN agent END AS agent, CASE WHEN k % 3 <> 0 THEN {div:us:86400000000} * 86400000000 END AS us, 'l' || CAST(k % 3 AS STRING) AS lane, CASE WHEN k % 4 <> 0 THEN 'h' || CAST(k % 2 AS STRING) END AS host FROM contexts)),
ses AS (SELECT DISTINCT lpad(session_id, 9, '0') || 'x' AS session_id, agent FROM ev),
hit AS (SELECT s.session_id, coalesce(l.us, -4611686018427387904) AS from_us, lane, host, line, row_number() OVER (PARTITION BY s.session_id, coalesce(l.us, -4611686018427387904) ORDER BY line DESC) AS n FROM ses s JOIN lab l ON starts_with(s.session_id, l.prefix) AND (l.agent IS NULL OR l.agent = s.agent)),
seg AS (SELECT session_id, from_us, coalesce(lead(from_us) OVER (PARTITION BY session_id ORDER BY from_us), 4611686018427387904) AS to_us, lane, host FROM hit WHERE n = 1) """


def labels(v: Views) -> DataFrame:
    pick = v.contexts.selectExpr("ord", "lpad(session_id, 9, '0') AS prefix", "CASE WHEN k % 2 = 0 THEN agent END AS agent", "CASE WHEN k % 3 <> 0 THEN us div 86400000000 * 86400000000 END AS us", "'l' || CAST(k % 3 AS STRING) AS lane", "CASE WHEN k % 4 <> 0 THEN 'h' || CAST(k % 2 AS STRING) END AS host")
    return pick.withColumn("line", F.col("ord"))


def long_sessions(v: Views) -> DataFrame:
    return v.ev.select(F.concat(F.lpad("session_id", 9, "0"), F.lit("x")).alias("session_id"), "agent").distinct()


@query("WITH " + LABELS + "SELECT session_id, from_us, to_us, lane, host FROM seg")
def label_segments(v: Views) -> DataFrame:
    return m.label_segments(long_sessions(v), labels(v), ("lane", "host"))


@query("WITH " + LABELS + """, b AS (SELECT u.session_id, u.ord, any_value(u.total) AS total, max(lane) AS lane, max(host) AS host FROM (SELECT lpad(session_id, 9, '0') || 'x' AS session_id, ord, us, total FROM usage) u LEFT JOIN seg ON u.session_id = seg.session_id AND u.us >= from_us AND u.us < to_us GROUP BY 1, 2)
SELECT 'lane' AS dimension, coalesce(lane, 'unlabeled') AS value, count(DISTINCT session_id) AS sessions, count(*) AS events, CAST(sum(total) AS BIGINT) AS total FROM b GROUP BY 1, 2
UNION ALL SELECT 'host', coalesce(host, 'unlabeled'), count(DISTINCT session_id), count(*), CAST(sum(total) AS BIGINT) FROM b GROUP BY 1, 2""")
def label_rollup(v: Views) -> DataFrame:
    usage = v.usage.withColumn("session_id", F.concat(F.lpad("session_id", 9, "0"), F.lit("x")))
    return m.label_rollup(usage, m.label_segments(long_sessions(v), labels(v), ("lane", "host")), ("lane", "host"))


@query("WITH " + LABELS + ", x AS (SELECT prefix || CASE WHEN line % 4 = 0 THEN 'y' ELSE '' END AS prefix, agent, line FROM lab), j AS (SELECT * FROM x JOIN ses s ON starts_with(s.session_id, x.prefix) AND (x.agent IS NULL OR x.agent = s.agent)) SELECT (SELECT count(DISTINCT line) FROM j) AS matched_lines, (SELECT count(*) FROM x) - (SELECT count(DISTINCT line) FROM j) AS unmatched_lines, (SELECT count(DISTINCT session_id) FROM j) AS labelled_sessions")
def label_coverage(v: Views) -> DataFrame:
    from pyspark.sql import Window

    lines = labels(v).withColumn("line", F.row_number().over(Window.orderBy("ord"))).withColumn("prefix", F.concat("prefix", F.when(F.col("line") % 4 == 0, "y").otherwise("")))
    return m.label_coverage(long_sessions(v), lines)


PRICES = (("ALPHA-1", {"new_input": 3.0, "cache_write": 3.75, "cache_read": 0.3, "output": 15.0}), ("alpha-*", {"new_input": 1.0, "output": 5.0}), ("b*", {"new_input": 2.0, "cache_write": 2.0, "cache_read": 2.0, "output": 2.0}))


@query(f"""WITH w AS ({MODELS}), p AS (SELECT *, CASE WHEN lower(model) = 'alpha-1' THEN 0 WHEN lower(model) LIKE 'alpha-%' THEN 1 WHEN lower(model) LIKE 'b%' THEN 2 ELSE 3 END AS r FROM w),
c AS (SELECT agent, model, CASE r WHEN 0 THEN new_input * 3.0 + coalesce(cache_write, 0) * 3.75 + cache_read * 0.3 + output * 15.0 WHEN 1 THEN new_input * 1.0 + output * 5.0 WHEN 2 THEN total * 2.0 ELSE 0 END / 1e6 AS cost,
 CASE r WHEN 0 THEN 0 WHEN 1 THEN coalesce(cache_write, 0) + cache_read WHEN 2 THEN 0 ELSE total END AS unpriced FROM p)
SELECT CASE GROUPING(agent) * 2 + GROUPING(model) WHEN 1 THEN 'agent' WHEN 2 THEN 'model' ELSE 'all' END AS level, agent, model, round(sum(cost), 6) AS cost, CAST(sum(unpriced) AS BIGINT) AS unpriced FROM c GROUP BY GROUPING SETS ((), (agent), (model))""")
def priced_spend(v: Views) -> DataFrame:
    return m.breakdowns(m.priced(with_model(v), PRICES), [(), ("agent",), ("model",)], F.round(F.sum("cost"), 6).alias("cost"), F.sum("unpriced").alias("unpriced"))


@query(f"WITH w AS ({MODELS}), s AS (SELECT *, CASE WHEN model IS NULL THEN 'unknown' WHEN model LIKE 'alpha-%' OR model = 'gamma' THEN 'forbidden' ELSE 'allowed' END AS status FROM w) SELECT status, model, count(*) AS events, count(DISTINCT session_id) AS sessions, CAST(sum(total) AS BIGINT) AS total FROM s WHERE status <> 'allowed' GROUP BY 1, 2")
def forbidden_models(v: Views) -> DataFrame:
    return m.forbidden_models(with_model(v), ("alpha-?", "gamma"))


WINDOWS = """WITH x AS (SELECT CASE WHEN us < 1705276800000000 THEN 'before' ELSE 'after' END AS arm, * FROM usage WHERE us >= $SINCE AND us < $UNTIL),
l AS (SELECT arm, 'tokens' AS metric, sum(total) AS value FROM x GROUP BY 1 UNION ALL SELECT arm, 'events', count(*) FROM x GROUP BY 1 UNION ALL SELECT arm, 'output_share', sum(output) / sum(total) FROM x GROUP BY 1),
c AS (SELECT metric, max(CASE WHEN arm = 'before' THEN value END) AS b, max(CASE WHEN arm = 'after' THEN value END) AS a FROM l GROUP BY 1) """


def compared(v: Views) -> DataFrame:
    x = inside(v.usage).withColumn("arm", F.when(F.col("us") < 1_705_276_800_000_000, "before").otherwise("after"))
    wide = x.groupBy("arm").agg(F.sum("total").alias("tokens"), F.count("*").alias("events"), (F.sum("output") / F.sum("total")).alias("output_share"))
    long = wide.select("arm", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("tokens", "events", "output_share")])).alias("x")).select("arm", "x.*")
    return m.compare_windows(long, ["tokens"])


@query(WINDOWS + "SELECT metric, round(b, 6) AS before, round(a, 6) AS after, round(100 * (a - b) / b, 6) AS change_percent, CASE WHEN metric = 'tokens' THEN CASE WHEN a < b THEN 'better' WHEN a > b THEN 'worse' ELSE 'unchanged' END ELSE CASE WHEN a > b THEN 'better' WHEN a < b THEN 'worse' ELSE 'unchanged' END END AS direction FROM c")
def metric_changes(v: Views) -> DataFrame:
    return rounded(compared(v))


@query(WINDOWS + "SELECT metric, round(100 * (a - b) / b, 6) AS change_percent, CASE WHEN metric = 'events' THEN a > b ELSE a < b END AS met, CASE WHEN metric = 'events' THEN 100 * (a - b) / b <= -1.0 ELSE 100 * (a - b) / b >= 1.0 END AS revert FROM c WHERE metric IN ('events', 'tokens')")
def prediction_checks(v: Views) -> DataFrame:
    spark = v.spark
    expected = spark.sql("SELECT * FROM VALUES ('events', 'increase', 1.0D), ('tokens', 'decrease', 1.0D) AS t(metric, direction, threshold)")
    return rounded(m.predictions(compared(v), expected))


@query(f"WITH t AS (SELECT CAST(count(*) AS DOUBLE) AS events, CAST(count(DISTINCT session_id) AS DOUBLE) AS sessions, CAST(sum(total) AS DOUBLE) AS total FROM usage WHERE {INSIDE}) SELECT 'events' AS metric, events AS value FROM t UNION ALL SELECT 'sessions', sessions FROM t UNION ALL SELECT 'total', total FROM t")
def observation_metrics(v: Views) -> DataFrame:
    return m.unpivot(m.totals(inside(v.usage)), ("events", "sessions", "total"))
