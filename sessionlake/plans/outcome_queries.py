"""Queries of the outcome operators over orders as pull requests and lines as checks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import outcomes as o
from .measure_queries import rounded
from .registry import Views, query

DAY = 86_400_000_000
NOW = 11_000 * DAY


@query("""WITH x AS (SELECT pr, name, {div:us:31536000000000} AS us, ok, pos, part FROM checks), b AS (SELECT pr, name, max(us) AS u FROM (SELECT pr, name, us FROM x GROUP BY 1, 2, 3 HAVING count(DISTINCT ok) > 1) GROUP BY 1, 2)
SELECT x.pr, x.name, x.us, x.ok, x.part FROM x LEFT JOIN b ON x.pr = b.pr AND x.name = b.name WHERE u IS NULL OR x.us > u""")
def check_conflicts(v: Views) -> DataFrame:
    return o.without_conflicts(v.checks.withColumn("us", F.expr("us div 31536000000000")), ["pr", "name"], "ok").select("pr", "name", "us", "ok", "part")


@query(f"""SELECT c.pr, c.part, c.us, CASE WHEN p.status = 'O' THEN 'not_merged' WHEN c.part % 7 = 0 THEN 'other_commit' WHEN c.us > p.merged_us THEN 'after_merge' WHEN NOT c.ok THEN 'incomplete' END AS gap FROM checks c JOIN pulls p ON c.pr = p.pr""")
def checks_at_merge(v: Views) -> DataFrame:
    p = v.pulls.select("pr", F.when(F.col("status") != "O", F.col("merged_us")).alias("merged_us"), F.lit("AB").alias("head_sha"))
    c = v.checks.withColumns({"sha": F.when(F.col("part") % 7 != 0, "ab").otherwise("cd"), "complete": F.col("ok")})
    return o.at_merge(c, p).select("pr", "part", "us", "gap")


RUNS = """WITH l AS (SELECT pr, name, kind, arg_max(ok, (us, pos * 100000 + part)) AS g FROM (SELECT *, pos % 2 = 0 AS kind FROM checks) GROUP BY 1, 2, 3),
n AS (SELECT pr, name, bool_and(g) AS g FROM l GROUP BY 1, 2), r AS (SELECT pr, CASE slot WHEN 0 THEN [] WHEN 1 THEN ['0'] WHEN 2 THEN ['1', '2'] END AS names FROM pulls),
u AS (SELECT r.pr, unnest(names) AS name FROM r), j AS (SELECT u.pr, bool_or(n.g IS NULL) AS miss, bool_and(coalesce(n.g, true)) AS g FROM u LEFT JOIN n ON u.pr = n.pr AND u.name = n.name GROUP BY 1),
v AS (SELECT r.pr, CASE WHEN names IS NULL OR coalesce(miss, false) THEN 'unknown' WHEN coalesce(g, true) THEN 'green' ELSE 'red' END AS verdict FROM r LEFT JOIN j ON r.pr = j.pr) """


def verdicts(v: Views) -> DataFrame:
    c = v.checks.withColumns({"kind": F.col("pos") % 2 == 0, "pos": F.col("pos") * 100_000 + F.col("part")})
    names = F.expr("CASE slot WHEN 0 THEN CAST(array() AS array<string>) WHEN 1 THEN array('0') WHEN 2 THEN array('1', '2') END")
    return o.checks_verdict(c.where("kind"), c.where("not kind"), v.pulls.select("pr", names.alias("names")))


@query(RUNS + "SELECT pr, verdict FROM v")
def checks_verdict(v: Views) -> DataFrame:
    return verdicts(v)


@query("""WITH vals AS (SELECT pr, name AS context, pos % 3 AS app, CASE WHEN bool_or(part % 10 = 0) THEN 'red' WHEN bool_or(part % 10 = 1) THEN 'unknown' ELSE 'green' END AS value FROM checks GROUP BY 1, 2, 3),
req AS (SELECT pr, CASE WHEN slot > 0 THEN CAST(slot % 3 AS STRING) END AS context, CASE WHEN slot = 2 THEN 1 END AS app FROM pulls),
w AS (SELECT r.pr, max(CASE WHEN v.value = 'red' THEN 2 WHEN v.value = 'green' THEN 0 ELSE 1 END) AS k, 'current_policy' AS basis FROM req r LEFT JOIN vals v ON r.pr = v.pr AND r.context = v.context AND (r.app IS NULL OR r.app = v.app) WHERE r.context IS NOT NULL GROUP BY 1
  UNION ALL SELECT r.pr, max(CASE WHEN v.value = 'red' THEN 2 WHEN v.value = 'green' THEN 0 ELSE 1 END), 'all_visible' FROM req r LEFT JOIN vals v ON r.pr = v.pr WHERE r.context IS NULL GROUP BY 1)
SELECT pr, CASE k WHEN 2 THEN 'red' WHEN 1 THEN 'unknown' ELSE 'green' END AS verdict, basis FROM w""")
def policy_verdict(v: Views) -> DataFrame:
    t = F.col("part") % 10
    values = v.checks.groupBy("pr", F.col("name").alias("context"), (F.col("pos") % 3).alias("app")).agg(F.when(F.bool_or(t == 0), "red").when(F.bool_or(t == 1), "unknown").otherwise("green").alias("value"))
    required = v.pulls.select("pr", F.when(F.col("slot") > 0, (F.col("slot") % 3).cast("string")).alias("context"), F.when(F.col("slot") == 2, F.lit(1).cast("long")).alias("app"))
    return o.policy_verdict(values, required)


LATER = "later AS (SELECT p.repo, CASE WHEN p.pr % 2 = 0 THEN 'pull' ELSE 'commit' END AS kind, q.merged_us + (p.pr % 10) * 86400000000 AS us, CASE p.pr % 3 WHEN 0 THEN 'Fixes #' WHEN 1 THEN 'revert of #' ELSE 'see #' END || CAST(q.pr AS STRING) AS text, q.pr AS ref FROM pulls p JOIN pulls q ON q.pr = {div:p.pr:3} AND p.repo = q.repo)"


def later(v: Views) -> DataFrame:
    p, q = v.pulls, v.pulls.select(F.col("pr").alias("q"), F.col("merged_us").alias("m"), F.col("repo").alias("r"))
    both = p.join(q, (F.expr("pr div 3") == F.col("q")) & (F.col("repo") == F.col("r")))
    text = F.concat(F.when(F.col("pr") % 3 == 0, "Fixes #").when(F.col("pr") % 3 == 1, "revert of #").otherwise("see #"), F.col("q").cast("string"))
    rows = both.select("repo", F.when(F.col("pr") % 2 == 0, "pull").otherwise("commit").alias("kind"), (F.col("m") + (F.col("pr") % 10) * DAY).alias("us"), text.alias("text"))
    return o.references(rows)


@query(f"WITH {LATER} SELECT p.pr, count(*) FILTER (kind = 'pull' AND NOT starts_with(text, 'see')) AS follow_ups, count(*) FILTER (kind = 'commit' AND starts_with(text, 'revert')) AS reverts, count(*) FILTER (kind = 'commit' AND starts_with(text, 'Fixes')) AS fixes FROM pulls p JOIN later l ON p.repo = l.repo AND p.pr = l.ref AND l.us > p.merged_us AND l.us < p.merged_us + 604800000000 GROUP BY 1")
def disturbances(v: Views) -> DataFrame:
    return o.disturbances(v.pulls, later(v))


ATTEMPTS = RUNS.replace("WITH l", "WITH RECURSIVE l") + f""", f AS (SELECT a.pr, a.pr * 2 AS repair FROM pulls a JOIN pulls b ON b.pr = a.pr * 2 WHERE a.pr > 0),
own AS (SELECT p.pr, CASE WHEN status = 'O' THEN CASE WHEN slot = 1 THEN 'failed' ELSE 'in_progress' END WHEN verdict = 'red' OR p.pr % 11 = 0 THEN 'failed' WHEN merged_us + 604800000000 > {NOW} THEN 'immature' WHEN verdict = 'unknown' THEN 'unverified' ELSE 'success' END AS own FROM pulls p JOIN v ON p.pr = v.pr),
ordered AS (SELECT own.pr, own, repair FROM own LEFT JOIN f ON own.pr = f.pr),
st AS (SELECT pr, own AS state, 0 AS d FROM ordered WHERE repair IS NULL UNION ALL SELECT o.pr, CASE WHEN st.state = 'success' THEN o.own ELSE 'failed' END, d + 1 FROM ordered o JOIN st ON o.repair = st.pr) """


def attempts(v: Views) -> DataFrame:
    p = v.pulls.join(verdicts(v), "pr").select("pr", F.when(F.col("status") != "O", F.col("merged_us")).alias("merged_us"), (F.col("slot") == 1).alias("closed"), F.col("verdict").alias("checks"), (F.col("pr") % 11 == 0).alias("reverted"))
    follow = v.pulls.where("pr > 0").select("pr", (F.col("pr") * 2).alias("repair")).join(v.pulls.select(F.col("pr").alias("repair")), "repair", "left_semi")
    return o.attempt_states(p, follow, NOW)


@query(ATTEMPTS + "SELECT pr, state FROM st")
def attempt_states(v: Views) -> DataFrame:
    return attempts(v)


JUDGED = ATTEMPTS + f""", d AS (SELECT p.author * 4 + p.slot AS deliverable, min(p.merged_us) - 1000 AS dispatched_us, min(CASE st.state WHEN 'failed' THEN 0 WHEN 'in_progress' THEN 1 WHEN 'immature' THEN 2 WHEN 'unverified' THEN 3 ELSE 4 END) AS k, max(CASE WHEN status <> 'O' THEN merged_us END) AS c, bool_or(slot = 3 AND p.pr % 2 = 0) AS retry, bool_or(p.pr % 9 = 0) AS no FROM pulls p JOIN st ON p.pr = st.pr GROUP BY 1),
jd AS (SELECT *, CASE WHEN k = 4 AND no THEN 'in_progress' ELSE ['failed', 'in_progress', 'immature', 'unverified', 'success'][k + 1] END AS state FROM d),
jj AS (SELECT deliverable, state, CASE WHEN state <> 'in_progress' THEN c END AS closed_us, CASE WHEN state <> 'in_progress' THEN c END - dispatched_us AS elapsed_us, state = 'success' AND NOT retry AS first_pass, CASE WHEN k = 4 AND no THEN 'human_acceptance_pending' END AS reason FROM jd) """


def judged(v: Views) -> DataFrame:
    p = v.pulls.join(attempts(v), "pr").withColumn("deliverable", F.col("author") * 4 + F.col("slot"))  # an author's pull requests of one slot
    parts = p.select("deliverable", (F.col("merged_us") - 1000).alias("dispatched_us"), "state", F.when(F.col("status") != "O", F.col("merged_us")).alias("closed_us"), ((F.col("slot") == 3) & (F.col("pr") % 2 == 0)).alias("retry"), F.when(F.col("pr") % 9 == 0, "n").otherwise("y").alias("human"))
    return o.judge(parts)


@query(JUDGED + "SELECT * FROM jj")
def deliverable_states(v: Views) -> DataFrame:
    return judged(v)


@query(JUDGED + """, s AS (SELECT CASE WHEN orders.o_orderkey % 3 <> 0 THEN o_custkey * 4 + o_orderkey % 4 END AS deliverable, CAST(round(o_totalprice) AS BIGINT) AS tokens FROM orders), w AS (SELECT count(*) FILTER (state = 'success') AS wins FROM jj)
SELECT wins, round(CASE WHEN wins > 0 THEN (SELECT sum(tokens) FROM s) / wins END, 6) AS operational, round(CASE WHEN wins > 0 THEN (SELECT sum(tokens) FROM s WHERE deliverable IS NOT NULL) / wins END, 6) AS operational_linked,
 round(CASE WHEN wins > 0 THEN (SELECT sum(tokens) FROM s JOIN jj ON s.deliverable = jj.deliverable WHERE state IN ('success', 'failed')) / wins END, 6) AS cohort FROM w""")
def cost_per_success(v: Views) -> DataFrame:
    spend = v.table("orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") * 4 + F.col("o_orderkey") % 4).alias("deliverable"), F.round("o_totalprice").cast("long").alias("tokens"))
    return rounded(o.cost_per_success(judged(v), spend))


@query("SELECT author AS deliverable, ['unknown', 'all_visible', 'current_policy', 'historical'][min(CASE slot WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END)] AS basis FROM pulls GROUP BY 1")
def checks_basis(v: Views) -> DataFrame:
    basis = F.expr("CASE slot WHEN 0 THEN 'historical' WHEN 1 THEN 'current_policy' WHEN 2 THEN 'all_visible' ELSE 'unknown' END")
    return o.checks_basis(v.pulls.select(F.col("author").alias("deliverable"), basis.alias("basis")))


@query("WITH p AS (SELECT DISTINCT cwd || CASE WHEN k % 3 = 0 THEN '_x' ELSE '' END AS value FROM contexts WHERE cwd IS NOT NULL), i AS (SELECT DISTINCT CASE WHEN k % 2 = 0 THEN 'r' || CAST(k % 3 AS STRING) ELSE 's' || CAST(k % 3 AS STRING) || '_x' END AS id FROM ev) SELECT value, id FROM p JOIN i ON regexp_matches(value, '(^|[^A-Za-z0-9])' || id || '($|[^A-Za-z0-9])')")
def id_mentions(v: Views) -> DataFrame:
    n = (F.col("k") % 3).cast("string")
    ids = v.ev.select(F.when(F.col("k") % 2 == 0, F.concat(F.lit("r"), n)).otherwise(F.concat(F.lit("s"), n, F.lit("_x"))).alias("id"))
    return o.id_mentions(v.contexts.where("cwd IS NOT NULL").select(F.concat("cwd", F.when(F.col("k") % 3 == 0, "_x").otherwise("")).alias("value")), ids)


@query("""WITH d AS (SELECT ord AS deliverable, k % 3 AS project, us AS a, CASE WHEN k % 5 <> 0 THEN us + 86400000000 END AS z FROM models), e AS (SELECT ord, k % 3 AS project, us FROM usage),
j AS (SELECT e.ord, min(deliverable) AS x, max(deliverable) AS y FROM e LEFT JOIN d ON e.project = d.project AND e.us >= a AND (z IS NULL OR e.us <= z) GROUP BY 1)
SELECT ord, CASE WHEN x = y THEN x END AS deliverable, CASE WHEN x IS NULL THEN 'unallocated' WHEN x = y THEN 'linked' ELSE 'ambiguous' END AS bucket FROM j""")
def open_deliverables(v: Views) -> DataFrame:
    d = v.models.select(F.col("ord").alias("deliverable"), (F.col("k") % 3).alias("project"), F.col("us").alias("dispatched_us"), F.when(F.col("k") % 5 != 0, F.col("us") + DAY).alias("closed_us"))
    return o.open_during(v.usage.select("ord", (F.col("k") % 3).alias("project"), "us"), d)


@query("""WITH e AS (SELECT session_id, max(us) AS edit FROM models GROUP BY 1), c AS (SELECT p.session_id, p.us, CASE WHEN k % 7 <> 0 THEN us - (k % 4) * 3600000000 END AS s, CASE WHEN k % 6 <> 0 THEN k % 2 END AS code, k % 5 <> 0 AS here FROM pairs p WHERE kind = 'tool_end'),
a AS (SELECT session_id, max(us) AS last_us, max(us) FILTER (k % 2 = 0) AS done FROM ev WHERE us < $UNTIL + 691200000000 GROUP BY 1),
x AS (SELECT c.*, edit, max(us) OVER (PARTITION BY c.session_id) AS m FROM c JOIN e ON c.session_id = e.session_id WHERE us > edit),
l AS (SELECT session_id, bool_or(coalesce(s <= edit OR s > us, true)) AS early, bool_and(here) AS here, min(code) AS lo, max(code) AS hi, count(*) FILTER (code IS NULL) AS unk FROM x WHERE us = m GROUP BY 1),
r AS (SELECT a.session_id, CASE WHEN edit IS NULL THEN 'no_known_edit' WHEN $UNTIL + 691200000000 - last_us <= 3600000000 AND (done IS NULL OR done < last_us) THEN 'recent_activity' WHEN lo IS NULL AND early IS NULL THEN 'no_check_after_last_edit' WHEN early THEN 'check_start_not_after_last_edit' WHEN NOT here THEN 'verification_cwd_unconfirmed'
  WHEN unk > 0 OR lo <> hi THEN 'last_check_exit_unknown' WHEN lo = 0 THEN 'last_check_passed' ELSE 'last_check_failed' END AS reason FROM a LEFT JOIN e ON a.session_id = e.session_id LEFT JOIN l ON a.session_id = l.session_id)
SELECT session_id, CASE reason WHEN 'no_known_edit' THEN 'no_change' WHEN 'recent_activity' THEN 'in_progress' WHEN 'last_check_passed' THEN 'success' WHEN 'last_check_failed' THEN 'failed' ELSE 'unverified' END AS state, reason FROM r""")
def local_states(v: Views) -> DataFrame:
    from .bridge import UNTIL

    until = UNTIL + 8 * DAY
    edits = v.models.select("session_id", "us")
    checks = v.pairs.where("kind = 'tool_end'").select("session_id", "us", F.when(F.col("k") % 7 != 0, F.col("us") - (F.col("k") % 4) * 3_600_000_000).alias("start_us"), F.when(F.col("k") % 6 != 0, F.col("k") % 2).alias("exit_code"), (F.col("k") % 5 != 0).alias("here"))
    activity = v.ev.where(F.col("us") < until).groupBy("session_id").agg(F.max("us").alias("last_us"), F.max(F.when(F.col("k") % 2 == 0, F.col("us"))).alias("completed_us"))
    return o.local_state(edits, checks, activity, until, 60)


@query("SELECT session_id, CASE WHEN count(cache_write) = count(*) THEN CAST(sum(cache_write) AS BIGINT) END AS cache_write, CAST(sum(output) AS BIGINT) AS output FROM usage GROUP BY 1")
def token_measurement(v: Views) -> DataFrame:
    return o.token_measurement(v.usage, ("cache_write", "output"))


@query("""WITH c AS (SELECT o_custkey AS worker, {div:o_orderkey:4} AS pr, CASE o_orderstatus WHEN 'F' THEN 'created' WHEN 'P' THEN 'pushed' ELSE 'branch' END AS evidence FROM orders),
b AS (SELECT worker, pr, max(CASE evidence WHEN 'created' THEN 2 WHEN 'pushed' THEN 1 ELSE 0 END) AS rank FROM c GROUP BY 1, 2)
SELECT worker, pr, CASE rank WHEN 2 THEN 'created' WHEN 1 THEN 'pushed' ELSE 'branch' END AS evidence, rank FROM b WHERE rank > 0 OR pr NOT IN (SELECT pr FROM b WHERE rank > 0)""")
def strongest_links(v: Views) -> DataFrame:
    c = v.table("orders").selectExpr("o_custkey AS worker", "o_orderkey div 4 AS pr", "CASE o_orderstatus WHEN 'F' THEN 'created' WHEN 'P' THEN 'pushed' ELSE 'branch' END AS evidence")
    return o.strongest_links(c, {"created": 2, "pushed": 1, "branch": 0})


@query("WITH RECURSIVE w AS (SELECT s.session_id, p.session_id AS ancestor, 1 AS steps, p.parent_id FROM sessions s JOIN sessions p ON s.parent_id = p.session_id AND s.agent = p.agent UNION ALL SELECT w.session_id, p.session_id, steps + 1, p.parent_id FROM w JOIN sessions p ON w.parent_id = p.session_id JOIN sessions a ON a.session_id = w.ancestor AND a.agent = p.agent WHERE steps < 64) SELECT session_id, ancestor, steps FROM w WHERE session_id <> ancestor")
def ancestor_chains(v: Views) -> DataFrame:
    return o.ancestors(v.sessions)


@query("SELECT CASE WHEN k % 3 = 0 THEN 'a' ELSE 'b' END AS reason, count(DISTINCT (session_id, k % 7)) AS n FROM ev GROUP BY 1")
def evidence_gaps(v: Views) -> DataFrame:
    return o.evidence_gaps(v.ev.select(F.when(F.col("k") % 3 == 0, "a").otherwise("b").alias("reason"), F.col("session_id").alias("identity"), (F.col("k") % 7).alias("item")))


@query(f"SELECT pr, CASE WHEN merged_us + 50 * 86400000000 < {NOW} THEN 'closed' ELSE 'open' END AS state, CASE WHEN merged_us + 50 * 86400000000 < {NOW} THEN merged_us + 50 * 86400000000 END AS merged_us FROM pulls WHERE merged_us < {NOW}")
def pulls_as_of(v: Views) -> DataFrame:
    p = v.pulls.select("pr", "repo", F.col("merged_us").alias("created_us"), (F.col("merged_us") + 50 * DAY).alias("closed_us"), (F.col("merged_us") + 50 * DAY).alias("merged_us"))
    return o.as_of(p, p.select("repo", F.col("pr").alias("sha"), F.col("created_us").alias("us")), NOW)[0].select("pr", "state", "merged_us")


@query("""WITH c AS (SELECT repo, CAST(slot AS STRING) AS context, CASE WHEN status = 'O' THEN -1 ELSE author END AS app FROM pulls), r AS (SELECT repo, status AS context, author AS app FROM pulls), x AS (SELECT DISTINCT repo, CAST(slot + 2 AS STRING) AS context FROM pulls),
b AS (SELECT repo, context, CASE WHEN app <> -1 THEN app END AS app FROM (SELECT * FROM c UNION ALL SELECT * FROM r))
SELECT repo, context, app FROM b UNION SELECT repo, context, NULL FROM x WHERE (repo, context) NOT IN (SELECT repo, context FROM b)""")
def required_checks(v: Views) -> DataFrame:
    p = v.pulls
    classic = p.selectExpr("repo", "CAST(slot AS STRING) AS context", "CASE WHEN status = 'O' THEN -1 ELSE author END AS app")
    return o.required_checks(classic, p.selectExpr("repo", "status AS context", "author AS app"), p.selectExpr("repo", "CAST(slot + 2 AS STRING) AS context"))


@query("SELECT pr, min({div:us:86400000000} * 100000 + part) AS place, arg_min(name, {div:us:86400000000} * 100000 + part) AS sha FROM checks WHERE ok GROUP BY 1")
def merge_results(v: Views) -> DataFrame:
    c = v.checks.select("pr", F.expr("us div 86400000000 * 100000 + part").alias("place"), F.col("name").alias("sha"), F.when(F.col("ok"), 1).otherwise(0).alias("usable"))
    return o.merge_results(c)
