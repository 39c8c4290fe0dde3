"""Queries of the worker operators: an order is a pull request and the session of the worker that it stems from, a line one of its commands."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import measures as m
from ..operators import workers as w
from ..operators.attribution import Rule
from .bridge import SINCE, UNTIL
from .measure_queries import LABELS, labels, long_sessions
from .registry import Views, query

#: Views in a form that both engines read ({div:a:b}).
LIFE = "SELECT pr AS session_id, merged_us AS start_us, merged_us + 8640000000000 AS end_us FROM pulls"
RUNS = """SELECT pr AS session_id, part AS identity, CASE WHEN pos % 7 <> 0 THEN us - (pos % 5 - 1) * 3600000000 END AS started_us, us, CASE WHEN part % 3 = 0 THEN NULL WHEN ok THEN 0 ELSE 1 END AS exit_code,
 CASE WHEN part % 2 = 0 THEN part % 5 = 0 END AS error, name = '0' AS creates, name = '1' AS commits FROM checks"""
RESULTS = """SELECT pr AS session_id, part AS identity, us - 1800000000 AS us, CASE name WHEN '0' THEN 'pr_created' WHEN '1' THEN 'branch_committed' ELSE 'push_result' END AS kind, CASE WHEN name = '0' THEN CAST(pr - pos % 2 AS STRING) ELSE 'b' || CAST(pr % 5 AS STRING) END AS value FROM checks
 UNION ALL SELECT pr, part, us, CASE WHEN pos % 3 = 0 THEN 'pr_created' WHEN pos % 3 = 1 THEN 'branch_committed' ELSE 'push_result' END, CASE WHEN pos % 3 = 0 THEN CAST(pr AS STRING) ELSE 'b' || CAST(pr % 5 AS STRING) END FROM checks"""
PULLS = "SELECT CAST(pr AS STRING) AS pr, CAST(author AS STRING) AS repo, 'b' || CAST(pr % 5 AS STRING) AS branch, merged_us + (author % 40 - 5) * 86400000000 AS created_us, CASE WHEN status <> 'O' THEN merged_us + (slot * 30 + 20) * 86400000000 END AS closed_us FROM pulls"
HINTS = """SELECT pr AS session_id, us, CASE name WHEN '0' THEN 'context' WHEN '1' THEN 'own' ELSE 'refs' END AS source, CASE pos % 3 WHEN 0 THEN 'branch' WHEN 1 THEN 'branch_observed' ELSE 'pr' END AS kind,
 CASE WHEN pos % 3 = 2 THEN CAST(pr AS STRING) WHEN part % 10 <> 0 THEN 'b' || CAST(part % 5 AS STRING) END AS value FROM checks"""
OWN = "SELECT DISTINCT h.session_id, kind, value FROM hints h JOIN life l ON h.session_id = l.session_id AND h.us >= start_us AND h.us < end_us WHERE value IS NOT NULL AND (source = 'own' OR (source = 'context' AND kind = 'branch') OR (source = 'refs' AND kind <> 'branch'))"
AUTHORED = """x AS (SELECT e.*, start_us, end_us FROM runs e JOIN life l ON e.session_id = l.session_id AND e.us >= start_us AND e.us < end_us),
y AS (SELECT x.session_id, x.identity, x.us, started_us, start_us, end_us, exit_code, error, creates, commits, r.kind, r.value FROM x LEFT JOIN results r ON x.session_id = r.session_id AND x.identity = r.identity AND r.us BETWEEN x.started_us AND x.us AND r.us >= start_us AND r.us < end_us),
f AS (SELECT session_id, identity, us, count(DISTINCT value) FILTER (kind = 'pr_created') > 1 OR count(DISTINCT value) FILTER (kind = 'branch_committed') > 1 AS differs, count(*) FILTER (kind = 'push_result') > 0 AS pushed FROM y GROUP BY 1, 2, 3),
z AS (SELECT y.*, exit_code IS NULL AND coalesce(NOT error, false) AS output_only, CASE WHEN coalesce(error, false) OR (exit_code IS NOT NULL AND exit_code <> 0) OR (exit_code IS NULL AND coalesce(error, true)) THEN CASE WHEN exit_code IS NULL THEN 'authorship_exit_unknown' ELSE 'failed_authorship_commands' END
  WHEN started_us IS NULL OR started_us < start_us OR started_us >= end_us OR y.us < started_us OR differs THEN 'link_conflicts' END AS gap FROM y JOIN f ON y.session_id = f.session_id AND y.identity = f.identity AND y.us = f.us WHERE creates OR commits OR pushed),
authored AS (SELECT DISTINCT session_id, identity, us, CASE WHEN gap IS NULL THEN kind END AS kind, CASE WHEN gap IS NULL THEN value END AS value, output_only, gap FROM z
  WHERE gap IS NOT NULL OR kind = 'push_result' OR (kind = 'pr_created' AND creates) OR (kind = 'branch_committed' AND commits AND NOT output_only))"""
#: Links of ``act`` (authored rows with dispatched_us and repo) against ``prs``.
LINKED = """cand AS (SELECT a.*, p.pr, p.branch AS head, p.created_us, p.closed_us, false AS spread FROM (SELECT * FROM act WHERE kind = 'pr_created') a LEFT JOIN prs p ON a.value = p.pr UNION ALL SELECT a.*, p.pr, p.branch, p.created_us, p.closed_us, false FROM act a JOIN prs p ON a.kind <> 'pr_created' AND a.repo = p.repo AND a.value = p.branch),
ok AS (SELECT *, CASE kind WHEN 'pr_created' THEN 'pr_created' WHEN 'push_result' THEN 'pushed_branch' ELSE 'committed_branch' END || CASE WHEN output_only THEN '_output' ELSE '' END AS evidence, CASE kind WHEN 'pr_created' THEN 6 WHEN 'push_result' THEN 5 ELSE 4 END AS rank, CASE WHEN kind <> 'pr_created' THEN value END AS named, coalesce(created_us < dispatched_us, false) AS continued FROM (SELECT * REPLACE (coalesce(pr, value) AS pr) FROM cand)
  WHERE NOT (coalesce(created_us < dispatched_us, false) AND kind = 'pr_created') AND NOT coalesce(closed_us < us, false) AND NOT (kind = 'pr_created' AND coalesce(created_us > us, false)))"""
ALL = f"WITH life AS ({LIFE}), runs AS ({RUNS}), results AS ({RESULTS}), prs AS ({PULLS}), hints AS ({HINTS}), own AS ({OWN}), {AUTHORED}, "
#: A worker's parent is the worker of the author's next lower order key, as the ancestor of one and two steps.
CHAIN = "chain AS (SELECT session_id, lag(session_id) OVER (PARTITION BY author ORDER BY session_id) AS ancestor, 1 AS steps FROM (SELECT pr AS session_id, author FROM pulls) UNION ALL SELECT session_id, lag(session_id, 2) OVER (PARTITION BY author ORDER BY session_id), 2 FROM (SELECT pr AS session_id, author FROM pulls))"


def rows(v: Views, sql: str, *views: str) -> DataFrame:
    for name in views:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return v.spark.sql(sql, **{name: getattr(v, name) for name in views})


def life(v: Views) -> DataFrame:
    return rows(v, LIFE, "pulls")


def own(v: Views) -> DataFrame:
    return w.references(rows(v, HINTS, "checks"), life(v))


def authored(v: Views) -> DataFrame:
    return w.authorship(rows(v, RUNS, "checks"), rows(v, RESULTS, "checks"), life(v))


def scoped(v: Views) -> DataFrame:
    """Authored rows; the repository of a branch is the author's."""
    return authored(v).where("gap IS NULL").join(v.pulls.select(F.col("pr").alias("session_id"), F.col("author").cast("string").alias("repo")), "session_id")


@query(ALL + "q AS (SELECT 1) SELECT session_id, kind, value FROM own")
def worker_references(v: Views) -> DataFrame:
    return own(v)


@query(ALL + "q AS (SELECT 1) SELECT * FROM authored")
def worker_authorship(v: Views) -> DataFrame:
    return authored(v)


@query(ALL + f"""act AS (SELECT a.*, p.merged_us AS dispatched_us, CAST(p.author AS STRING) AS repo FROM authored a JOIN pulls p ON a.session_id = p.pr WHERE gap IS NULL), {LINKED}
SELECT session_id, pr, evidence, named AS branch, CASE WHEN continued THEN 'continued' ELSE 'constituent' END AS role, 'strong' AS strength FROM (SELECT *, row_number() OVER (PARTITION BY session_id, pr ORDER BY rank DESC, us, evidence, named) AS n FROM ok) WHERE n = 1""")
def worker_links(v: Views) -> DataFrame:
    dispatched = v.pulls.select(F.col("pr").alias("session_id"), F.col("merged_us").alias("dispatched_us"))
    return w.best_links(w.link_candidates(scoped(v), rows(v, PULLS, "pulls"), dispatched))


@query(ALL + CHAIN + f""", act AS (SELECT c.session_id, c.steps, a.us, a.kind, a.value, a.output_only, l.start_us AS dispatched_us, CAST(p.author AS STRING) AS repo FROM chain c JOIN life l ON c.session_id = l.session_id JOIN authored a ON a.session_id = c.ancestor AND a.us >= l.start_us AND a.us < l.end_us JOIN pulls p ON p.pr = c.ancestor WHERE gap IS NULL AND kind IN ('push_result', 'pr_created')), {LINKED},
s AS (SELECT ok.session_id, ok.pr, ok.us, steps, CASE WHEN kind = 'push_result' THEN 'ancestor_pushed_branch' ELSE 'ancestor_pr_created' END AS evidence, rank, coalesce(named, head) AS branch, CASE WHEN continued THEN 'continued' ELSE 'constituent' END AS role,
  CASE WHEN EXISTS (SELECT 1 FROM own o WHERE o.session_id = ok.session_id AND o.kind IN ('branch', 'branch_observed') AND o.value = coalesce(ok.named, ok.head)) THEN 'strong' ELSE 'weak' END AS strength FROM ok)
SELECT session_id, pr, evidence, branch, role, strength FROM (SELECT *, row_number() OVER (PARTITION BY session_id, pr ORDER BY strength = 'strong' DESC, rank DESC, steps, us, branch) AS n FROM s) WHERE n = 1""")
def inherited_links(v: Views) -> DataFrame:
    chains = rows(v, f"WITH {CHAIN} SELECT * FROM chain WHERE ancestor IS NOT NULL", "pulls")
    return w.inherited_links(life(v), chains, scoped(v).withColumn("gap", F.lit(None).cast("string")), rows(v, PULLS, "pulls"), own(v))


TARGETS = "SELECT pr AS session_id, part AS identity, CASE WHEN pos % 4 <> 0 THEN 'f' || CAST(pos % 12 AS STRING) END AS target FROM checks UNION ALL SELECT pr, part, 'f' || CAST(part % 12 AS STRING) FROM checks WHERE ok"
STATUS = "SELECT DISTINCT 'f' || CAST(pos % 9 AS STRING) AS target, CASE WHEN pos % 9 < 5 THEN 'in_scope' WHEN pos % 9 < 7 THEN 'edit_ignored' ELSE 'edit_outside_scope' END AS state FROM checks"


@query(f"""WITH life AS ({LIFE}), t AS ({TARGETS}), st AS ({STATUS}), e AS (SELECT pr AS session_id, part AS identity FROM checks c JOIN life l ON c.pr = l.session_id AND c.us >= start_us AND c.us < end_us),
x AS (SELECT DISTINCT e.session_id, e.identity, coalesce(state, 'edit_target_unknown') AS state FROM e LEFT JOIN t ON e.session_id = t.session_id AND e.identity = t.identity LEFT JOIN st ON t.target = st.target)
SELECT session_id, bool_or(state IN ('in_scope', 'edit_target_unknown')) AS changed, bool_or(state = 'in_scope') AS known, count(*) FILTER (state = 'edit_outside_scope') AS edit_outside_scope, count(*) FILTER (state = 'edit_ignored') AS edit_ignored, count(*) FILTER (state = 'edit_target_unknown') AS edit_target_unknown FROM x GROUP BY 1""")
def edit_scopes(v: Views) -> DataFrame:
    edits = v.checks.select(F.col("pr").alias("session_id"), F.col("part").alias("identity"), "us")
    return w.edit_scope(edits, rows(v, TARGETS, "checks"), rows(v, STATUS, "checks"), life(v))


#: What a worker did, from its order; its links are the author's pull requests of the same slot.
DONE = "SELECT pr AS session_id, status = 'F' AS edited, slot = 1 AS incomplete, CASE WHEN status = 'P' THEN true END AS authored FROM pulls"
JOINED = "SELECT a.pr AS session_id, b.pr, CASE WHEN b.status = 'P' THEN 'strong' ELSE 'weak' END AS strength FROM pulls a JOIN pulls b ON a.author = b.author AND a.slot = b.slot AND a.pr <> b.pr"
BROKEN = "SELECT pr, CASE WHEN bool_and(NOT ok) THEN 'checks_red' WHEN max(pos % 10) = 9 AND bool_or(NOT ok) THEN 'reverted' END AS reason FROM checks GROUP BY 1"


@query(f"""WITH d AS ({DONE}), j AS ({JOINED}), b AS ({BROKEN}), l AS (SELECT session_id, bool_or(strength = 'strong') AS strong, arg_min(reason, j.pr) FILTER (reason IS NOT NULL) AS broken FROM j LEFT JOIN b ON j.pr = b.pr GROUP BY 1),
c AS (SELECT d.session_id, edited OR incomplete OR coalesce(authored, false) OR coalesce(strong, false) AS changed, strong IS NOT NULL AS linked, broken FROM d LEFT JOIN l ON d.session_id = l.session_id)
SELECT c.session_id, CASE WHEN NOT changed THEN 'no_change' WHEN NOT linked THEN 'no_pr' WHEN broken IS NOT NULL THEN 'failed' WHEN status = 'O' THEN 'in_progress' ELSE 'success' END AS state, CASE WHEN NOT changed THEN 'no_known_edit' WHEN NOT linked THEN 'no_linked_pr' ELSE broken END AS reason FROM c JOIN pulls p ON c.session_id = p.pr""")
def worker_states(v: Views) -> DataFrame:
    pulls = v.pulls
    judged = pulls.select(F.col("pr").alias("session_id"), F.when(F.col("status") == "O", "in_progress").otherwise("success").alias("state"), F.lit(None).cast("string").alias("reason"))
    side = lambda a, b: pulls.select(F.col("pr").alias(a), "author", "slot", F.col("status").alias(b))
    links = side("session_id", "own").join(side("pr", "status"), ["author", "slot"]).where("session_id <> pr").select("session_id", "pr", F.when(F.col("status") == "P", "strong").otherwise("weak").alias("strength"))
    return w.worker_judgment(rows(v, DONE, "pulls"), links, judged, rows(v, BROKEN, "checks"))


@query(f"WITH prs AS ({PULLS}), h AS ({HINTS}), t AS (SELECT {{div:pr:8}} AS deliverable, 'pr' AS kind, CAST(pr AS STRING) AS value FROM pulls UNION ALL SELECT {{div:pr:8}}, 'branch', 'b' || CAST(slot AS STRING) || CAST(author AS STRING) FROM pulls), g AS (SELECT session_id, kind, CASE WHEN kind = 'pr' THEN value ELSE value || CAST(p.author AS STRING) END AS value FROM h JOIN pulls p ON h.session_id = p.pr) SELECT DISTINCT session_id, deliverable FROM g JOIN t ON g.value = t.value AND (g.kind = 'pr') = (t.kind = 'pr')")
def reference_matches(v: Views) -> DataFrame:
    p = v.pulls.withColumn("deliverable", F.expr("pr div 8"))
    targets = p.select("deliverable", F.lit("pr").alias("kind"), F.col("pr").cast("string").alias("value")).union(p.select("deliverable", F.lit("branch"), F.concat(F.lit("b"), F.col("slot").cast("string"), F.col("author").cast("string"))))
    hints = rows(v, HINTS, "checks").join(v.pulls.select(F.col("pr").alias("session_id"), "author"), "session_id")
    named = hints.select("session_id", "kind", F.when(F.col("kind") == "pr", F.col("value")).otherwise(F.concat("value", F.col("author").cast("string"))).alias("value"))
    return w.reference_matches(named, targets, ["session_id"])


RULES = (Rule("r1", origins=("github.com/o1/*",)), Rule("r2"), Rule("r3", origins=("github.com/*/r3", "github.com/o2/r2")))
LINKS = "SELECT CASE WHEN slot = 0 THEN 'other' ELSE 'project' END AS bucket, CASE WHEN status = 'O' THEN 'GitHub.com/o' || CAST(repo % 4 AS STRING) || '/r' || CAST(author % 5 AS STRING) END AS origin, 'r' || CAST(slot AS STRING) AS rule FROM pulls"


@query(f"""WITH l AS (SELECT DISTINCT * FROM ({LINKS}) WHERE bucket = 'project'), d AS (SELECT DISTINCT 'o' || CAST(repo % 4 AS STRING) AS o, 'r' || CAST(author % 5 AS STRING) AS r FROM pulls)
SELECT bucket, origin, rule, o || '/' || r AS repo FROM l JOIN d ON lower(origin) = 'github.com/' || o || '/' || r UNION ALL SELECT bucket, origin, rule, o || '/' || r FROM l JOIN d ON origin IS NULL AND ((rule = 'r1' AND o = 'o1') OR (rule = 'r2' AND r = 'r2') OR (rule = 'r3' AND (r = 'r3' OR (o = 'o2' AND r = 'r2'))))""")
def project_repositories(v: Views) -> DataFrame:
    repos = v.pulls.select(F.expr("'o' || (repo % 4) || '/r' || (author % 5)").alias("repo"))
    return w.project_repositories(rows(v, LINKS, "pulls"), repos, RULES)


@query("WITH " + LABELS + """, q AS (SELECT lpad(session_id, 9, '0') || 'x' AS session_id, us, ord, CASE WHEN k % 17 <> 0 THEN new_input + coalesce(cache_write, 0) + cache_read END AS context FROM usage),
g AS (SELECT q.*, (SELECT max(from_us) FROM seg WHERE seg.session_id = q.session_id AND from_us <= q.us) AS from_us FROM q), n AS (SELECT *, row_number() OVER (PARTITION BY session_id, from_us ORDER BY us, ord) AS n, us >= $SINCE AND us < $UNTIL AS inside FROM g)
SELECT session_id, from_us, max(context) FILTER (n = 1) AS first_context, CASE WHEN bool_and(NOT inside OR context IS NOT NULL) THEN CAST(sum(context) FILTER (inside) AS BIGINT) END AS first_sum FROM n WHERE n <= 5 GROUP BY 1, 2 HAVING bool_or(n = 1 AND inside)""")
def segment_starts(v: Views) -> DataFrame:
    requests = v.usage.select(F.concat(F.lpad("session_id", 9, "0"), F.lit("x")).alias("session_id"), "us", "ord", F.when(F.col("k") % 17 != 0, m.context_size()).alias("context"))
    return m.segment_starts(requests, m.label_segments(long_sessions(v), labels(v), ("lane",)), SINCE, UNTIL)
