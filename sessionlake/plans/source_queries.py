"""Queries of file pruning, recorded outcomes and executions over the bridge views."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import executions, pruning
from ..sources import recorded
from .bridge import SINCE
from .registry import Views, query

DAY = 86_400_000_000


@query("""
WITH RECURSIVE f AS (SELECT s.session_id, s.parent_id, max(us) AS latest FROM sessions s JOIN ev ON ev.session_id = s.session_id GROUP BY 1, 2),
need(session_id) AS (SELECT session_id FROM f WHERE latest >= $LATE UNION SELECT f.parent_id FROM need JOIN f ON f.session_id = need.session_id WHERE f.parent_id IS NOT NULL)
SELECT DISTINCT f.session_id, f.latest FROM need JOIN f ON f.session_id = need.session_id""", LATE=SINCE + 14 * DAY)  # fmt: skip
def window_files(v: Views) -> DataFrame:
    """A session is a file: those with an event of the month's last days, and all that their ancestors lie in."""
    latest = v.ev.groupBy("session_id").agg(F.max("us").alias("latest"))
    files = v.sessions.select("session_id", "parent_id").join(latest, "session_id").select(F.col("session_id").alias("path"), F.col("latest").alias("modified"), "latest", F.lit(True).alias("provable"), F.array("session_id").alias("ids"), F.array_compact(F.array("parent_id")).alias("parents"))
    return pruning.window_files(files, SINCE + 14 * DAY).select(F.col("path").alias("session_id"), "latest")


@query("""
WITH p AS (SELECT 'o/c' || CAST(author AS STRING) AS repo, pr, merged_us, slot, CASE slot WHEN 0 THEN merged_us WHEN 1 THEN merged_us - $DAY END AS closed_us FROM pulls),
g AS (SELECT *, slot = 1 AS gap FROM p)
SELECT repo, count(*) FILTER (NOT gap) AS pulls, count(*) FILTER (gap) AS gaps, count(*) FILTER (slot = 0) AS merged, bool_and(NOT gap) AS complete FROM g GROUP BY 1""", DAY=DAY)  # fmt: skip
def recorded_pulls(v: Views) -> DataFrame:
    """An author's pull requests are a repository's document. One slot's are merged, another's closed before they merged, the others' are open."""
    iso = lambda us: F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    merged, closed = F.col("slot") < 2, F.when(F.col("slot") == 0, F.col("merged_us")).when(F.col("slot") == 1, F.col("merged_us") - DAY)
    sha = F.sha1(F.col("pr").cast("string").cast("binary"))
    response = F.struct(
        (F.col("pr") + 1).alias("number"), F.when(merged, "closed").otherwise("open").alias("state"), merged.alias("merged"), iso(F.col("merged_us") - 2 * DAY).alias("created_at"), iso(closed).alias("closed_at"), iso(F.when(merged, F.col("merged_us"))).alias("merged_at"),
        F.struct(sha.alias("sha")).alias("head"), F.when(merged, sha).alias("merge_commit_sha"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("body"),
    )
    entry = F.struct(response.alias("response"), F.lit(None).cast("string").alias("checks_at_merge"))
    docs = v.pulls.withColumn("entry", entry).groupBy("author").agg(F.collect_list("entry").alias("pulls"))  # an author's few
    document = F.struct(F.concat(F.lit("O/C"), F.col("author").cast("string")).alias("repository"), F.lit("1990-01-01T00:00:00Z").alias("coverage_start"), F.lit("2100-01-01T00:00:00Z").alias("observed_at"), F.lit(True).alias("pulls_complete"), F.lit(True).alias("commits_complete"), "pulls", F.array().cast("array<string>").alias("commits"))
    text = F.to_json(document, {"ignoreNullFields": "false"})
    r = recorded.taken_apart(docs.select(F.col("author").cast("string").alias("path"), F.parse_json(text).alias("record")))
    good = r.pulls.groupBy("repo").agg(F.count("*").alias("pulls"), F.count("merged_us").alias("merged"))
    bad = r.violations.groupBy("repo").agg(F.count("*").alias("gaps"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return r.observations.join(good, "repo", "left").join(bad, "repo", "left").select("repo", zero("pulls"), zero("gaps"), zero("merged"), F.col("pulls_complete").alias("complete"))


@query("""
WITH x AS (SELECT *, CASE WHEN k % 4 <> 0 THEN '/w' || CAST(k % 2 AS STRING) END AS cwd, k % 9 = 0 AS deferred, CASE k % 3 WHEN 0 THEN 'launch' WHEN 1 THEN 'interval' END AS mode, CASE WHEN k % 5 <> 0 THEN us - 1000000 * (k % 2) END AS own FROM pairs),
l AS (SELECT *, last_value(CASE WHEN kind = 'tool_start' THEN {'at': us, 'cwd': cwd, 'deferred': deferred, 'command': 'c' || CAST(k % 7 AS STRING)} END IGNORE NULLS) OVER (PARTITION BY session_id, id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM x),
e AS (SELECT *, a.at IS NOT NULL AND own <> a.at AS clash, a.at IS NOT NULL AND a.cwd IS DISTINCT FROM cwd AS apart FROM l WHERE kind = 'tool_end' AND NOT (coalesce(mode = 'launch', false) AND k % 2 = 0 AND a.at IS NULL)),
o AS (SELECT session_id, id, ord, us AS end_us, CASE WHEN mode = 'launch' THEN a.command END AS command, CASE WHEN coalesce(mode = 'launch', false) AND coalesce(a.deferred, false) THEN NULL ELSE k % 2 END AS exit_code,
  CASE WHEN mode = 'launch' THEN a.at WHEN mode = 'interval' THEN CASE WHEN coalesce(clash, false) THEN NULL ELSE coalesce(own, a.at) END ELSE own END AS start_us,
  CASE WHEN mode = 'launch' THEN a.cwd WHEN mode = 'interval' THEN CASE WHEN coalesce(clash, false) OR apart THEN NULL ELSE cwd END ELSE cwd END AS cwd FROM e)
SELECT session_id, id, end_us, command, exit_code, start_us, cwd FROM (SELECT *, row_number() OVER (PARTITION BY session_id, id ORDER BY ord DESC) AS n FROM o) WHERE n = 1""")
def command_executions(v: Views) -> DataFrame:
    k, start = F.col("k"), F.col("kind") == "tool_start"
    none = F.lit(None)
    x = v.pairs.select(
        "session_id", "id", "us", "ord", F.when(start, "start").otherwise("end").alias("phase"), F.when(start, none).when(k % 3 == 0, "launch").when(k % 3 == 1, "interval").alias("pairing"), F.when(start, F.concat(F.lit("c"), (k % 7).cast("string"))).alias("command"), (k % 2).alias("exit_code"),
        F.when(start, F.col("us")).when(k % 5 != 0, F.col("us") - 1_000_000 * (k % 2)).alias("at_us"), F.when(k % 4 != 0, F.concat(F.lit("/w"), (k % 2).cast("string"))).alias("cwd"), F.lit(True).alias("cwd_given"), (start & (k % 9 == 0)).alias("deferred"), (~start & (k % 3 == 0) & (k % 2 == 0)).alias("require_pair"), none.cast("boolean").alias("error"),
    )
    return executions.executions(x).select("session_id", "id", "end_us", "command", "exit_code", "start_us", "cwd")
