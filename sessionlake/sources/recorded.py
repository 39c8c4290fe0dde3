"""Recorded outcomes of repositories (S8): a JSON document each, taken apart to tables, with what is wrong in it as rows.

A document says what was seen of a repository in an interval: pull requests with what checks said at their merge, and commits. ``Recorded`` has

* ``observations``: repo, path, start_us, until_us, pulls_complete, commits_complete;
* ``pulls``: repo, pr (repo#number), number, open, created_us, closed_us, merged_us, head_sha, merge_sha, head_ref, title, body, observed, has_snapshot, policy (variant);
* ``runs`` and ``statuses`` at a merge: repo, pr, pos, name, app_id, sha, us, started_us, complete, ok, captured_us, snapshot_sha; ``required``: repo, pr, names (null: not known);
* ``commits``: repo, sha, us, message;
* ``violations``: path, repo, pr, reason, structural.

A row whose evidence contradicts itself isn't in its table but in ``violations``, and voids the flag of its repository that says that all are there: the pull requests' for one of
them, the commits' for a commit. A document that can't be read as one at all, or whose repository another document has too, has only a violation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import strict_timestamp
from ..functions.storage import durable
from ..functions.variants import at, elements, flag, obj, string, type_of
from .vendor import whole

# ---- fixed values: fields and forms of the documents ----
FIELDS = ("repository", "coverage_start", "observed_at", "pulls_complete", "commits_complete", "pulls", "commits")
ENTRY_FIELDS, ENTRY_MORE = ("response", "checks_at_merge"), ("observed_checks_at_merge", "current_policy_evidence")
SNAPSHOT_FIELDS = ("head_sha", "captured_at", "required", "check_runs", "statuses")
REPOSITORY, SHA = r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$", r"^[0-9A-Fa-f]{40}(?:[0-9A-Fa-f]{24})?$"
GOOD, BAD = ("success", "neutral", "skipped"), ("failure", "cancelled", "timed_out", "action_required", "stale", "startup_failure")
RUN_STATES, STATUS_STATES = ("queued", "in_progress", "completed"), ("success", "pending", "failure", "error")
# ---- end of fixed values ----


@dataclass
class Recorded:
    observations: DataFrame
    pulls: DataFrame
    runs: DataFrame
    statuses: DataFrame
    required: DataFrame
    commits: DataFrame
    violations: DataFrame


def instant(v: Column) -> Column:
    return F.unix_micros(strict_timestamp(string(v)))


def null_or(v: Column, ok: Column) -> Column:
    """Whether a value is absent, a JSON null, or ``ok``."""
    return (F.coalesce(type_of(v), F.lit("VOID")) == "VOID") | F.coalesce(ok, F.lit(False))


def keys(v: Column) -> Column:
    return F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))


def is_sha(v: Column) -> Column:
    return F.coalesce(string(v).rlike(SHA), F.lit(False))


def first_of(*cases: tuple[Column, str]) -> Column:
    """The name of the first condition that holds; a null doesn't."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), reason).otherwise(out)
    return out


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path and record (variant; null: no JSON) of the documents under a folder."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return text.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("record"))


def headed(docs: DataFrame) -> DataFrame:
    """Documents with repo, interval and flags, and ``problem``."""
    r = F.col("record")
    rows = docs.withColumns({"repo": F.lower(string(at(r, "repository"))), "start_us": instant(at(r, "coverage_start")), "until_us": instant(at(r, "observed_at")), "all_pulls": flag(at(r, "pulls_complete")), "all_commits": flag(at(r, "commits_complete"))})
    times = F.count("*").over(Window.partitionBy("repo"))  # documents of a repository: a few
    problem = first_of(
        (obj(r).isNull(), "unreadable"),
        (keys(r) != F.array_sort(F.array(*[F.lit(f) for f in FIELDS])), "fields"),
        (~F.coalesce(F.col("repo").rlike(REPOSITORY), F.lit(False)), "repository"),
        (times > 1, "duplicate_repository"),
        (F.col("start_us").isNull() | F.col("until_us").isNull() | (F.col("start_us") >= F.col("until_us")), "coverage"),
        (F.col("all_pulls").isNull() | F.col("all_commits").isNull(), "completeness"),
        ((type_of(at(r, "pulls")) != "ARRAY") | (type_of(at(r, "commits")) != "ARRAY"), "arrays"),
    )
    return rows.withColumn("problem", problem)


def pulled(docs: DataFrame) -> DataFrame:
    """A row per pull request of sound documents, with ``problem`` (its form), ``gap`` (its instants contradict each other) and ``snapshot_problem``."""
    e = F.col("entry")
    p = at(e, "response")
    rows = docs.select("path", "repo", "until_us", F.posexplode(elements(at(F.col("record"), "pulls"))).alias("pos", "entry"))
    created, closed, merged = (instant(at(p, f"{c}_at")) for c in ("created", "closed", "merged"))
    number, head, merge, ref = whole(at(p, "number")), at(p, "head.sha"), at(p, "merge_commit_sha"), at(p, "head.ref")
    rows = rows.withColumns({
        "number": number, "state": string(at(p, "state")), "flagged": flag(at(p, "merged")), "created_us": created, "closed_us": closed, "merged_us": merged, "head_sha": F.lower(string(head)), "merge_sha": F.lower(string(merge)),
        "head_ref": string(ref), "title": string(at(p, "title")), "body": F.coalesce(string(at(p, "body")), F.lit("")), "observed": F.coalesce(string(at(e, "observed_checks_at_merge")), F.lit("unknown")), "policy": obj(at(e, "current_policy_evidence")),
        "snapshot": obj(at(e, "checks_at_merge")),
    })
    rows = rows.withColumn("pr", F.concat("repo", F.lit("#"), F.col("number").cast("string")))
    given = F.map_keys(F.try_variant_get(e, "$", "map<string,variant>"))
    times = F.when(F.col("pr").isNotNull(), F.count("*").over(Window.partitionBy("pr")))
    problem = first_of(
        (obj(e).isNull() | (F.size(F.array_except(F.array(*map(F.lit, ENTRY_FIELDS)), given)) > 0) | (F.size(F.array_except(given, F.array(*map(F.lit, ENTRY_FIELDS + ENTRY_MORE)))) > 0), "entry_fields"),
        (F.col("number").isNull() | (F.col("number") <= 0) | ~F.coalesce(F.col("state").isin("open", "closed"), F.lit(False)) | F.col("flagged").isNull(), "number_state_or_merged"),
        (times > 1, "duplicate_pull"),
        (F.col("created_us").isNull() | ~null_or(at(p, "closed_at"), closed.isNotNull()) | ~null_or(at(p, "merged_at"), merged.isNotNull()), "instants"),
        (~is_sha(head) | ~null_or(merge, is_sha(merge)), "sha"),
        (~null_or(ref, string(ref).isNotNull()) | F.col("title").isNull() | ~null_or(at(p, "body"), string(at(p, "body")).isNotNull()), "texts"),
        (~F.col("observed").isin("unknown", "green", "red"), "observed_label"),
    )
    is_merged, is_closed = F.col("merged_us").isNotNull(), F.col("closed_us").isNotNull()
    outside = lambda c: (F.col(c) < F.col("created_us")) | (F.col(c) >= F.col("until_us"))
    gap = (
        (is_merged != F.col("flagged")) | (is_merged & (F.col("merge_sha").isNull() | (F.col("state") != "closed"))) | ((F.col("state") == "closed") != is_closed) | (F.col("created_us") >= F.col("until_us"))
        | F.coalesce(outside("closed_us"), F.lit(False)) | F.coalesce(outside("merged_us"), F.lit(False)) | (is_merged & F.coalesce(F.col("closed_us") < F.col("merged_us"), ~is_closed))
    )
    return rows.withColumns({"problem": problem, "gap": F.coalesce(gap, F.lit(True)), "snapshot_problem": snapshot_problem(at(e, "checks_at_merge"))})


def snapshot_problem(v: Column) -> Column:
    """What is wrong with the form of what checks said; null for a sound snapshot and for none."""
    run_ok = lambda c: F.coalesce((string(at(c, "name")) != "") & is_sha(at(c, "head_sha")) & string(at(c, "status")).isin(*RUN_STATES) & null_or(at(c, "conclusion"), string(at(c, "conclusion")).isin(*GOOD, *BAD)) & null_or(at(c, "started_at"), instant(at(c, "started_at")).isNotNull()) & null_or(at(c, "completed_at"), instant(at(c, "completed_at")).isNotNull()) & null_or(at(c, "app.id"), whole(at(c, "app.id")) > 0), F.lit(False))
    status_ok = lambda s: F.coalesce((string(at(s, "context")) != "") & is_sha(at(s, "sha")) & instant(at(s, "updated_at")).isNotNull() & string(at(s, "state")).isin(*STATUS_STATES), F.lit(False))
    names = elements(at(v, "required"))
    found = F.filter(F.transform(names, string), lambda n: F.coalesce(n != "", F.lit(False)))
    ids = lambda field: F.filter(F.transform(elements(at(v, field)), lambda x: whole(at(x, "id"))), lambda i: i.isNotNull())
    unique = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    return F.when(
        type_of(v) != "VOID",
        first_of(
            (obj(v).isNull() | (keys(v) != F.array_sort(F.array(*[F.lit(f) for f in SNAPSHOT_FIELDS]))), "snapshot_fields"),
            (~is_sha(at(v, "head_sha")) | instant(at(v, "captured_at")).isNull(), "snapshot_head_or_instant"),
            (~null_or(at(v, "required"), (type_of(at(v, "required")) == "ARRAY") & (F.size(found) == F.size(names)) & unique(found)), "required_names"),
            ((type_of(at(v, "check_runs")) != "ARRAY") | ~F.forall(elements(at(v, "check_runs")), run_ok) | ~unique(ids("check_runs")), "check_runs"),
            ((type_of(at(v, "statuses")) != "ARRAY") | ~F.forall(elements(at(v, "statuses")), status_ok) | ~unique(ids("statuses")), "statuses"),
        ),
    )


def recorded(spark: SparkSession, path: str) -> Recorded:
    """S8. The tables of the documents under a folder."""
    return taken_apart(documents(spark, path))


def taken_apart(docs: DataFrame) -> Recorded:
    """S8. The tables of documents (path, record as a variant). They are read for each table's start; pull requests and commits are stored."""
    docs = headed(docs)
    heads = durable(docs.select("path", "repo", "start_us", "until_us", "all_pulls", "all_commits", "problem"))
    sound = docs.where("problem IS NULL")
    pulls = durable(pulled(sound).drop("entry"))
    c = F.col("commit")
    rows = sound.select("path", "repo", "start_us", "until_us", F.explode(elements(at(F.col("record"), "commits"))).alias("commit"))
    rows = rows.select("path", "repo", "start_us", "until_us", F.lower(string(at(c, "sha"))).alias("sha"), instant(at(c, "commit.committer.date")).alias("us"), string(at(c, "commit.message")).alias("message"))
    bad = first_of((~F.coalesce(F.col("sha").rlike(SHA), F.lit(False)) | F.col("message").isNull() | F.col("us").isNull(), "commit"), (F.count("*").over(Window.partitionBy("repo", "sha")) > 1, "duplicate_commit"))
    outside = (F.col("us") < F.col("start_us")) | (F.col("us") >= F.col("until_us"))
    commits = durable(rows.withColumn("problem", bad).withColumn("outside", F.col("problem").isNull() & outside))
    none = F.lit(None).cast("string")
    said = lambda df, pr, reason, structural: df.select("path", "repo", pr.alias("pr"), reason.alias("reason"), F.lit(structural).alias("structural"))
    violations = (
        said(heads.where("problem IS NOT NULL"), none, F.col("problem"), True)
        .union(said(pulls.where("problem IS NOT NULL"), F.col("pr"), F.col("problem"), True))
        .union(said(pulls.where("problem IS NULL AND snapshot_problem IS NOT NULL"), F.col("pr"), F.col("snapshot_problem"), True))
        .union(said(pulls.where("problem IS NULL AND gap"), F.col("pr"), F.lit("pr_evidence_inconsistent"), False))
        .union(said(commits.where("problem IS NOT NULL"), none, F.col("problem"), True))
        .union(said(commits.where("outside"), none, F.lit("commit_outside_coverage"), False))
    )
    void = pulls.where("problem IS NOT NULL OR gap").select("repo").distinct().withColumn("v", F.lit(True))
    void_commits = commits.where("problem IS NOT NULL").select("repo").distinct().withColumn("w", F.lit(True))
    seen = heads.where("problem IS NULL").join(void, "repo", "left").join(void_commits, "repo", "left")
    observations = seen.select("repo", "path", "start_us", "until_us", (F.col("all_pulls") & F.col("v").isNull()).alias("pulls_complete"), (F.col("all_commits") & F.col("w").isNull()).alias("commits_complete"))
    good = pulls.where("problem IS NULL AND NOT gap")
    table = good.select("repo", "pr", "number", (F.col("state") == "open").alias("open"), "created_us", "closed_us", "merged_us", "head_sha", "merge_sha", "head_ref", "title", "body", "observed", F.col("snapshot").isNotNull().alias("has_snapshot"), "policy")
    snaps = good.where("snapshot IS NOT NULL AND snapshot_problem IS NULL").select("repo", "pr", "snapshot", instant(at(F.col("snapshot"), "captured_at")).alias("captured_us"), F.lower(string(at(F.col("snapshot"), "head_sha"))).alias("snapshot_sha"))
    x = F.col("x")
    items = lambda field: snaps.select("repo", "pr", "captured_us", "snapshot_sha", F.posexplode(elements(at(F.col("snapshot"), field))).alias("pos", "x"))
    keep = ("captured_us", "snapshot_sha")
    runs = items("check_runs").select("repo", "pr", "pos", string(at(x, "name")).alias("name"), whole(at(x, "app.id")).alias("app_id"), F.lower(string(at(x, "head_sha"))).alias("sha"), instant(at(x, "completed_at")).alias("us"), instant(at(x, "started_at")).alias("started_us"), ((string(at(x, "status")) == "completed") & instant(at(x, "completed_at")).isNotNull() & string(at(x, "conclusion")).isNotNull()).alias("complete"), F.coalesce(string(at(x, "conclusion")).isin(*GOOD), F.lit(False)).alias("ok"), *keep)
    statuses = items("statuses").select("repo", "pr", "pos", string(at(x, "context")).alias("name"), F.lit(None).cast("bigint").alias("app_id"), F.lower(string(at(x, "sha"))).alias("sha"), instant(at(x, "updated_at")).alias("us"), F.lit(None).cast("bigint").alias("started_us"), (string(at(x, "state")) != "pending").alias("complete"), (string(at(x, "state")) == "success").alias("ok"), *keep)
    named = at(F.col("snapshot"), "required")
    required = snaps.select("repo", "pr", F.when(type_of(named) == "ARRAY", F.transform(elements(named), string)).alias("names"))
    return Recorded(observations, table, runs, statuses, required, commits.where("problem IS NULL AND NOT outside").select("repo", "sha", "us", "message"), violations)
