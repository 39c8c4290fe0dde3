"""Links of workers to pull requests: references, authorship, own and inherited links, edit scope, judgment.

A worker is a session; instants are microseconds, lifetimes half-open (start_us, end_us). Facts that would need a repository or a shell are
inputs: what a command does (creates, commits), and the state of an edited path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_origin
from .attribution import Rule, rule_names

# ---- fixed values: evidence of a link and its rank ----
RANKS = {"pr_created": 6, "pr_created_output": 6, "pushed_branch": 5, "pushed_branch_output": 5, "committed_branch": 4, "ancestor_pr_created": 3, "ancestor_pushed_branch": 2, "cwd_branch": 1}
EVIDENCE = {"pr_created": "pr_created", "push_result": "pushed_branch", "branch_committed": "committed_branch"}
BRANCH_KINDS = ("branch", "branch_change", "branch_observed")
# ---- end of fixed values ----


def mapped(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def alive(us: str = "us") -> Column:
    return (F.col(us) >= F.col("start_us")) & (F.col(us) < F.col("end_us"))


def reference_matches(references: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J13. Distinct (keys, deliverable): a reference of any branch kind equals one of the deliverable's branches, or a pull request one of its attempts.

    references: keys, kind, value. targets: deliverable, kind (branch, pr), value.
    """
    kind = F.when(F.col("kind").isin(*BRANCH_KINDS), "branch").when(F.col("kind") == "pr", "pr")
    return references.withColumn("kind", kind).join(targets, ["kind", "value"]).select(*keys, "deliverable").distinct()


def project_repositories(links: DataFrame, repos: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """J14. Distinct (bucket, origin, rule, repo) of project links: the repository of a known origin, else those that the rule's origins match, else those of the rule's name.

    links: bucket, origin (null: not known), rule. repos: repo (owner/name). Origins of rules are given as host/path in lower case.
    """
    distinct = links.where("bucket = 'project'").select("bucket", "origin", "rule").distinct()
    known = repos.select("repo", normalize_origin(F.concat(F.lit("https://github.com/"), "repo")).alias("o")).distinct()
    by_origin = distinct.join(known, F.lower("origin") == F.col("o")).select("bucket", "origin", "rule", "repo")
    own = F.split_part("repo", F.lit("/"), F.lit(2))
    plain = [F.when(own == r.name, r.name) for r in rules if not r.origins]
    named = F.concat(rule_names(rules, F.concat(F.lit("github.com/"), "repo"), "origins"), F.array_compact(F.array(*plain)) if plain else F.array().cast("array<string>"))
    by_rule = distinct.where("origin IS NULL").join(known.select("repo", F.explode(F.array_distinct(named)).alias("rule")), "rule").select("bucket", "origin", "rule", "repo")
    return by_origin.union(by_rule)


def references(hints: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """J21. Distinct (session_id, kind, value) that a worker's own contexts and tools name in its lifetime.

    hints: session_id, us, source (context, own, refs), kind, value. A context names a branch only; a branch among the references of a tool's result isn't its own.
    """
    live = hints.join(lifetimes.select("session_id", "start_us", "end_us"), "session_id").where(alive() & F.col("value").isNotNull() & (F.col("value") != ""))
    taken = ((F.col("source") == "context") & (F.col("kind") == "branch")) | (F.col("source") == "own") | ((F.col("source") == "refs") & (F.col("kind") != "branch"))
    return live.where(taken).select("session_id", "kind", "value").distinct()


def authorship(executions: DataFrame, results: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """J22. What workers' commands brought about: (session_id, identity, us, kind, value, output_only, gap).

    executions: session_id, identity, started_us, us, exit_code, error, creates, commits. results: session_id, identity, us, kind (pr_created, push_result, branch_committed), value; they
    count between the command's start and end. A command without success, start or one answer makes one row with a ``gap`` and no kind. Where
    the exit code is unknown and no error was reported, only pushes and created pull requests count.
    """
    life = lifetimes.select("session_id", "start_us", "end_us")
    e = executions.join(life, "session_id").where(alive())
    r = results.select("session_id", "identity", F.col("us").alias("__at"), "kind", "value")
    inside = (F.col("__at") >= F.col("started_us")) & (F.col("__at") <= F.col("us")) & (F.col("__at") >= F.col("start_us")) & (F.col("__at") < F.col("end_us"))
    hit = F.coalesce(inside, F.lit(False))
    both = e.join(r, ["session_id", "identity"], "left").withColumns({"kind": F.when(hit, F.col("kind")), "value": F.when(hit, F.col("value"))})
    w = Window.partitionBy("session_id", "identity", "us")
    differs = lambda kind: F.coalesce(F.min(F.when(F.col("kind") == kind, F.col("value"))).over(w) != F.max(F.when(F.col("kind") == kind, F.col("value"))).over(w), F.lit(False))
    pushed = F.coalesce(F.bool_or(F.col("kind") == "push_result").over(w), F.lit(False))
    judged = both.withColumns({"__pushed": pushed, "__differs": differs("pr_created") | differs("branch_committed"), "output_only": F.col("exit_code").isNull() & F.coalesce(~F.col("error"), F.lit(False))})
    failed = F.coalesce(F.col("error"), F.lit(False)) | (~F.col("exit_code").eqNullSafe(0) & ~F.col("output_only"))
    gap = (
        F.when(failed, F.when(F.col("exit_code").isNull(), "authorship_exit_unknown").otherwise("failed_authorship_commands"))
        .when(~F.coalesce(alive("started_us") & (F.col("us") >= F.col("started_us")), F.lit(False)), "link_conflicts")
        .when(F.col("__differs"), "link_conflicts")
    )
    kind = F.col("kind")
    counts = (kind == "push_result") | ((kind == "pr_created") & F.col("creates")) | ((kind == "branch_committed") & F.col("commits") & ~F.col("output_only"))
    rows = judged.where(F.col("creates") | F.col("commits") | F.col("__pushed")).withColumn("gap", gap).where(F.col("gap").isNotNull() | counts)
    clear = lambda c: F.when(F.col("gap").isNull(), F.col(c)).alias(c)
    return rows.select("session_id", "identity", "us", clear("kind"), clear("value"), "output_only", "gap").distinct()


def link_candidates(authored: DataFrame, pulls: DataFrame, dispatched: DataFrame) -> DataFrame:
    """J23. Candidate links of authored pull requests and branches: (session_id, identity, pr, us, evidence, branch, head, role, gap).

    authored: session_id, identity, us, kind, value, output_only, repo (scope of a branch). pulls: pr, repo, branch, created_us, closed_us. dispatched: session_id, dispatched_us.
    A branch leads to the pull requests of its repository with that head; one command with pull requests of several repositories, and
    links against the pull request's times, have the ``gap`` link_conflicts. Work on an older pull request continues it.
    """
    a = authored.join(dispatched.select("session_id", "dispatched_us"), "session_id")
    p = pulls.select("pr", F.col("repo").alias("__repo"), F.col("branch").alias("head"), "created_us", "closed_us")
    created = a.where("kind = 'pr_created'").join(p, F.col("value") == F.col("pr"), "left").drop("pr").withColumn("pr", F.col("value"))
    by_head = a.where("kind <> 'pr_created'").join(p, (F.col("repo") == F.col("__repo")) & (F.col("value") == F.col("head")))
    w = Window.partitionBy("session_id", "identity", "us", "kind", "value")
    spread = F.min("__repo").over(w) != F.max("__repo").over(w)
    both = created.withColumn("__spread", F.lit(False)).unionByName(by_head.withColumn("__spread", spread))
    is_new = F.col("kind") == "pr_created"
    continued = F.coalesce(F.col("created_us") < F.col("dispatched_us"), F.lit(False))
    against = F.coalesce(F.col("__spread"), F.lit(False)) | (continued & is_new) | F.coalesce(F.col("closed_us") < F.col("us"), F.lit(False)) | (is_new & F.coalesce(F.col("created_us") > F.col("us"), F.lit(False)))
    evidence = F.concat(mapped(EVIDENCE, F.col("kind")), F.when(F.col("output_only"), "_output").otherwise(""))
    return both.select(
        "session_id", "identity", "pr", "us", evidence.alias("evidence"), F.when(~is_new, F.col("value")).alias("branch"), F.col("head"),
        F.when(continued, "continued").otherwise("constituent").alias("role"), F.when(against, "link_conflicts").alias("gap"),
    )


def best_links(candidates: DataFrame) -> DataFrame:
    """J23. Per worker and pull request the link of the highest rank; equal ranks: the earliest, then by evidence and branch."""
    order = (F.desc(mapped(RANKS, F.col("evidence"))), "us", "evidence", "branch")
    w = Window.partitionBy("session_id", "pr").orderBy(*order)
    return candidates.where("gap IS NULL").withColumn("__n", F.row_number().over(w)).where("__n = 1").select("session_id", "pr", "evidence", "branch", "role", F.lit("strong").alias("strength"))


def inherited_links(workers: DataFrame, chains: DataFrame, authored: DataFrame, pulls: DataFrame, own: DataFrame) -> DataFrame:
    """J26. Links through what a worker's ancestors pushed or created in the worker's lifetime: (session_id, pr, evidence, branch, role, strength).

    workers: session_id, start_us, end_us. chains: session_id, ancestor, steps. own: the workers' own references (J21). A link is strong where the worker itself names
    its branch. Per pull request strong ones come first, then the rank, then the nearest ancestor.
    """
    mine = authored.where("gap IS NULL AND kind IN ('push_result', 'pr_created')").withColumnRenamed("session_id", "ancestor")
    theirs = chains.join(workers.select("session_id", "start_us", "end_us"), "session_id").join(mine, "ancestor").where(alive())
    found = link_candidates(theirs.withColumn("identity", F.struct("steps", "ancestor", "identity")), pulls, workers.select("session_id", F.col("start_us").alias("dispatched_us"))).where("gap IS NULL")
    evidence = F.when(F.col("evidence").startswith("pushed_branch"), "ancestor_pushed_branch").otherwise("ancestor_pr_created")
    links = found.withColumns({"evidence": evidence, "branch": F.coalesce("branch", "head")})
    named = own.where(F.col("kind").isin("branch", "branch_observed")).select("session_id", F.col("value").alias("branch"), F.lit(True).alias("named")).distinct()
    rated = links.join(named, ["session_id", "branch"], "left").withColumn("strength", F.when(F.col("named"), "strong").otherwise("weak"))
    w = Window.partitionBy("session_id", "pr").orderBy((F.col("strength") == "strong").desc(), F.desc(mapped(RANKS, F.col("evidence"))), "identity.steps", "us", "branch")
    return rated.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("session_id", "pr", "evidence", "branch", "role", "strength")


def edit_scope(edits: DataFrame, targets: DataFrame, status: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """J29. Per worker whether its edits changed the repository, whether that is known, and its edits outside, ignored and unknown, once each.

    edits: session_id, identity, us. targets: session_id, identity, target. status: target, state (in_scope, edit_ignored, edit_outside_scope); a target without one, and an edit without a target, is unknown.
    """
    live = edits.join(lifetimes.select("session_id", "start_us", "end_us"), "session_id").where(alive()).select("session_id", "identity")
    states = live.join(targets, ["session_id", "identity"], "left").join(status, "target", "left").select("session_id", "identity", F.coalesce("state", F.lit("edit_target_unknown")).alias("state")).distinct()
    return states.groupBy("session_id").agg(
        F.bool_or(F.col("state").isin("in_scope", "edit_target_unknown")).alias("changed"), F.bool_or(F.col("state") == "in_scope").alias("known"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("edit_outside_scope", "edit_ignored", "edit_target_unknown")],
    )


def worker_judgment(workers: DataFrame, links: DataFrame, judged: DataFrame, disturbed: DataFrame) -> DataFrame:
    """J27. (session_id, state, reason): the linked pull requests' judgment, but what was disturbed after its merge fails the dispatch, whatever repaired it.

    workers: session_id, edited, incomplete, authored. links: session_id, pr, strength. judged: session_id, state, reason. disturbed: pr, reason (of merged pull requests; null: none); the first in order of pr gives the reason.
    """
    l = links.join(disturbed, "pr", "left").groupBy("session_id").agg(F.bool_or(F.col("strength") == "strong").alias("strong"), F.min(F.when(F.col("reason").isNotNull(), F.struct("pr", "reason")))["reason"].alias("broken"))
    both = workers.join(l, "session_id", "left").join(judged.select("session_id", "state", "reason"), "session_id", "left")
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    changed = true("edited") | true("incomplete") | true("authored") | true("strong")
    linked = F.col("strong").isNotNull()
    state = F.when(~changed, "no_change").when(~linked, "no_pr").when(F.col("broken").isNotNull(), "failed").otherwise(F.col("state"))
    reason = F.when(~changed, "no_known_edit").when(~linked, "no_linked_pr").when(F.col("broken").isNotNull(), F.col("broken")).otherwise(F.col("reason"))
    return both.select("session_id", state.alias("state"), reason.alias("reason"))
