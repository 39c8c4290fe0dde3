"""Recorded outcomes: checks, follow-ups, attempts, deliverables, links and local state (J rows).

Pull requests are keyed by ``pr``; instants are microseconds. Verdicts are ordered CASE expressions over aggregates that are joined
once. Recursive facts run in a bounded number of rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import durable
from .timeline import disjoint, running_sums

# ---- fixed values: what marks a fix, and what marks a revert ----
FIX = r"(?i)\b(?:fix(?:es|ed|ing)?|revert(?:s|ed|ing)?|regression|follow[ -]?up|hotfix)\b"
REVERT = r"(?i)\brevert(?:s|ed|ing)?\b"
# ---- end of fixed values ----
DAY = 86_400_000_000
#: Worst first.
STATES = ("failed", "in_progress", "immature", "unverified", "success")
BASES = ("historical", "current_policy", "all_visible", "unknown")


def without_conflicts(checks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """J2. Rows after the last instant at which their key has two values."""
    bad = checks.groupBy(*keys, "us").agg(F.min(value).alias("a"), F.max(value).alias("b")).where("a <> b")
    last = bad.groupBy(*keys).agg(F.max("us").alias("__until"))
    return checks.join(last, list(keys), "left").where("__until IS NULL OR us > __until").drop("__until")


def at_merge(checks: DataFrame, pulls: DataFrame) -> DataFrame:
    """J1. checks with ``gap`` (null: valid): on another commit, after the merge, or unfinished."""
    both = checks.join(pulls.select("pr", "merged_us", "head_sha"), "pr")
    return both.withColumn("gap", F.when(F.col("merged_us").isNull(), "not_merged").when(~F.lower("sha").eqNullSafe(F.lower("head_sha")), "other_commit").when(F.col("us") > F.col("merged_us"), "after_merge").when(~F.col("complete"), "incomplete"))


def latest_green(runs: DataFrame) -> DataFrame:
    """J3. Per pr and name the latest run's verdict; on equal instants the later list place wins."""
    return runs.groupBy("pr", "name").agg(F.max_by("ok", F.struct("us", "pos")).alias("green"))


def checks_verdict(runs: DataFrame, statuses: DataFrame, required: DataFrame) -> DataFrame:
    """J3. green, red or unknown per pr. A name that both kinds report needs both; a required name without a report is unknown.

    required: pr, names (null: not known).
    """
    both = latest_green(runs).withColumnRenamed("green", "g1").join(latest_green(statuses).withColumnRenamed("green", "g2"), ["pr", "name"], "full").select("pr", "name", (F.coalesce("g1", F.lit(True)) & F.coalesce("g2", F.lit(True))).alias("green"))
    need = required.where("names IS NOT NULL").select("pr", F.explode_outer("names").alias("name"))
    got = need.join(both, ["pr", "name"], "left").groupBy("pr").agg(F.bool_or(F.col("name").isNotNull() & F.col("green").isNull()).alias("missing"), F.bool_and(F.coalesce("green", F.lit(True))).alias("all"))
    return required.select("pr").join(got, "pr", "left").select("pr", F.when(F.col("missing").isNull() | F.col("missing"), "unknown").when(F.col("all"), "green").otherwise("red").alias("verdict"))


def policy_verdict(values: DataFrame, required: DataFrame) -> DataFrame:
    """J4. (pr, verdict, basis): red over unknown over green, over the required (context, app) pairs, or over all values if none is required.

    values: pr, context, app, value (green, red, unknown). required: pr, context, app (null: any), with a null context for a pr whose policy requires nothing.
    """
    wanted = required.where("context IS NOT NULL").alias("r").join(values.alias("v"), (F.col("r.pr") == F.col("v.pr")) & (F.col("r.context") == F.col("v.context")) & (F.col("r.app").isNull() | (F.col("r.app") == F.col("v.app"))), "left")
    rank = F.when(F.col("v.value") == "red", 2).when((F.col("v.value") == "unknown") | F.col("v.value").isNull(), 1).otherwise(0)
    policy = wanted.groupBy(F.col("r.pr").alias("pr")).agg(F.max(rank).alias("r")).withColumn("basis", F.lit("current_policy"))
    free = required.groupBy("pr").agg(F.count("context").alias("n")).where("n = 0").select("pr").join(values, "pr", "left")
    visible = free.groupBy("pr").agg(F.max(F.when(F.col("value") == "red", 2).when((F.col("value") == "unknown") | F.col("value").isNull(), 1).otherwise(0)).alias("r")).withColumn("basis", F.lit("all_visible"))
    return policy.union(visible).select("pr", F.when(F.col("r") == 2, "red").when(F.col("r") == 1, "unknown").otherwise("green").alias("verdict"), "basis")


def references(texts: DataFrame, pattern: str = r"#(\d+)") -> DataFrame:
    """J5. texts with one row per distinct number that they refer to (``ref``): extracted once, to be joined by equality."""
    return texts.withColumn("ref", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))))).withColumn("ref", F.col("ref").cast("long"))


def disturbances(pulls: DataFrame, later: DataFrame, days: float = 7) -> DataFrame:
    """J5, J6. Per merged pr what followed in (merge, merge + days) in its repository, refers to it and speaks of a fix: pull requests, reverting commits, fixing commits.

    later: repo, kind (pull, commit), us, text, ref.
    """
    m = pulls.where("merged_us IS NOT NULL").select("pr", "repo", "merged_us")
    both = m.join(later, (m["repo"] == later["repo"]) & (m["pr"] == later["ref"]) & (later["us"] > m["merged_us"]) & (later["us"] < m["merged_us"] + int(days * DAY)))
    fix, revert = F.col("text").rlike(FIX), F.col("text").rlike(REVERT)
    return both.groupBy("pr").agg(F.count_if((F.col("kind") == "pull") & fix).alias("follow_ups"), F.count_if((F.col("kind") == "commit") & revert).alias("reverts"), F.count_if((F.col("kind") == "commit") & fix & ~revert).alias("fixes"))


def attempt_states(pulls: DataFrame, follow_ups: DataFrame, now: int, days: float = 7) -> DataFrame:
    """J7, J8. (pr, state): an ordered decision per pull request; a repair's own state counts for what it repairs.

    pulls: pr, merged_us, closed, checks (green, red, unknown), reverted. follow_ups: pr, repair. A pull request with repairs
    takes its own state if one of them succeeds in the end, and fails otherwise; one that failed by itself stays so. It is decided when all its
    repairs are; what a cycle leaves undecided is in progress.

    Leaf first, in as many rounds as the longest branching chain has levels. Chains of single repairs, the usual ones, are
    contracted first by pointer doubling: a link of the chain succeeds where all after it do, so that length n takes log2(n) rounds.
    """
    mature = F.col("merged_us") + int(days * DAY) <= now
    own = (
        F.when(F.col("merged_us").isNull(), F.when(F.col("closed"), "failed").otherwise("in_progress"))
        .when(F.col("checks") == "red", "failed")
        .when(F.col("reverted"), "failed")
        .when(~mature, "immature")
        .when(F.col("checks") == "unknown", "unverified")
        .otherwise("success")
    )
    base = durable(pulls.select("pr", own.alias("own")))
    edges = durable(follow_ups.select("pr", "repair").distinct())
    need = durable(edges.groupBy("pr").agg(F.count("*").alias("need"), F.min("repair").alias("repair")))
    leaf = base.join(need, "pr", "left").where("need IS NULL OR own = 'failed'").select("pr", F.col("own").alias("state"))
    known = durable(leaf)
    # to: the first pull request down the chain that isn't a single link; good: whether all links in between succeed.
    link = base.join(need.where("need = 1"), "pr").where("own <> 'failed'").select("pr", F.col("repair").alias("to"))
    links = durable(link.withColumn("good", F.lit(True)))
    own_good = base.select(F.col("pr").alias("p"), (F.col("own") == "success").alias("ok"))
    for _ in range(links.count().bit_length() + 1):
        hop = links.join(own_good, F.col("pr") == F.col("p")).select(F.col("pr").alias("to"), F.col("to").alias("next"), (F.col("good") & F.col("ok")).alias("more"))
        links = durable(links.join(hop, "to", "left").select("pr", F.coalesce("next", "to").alias("to"), (F.col("good") & F.coalesce("more", F.lit(True))).alias("good"), F.col("next").isNotNull().alias("moved")))
        moved = links.where("moved").limit(1).count()
        links = links.drop("moved")
        if not moved:
            break
    while True:
        state = known.select(F.col("pr").alias("to"), F.col("state").alias("s"))
        one = links.join(state, "to").select("pr", (F.col("good") & (F.col("s") == "success")).alias("repaired"))
        many = edges.join(need.where("need > 1"), "pr", "left_semi").join(state.withColumnRenamed("to", "repair"), "repair").groupBy("pr").agg(F.count("*").alias("have"), F.bool_or(F.col("s") == "success").alias("repaired"))
        all_known = many.join(need, "pr").where("have = need").select("pr", "repaired")
        new = base.join(one.union(all_known), "pr").join(known, "pr", "left_anti")
        more = durable(new.select("pr", F.when(F.col("repaired"), F.col("own")).otherwise("failed").alias("state")))
        if not more.limit(1).count():
            break
        known = durable(known.union(more))
    return base.join(known, "pr", "left").select("pr", F.coalesce("state", F.lit("in_progress")).alias("state"))


def worst(state: Column, order: Sequence[str] = STATES) -> Column:
    """Aggregate: the first of ``order`` that occurs."""
    rank = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        rank = F.when(state == s, i).otherwise(rank)
    return F.element_at(F.array(*map(F.lit, order)), F.min(rank) + 1)


def judge(parts: DataFrame) -> DataFrame:
    """J9, J10. Per deliverable: its worst part's state, when it closed, elapsed time, and whether it passed at first.

    parts: deliverable, dispatched_us, state, closed_us, retry, human (y, n, null). Success waits for a human who said no.
    """
    out = parts.groupBy("deliverable").agg(F.min("dispatched_us").alias("dispatched_us"), worst(F.col("state")).alias("s"), F.max("closed_us").alias("c"), F.bool_or("retry").alias("retry"), F.max("human").alias("human"), F.min("human").alias("no"))
    pending = (F.col("s") == "success") & (F.col("no") == "n")
    state = F.when(pending, "in_progress").otherwise(F.col("s"))
    closed = F.when(state != "in_progress", F.col("c"))
    return out.select("deliverable", state.alias("state"), closed.alias("closed_us"), (closed - F.col("dispatched_us")).alias("elapsed_us"), ((state == "success") & ~F.col("retry")).alias("first_pass"), F.when(pending, "human_acceptance_pending").alias("reason"))


def checks_basis(parts: DataFrame) -> DataFrame:
    """J11. The weakest basis of a deliverable's checks."""
    return parts.groupBy("deliverable").agg(worst(F.col("basis"), tuple(reversed(BASES))).alias("basis"))


def id_mentions(values: DataFrame, ids: DataFrame, paths: bool = False) -> DataFrame:
    """J12. Distinct (value, id): the value holds the id with no ASCII letter or digit beside it. An id without any is never mentioned.

    The id's first run of letters and digits is a whole run of the value, so that runs join by equality before the id is looked for. ``paths``:
    values with a drive or a network share are compared without case.
    """
    run = r"[A-Za-z0-9]+"
    any_case = F.col("value").rlike(r"^(?:[A-Za-z]:|//|\\\\)") if paths else F.lit(False)
    v = values.select("value").where("value IS NOT NULL").distinct().withColumns({"run": F.explode(F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit(run), F.lit(0)))), "any_case": any_case})
    d = ids.select("id").where("id IS NOT NULL").distinct().withColumn("run", F.lower(F.regexp_extract("id", run, 0)))
    literal = F.concat(F.lit("\\Q"), F.replace(F.col("id"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    whole = F.concat(F.when(F.col("any_case"), "(?i)").otherwise(""), F.lit("(?<![A-Za-z0-9])"), literal, F.lit("(?![A-Za-z0-9])"))
    return v.join(d, "run").where(F.regexp_like("value", whole)).select("value", "id").distinct()


def open_during(events: DataFrame, deliverables: DataFrame) -> DataFrame:
    """J15. Usage events with the one deliverable of their project that was open at the time: linked, ambiguous (several), or none.

    events: ord (of its own for each), project, us. deliverables: deliverable, project, dispatched_us, closed_us (null: still open; a close counts as open).

    A sweep: opens, events and closes in one timeline of their project, with the running number of open deliverables and the sum of their numbers, which is
    the one's if there is one. A project of any size is shared by all tasks.
    """
    spans = disjoint(deliverables.where("project IS NOT NULL AND dispatched_us IS NOT NULL AND (closed_us IS NULL OR closed_us >= dispatched_us)").select("project", "deliverable", "dispatched_us", "closed_us"), ("project", "deliverable"), "dispatched_us", "closed_us")
    names = durable(spans.select("project", "deliverable").distinct().withColumn("code", F.monotonically_increasing_id() + 1))
    coded = spans.join(names, ["project", "deliverable"])
    none = F.lit(None)
    at = lambda df, us, turn, ord_, code, by: df.select("project", us.cast("long").alias("us"), F.lit(turn).alias("turn"), ord_.alias("ord"), code.cast("long").alias("code"), F.lit(by).alias("by"))
    kind = events.schema["ord"].dataType
    points = (
        at(coded, F.col("dispatched_us"), 0, none.cast(kind), F.col("code"), 1)
        .union(at(events.where("project IS NOT NULL AND us IS NOT NULL"), F.col("us"), 1, F.col("ord"), F.lit(0), 0))
        .union(at(coded.where("closed_us IS NOT NULL"), F.col("closed_us"), 2, none.cast(kind), F.col("code"), -1))
    )
    swept = running_sums(points, "project", ("us", "turn", "ord", "code"), {"open": F.col("by").cast("long"), "sum": (F.col("by") * F.col("code")).cast("decimal(38,0)")}).where("turn = 1")
    one = swept.withColumn("only", F.when(F.col("open") == 1, F.col("sum").cast("long")))
    found = one.select("ord", "project", "open", "only").join(names.select(F.col("project").alias("p"), F.col("code").alias("only"), "deliverable"), "only", "left")
    bucket = F.when(F.col("open") == 0, "unallocated").when(F.col("open") == 1, "linked").otherwise("ambiguous")
    apart = events.where("project IS NULL OR us IS NULL").select("ord", none.cast(deliverables.schema["deliverable"].dataType).alias("deliverable"), F.lit("unallocated").alias("bucket"))
    return found.select("ord", "deliverable", bucket.alias("bucket")).union(apart)


def cost_per_success(judged: DataFrame, spend: DataFrame) -> DataFrame:
    """J16, J17. Tokens per successful deliverable: all of the project's, the linked ones, and those of the judged cohort. One row.

    judged: deliverable, state. spend: deliverable (null: not linked), tokens.
    """
    wins = judged.agg(F.count_if(F.col("state") == "success").alias("wins"))
    own = spend.join(judged.select("deliverable", "state"), "deliverable", "left")
    sums = own.agg(F.sum("tokens").alias("all"), F.sum(F.when(F.col("deliverable").isNotNull(), F.col("tokens"))).alias("linked"), F.sum(F.when(F.col("state").isin("success", "failed"), F.col("tokens"))).alias("cohort"))
    ratio = lambda c: F.when(F.col("wins") > 0, F.col(c) / F.col("wins"))
    return sums.crossJoin(wins).select("wins", ratio("all").alias("operational"), ratio("linked").alias("operational_linked"), ratio("cohort").alias("cohort"))


def local_state(edits: DataFrame, checks: DataFrame, activity: DataFrame, until: int, active_minutes: int = 30) -> DataFrame:
    """J18. (session_id, state, reason) from edits, matching checks and recent activity.

    edits: session_id, us. checks: session_id, us, start_us, exit_code, here (whether it ran in the repository). activity: session_id, last_us, completed_us. The
    last check must start strictly after the last edit; several at one instant must agree.
    """
    e = edits.groupBy("session_id").agg(F.max("us").alias("edit_us"))
    after = checks.join(e, "session_id").where("us > edit_us")
    last = after.withColumn("__m", F.max("us").over(Window.partitionBy("session_id"))).where("us = __m")
    c = last.groupBy("session_id").agg(
        F.count("*").alias("n"), F.bool_or(F.coalesce((F.col("start_us") <= F.col("edit_us")) | (F.col("start_us") > F.col("us")), F.lit(True))).alias("early"), F.bool_and(F.coalesce("here", F.lit(False))).alias("here"),
        F.min("exit_code").alias("low"), F.max("exit_code").alias("high"), F.count_if(F.col("exit_code").isNull()).alias("unknown"),
    )
    recent = (until - F.col("last_us") <= active_minutes * 60_000_000) & (F.col("completed_us").isNull() | (F.col("completed_us") < F.col("last_us")) | (F.col("completed_us") >= until))
    reason = (
        F.when(F.col("edit_us").isNull(), "no_known_edit").when(F.coalesce(recent, F.lit(False)), "recent_activity").when(F.col("n").isNull(), "no_check_after_last_edit")
        .when(F.col("early"), "check_start_not_after_last_edit").when(~F.col("here"), "verification_cwd_unconfirmed").when((F.col("unknown") > 0) | (F.col("low") != F.col("high")), "last_check_exit_unknown")
        .when(F.col("low") == 0, "last_check_passed").otherwise("last_check_failed")
    )
    out = activity.join(e, "session_id", "left").join(c, "session_id", "left").select("session_id", reason.alias("reason"))
    r = F.col("reason")
    return out.select("session_id", F.when(r == "no_known_edit", "no_change").when(r == "recent_activity", "in_progress").when(r == "last_check_passed", "success").when(r == "last_check_failed", "failed").otherwise("unverified").alias("state"), "reason")


def token_measurement(usage: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """J19. Sums per session; a kind that any event leaves out is unknown."""
    return usage.groupBy("session_id").agg(*[F.when(F.bool_and(F.col(k).isNotNull()), F.sum(k)).alias(k) for k in kinds])


def strongest_links(candidates: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """J23, J24. Per worker and pr the strongest evidence (ties: by name); weak links (rank 0) only for a pr without a strong one."""
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col("evidence")]
    best = candidates.withColumn("rank", rank).groupBy("worker", "pr").agg(F.max_by("evidence", F.struct("rank", "evidence")).alias("evidence"), F.max("rank").alias("rank"))
    strong = best.where("rank > 0")
    weak = best.where("rank = 0").join(strong.select("pr").distinct(), "pr", "left_anti")
    return strong.unionByName(weak)


def ancestors(sessions: DataFrame, cap: int = 64) -> DataFrame:
    """J25. (session_id, ancestor, steps) along parents of the same agent, up to ``cap`` steps; cycles end where they close.

    Doubling: the pairs of up to 2^k steps joined with themselves give those of up to 2^(k+1).
    """
    s = sessions.select("session_id", "agent", "parent_id").distinct()
    p = s.select(F.col("session_id").alias("parent_id"), F.col("agent").alias("a"))
    pairs = s.join(p, "parent_id").where("agent = a").select("session_id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("steps"))
    reach = 1
    while reach < cap:
        hop = pairs.select(F.col("session_id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("steps").alias("more"))
        longer = pairs.where(F.col("steps") == reach).join(hop, "ancestor").select("session_id", F.col("next").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps"))
        both = pairs.unionByName(longer).where(F.col("session_id") != F.col("ancestor"))
        before, pairs = pairs, durable(both.groupBy("session_id", "ancestor").agg(F.min("steps").alias("steps")))
        if pairs.count() == before.count():
            break
        reach *= 2
    return pairs.where(F.col("steps") <= cap)


def evidence_gaps(gaps: DataFrame) -> DataFrame:
    """J31. Distinct (identity, item) per reason."""
    return gaps.groupBy("reason").agg(F.count_distinct("identity", "item").alias("n"))


def as_of(pulls: DataFrame, commits: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """J32. Captured pulls and commits as they stood: created before ``at``; closures and merges at or after it are undone; commits once per sha."""
    then = lambda c: F.when(F.col(c) < at, F.col(c))
    p = pulls.where(F.col("created_us") < at).withColumns({"closed_us": then("closed_us"), "merged_us": then("merged_us")})
    return p.withColumn("state", F.when(F.col("closed_us").isNull(), "open").otherwise("closed")), commits.where(F.col("us") < at).dropDuplicates(["repo", "sha"])


def required_checks(classic: DataFrame, rulesets: DataFrame, contexts: DataFrame) -> DataFrame:
    """J33. Distinct (repo, context, app) from both policies; app -1 is any; bare contexts that a check of the same name mirrors are dropped."""
    both = classic.select("repo", "context", "app").union(rulesets.select("repo", "context", "app")).withColumn("app", F.when(F.col("app") != -1, F.col("app")))
    bare = contexts.join(both, ["repo", "context"], "left_anti").select("repo", "context", F.lit(None).cast("long").alias("app"))
    return both.union(bare).distinct()


def merge_results(candidates: DataFrame) -> DataFrame:
    """J34. Per pr the first candidate snapshot with usable values, by its place."""
    w = Window.partitionBy("pr").orderBy("place")
    return candidates.where("usable > 0").withColumn("__n", F.row_number().over(w)).where("__n = 1").select("pr", "place", "sha")
