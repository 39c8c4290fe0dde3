"""What a dispatched session cost against doing its work inline in its parent, and groups of dispatched sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("agent", "session_id")
ESTIMATES = ("actual_fresh", "inline_fresh", "actual_reused", "inline_reused", "actual_carry", "inline_carry")
EARLIEST, LATEST = -(1 << 62), 1 << 62


def timelines(sessions: DataFrame, requests: DataFrame, usage: DataFrame, compactions: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per child what its parent's timeline holds at the dispatch and after the child's last activity.

    Everything is one row of the parent's timeline: requests and usage, compactions, the ends of request gaps, and two questions of each child.
    Later requests are differences of running counts, so that no child is joined with its parent's requests.
    """
    steps = requests.select(*KEY, "us", "ord", "context", F.lit(1).alias("r"), F.lit(0).alias("u")).union(usage.select(*KEY, "us", "ord", F.lit(None).cast("long"), F.lit(0), F.lit(1)))
    one = steps.groupBy(*KEY, "us", "ord").agg(F.max("context").alias("context"), F.max("r").alias("r"), F.max("u").alias("u"))
    same = Window.partitionBy(*KEY, "us")
    sure = F.min(F.when(F.col("r") == 1, F.coalesce("context", F.lit(EARLIEST)))).over(same) == F.max(F.when(F.col("r") == 1, F.coalesce("context", F.lit(EARLIEST)))).over(same)
    one = one.withColumn("context", F.when((F.col("r") == 1) & sure, F.col("context"))).withColumn("turn", F.lit(1))
    stops = compactions.where("us IS NOT NULL").select(*KEY, "us", F.lit(0).alias("turn"), F.lit(True).alias("stop"))
    ends = gaps.select(*KEY, F.coalesce("to_us", F.lit(LATEST)).alias("us"), F.lit(0).alias("turn"), F.coalesce("from_us", F.lit(EARLIEST)).alias("gap_from"))
    child = sessions.where("parent_id IS NOT NULL")
    asked = child.select("agent", F.col("parent_id").alias("session_id"), F.col("session_id").alias("child"), F.lit(2).alias("turn"), F.explode(F.array(F.struct(F.col("start_us").alias("us"), F.lit(True).alias("at_start")), F.struct(F.col("last_us").alias("us"), F.lit(False).alias("at_start")))).alias("q")).select("agent", "session_id", "child", "turn", "q.*").where("us IS NOT NULL")
    rows = one.unionByName(stops, True).unionByName(ends, True).unionByName(asked, True)
    w = Window.partitionBy(*KEY).orderBy("us", "turn", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = Window.partitionBy(*KEY).orderBy("us", "turn", "ord").rowsBetween(1, Window.unboundedFollowing)
    last = lambda test, value: F.last(F.when(test, value), ignorenulls=True).over(w)
    is_request, is_usage, is_stop = F.col("r") == 1, F.col("u") == 1, F.col("stop")
    told = rows.withColumns({
        "prior": last(is_request, F.struct("us", "context")), "last_usage": last(is_usage, F.col("r")), "last_stop": last(is_stop, F.col("us")),
        "seen": F.count_if(is_request).over(w), "missing": F.count_if(is_usage & (F.col("r") == 0)).over(w),
    })
    # Running counts at the next compaction, or at the end.
    whole = Window.partitionBy(*KEY)
    next_stop = F.first(F.when(is_stop, F.struct("us", "seen", "missing")), ignorenulls=True).over(on)
    told = told.withColumns({"next": next_stop, "all_seen": F.max("seen").over(whole), "all_missing": F.max("missing").over(whole), "gap_low": F.min("gap_from").over(on)}).where("child IS NOT NULL")
    at = lambda flag, value: F.max(F.when(F.col("at_start") == flag, value))
    return told.groupBy("agent", F.col("child").alias("session_id")).agg(
        at(True, F.col("prior")).alias("prior"), at(True, F.col("last_usage")).alias("last_usage"), at(True, F.col("last_stop")).alias("last_stop"),
        at(False, F.coalesce("next.seen", "all_seen") - F.col("seen")).alias("tail"), at(False, F.coalesce("next.missing", "all_missing") - F.col("missing")).alias("unseen"),
        F.bool_or(~F.col("at_start") & F.coalesce(F.col("gap_low") < F.coalesce("next.us", F.lit(LATEST + 1)), F.lit(False))).alias("gap"),
    )


def delegation_estimates(sessions: DataFrame, requests: DataFrame, usage: DataFrame, compactions: DataFrame, gaps: DataFrame, since: int, until: int, inclusive: Sequence[str] = ("codex",)) -> DataFrame:
    """M19. Per dispatched session the estimates of fresh, reused and carried tokens, actual and inline, or the first ``reason`` why there are none.

    sessions: agent, session_id, parent_id, start_us, last_us (last activity). requests: agent, session_id, us, ord, context, new_input, cache_write, cache_read, output. usage: the
    usage events (agent, session_id, us, ord), of which one without a request makes its session's requests incomplete. compactions: us may be null. gaps: times (from_us, to_us; null: open)
    at which requests are missing. Agents named ``inclusive`` report no cache writes. A row per child; an empty table gives none.
    """
    child = sessions.where("parent_id IS NOT NULL")
    parents = sessions.select("agent", F.col("session_id").alias("parent_id"), F.lit(True).alias("has_parent")).distinct()
    unclear = compactions.groupBy("agent", F.col("session_id").alias("parent_id")).agg(F.bool_or(F.col("us").isNull()).alias("unclear"))
    order = F.struct("us", "ord")
    no_kind = F.col("context").isNull() | F.col("cache_read").isNull() | (~F.col("agent").isin(*inclusive) & F.col("cache_write").isNull())
    own = requests.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.bool_or((F.col("us") < since) | (F.col("us") >= until)).alias("outside"), F.bool_or(no_kind).alias("no_kind"),
        F.min_by("context", order).alias("first"), F.max_by("context", order).alias("final"), F.sum("context").alias("contexts"), F.max_by("output", order).alias("result"),
        F.sum(F.col("new_input") + F.coalesce("cache_write", F.lit(0))).alias("fresh"), F.sum("cache_read").alias("reused"),
    )
    lost = usage.select(*KEY, "us", "ord").join(requests.select(*KEY, "us", "ord"), [*KEY, "us", "ord"], "left_anti").select(*KEY).union(gaps.select(*KEY)).distinct().withColumn("lost", F.lit(True))
    both = child.join(parents, ["agent", "parent_id"], "left").join(unclear, ["agent", "parent_id"], "left").join(own, list(KEY), "left").join(lost, list(KEY), "left").join(timelines(sessions, requests, usage, compactions, gaps), list(KEY), "left")
    reason = (
        F.when(F.col("has_parent").isNull() | F.col("start_us").isNull(), "parent_or_dispatch_unobserved")
        .when(F.col("prior").isNull(), "parent_request_unobserved")
        .when(F.col("last_usage") == 0, "parent_latest_request_unobserved")
        .when(F.col("prior.context").isNull(), "parent_context_unobserved_or_conflicting")
        .when(F.col("unclear"), "carry_compaction_time_unobserved")
        .when(F.col("last_stop") > F.col("prior.us"), "parent_context_compacted")
        .when(F.col("n").isNull() | F.col("outside"), "child_scope_incomplete")
        .when(F.col("lost"), "child_requests_incomplete")
        .when(F.col("no_kind"), "child_token_kinds_unobserved")
        .when(F.col("last_us").isNull(), "carry_activity_time_unobserved")
        .when(F.col("gap") | (F.col("unseen") > 0), "carry_parent_requests_incomplete")
        .when(F.col("result").isNull(), "carry_returned_result_unobserved")
    )
    carry, inline_carry = F.col("result") * F.col("tail"), (F.col("final") - F.col("first")) * F.col("tail")
    values: tuple[Column, ...] = (
        F.col("fresh"), F.greatest(F.col("fresh") - F.col("first"), F.lit(0)), F.col("reused") + carry,
        F.col("n") * (F.col("prior.context") - F.col("first")) + F.col("first") + F.col("contexts") - F.col("final") + inline_carry, carry, inline_carry,
    )
    rows = both.withColumn("reason", reason)
    return rows.select(*KEY, "reason", *[F.when(F.col("reason").isNull(), v).alias(c) for c, v in zip(ESTIMATES, values, strict=True)])


def delegation_groups(spent: DataFrame) -> DataFrame:
    """M23. Dispatched sessions, their parents and the share of both's tokens that the children spent: overall, by agent, and by project and agent.

    spent: agent, session_id, parent_id, project, total. A parent counts wherever a child of it does, with the tokens that it has there, none if its
    spend is elsewhere; a parent that isn't in ``spent`` isn't counted. One pass per side, with all levels as keys.
    """
    level = lambda name, agent, project: F.struct(F.lit(name).alias("level"), agent.alias("g_agent"), project.alias("g_project"))
    none = F.lit(None).cast("string")
    levels = F.inline(F.array(level("all", none, none), level("agent", F.col("agent"), none), level("project+agent", F.col("agent"), F.col("project"))))
    group = ["level", "g_agent", "g_project"]
    rows = spent.select("agent", "session_id", "parent_id", "total", levels).groupBy(*group, "agent", "session_id").agg(F.max("parent_id").alias("parent_id"), F.sum("total").alias("total"))
    known = spent.select("agent", "session_id").distinct()
    wanted = rows.where("parent_id IS NOT NULL").select(*group, "agent", F.col("parent_id").alias("session_id")).distinct().join(known, ["agent", "session_id"], "left_semi")
    # A session's own row and the wish for it as a parent meet by grouping, as null keys don't join.
    both = rows.select(*group, "agent", "session_id", "total", F.col("parent_id").isNotNull().alias("child"), F.lit(False).alias("parent")).union(wanted.select(*group, "agent", "session_id", F.lit(0).cast("long"), F.lit(False), F.lit(True)))
    one = both.groupBy(*group, "agent", "session_id").agg(F.sum("total").alias("total"), F.bool_or("child").alias("child"), F.bool_or("parent").alias("parent"))
    sums = one.groupBy(*group).agg(F.count_if("child").alias("children"), F.count_if("parent").alias("parents"), F.coalesce(F.sum(F.when(F.col("child"), F.col("total"))), F.lit(0)).alias("child_total"), F.sum(F.when(F.col("child") | F.col("parent"), F.col("total"))).alias("both"))
    return sums.where("children > 0").select("level", F.col("g_agent").alias("agent"), F.col("g_project").alias("project"), "children", "parents", "child_total", F.try_divide("child_total", "both").alias("child_share"))
