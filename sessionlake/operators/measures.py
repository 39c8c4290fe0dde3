"""Report aggregates: totals, profiles, calls, delegation, denials, labels, prices and policy (M rows).

Breakdowns that share an input are one pass with GROUPING SETS. Percentiles are nearest-rank (``percentile_disc``); shares of
nothing are null. Small dimensions (prices, patterns, labels) join distinct values, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import glob_regex
from ..functions.storage import durable
from .attribution import TOKENS


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def nearest_rank(value: str, fraction: float, kind: str = "long") -> Column:
    """M15. sorted[ceil(n * fraction) - 1]."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {value})").cast(kind)


def token_sums(kinds: Sequence[str] = TOKENS) -> list[Column]:
    """M1. Sums of reported values, and how many rows don't report them."""
    return [x for c in kinds for x in (F.sum(c).alias(c), F.count_if(F.col(c).isNull()).alias(f"{c}_unreported"))]


def totals(usage: DataFrame) -> DataFrame:
    """M1. One row over all events."""
    return usage.agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), *token_sums())


def by_agent(usage: DataFrame, agents: DataFrame) -> DataFrame:
    """M2. Totals per agent; agents without events have a row."""
    got = usage.groupBy("agent").agg(F.count("*").alias("events"), F.sum("total").alias("total"), *token_sums())
    return agents.select("agent").distinct().join(got, "agent", "left").fillna(0, ["events", "total"])


def role(parent_id: Column, header_role: Column, is_open: Column) -> Column:
    """M4. Open events state their role; native sessions with a parent or a worker header are workers."""
    return F.when(is_open, header_role).when(parent_id.isNotNull() | (header_role == "worker"), "worker").otherwise("orchestrator")


def top_decile(sessions: DataFrame, by: Sequence[str], value: str = "total") -> DataFrame:
    """M6. The (n + 9) // 10 largest sessions per group: how many, their tokens and their share."""
    every = Window.partitionBy(*by)
    ranked = sessions.withColumns({"__r": F.row_number().over(every.orderBy(F.desc(value), "session_id")), "__n": F.count("*").over(every)})
    top = F.col("__r") <= F.expr("(__n + 9) div 10")
    out = ranked.groupBy(*by).agg(F.count_if(top).alias("top_sessions"), F.sum(F.when(top, F.col(value))).alias("top_total"), F.sum(value).alias("__all"))
    return out.withColumn("top_share", share(F.col("top_total"), F.col("__all"))).drop("__all")


def role_profile(sessions: DataFrame, by: Sequence[str], days: float, long_us: int = 3_600_000_000) -> DataFrame:
    """M3, M5. Per group: sessions, per-day rates, median tokens, error rate, cache reads per call, and the long tail of active time."""
    n, calls = F.count("*"), F.sum("calls")
    tail = F.col("active_us") > long_us
    return sessions.groupBy(*by).agg(
        n.alias("sessions"), (n / days).alias("sessions_per_day"), F.sum("total").alias("total"), (F.sum("total") / days).alias("tokens_per_day"),
        F.median("total").alias("median_total"), calls.alias("calls"), share(F.sum("errors"), calls).alias("error_rate"),
        share(F.coalesce(F.sum("cache_read"), F.lit(0)), calls).alias("cache_read_per_call"), F.sum("active_us").alias("active_us"),
        F.count_if(tail).alias("long_sessions"), F.coalesce(F.sum(F.when(tail, F.col("total"))), F.lit(0)).alias("long_total"),
        share(F.coalesce(F.sum(F.when(tail, F.col("total"))), F.lit(0)), F.sum("total")).alias("long_share"),
    )


def model_sets(usage: DataFrame) -> DataFrame:
    """M7. Sessions and tokens by the sorted set of models that a session used."""
    one = usage.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("model")), "+").alias("models"), F.sum("total").alias("total"))
    return one.groupBy("models").agg(F.count("*").alias("sessions"), F.sum("total").alias("total"))


def latency(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """M8. Paired calls: count, median (rounded down) and nearest-rank p90 of their microseconds (column ``took``)."""
    return pairs.groupBy(*by).agg(F.count("*").alias("paired_calls"), F.floor(F.median("took")).alias("median_us"), nearest_rank("took", 0.9).alias("p90_us"))


def fan_out(sessions: DataFrame) -> DataFrame:
    """M9. Parents, children, and the most and median children of a parent."""
    per = sessions.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("parents"), F.coalesce(F.sum("n"), F.lit(0)).alias("children"), F.max("n").alias("children_max"), F.median("n").alias("children_median"))


def breakdowns(bridge: DataFrame, dimensions: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    """M10, M28. Aggregates for several sets of dimensions in one pass; ``level`` names the set, columns outside it are null."""
    columns = sorted({c for d in dimensions for c in d})
    sets = [[F.col(c) for c in d] for d in dimensions]
    got = bridge.groupingSets(sets, *columns).agg(F.grouping_id(*columns).alias("__id"), *aggregates)
    level = F.lit(None).cast("string")
    for d in dimensions:
        code = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in d)
        level = F.when(F.col("__id") == code, "+".join(d) or "all").otherwise(level)
    return got.withColumn("level", level).drop("__id")


def context_size() -> Column:
    """M14. New and cached input of a request; unknown where the new input is."""
    return F.when(F.col("new_input").isNotNull(), F.col("new_input") + F.coalesce("cache_write", F.lit(0)) + F.coalesce("cache_read", F.lit(0)))


def calls(requests: DataFrame, since: int, until: int, first: int = 5) -> DataFrame:
    """M11, M12. Per session: calls in the window and their contexts, and the start cost: the first context and the sum of the first ones.

    requests: session_id, us, ord, context. The start counts only if the session's first call lies in the window, and is null if any of its contexts is.
    """
    w = Window.partitionBy("session_id").orderBy("us", "ord")
    inside = (F.col("us") >= since) & (F.col("us") < until)
    rows = requests.withColumns({"__n": F.row_number().over(w), "__in": inside, "__c": F.when(inside, F.col("context"))})
    head = F.col("__n") <= first
    out = rows.groupBy("session_id").agg(
        F.count_if("__in").alias("calls"), F.count_if(F.col("__in") & F.col("context").isNull()).alias("unobserved"), F.sum("__c").alias("context_total"),
        F.median("__c").alias("context_median"), nearest_rank("__c", 0.9).alias("context_p90"), F.max("__c").alias("context_max"),
        F.bool_or(F.col("__in") & (F.col("__n") == 1)).alias("starts"), F.max(F.when(F.col("__n") == 1, F.col("context"))).alias("__first"),
        F.when(F.bool_and(~head | F.col("context").isNotNull()), F.sum(F.when(head, F.col("context")))).alias("__sum"),
    )
    return out.where("calls > 0").withColumns({"first_context": F.when(F.col("starts"), F.col("__first")), "first_sum": F.when(F.col("starts"), F.col("__sum"))}).drop("__first", "__sum")


def pooled_calls(requests: DataFrame, per_session: DataFrame, since: int, until: int) -> DataFrame:
    """M13. Contexts pooled over sessions, starts as medians of sessions. One row."""
    pooled = requests.where((F.col("us") >= since) & (F.col("us") < until)).agg(F.count("*").alias("count"), F.median("context").alias("context_median"), nearest_rank("context", 0.9).alias("context_p90"), F.max("context").alias("context_max"))
    starts = per_session.agg(F.count("*").alias("sessions_with_calls"), F.median("calls").alias("per_session_median"), F.sum("unobserved").alias("unobserved"), F.count_if("starts").alias("start_sessions"), F.median("first_context").alias("first_context_median"), F.median("first_sum").alias("first_sum_median"), F.sum("first_sum").alias("first_sum_total"))
    return pooled.crossJoin(starts)  # one row each


def delegation(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M16. Dispatched children and their parents, their tokens, and the children's share of the tokens of both together."""
    children = sessions.where("parent_id is not null")
    parents = sessions.join(children.select(F.col("parent_id").alias("session_id")).distinct(), "session_id", "left_semi")
    both = children.select("session_id", *by, "total", F.lit(1).alias("c"), F.lit(0).alias("p")).union(parents.select("session_id", *by, "total", F.lit(0), F.lit(1)))
    one = both.groupBy("session_id", *by).agg(F.max("total").alias("total"), F.max("c").alias("c"), F.max("p").alias("p"))
    return one.groupBy(*by).agg(F.sum("c").alias("children"), F.sum("p").alias("parents"), F.sum(F.when(F.col("c") == 1, F.col("total"))).alias("child_total"), share(F.sum(F.when(F.col("c") == 1, F.col("total"))), F.sum("total")).alias("child_share"))


def nesting_depth(sessions: DataFrame) -> DataFrame:
    """M17. Steps to the root (0: no parent). Missing parents and cycles are unknown (null). Where sessions have a column ``reported``, a
    depth that the session itself reports comes first; with a column ``agent``, parents are those of the same agent.

    Pointer doubling: each round joins every session's known ancestor with that one's own, so depth d takes log2(d) rounds. When
    2^rounds exceed the number of sessions, those that still have an ancestor to follow are on cycles or lead into one.
    """
    keys = ["agent", "session_id"] if "agent" in sessions.columns else ["session_id"]
    reported = ["reported"] if "reported" in sessions.columns else []
    known = durable(sessions.select(*keys, F.col("parent_id").alias("up"), *reported).distinct())
    at = known.select(*keys, "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"))
    for _ in range(known.count().bit_length() + 1):
        hop = at.select(*keys[:-1], F.col("session_id").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__d"), F.lit(True).alias("__known"))
        at = durable(at.join(hop, [*keys[:-1], "up"], "left").select(
            *keys,
            F.when(F.col("up").isNotNull() & F.col("__known"), F.col("__up")).otherwise(F.col("up")).alias("up"),
            F.when(F.col("up").isNull() | F.col("__known").isNull(), F.col("depth")).otherwise(F.col("depth") + F.col("__d")).alias("depth"),
            F.coalesce(F.col("__known"), F.lit(False)).alias("moved"),
        ))
        moved = at.where("moved AND up IS NOT NULL").limit(1).count()
        at = at.drop("moved")
        if not moved:
            break
    out = at.select(*keys, F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
    if not reported:
        return out
    given = known.groupBy(*keys).agg(F.max("reported").alias("reported"))
    return out.join(given, keys).select(*keys, F.coalesce("reported", "depth").alias("depth"))


def context_exposure(requests: DataFrame, thresholds: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """M18. Per group: sessions, median and p90 of their mean context, and tokens that lie above each threshold."""
    above = [F.sum(F.greatest(F.col("context") - t, F.lit(0))).alias(f"above_{t}") for t in thresholds]
    one = requests.where("context is not null").groupBy("session_id", *by).agg(F.avg("context").alias("mean"), *above)
    return one.groupBy(*by).agg(F.count("*").alias("sessions"), F.median("mean").alias("mean_median"), nearest_rank("mean", 0.9, "double").alias("mean_p90"), *[F.sum(f"above_{t}").alias(f"above_{t}") for t in thresholds])


def break_even(ratios: DataFrame, limits: Sequence[int]) -> DataFrame:
    """M20. Ratios of reused to fresh tokens of pairs where both are positive: median, p10, p90, and the share below each limit."""
    r = ratios.where("reused > 0 AND fresh > 0").select((F.col("reused") / F.col("fresh")).alias("r"))
    return r.agg(F.count("*").alias("pairs"), F.median("r").alias("median"), nearest_rank("r", 0.1, "double").alias("p10"), nearest_rank("r", 0.9, "double").alias("p90"), *[share(F.count_if(F.col("r") < n).cast("double"), F.count("*")).alias(f"below_{n}") for n in limits])


def model_status(usage: DataFrame) -> DataFrame:
    """M21. Tokens by observed model and whether it was the requested one."""
    status = F.when(F.col("model").isNull() | F.col("requested").isNull(), "unknown").when(F.col("model") == F.col("requested"), "requested").otherwise("unrequested")
    return usage.groupBy(F.coalesce("model", F.lit("unknown")).alias("model"), status.alias("status")).agg(F.count("*").alias("events"), F.sum("total").alias("total"))


def edit_friction(edits: DataFrame, scripts: Sequence[str] = (".sh", ".py", ".js")) -> DataFrame:
    """M22. Edits outside the session's checkout, scripts among them, unobserved targets, and sessions whose edits are all outside.

    edits: session_id, target (null: unobserved), root.
    """
    outside = F.coalesce(~((F.col("target") == F.col("root")) | F.col("target").startswith(F.concat("root", F.lit("/")))), F.lit(False))
    script = F.lit(False)
    for s in scripts:
        script = script | F.col("target").endswith(s)
    one = edits.withColumn("__o", outside).groupBy("session_id").agg(F.count("*").alias("edits"), F.count_if("__o").alias("outside"), F.count_if(F.col("__o") & script).alias("scripts"), F.count_if(F.col("target").isNull()).alias("unobserved"), F.bool_and("__o").alias("all"))
    return one.agg(F.sum("edits").alias("edits"), F.sum("outside").alias("outside"), F.sum("scripts").alias("outside_scripts"), F.sum("unobserved").alias("unobserved"), F.count_if("all").alias("sessions_all_outside"))


def hook_calls(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """M24. Each tool call (session_id, id) with its first output; an output before its input is invalid and dropped."""
    def first(df: DataFrame, *keep: Column) -> DataFrame:
        w = Window.partitionBy("session_id", "id").orderBy("us", "ord")
        return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("session_id", "id", *keep)

    a = first(inputs, F.col("us").alias("called_us"), F.col("ord").alias("called_ord"), "tool")
    b = first(outputs, F.col("us").alias("result_us"), F.col("ord").alias("result_ord"), "denied")
    both = a.join(b, ["session_id", "id"], "left")
    late = F.coalesce(F.col("result_us") < F.col("called_us"), F.lit(False))
    return both.withColumns({"invalid": late, "denied": F.when(~late, F.col("denied")), "result_us": F.when(~late, F.col("result_us")), "result_ord": F.when(~late, F.col("result_ord"))})


def denial_recovery(calls: DataFrame, within: int = 3) -> DataFrame:
    """M25, M26. Denied calls with ``recovered`` (the same tool succeeds in one of the next calls after the denied result) and ``first`` (before every success).

    calls: session_id, called_us, called_ord, result_us, tool, denied. Two windows per session: the calls' ranks, and the number of calls up to
    each result; then an equi join on the rank of the next calls.
    """
    w = Window.partitionBy("session_id").orderBy("called_us", "called_ord")
    ranked = calls.withColumn("rank", F.row_number().over(w))
    probe = ranked.where("denied").select("session_id", F.col("result_us").alias("us"), F.lit(1).alias("p"), "tool", "called_ord")
    marks = probe.unionByName(ranked.select("session_id", F.col("called_us").alias("us"), F.lit(0).alias("p")), allowMissingColumns=True)
    before = F.sum(1 - F.col("p")).over(Window.partitionBy("session_id").orderBy("us", "p").rowsBetween(Window.unboundedPreceding, 0))
    denied = marks.withColumn("k", before).where("p = 1").withColumn("rank", F.explode(F.sequence(F.col("k") + 1, F.col("k") + within)))
    good = ranked.where("not denied").select("session_id", "rank", "tool", F.lit(True).alias("hit"))
    got = denied.join(good, ["session_id", "rank", "tool"], "left").groupBy("session_id", "called_ord").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("recovered"))
    success = ranked.where("not denied").groupBy("session_id").agg(F.min("result_us").alias("s"))
    first = ranked.where("denied").groupBy("session_id").agg(F.min("result_us").alias("d")).join(success, "session_id", "left").select("session_id", F.coalesce(F.col("d") < F.col("s"), F.lit(True)).alias("first"))
    return got.join(first, "session_id")


def denial_summary(calls: DataFrame, by: Sequence[str], top: int = 10) -> DataFrame:
    """M27. Per group: calls, denials, denials per 100 calls, and the most frequent reasons as ``id=count`` (ties: by id)."""
    counts = calls.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if("denied").alias("denials"))
    reasons = calls.where("denied").groupBy(*by, "reason").agg(F.count("*").alias("n"))
    ranked = reasons.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "reason"))).where(F.col("r") <= top)
    best = ranked.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "reason", "n"))), lambda x: F.concat(x["reason"], F.lit("="), x["n"].cast("string"))), ",").alias("top_reasons"))
    return counts.withColumn("per_100_calls", 100 * F.col("denials") / F.col("calls")).join(best, list(by), "left")


def label_segments(sessions: DataFrame, labels: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """M29. (session_id, from_us, to_us, dimensions): half-open spans in which a label line is in force; untimed lines hold from the start.

    labels: prefix (8 characters or more), agent (null: any), us (null: untimed). A line at the same instant as another one replaces it if its order (``line``) is later.
    The prefix join is an equi join on the first 8 characters.
    """
    left = sessions.select("session_id", "agent").withColumn("__p", F.substring("session_id", 1, 8))
    right = labels.withColumn("__p", F.substring("prefix", 1, 8)).withColumnRenamed("agent", "__agent")
    hit = left.join(right, "__p").where(F.col("session_id").startswith(F.col("prefix")) & (F.col("__agent").isNull() | (F.col("__agent") == F.col("agent"))))
    start = F.coalesce("us", F.lit(-(1 << 62)))
    last = hit.withColumn("from_us", start).withColumn("__n", F.row_number().over(Window.partitionBy("session_id", "from_us").orderBy(F.desc("line")))).where("__n = 1")
    w = Window.partitionBy("session_id").orderBy("from_us")
    return last.select("session_id", "from_us", F.coalesce(F.lead("from_us").over(w), F.lit(1 << 62)).alias("to_us"), *dimensions)


def label_rollup(usage: DataFrame, segments: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """M30. Per dimension and value: sessions, events and tokens; what no segment covers is ``unlabeled``."""
    both = usage.join(segments, "session_id", "left")
    inside = F.coalesce((F.col("us") >= F.col("from_us")) & (F.col("us") < F.col("to_us")), F.lit(False))
    one = both.groupBy("session_id", "ord", "total").agg(*[F.max(F.when(inside, F.col(d))).alias(d) for d in dimensions])
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("unlabeled")).alias("value")) for d in dimensions])).alias("x")
    return one.select("session_id", "total", pairs).groupBy("x.dimension", "x.value").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("events"), F.sum("total").alias("total"))


def segment_starts(requests: DataFrame, segments: DataFrame, since: int, until: int, first: int = 5) -> DataFrame:
    """M31. Per session and label segment whose first call lies in the window: the first context, and the sum over its first calls there.

    requests: session_id, us, ord, context. segments: session_id, from_us. Calls before the first segment are one of their own (null from_us). The sum is null if any of its contexts is.
    """
    marks = requests.select("session_id", "us", F.lit(1).alias("__p"), "ord", "context").unionByName(segments.select("session_id", F.col("from_us").alias("us"), F.lit(0).alias("__p")).distinct(), allowMissingColumns=True)
    into = Window.partitionBy("session_id").orderBy("us", "__p", "ord")
    calls = marks.withColumn("from_us", F.last(F.when(F.col("__p") == 0, F.col("us")), ignorenulls=True).over(into)).where("__p = 1")
    n = F.row_number().over(Window.partitionBy("session_id", "from_us").orderBy("us", "ord"))
    head = calls.withColumn("__n", n).where(F.col("__n") <= first).withColumn("__in", (F.col("us") >= since) & (F.col("us") < until))
    out = head.groupBy("session_id", "from_us").agg(
        F.bool_or(F.col("__in") & (F.col("__n") == 1)).alias("__starts"), F.max(F.when(F.col("__n") == 1, F.col("context"))).alias("first_context"),
        F.when(F.bool_and(~F.col("__in") | F.col("context").isNotNull()), F.sum(F.when(F.col("__in"), F.col("context")))).alias("first_sum"),
    )
    return out.where("__starts").drop("__starts")


def label_coverage(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    """M32. Label lines that match a session and those that don't, and sessions with a label. One row."""
    right = labels.withColumn("__p", F.substring("prefix", 1, 8)).withColumnRenamed("agent", "__agent")
    hit = right.join(sessions.withColumn("__p", F.substring("session_id", 1, 8)), "__p").where(F.col("session_id").startswith(F.col("prefix")) & (F.col("__agent").isNull() | (F.col("__agent") == F.col("agent"))))
    matched = hit.agg(F.count_distinct("line").alias("matched_lines"), F.count_distinct("session_id").alias("labelled_sessions"))
    return matched.crossJoin(labels.agg(F.count("*").alias("lines"))).select("matched_lines", (F.col("lines") - F.col("matched_lines")).alias("unmatched_lines"), "labelled_sessions")


def priced(usage: DataFrame, prices: Sequence[tuple[str, dict[str, float | None]]], per: float = 1e6) -> DataFrame:
    """M33. usage with ``cost`` and ``unpriced`` tokens. prices: (glob, price per kind) in order; the first glob that matches the model, in any case, wins.

    A kind without a price, and all kinds of an unknown or unmatched model, are unpriced. Reasoning is part of output and isn't priced again.
    """
    model, row = F.col("model"), F.lit(len(prices))
    for i, (glob, _) in reversed(list(enumerate(prices))):
        row = F.when(model.rlike(glob_regex(glob, ignore_case=True)), i).otherwise(row)
    row = F.coalesce(row, F.lit(len(prices)))
    cost, unpriced = F.lit(0.0), F.lit(0).cast("long")
    for kind in TOKENS[:-1]:
        price = F.lit(None).cast("double")
        for i, (_, of) in enumerate(prices):
            price = F.when(F.col("__row") == i, F.lit(of.get(kind)).cast("double")).otherwise(price)
        n = F.coalesce(F.col(kind), F.lit(0))
        cost = cost + F.coalesce(n * price / per, F.lit(0.0))
        unpriced = unpriced + F.when(price.isNull(), n).otherwise(0)
    return usage.withColumn("__row", row).withColumns({"cost": cost, "unpriced": unpriced}).drop("__row")


def forbidden_models(usage: DataFrame, globs: Sequence[str]) -> DataFrame:
    """M34. Events and tokens of models that match a forbidden glob, by model; unknown models are counted apart."""
    bad = F.coalesce(F.col("model").rlike("|".join(glob_regex(g) for g in globs)), F.lit(False))
    rows = usage.withColumn("status", F.when(F.col("model").isNull(), "unknown").when(bad, "forbidden").otherwise("allowed")).where("status <> 'allowed'")
    return rows.groupBy("status", "model").agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.sum("total").alias("total"))


def compare_windows(metrics: DataFrame, lower_is_better: Sequence[str]) -> DataFrame:
    """M35. metrics(arm, metric, value) of two arms side by side: change in percent and direction."""
    both = metrics.groupBy("metric").agg(F.max(F.when(F.col("arm") == "before", F.col("value"))).alias("before"), F.max(F.when(F.col("arm") == "after", F.col("value"))).alias("after"))
    change = F.when(F.col("before") != 0, 100 * (F.col("after") - F.col("before")) / F.col("before"))
    sign = F.when(F.col("metric").isin(*lower_is_better), -1).otherwise(1) * (F.col("after") - F.col("before"))
    return both.withColumns({"change_percent": change, "direction": F.when(sign > 0, "better").when(sign < 0, "worse").when(sign == 0, "unchanged").otherwise("unknown")})


def predictions(compared: DataFrame, expected: DataFrame) -> DataFrame:
    """M36. Registered predictions (metric, direction, threshold percent) against the comparison: met, and whether the revert threshold is crossed."""
    both = expected.join(compared.withColumnRenamed("direction", "observed"), "metric", "left")
    up = F.col("direction") == "increase"
    met = F.when(up, F.col("change_percent") > 0).otherwise(F.col("change_percent") < 0)
    crossed = F.when(up, F.col("change_percent") <= -F.col("threshold")).otherwise(F.col("change_percent") >= F.col("threshold"))
    return both.select("metric", "change_percent", met.alias("met"), crossed.alias("revert"))


def unpivot(row: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """M37. Allow-listed columns of a wide row as (metric, value)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*")
