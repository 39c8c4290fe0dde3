"""Comparison of pre-registered before/after cohorts (C1 to C10, C15, C20, C22). Many experiments per run: all keyed by ``experiment``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.stats import cost_per_success, wilson

#: A prime, below which all products of a draw fit 64 bits; and how often a unit with a weight of k or less is drawn, of a million million: the Poisson distribution of mean 1.
PRIME = (1 << 31) - 1
POISSON = (367879441171, 735758882343, 919698602929, 981011843124, 996340153173, 999405815183, 999916758851, 999989750804, 999998874798)


def arms(units: DataFrame, registrations: DataFrame) -> DataFrame:
    """C1. Units with the experiment and arm whose window holds their dispatch.

    registrations: experiment, before_since, before_until, after_since, after_until. A table of experiments is small beside the units, so
    the range join is against its rows; Spark picks the strategy by its size.
    """
    w = registrations.select("experiment", F.explode(F.array(F.struct(F.lit("before").alias("arm"), F.col("before_since").alias("since"), F.col("before_until").alias("until")), F.struct(F.lit("after").alias("arm"), F.col("after_since").alias("since"), F.col("after_until").alias("until")))).alias("w")).select("experiment", "w.*")
    return units.join(w, (units["dispatched_us"] >= w["since"]) & (units["dispatched_us"] < w["until"])).drop("since", "until")


def exposure_gap(planned: Column, actual: Column) -> tuple[Column, Column]:
    """C2. The half-open span between the planned and the actual application; null bounds if they agree or one is unknown."""
    apart = planned.isNotNull() & actual.isNotNull() & (planned != actual)
    return F.when(apart, F.least(planned, actual)), F.when(apart, F.greatest(planned, actual))


def exclusions(candidates: DataFrame, excluded_states: Sequence[str]) -> DataFrame:
    """C3. candidates with ``reason`` (null: kept): in the exposure gap, unlinked, an excluded state, or exposed on both sides.

    candidates: dispatched_us, gap_from, gap_to, linked, state, exposed_before, exposed_after.
    """
    gap = F.coalesce((F.col("dispatched_us") >= F.col("gap_from")) & (F.col("dispatched_us") < F.col("gap_to")), F.lit(False))
    mixed = F.coalesce(F.col("exposed_before") & F.col("exposed_after"), F.lit(False))
    return candidates.withColumn("reason", F.when(gap, "exposure_gap").when(~F.col("linked"), "unlinked").when(F.col("state").isin(*excluded_states), "excluded_state").when(mixed, "mixed_exposure"))


def exclusion_shares(marked: DataFrame, limit: float = 0.10) -> DataFrame:
    """C4. Excluded units per experiment and arm, by reason, their share, and whether it blocks."""
    out = marked.groupBy("experiment", "arm").agg(F.count("*").alias("units"), F.count("reason").alias("excluded"), F.count_if(F.col("reason") == "unlinked").alias("unlinked"))
    return out.withColumn("share", F.col("excluded") / F.col("units")).withColumn("blocking", F.col("share") > limit)


def observability(units: DataFrame, fields: Sequence[str]) -> DataFrame:
    """C5. Per experiment, agent and field: unobservable (never stated), asymmetric (in one arm only), partial (not always), or complete."""
    long = units.select("experiment", "agent", "arm", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("known")) for f in fields])).alias("x")).select("experiment", "agent", "arm", "x.*")
    per = long.groupBy("experiment", "agent", "field").agg(F.bool_or("known").alias("some"), F.bool_and("known").alias("all"), F.bool_or(F.col("known") & (F.col("arm") == "before")).alias("b"), F.bool_or(F.col("known") & (F.col("arm") == "after")).alias("a"))
    return per.select("experiment", "agent", "field", F.when(~F.col("some"), "unobservable").when(F.col("b") != F.col("a"), "asymmetric").when(~F.col("all"), "partial").otherwise("complete").alias("status"))


def mix_distance(units: DataFrame, field: str, limit: tuple[int, int] = (1, 5)) -> DataFrame:
    """C6, C8. Half the L1 distance of a field's shares between the arms, and whether it exceeds the limit (a fraction), decided in whole numbers.

    ``dominant_changed``: the most frequent values differ.
    """
    counts = units.where(F.col(field).isNotNull()).groupBy("experiment", field).agg(F.count_if(F.col("arm") == "before").alias("b"), F.count_if(F.col("arm") == "after").alias("a"))
    all_ = Window.partitionBy("experiment")
    rows = counts.withColumns({"nb": F.sum("b").over(all_), "na": F.sum("a").over(all_), "mb": F.max("b").over(all_), "ma": F.max("a").over(all_)})
    gap = F.sum(F.abs(F.col("b") * F.col("na") - F.col("a") * F.col("nb")))
    out = rows.groupBy("experiment").agg(gap.alias("gap"), F.max("nb").alias("nb"), F.max("na").alias("na"), F.bool_or((F.col("b") == F.col("mb")) != (F.col("a") == F.col("ma"))).alias("dominant_changed"))
    some = (F.col("nb") > 0) & (F.col("na") > 0)
    return out.select("experiment", F.lit(field).alias("field"), F.when(some, F.col("gap") / (2 * F.col("nb") * F.col("na"))).alias("distance"), (some & (F.col("gap") * limit[1] > 2 * limit[0] * F.col("nb") * F.col("na"))).alias("exceeds"), "dominant_changed")


def one_arm_agents(units: DataFrame) -> DataFrame:
    """C7. Agents of one arm only."""
    per = units.groupBy("experiment", "agent").agg(F.min("arm").alias("x"), F.max("arm").alias("y"))
    return per.where("x = y").select("experiment", "agent", F.col("x").alias("arm"))


def volume_flags(units: DataFrame, ratio: tuple[int, int] = (3, 2)) -> DataFrame:
    """C9. Units per arm, and whether one arm has more than ratio times the other's."""
    per = units.groupBy("experiment").agg(F.count_if(F.col("arm") == "before").alias("before"), F.count_if(F.col("arm") == "after").alias("after"))
    return per.withColumn("volume_differs", F.greatest("before", "after") * ratio[1] > F.least("before", "after") * ratio[0])


def confounders(registered: DataFrame, registrations: DataFrame) -> DataFrame:
    """C9. Registered confounders (experiment, at_us, label) that fall into a window of their experiment."""
    both = registered.join(registrations, "experiment")
    inside = ((F.col("at_us") >= F.col("before_since")) & (F.col("at_us") < F.col("before_until"))) | ((F.col("at_us") >= F.col("after_since")) & (F.col("at_us") < F.col("after_until")))
    return both.where(inside).select("experiment", "label").distinct()


def coverage_reasons(facts: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """C10, C21. Per experiment the sorted distinct names of the predicates that hold for any of its rows."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in reasons.items()]))
    return facts.groupBy("experiment").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(hits)))).alias("reasons"))


def wide(units: DataFrame, name: str) -> Column:
    """The column, whole numbers as decimals: a million units' microseconds sum to more than a long holds."""
    return F.col(name).cast("decimal(38,0)") if isinstance(units.schema[name].dataType, IntegralType) else F.col(name)


def rates(units: DataFrame, by: Sequence[str] = ("experiment", "arm")) -> DataFrame:
    """C11, C14, C20. Success rate with its interval, and tokens and time per success, by arm (and task)."""
    win = F.col("state") == "success"
    out = units.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(win).alias("successes"), cost_per_success(wide(units, "tokens"), win).alias("tokens_per_success"), cost_per_success(wide(units, "elapsed_us"), win).alias("us_per_success"))
    low, high = wilson(F.col("successes"), F.col("n"))
    return out.withColumns({"rate": F.col("successes") / F.col("n"), "low": low, "high": high})


def drawn(rows: DataFrame, seed: int, unit: str, replicate: str, out: str) -> DataFrame:
    """C15. rows with how often a replicate draws a unit: a number that is mixed from both, so that any can be had anywhere, and twice alike. In whole numbers that other engines have
    too; a column for each step, as one expression would repeat the steps before it."""
    mixed = rows.withColumn(out, (F.col(unit) * 48271 + F.col(replicate) * 69621 + F.lit(seed).cast("long")) % PRIME)
    x = F.col(out)
    for a, c in ((40692, 12211), (40014, 3791)):
        mixed = mixed.withColumn(out, (x * x % PRIME * x + x * a + c) % PRIME)
    return mixed.withColumn(out, sum((x >= t * PRIME // 10**12).cast("long") for t in POISSON))


def bootstrap(units: DataFrame, metrics: Sequence[str], seed: int = 1729, resamples: int = 5000, level: float = 0.95) -> DataFrame:
    """C15, C16. The ratio (after by before) of each metric per success, and its percentile interval over ``resamples`` resamplings of the units.

    units: experiment, arm, unit_id, state and metrics. A replicate draws each unit as often as a Poisson number says, by ``drawn`` of its id (a hash of ids that aren't whole numbers);
    draws are shared across metrics. A replicate without success or with an unknown value is undefined; any undefined one is counted and voids the interval.
    Draws are summed where they are made, a row per replicate and arm in each task: units are neither ranked, joined nor sent anywhere. Draws made: resamples times units.
    """
    whole = units.schema["unit_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    unit = F.pmod(F.col("unit_id").cast("long") if whole else F.xxhash64("unit_id"), F.lit(PRIME))
    win = F.coalesce(F.col("state") == "success", F.lit(False))
    side = F.xxhash64("experiment", "arm").alias("side")  # a number is a faster key than two texts
    sides = units.select(side, "experiment", "arm").distinct()
    values = units.select(side, unit.alias("unit"), win.cast("long").alias("win"), *metrics)
    spread = values.repartition(max(32, units.sparkSession.sparkContext.defaultParallelism))  # few rows, many draws
    draws = drawn(spread.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long")))), seed, "unit", "replicate", "w")
    sums = [F.sum(F.col("w") * F.col("win")).alias("wins")]
    for m in metrics:
        sums += [F.sum(F.col("w") * F.col(m)).alias(m), F.count_if(F.col(m).isNull() & (F.col("w") > 0)).alias(f"no_{m}")]
    ratio = lambda c: F.max(F.when(F.col("arm") == "after", c)) / F.max(F.when(F.col("arm") == "before", c))
    cost = lambda m: F.when((F.col(f"no_{m}") == 0) & (F.col("wins") > 0), F.col(m) / F.col("wins"))
    costs = draws.groupBy("side", "replicate").agg(*sums).join(sides, "side")
    ratios = costs.groupBy("experiment", "replicate").agg(*[ratio(cost(m)).alias(m) for m in metrics])
    each = units.groupBy("experiment", "arm").agg(*[cost_per_success(F.col(m), F.col("state") == "success").alias(m) for m in metrics])
    points = each.groupBy("experiment").agg(*[ratio(F.col(m)).alias(m) for m in metrics])
    unfold = lambda df, name: df.select("experiment", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics])).alias("x")).select("experiment", "x.*")
    tail = (1 - level) / 2
    bad = F.count_if(F.col("r").isNull())
    intervals = unfold(ratios, "r").groupBy("experiment", "metric").agg(bad.alias("undefined"), F.when(bad == 0, F.percentile("r", tail)).alias("low"), F.when(bad == 0, F.percentile("r", 1 - tail)).alias("high"))
    return unfold(points, "ratio").join(intervals, ["experiment", "metric"]).select("experiment", "metric", "ratio", "undefined", "low", "high")


def verifier_health(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """C22. Verifier runs per group: completed, passed, and an exit-code histogram as ``code=count``."""
    counts = runs.groupBy(*by, "exit_code").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("exit_code", "n")))
    return counts.groupBy(*by).agg(F.sum(F.when(F.col("exit_code").isNotNull(), F.col("n"))).alias("completed"), F.coalesce(F.sum(F.when(F.col("exit_code") == 0, F.col("n"))), F.lit(0)).alias("passed"), F.array_join(F.transform(F.filter(pairs, lambda x: x["exit_code"].isNotNull()), lambda x: F.concat(x["exit_code"].cast("string"), F.lit("="), x["n"].cast("string"))), ",").alias("histogram"))
