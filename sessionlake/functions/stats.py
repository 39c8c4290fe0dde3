"""Column forms of the comparison statistics."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963984540054
POWER_Z = Z + NormalDist().inv_cdf(0.8)


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """C11. Score interval of a proportion, in [0, 1]; null without trials."""
    n = n.cast("double")
    p, z2 = successes / n, Z * Z
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)), F.when(some, F.least(F.lit(1.0), centre + half))


def newcombe(before: Column, before_n: Column, after: Column, after_n: Column) -> tuple[Column, Column, Column]:
    """C12. Difference of two proportions, after minus before, with its hybrid score interval."""
    q, p = before / before_n, after / after_n
    (ql, qu), (pl, pu) = wilson(before, before_n), wilson(after, after_n)
    some = (before_n > 0) & (after_n > 0)
    return F.when(some, p - q), F.when(some, p - q - F.hypot(p - pl, qu - q)), F.when(some, p - q + F.hypot(pu - p, q - ql))


def sample_size(baseline: Column, margin_pp: Column) -> Column:
    """C13. Units per arm for a non-inferiority margin in percentage points."""
    m = margin_pp / 100
    return F.ceil(2 * baseline * (1 - baseline) * POWER_Z**2 / (m * m))


def cost_per_success(value: Column, success: Column) -> Column:
    """C14. Aggregate: sum of values per success; null if a value is unknown or nothing succeeded."""
    wins = F.count_if(success)
    return F.when((F.count_if(value.isNull()) == 0) & (wins > 0), F.sum(value).cast("double") / wins)


def ratio_class(ratio: Column, low: Column, high: Column) -> Column:
    """C17. improved, worse or uncertain."""
    return F.when(ratio.isNull() | low.isNull() | high.isNull(), "uncertain").when((ratio <= 0.90) & (high < 1.0), "improved").when(low > 1.0, "worse").otherwise("uncertain")


def non_inferiority(low: Column, high: Column, margin_pp: Column) -> Column:
    """C19. Strict comparisons of the difference's interval with the margin."""
    return F.when(low.isNull(), "unknown").when(low > -margin_pp / 100, "non_inferior").when(high < -margin_pp / 100, "inferior").otherwise("inconclusive")


def verdict(gaps: Column, preregistered: Column, flags: Column, unripe: Column, enough: Column, low: Column, high: Column, margin_pp: Column, tokens: Column, time: Column) -> Column:
    """C18. struct(proposal, reasons) by ordered gates. gaps and flags are sorted arrays of names; a later gate never undoes an earlier one."""

    def say(proposal: str, *reasons: str) -> Column:
        return F.struct(F.lit(proposal).alias("proposal"), F.array(*map(F.lit, reasons)).alias("reasons"))

    empty = F.array().cast("array<string>")
    not_ready = F.concat(F.when(~preregistered, F.array(F.lit("not_preregistered"))).otherwise(empty), F.when(F.size(flags) > 0, F.concat(F.array(F.lit("not_comparable")), flags)).otherwise(empty))
    worse, better = (tokens == "worse") | (time == "worse"), (tokens == "improved") | (time == "improved")
    return (
        F.when(F.size(gaps) > 0, F.struct(F.lit("withhold").alias("proposal"), F.concat(F.array(F.lit("incomplete_coverage")), gaps).alias("reasons")))
        .when(F.size(not_ready) > 0, F.struct(F.lit("withhold").alias("proposal"), not_ready.alias("reasons")))
        .when(unripe, say("withhold", "immature_or_in_progress"))
        .when(~enough, say("withhold", "insufficient_sample"))
        .when(low.isNull(), say("withhold", "inconclusive_success"))
        .when(high < -margin_pp / 100, say("reject", "success_inferior"))
        .when(low <= -margin_pp / 100, say("withhold", "inconclusive_success"))
        .when((low > 0) & worse, say("owner_decides", "success_cost_tradeoff"))
        .when(worse & better, say("owner_decides", "time_token_tradeoff"))
        .when((tokens == "worse") & (time == "worse"), say("reject", "tokens_and_time_worse"))
        .when(tokens == "worse", say("reject", "tokens_worse_without_offset"))
        .when(time == "worse", say("reject", "time_worse_without_offset"))
        .when(better, say("adopt", "non_inferior_with_cost_improvement"))
        .otherwise(say("withhold", "no_detectable_change"))
    )
