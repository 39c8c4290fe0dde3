"""Queries of the comparison statistics and experiment operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import experiments as x
from .measure_queries import rounded
from .registry import Views, query

DAY = 86_400_000_000
T0 = 9862 * DAY  # 1997-01-01
REGISTERED = [(f"e{i}", T0 + 150 * i * DAY, T0 + (150 * i + 200) * DAY, T0 + (150 * i + 260) * DAY, T0 + (150 * i + 520) * DAY) for i in range(3)]
REG = "reg(experiment, before_since, before_until, after_since, after_until) AS (VALUES " + ", ".join(f"('{e}', {a}, {b}, {c}, {d})" for e, a, b, c, d in REGISTERED) + ")"
ARMS = f"""WITH {REG}, w AS (SELECT experiment, 'before' AS arm, before_since AS s, before_until AS t FROM reg UNION ALL SELECT experiment, 'after', after_since, after_until FROM reg),
armed AS (SELECT u.*, w.experiment, w.arm FROM units u JOIN w ON u.dispatched_us >= w.s AND u.dispatched_us < w.t) """


def registrations(v: Views) -> DataFrame:
    rows = ", ".join(f"('{e}', {a}, {b}, {c}, {d})" for e, a, b, c, d in REGISTERED)
    return v.spark.sql(f"SELECT * FROM VALUES {rows} AS t(experiment, before_since, before_until, after_since, after_until)")


def armed(v: Views) -> DataFrame:
    return x.arms(v.units, registrations(v))


@query(ARMS + "SELECT experiment, arm, unit_id, state, tokens, elapsed_us FROM armed")
def experiment_arms(v: Views) -> DataFrame:
    return armed(v).select("experiment", "arm", "unit_id", "state", "tokens", "elapsed_us")


@query("SELECT unit_id, CASE WHEN p <> a THEN least(p, a) END AS gap_from, CASE WHEN p <> a THEN greatest(p, a) END AS gap_to FROM (SELECT unit_id, dispatched_us AS p, CASE WHEN unit_id % 3 = 0 THEN dispatched_us WHEN unit_id % 3 = 1 THEN dispatched_us + 5 - unit_id % 10 END AS a FROM units)")
def exposure_gaps(v: Views) -> DataFrame:
    u = v.units.withColumn("a", F.expr("CASE WHEN unit_id % 3 = 0 THEN dispatched_us WHEN unit_id % 3 = 1 THEN dispatched_us + 5 - unit_id % 10 END"))
    low, high = x.exposure_gap(F.col("dispatched_us"), F.col("a"))
    return u.select("unit_id", low.alias("gap_from"), high.alias("gap_to"))


MARKED = ARMS + f""", m AS (SELECT *, CASE WHEN dispatched_us >= {T0 + 190 * DAY} AND dispatched_us < {T0 + 210 * DAY} THEN 'exposure_gap' WHEN unit_id % 13 = 0 THEN 'unlinked' WHEN state = 'unverified' AND unit_id % 2 = 0 THEN 'excluded_state'
  WHEN unit_id % 5 = 0 AND unit_id % 3 = 0 THEN 'mixed_exposure' END AS reason FROM armed) """


def marked(v: Views) -> DataFrame:
    c = armed(v).withColumns({"gap_from": F.lit(T0 + 190 * DAY), "gap_to": F.lit(T0 + 210 * DAY), "linked": F.col("unit_id") % 13 != 0, "exposed_before": F.col("unit_id") % 5 == 0, "exposed_after": F.col("unit_id") % 3 == 0})
    c = c.withColumn("state", F.when((F.col("state") == "unverified") & (F.col("unit_id") % 2 == 0), "abandoned").otherwise(F.col("state")))
    return x.exclusions(c, ["abandoned"])


@query(MARKED + "SELECT experiment, arm, unit_id, reason FROM m")
def exclusion_reasons(v: Views) -> DataFrame:
    return marked(v).select("experiment", "arm", "unit_id", "reason")


@query(MARKED + "SELECT experiment, arm, count(*) AS units, count(reason) AS excluded, count(*) FILTER (reason = 'unlinked') AS unlinked, round(count(reason) / count(*), 6) AS share, count(reason) / count(*) > 0.1 AS blocking FROM m GROUP BY 1, 2")
def exclusion_shares(v: Views) -> DataFrame:
    return rounded(x.exclusion_shares(marked(v)))


@query(ARMS + """, f AS (SELECT experiment, agent, arm, 'tokens' AS field, tokens IS NOT NULL AS k FROM armed UNION ALL SELECT experiment, agent, arm, 'note', agent = 'BUILDING' AND arm = 'after' FROM armed UNION ALL SELECT experiment, agent, arm, 'model', true FROM armed)
SELECT experiment, agent, field, CASE WHEN NOT bool_or(k) THEN 'unobservable' WHEN coalesce(bool_or(k) FILTER (arm = 'before'), false) <> coalesce(bool_or(k) FILTER (arm = 'after'), false) THEN 'asymmetric' WHEN NOT bool_and(k) THEN 'partial' ELSE 'complete' END AS status FROM f GROUP BY 1, 2, 3""")
def metadata_observability(v: Views) -> DataFrame:
    return x.observability(armed(v).withColumn("note", F.when((F.col("agent") == "BUILDING") & (F.col("arm") == "after"), "x")), ("tokens", "note", "model"))


MIX = """, c AS (SELECT experiment, model, count(*) FILTER (arm = 'before') AS b, count(*) FILTER (arm = 'after') AS a FROM (SELECT experiment, arm, CASE WHEN arm = 'after' AND agent = 'MACHINERY' THEN '1-URGENT' ELSE model END AS model FROM armed) GROUP BY 1, 2),
t AS (SELECT *, sum(b) OVER w AS nb, sum(a) OVER w AS na, max(b) OVER w AS mb, max(a) OVER w AS ma FROM c WINDOW w AS (PARTITION BY experiment))
SELECT experiment, 'model' AS field, round(CAST(sum(abs(b * na - a * nb)) AS DOUBLE) / (2 * max(nb) * max(na)), 6) AS distance, sum(abs(b * na - a * nb)) * 200 > 2 * 1 * max(nb) * max(na) AS exceeds, bool_or((b = mb) <> (a = ma)) AS dominant_changed FROM t GROUP BY 1"""


@query(ARMS + MIX)
def mix_distance(v: Views) -> DataFrame:
    u = armed(v).withColumn("model", F.when((F.col("arm") == "after") & (F.col("agent") == "MACHINERY"), "1-URGENT").otherwise(F.col("model")))
    return rounded(x.mix_distance(u, "model", (1, 200)))


@query(ARMS + "SELECT experiment, agent, min(arm) AS arm FROM (SELECT experiment, arm, CASE WHEN agent = 'BUILDING' AND arm = 'after' AND experiment = 'e1' THEN 'BUILT' ELSE agent END AS agent FROM armed) GROUP BY 1, 2 HAVING min(arm) = max(arm)")
def one_arm_agents(v: Views) -> DataFrame:
    return x.one_arm_agents(armed(v).withColumn("agent", F.expr("CASE WHEN agent = 'BUILDING' AND arm = 'after' AND experiment = 'e1' THEN 'BUILT' ELSE agent END")))


@query(ARMS + "SELECT experiment, count(*) FILTER (arm = 'before') AS before, count(*) FILTER (arm = 'after') AS after, greatest(count(*) FILTER (arm = 'before'), count(*) FILTER (arm = 'after')) * 10 > 13 * least(count(*) FILTER (arm = 'before'), count(*) FILTER (arm = 'after')) AS volume_differs FROM armed GROUP BY 1")
def volume_flags(v: Views) -> DataFrame:
    return x.volume_flags(armed(v), (13, 10))


@query(f"WITH {REG}, c AS (SELECT 'e' || CAST(unit_id % 3 AS STRING) AS experiment, dispatched_us AS at_us, model AS label FROM units) SELECT DISTINCT c.experiment, label FROM c JOIN reg r ON c.experiment = r.experiment WHERE (at_us >= before_since AND at_us < before_until) OR (at_us >= after_since AND at_us < after_until)")
def confounders(v: Views) -> DataFrame:
    c = v.units.select(F.concat(F.lit("e"), (F.col("unit_id") % 3).cast("string")).alias("experiment"), F.col("dispatched_us").alias("at_us"), F.col("model").alias("label"))
    return x.confounders(c, registrations(v))


@query(ARMS + """, r AS (SELECT experiment, 'missing_tokens' AS r FROM armed WHERE tokens IS NULL UNION SELECT experiment, 'late' FROM armed WHERE elapsed_us > 200000000000000 UNION SELECT experiment, 'never' FROM armed WHERE tokens < 0)
SELECT e.experiment, coalesce((SELECT string_agg(r, ',' ORDER BY r) FROM r WHERE r.experiment = e.experiment), '') AS reasons FROM (SELECT DISTINCT experiment FROM armed) e""")
def coverage_reasons(v: Views) -> DataFrame:
    out = x.coverage_reasons(armed(v), {"missing_tokens": F.col("tokens").isNull(), "late": F.col("elapsed_us") > 200_000_000_000_000, "never": F.col("tokens") < 0})
    return out.withColumn("reasons", F.array_join("reasons", ","))


WILSON = "(({s}) / ({n}) + {z2} / (2 * ({n}))) / (1 + {z2} / ({n})) {sign} 1.959963984540054 * sqrt(({s}) / ({n}) * (1 - ({s}) / ({n})) / ({n}) + {z2} / (4 * ({n}) * ({n}))) / (1 + {z2} / ({n}))"


def interval(s: str, n: str, upper: bool) -> str:
    s, n = f"CAST({s} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    value = WILSON.format(s=s, n=n, z2=1.959963984540054**2, sign="+" if upper else "-")
    return f"{'least(1.0,' if upper else 'greatest(0.0,'} {value})"


RATES = ", r AS (SELECT experiment, arm, count(*) AS n, count(*) FILTER (state = 'success') AS s, CASE WHEN count(tokens) = count(*) AND count(*) FILTER (state = 'success') > 0 THEN CAST(sum(tokens) AS DOUBLE) / count(*) FILTER (state = 'success') END AS tp, CASE WHEN count(elapsed_us) = count(*) AND count(*) FILTER (state = 'success') > 0 THEN CAST(sum(elapsed_us) AS DOUBLE) / count(*) FILTER (state = 'success') END AS up FROM armed GROUP BY 1, 2) "


@query(ARMS + RATES + f"SELECT experiment, arm, n, s AS successes, round(tp, 6) AS tokens_per_success, round(up, 3) AS us_per_success, round(s / n, 6) AS rate, round({interval('s', 'n', False)}, 6) AS low, round({interval('s', 'n', True)}, 6) AS high FROM r")
def success_rates(v: Views) -> DataFrame:
    return rounded(x.rates(armed(v)).withColumn("us_per_success", F.round("us_per_success", 3)))


@query(ARMS + ", t AS (SELECT experiment, arm, task_type, count(*) AS n, count(*) FILTER (state = 'success') AS s FROM armed GROUP BY 1, 2, 3) " + f"SELECT experiment, arm, task_type, n, s AS successes, round({interval('s', 'n', False)}, 6) AS low, round({interval('s', 'n', True)}, 6) AS high FROM t")
def task_breakdown(v: Views) -> DataFrame:
    return rounded(x.rates(armed(v), ("experiment", "arm", "task_type")).select("experiment", "arm", "task_type", "n", "successes", "low", "high"))


SIDES = RATES + ", p AS (SELECT experiment, max(s) FILTER (arm = 'before') AS bs, max(n) FILTER (arm = 'before') AS bn, max(s) FILTER (arm = 'after') AS as_, max(n) FILTER (arm = 'after') AS an FROM r GROUP BY 1), q AS (SELECT *, " + f"{interval('bs', 'bn', False)} AS ql, {interval('bs', 'bn', True)} AS qu, {interval('as_', 'an', False)} AS pl, {interval('as_', 'an', True)} AS pu, as_ / an AS pp, bs / bn AS qq FROM p), d AS (SELECT experiment, bs, bn, pp - qq AS difference, pp - qq - sqrt((pp - pl) ** 2 + (qu - qq) ** 2) AS low, pp - qq + sqrt((pu - pp) ** 2 + (qq - ql) ** 2) AS high FROM q) "


def sides(v: Views) -> DataFrame:
    r = x.rates(armed(v)).groupBy("experiment").agg(*[F.max(F.when(F.col("arm") == arm, F.col(c))).alias(f"{arm}_{c}") for arm in ("before", "after") for c in ("successes", "n")])
    d, low, high = stats.newcombe(F.col("before_successes"), F.col("before_n"), F.col("after_successes"), F.col("after_n"))
    return r.withColumns({"difference": d, "low": low, "high": high})


@query(ARMS + SIDES + "SELECT experiment, round(difference, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, CAST(ceil(2 * (bs / bn) * (1 - bs / bn) * power(1.959963984540054 + 0.8416212335729143, 2) / power(0.05, 2)) AS BIGINT) AS needed, CASE WHEN low > -0.05 THEN 'non_inferior' WHEN high < -0.05 THEN 'inferior' ELSE 'inconclusive' END AS non_inferiority FROM d")
def newcombe_difference(v: Views) -> DataFrame:
    s, margin = sides(v), F.lit(5.0)
    out = s.select("experiment", "difference", "low", "high", stats.sample_size(F.col("before_successes") / F.col("before_n"), margin).alias("needed"), stats.non_inferiority(F.col("low"), F.col("high"), margin).alias("non_inferiority"))
    return rounded(out)


MIX = "(((({x} * {x}) % 2147483647) * {x} + {x} * {a} + {c}) % 2147483647)"
DRAWN = MIX.format(x="y", a=40014, c=3791)
BOOT = f""", k AS (SELECT experiment, arm, CASE WHEN state = 'success' THEN 1 ELSE 0 END AS win, tokens, coalesce(tokens, 0) AS spent, (unit_id % 2147483647 * 48271 + replicate * 69621 + 1729) % 2147483647 AS x, replicate FROM armed CROSS JOIN (SELECT unnest(range(0, 5000)) AS replicate)),
g AS (SELECT *, {DRAWN} AS z FROM (SELECT *, {MIX.format(x='x', a=40692, c=12211)} AS y FROM k)),
h AS (SELECT *, {' + '.join(f'CAST(z >= {t * x.PRIME // 10**12} AS BIGINT)' for t in x.POISSON)} AS w FROM g),
s AS (SELECT experiment, replicate, arm, sum(w * win) AS wins, CASE WHEN count(tokens) = count(*) THEN sum(w * tokens) END AS tokens, sum(w * spent) AS spent FROM h WHERE w > 0 GROUP BY 1, 2, 3),
c AS (SELECT experiment, replicate, arm, unnest(['tokens', 'spent']) AS metric, unnest([CASE WHEN wins > 0 THEN CAST(tokens AS DOUBLE) / wins END, CASE WHEN wins > 0 THEN CAST(spent AS DOUBLE) / wins END]) AS v FROM s),
q AS (SELECT experiment, replicate, metric, max(v) FILTER (arm = 'after') / max(v) FILTER (arm = 'before') AS r FROM c GROUP BY 1, 2, 3),
ci AS (SELECT experiment, metric, count(*) FILTER (r IS NULL) AS undefined, CASE WHEN count(r) = count(*) THEN quantile_cont(r, 0.025) END AS low, CASE WHEN count(r) = count(*) THEN quantile_cont(r, 0.975) END AS high FROM q GROUP BY 1, 2),
t AS (SELECT experiment, arm, count(*) FILTER (state = 'success') AS wins, CASE WHEN count(tokens) = count(*) THEN sum(tokens) END AS tokens, sum(coalesce(tokens, 0)) AS spent FROM armed GROUP BY 1, 2),
u AS (SELECT experiment, arm, unnest(['tokens', 'spent']) AS metric, unnest([CAST(tokens AS DOUBLE) / nullif(wins, 0), CAST(spent AS DOUBLE) / nullif(wins, 0)]) AS v FROM t),
pt AS (SELECT experiment, metric, max(v) FILTER (arm = 'after') / max(v) FILTER (arm = 'before') AS ratio FROM u GROUP BY 1, 2) """


def booted(v: Views) -> DataFrame:
    """Tokens, of which some are unknown, and what is known of them, ``spent``."""
    return x.bootstrap(armed(v).withColumn("spent", F.coalesce("tokens", F.lit(0))), ["tokens", "spent"])


@query(ARMS + BOOT + "SELECT experiment, metric, round(ratio, 6) AS ratio, undefined, round(low, 6) AS low, round(high, 6) AS high FROM pt JOIN ci USING (experiment, metric)")
def bootstrap_ratio(v: Views) -> DataFrame:
    return rounded(booted(v))


@query(ARMS + BOOT + "SELECT experiment, metric, CASE WHEN ratio IS NULL OR low IS NULL OR high IS NULL THEN 'uncertain' WHEN ratio <= 0.9 AND high < 1.0 THEN 'improved' WHEN low > 1.0 THEN 'worse' ELSE 'uncertain' END AS classification FROM pt JOIN ci USING (experiment, metric)")
def ratio_classes(v: Views) -> DataFrame:
    return booted(v).select("experiment", "metric", stats.ratio_class(F.col("ratio"), F.col("low"), F.col("high")).alias("classification"))


CASES = """cases AS (SELECT unit_id, unit_id % 11 = 0 AS gap, unit_id % 3 <> 0 AS pre, unit_id % 13 = 0 AS flag, unit_id % 17 = 0 AS unripe, unit_id % 7 <> 0 AS enough, CASE WHEN unit_id % 19 <> 0 THEN (unit_id % 23 - 12) / 100.0 END AS low, (unit_id % 23 - 12) / 100.0 + 0.08 AS high,
 CASE unit_id % 4 WHEN 0 THEN 'worse' WHEN 1 THEN 'improved' ELSE 'uncertain' END AS tok, CASE unit_id % 5 WHEN 0 THEN 'worse' WHEN 1 THEN 'improved' ELSE 'uncertain' END AS tim FROM units)"""


@query("WITH " + CASES + """SELECT unit_id, CASE WHEN gap OR NOT pre OR flag OR unripe OR NOT enough OR low IS NULL THEN 'withhold' WHEN high < -0.05 THEN 'reject' WHEN low <= -0.05 THEN 'withhold'
 WHEN low > 0 AND (tok = 'worse' OR tim = 'worse') THEN 'owner_decides' WHEN tok <> tim AND tok <> 'uncertain' AND tim <> 'uncertain' THEN 'owner_decides' WHEN tok = 'worse' OR tim = 'worse' THEN 'reject' WHEN tok = 'improved' OR tim = 'improved' THEN 'adopt' ELSE 'withhold' END AS proposal,
 CASE WHEN gap THEN 'incomplete_coverage,gap' WHEN NOT pre AND flag THEN 'not_preregistered,not_comparable,mix' WHEN NOT pre THEN 'not_preregistered' WHEN flag THEN 'not_comparable,mix' WHEN unripe THEN 'immature_or_in_progress' WHEN NOT enough THEN 'insufficient_sample' WHEN low IS NULL THEN 'inconclusive_success' WHEN high < -0.05 THEN 'success_inferior' WHEN low <= -0.05 THEN 'inconclusive_success'
 WHEN low > 0 AND (tok = 'worse' OR tim = 'worse') THEN 'success_cost_tradeoff' WHEN tok <> tim AND tok <> 'uncertain' AND tim <> 'uncertain' THEN 'time_token_tradeoff' WHEN tok = 'worse' AND tim = 'worse' THEN 'tokens_and_time_worse' WHEN tok = 'worse' THEN 'tokens_worse_without_offset' WHEN tim = 'worse' THEN 'time_worse_without_offset' WHEN tok = 'improved' OR tim = 'improved' THEN 'non_inferior_with_cost_improvement' ELSE 'no_detectable_change' END AS reasons FROM cases""")
def verdicts(v: Views) -> DataFrame:
    c = v.units.selectExpr("unit_id", "unit_id % 11 = 0 AS gap", "unit_id % 3 <> 0 AS pre", "unit_id % 13 = 0 AS flag", "unit_id % 17 = 0 AS unripe", "unit_id % 7 <> 0 AS enough", "CASE WHEN unit_id % 19 <> 0 THEN CAST((unit_id % 23 - 12) / 100.0 AS DOUBLE) END AS low", "CAST((unit_id % 23 - 12) / 100.0 + 0.08 AS DOUBLE) AS high", "CASE unit_id % 4 WHEN 0 THEN 'worse' WHEN 1 THEN 'improved' ELSE 'uncertain' END AS tok", "CASE unit_id % 5 WHEN 0 THEN 'worse' WHEN 1 THEN 'improved' ELSE 'uncertain' END AS tim")
    names = lambda c, n: F.when(F.col(c), F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
    out = stats.verdict(names("gap", "gap"), F.col("pre"), names("flag", "mix"), F.col("unripe"), F.col("enough"), F.col("low"), F.col("high"), F.lit(5.0), F.col("tok"), F.col("tim"))
    return c.select("unit_id", out.alias("v")).select("unit_id", "v.proposal", F.array_join("v.reasons", ",").alias("reasons"))


@query("WITH r AS (SELECT agent, CASE WHEN unit_id % 9 <> 0 THEN unit_id % 3 END AS e FROM units), g AS (SELECT agent, e, count(*) AS n FROM r GROUP BY 1, 2) SELECT agent, CAST(sum(n) FILTER (e IS NOT NULL) AS BIGINT) AS completed, CAST(coalesce(sum(n) FILTER (e = 0), 0) AS BIGINT) AS passed, string_agg(CAST(e AS STRING) || '=' || CAST(n AS STRING), ',' ORDER BY e) FILTER (e IS NOT NULL) AS histogram FROM g GROUP BY 1")
def verifier_health(v: Views) -> DataFrame:
    return x.verifier_health(v.units.withColumn("exit_code", F.when(F.col("unit_id") % 9 != 0, F.col("unit_id") % 3)), ["agent"])
