"""Small inputs as tables: ledger, registrations, interventions, labels, prices and signals (S7, S9 to S13). Problems are rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import LABEL, epoch_or_timestamp, strict_integer, strict_timestamp
from ..functions.variants import at, elements, string, type_of

LEDGER = "id string, dispatched_at string, acceptance string, repos string, prs string, branches string, state_override string, accepted_by_human string, notes string, task_type string"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """S7. Deliverables with arrays of repositories, branches and pull requests (id, role), and ``problem``."""
    raw = spark.read.csv(path, header=True, schema=LEDGER, enforceSchema=True)
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), F.trim), lambda x: x != "")
    prs = F.transform(parts("prs"), lambda p: F.struct(F.regexp_extract(p, r"^([^:]+)", 1).alias("pr"), F.coalesce(F.nullif(F.regexp_extract(p, r":(\w+)$", 1), F.lit("")), F.lit("constituent")).alias("role")))
    at = F.unix_micros(strict_timestamp(F.col("dispatched_at")))
    rows = raw.select("id", at.alias("dispatched_us"), parts("repos").alias("repos"), prs.alias("prs"), parts("branches").alias("branches"), F.col("state_override").startswith("abandoned").alias("abandoned"), F.col("accepted_by_human").alias("human"), "task_type")
    repeated = F.count("*").over(Window.partitionBy("id")) > 1
    bad_pr = F.exists("prs", lambda p: ~p["pr"].rlike(r"^[^/#\s]+/[^/#\s]+#[0-9]+$") | ~p["role"].isin("constituent", "retry", "followup"))
    return rows.withColumn("problem", F.when(repeated, "duplicate_id").when(F.col("dispatched_us").isNull(), "dispatched_at").when(bad_pr, "prs").when(~F.coalesce(F.col("human"), F.lit("")).isin("", "y", "n"), "accepted_by_human"))


def shared_pulls(deliverables: DataFrame) -> DataFrame:
    """S7. Pull requests that more than one deliverable owns."""
    one = deliverables.select("id", F.explode("prs.pr").alias("pr")).distinct()
    return one.groupBy("pr").agg(F.count("*").alias("owners")).where("owners > 1")


def interventions(records: DataFrame) -> DataFrame:
    """S10. The one applied instant of each intervention; several or none make no row. records: action, intervention_id, practice_id, utc_time (text)."""
    applied = records.where("action <> 'revert'").select(F.coalesce("intervention_id", "practice_id").alias("id"), F.unix_micros(strict_timestamp(F.col("utc_time"))).alias("us"))
    return applied.where("us IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.min("us").alias("us"), F.max("us").alias("z")).where("us = z").drop("z")


def labels(records: DataFrame, dimensions: tuple[str, ...] = ("lane", "account", "start_kind", "host")) -> DataFrame:
    """S11. Label lines with ``problem``: a prefix of 8 characters at least, one dimension at least, and a valid instant if one is stated."""
    any_ = F.coalesce(*dimensions).isNotNull()
    us = F.unix_micros(strict_timestamp(F.col("at")))
    bad = F.when(F.coalesce(F.length("session"), F.lit(0)) < 8, "session").when(~any_, "dimensions").when(F.col("at").isNotNull() & us.isNull(), "at")
    return records.withColumns({"us": us, "problem": bad})


def signals(records: DataFrame, windows: DataFrame) -> DataFrame:
    """S13. Signals (ts text, event) per arm and label; ``outside`` and ``unreadable`` are counted as arms. windows: arm, since, until."""
    at = F.unix_micros(epoch_or_timestamp(F.col("ts")))
    rows = records.withColumn("__us", at)
    hit = rows.join(windows, (F.col("__us") >= F.col("since")) & (F.col("__us") < F.col("until")), "left")
    return hit.groupBy(F.when(F.col("__us").isNull() | F.col("event").isNull(), "unreadable").when(F.col("arm").isNull(), "outside").otherwise(F.col("arm")).alias("arm"), F.col("event").alias("label")).agg(F.count("*").alias("n"))


# ---- fixed values: fields of registrations and kinds of prices ----
REGISTRATION = ("intervention_id", "applied_at", "registered_at", "predictions", "non_inferiority_margin_pp", "sample_size_per_arm", "follow_up_days", "before", "after")
REGISTRATION_MORE, PREDICTION, PREDICTION_MORE = ("confounders", "outcome_source"), ("metric", "direction", "rough_size_percent"), ("condition",)
OUTCOME_SOURCES, PRICED = ("github", "local-verify", "worker-github"), ("new_input", "cache_write", "cache_read", "output")
# ---- end of fixed values ----


def only(v: Column, must: tuple[str, ...], may: tuple[str, ...] = ()) -> Column:
    """Whether a variant is an object with all the fields of ``must`` and others of ``may`` at most."""
    names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    lits = lambda x: F.array(*[F.lit(n) for n in x]).cast("array<string>")
    return F.coalesce((type_of(v) == "OBJECT") & (F.size(F.array_except(lits(must), names)) == 0) & (F.size(F.array_except(names, lits(must + may))) == 0), F.lit(False))


def number(v: Column) -> Column:
    return F.when(type_of(v).isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), F.try_variant_get(v, "$", "double"))


def registrations(docs: DataFrame) -> DataFrame:
    """S9. Registrations of comparisons with ``problem`` (null: valid). docs: path, record (variant).

    Columns: intervention_id, applied_us, registered_us, before_since to after_until, margin, per_arm, follow_up_days, predictions (metric, direction, size), confounders (us, label), outcome_source,
    and ``preregistered``: before both the change and the second window.
    """
    r = F.col("record")
    us = lambda path: F.unix_micros(strict_timestamp(string(at(r, path))))
    label = lambda v: F.coalesce(string(v).rlike(LABEL) & ~F.contains(string(v), F.lit("\n")), F.lit(False))
    foreseen = F.transform(elements(at(r, "predictions")), lambda p: F.struct(string(at(p, "metric")).alias("metric"), string(at(p, "direction")).alias("direction"), number(at(p, "rough_size_percent")).alias("size")))
    events = F.transform(elements(at(r, "confounders")), lambda e: F.struct(F.unix_micros(strict_timestamp(string(at(e, "at")))).alias("us"), string(at(e, "label")).alias("label")))
    rows = docs.select(
        *docs.columns, string(at(r, "intervention_id")).alias("intervention_id"), us("applied_at").alias("applied_us"), us("registered_at").alias("registered_us"),
        *[us(f"{arm}.{end}").alias(f"{arm}_{end}") for arm in ("before", "after") for end in ("since", "until")], number(at(r, "non_inferiority_margin_pp")).alias("margin"), strict_integer(at(r, "sample_size_per_arm")).alias("per_arm"),
        number(at(r, "follow_up_days")).alias("follow_up_days"), foreseen.alias("predictions"), events.alias("confounders"), F.when(at(r, "outcome_source").isNull(), "github").otherwise(string(at(r, "outcome_source"))).alias("outcome_source"),
    )
    known = lambda *c: F.greatest(*[F.col(x).isNull() for x in c])
    sound_prediction = lambda p: F.coalesce(only(p, PREDICTION, PREDICTION_MORE) & label(at(p, "metric")) & string(at(p, "direction")).isin("increase", "decrease") & (number(at(p, "rough_size_percent")) >= 0) & (at(p, "condition").isNull() | string(at(p, "condition")).isNotNull()), F.lit(False))
    sound_event = lambda e: F.coalesce(only(e, ("at", "label")) & label(at(e, "label")) & strict_timestamp(string(at(e, "at"))).isNotNull(), F.lit(False))
    length = lambda arm: F.col(f"{arm}_until") - F.col(f"{arm}_since")
    problem = (
        F.when(~only(r, REGISTRATION, REGISTRATION_MORE), "fields")
        .when(~F.coalesce(F.col("outcome_source").isin(*OUTCOME_SOURCES), F.lit(False)), "outcome_source")
        .when(~label(at(r, "intervention_id")), "intervention_id")
        .when(known("applied_us", "registered_us") | ~only(at(r, "before"), ("since", "until")) | ~only(at(r, "after"), ("since", "until")) | known("before_since", "before_until", "after_since", "after_until"), "instants")
        .when((length("before") <= 0) | (length("before") != length("after")) | (F.col("before_until") > F.col("applied_us")) | (F.col("after_since") < F.col("applied_us")), "windows")
        .when(F.col("margin").isNull() | (F.col("margin") <= 0) | (F.col("margin") >= 100) | F.coalesce(F.col("per_arm") < 1, F.lit(True)) | F.coalesce(F.col("follow_up_days") <= 0, F.lit(True)), "sizes")
        .when((type_of(at(r, "predictions")) != "ARRAY") | (F.size("predictions") == 0) | ~F.forall(elements(at(r, "predictions")), sound_prediction), "predictions")
        .when(F.coalesce(type_of(at(r, "confounders")) != "ARRAY", F.lit(False)) | ~F.forall(elements(at(r, "confounders")), sound_event), "confounders")
    )
    return rows.withColumns({"preregistered": F.col("registered_us") <= F.least("applied_us", "after_since"), "problem": problem})


def prices(docs: DataFrame) -> DataFrame:
    """S12. A row per model pattern of price tables: path, place (in the file: the first pattern that fits a model counts), pattern (lower case), the price per kind (null: none), currency, as_of, and
    ``problem`` (null: valid). docs: path, text (JSON).

    A table without patterns is one row with a problem.
    """
    whole = docs.select("path", "text", F.try_parse_json("text").alias("record"))
    r = F.col("record")
    names = F.map_keys(F.from_json("text", "models map<string,string>")["models"])  # a map of text keeps the file's order, a variant doesn't
    models = F.try_variant_get(at(r, "models"), "$", "map<string,variant>")
    placed = F.when(F.size(models) > 0, F.transform(names, lambda n: F.struct(n.alias("key"), models[n].alias("value"))))
    one = whole.select("path", F.coalesce(string(at(r, "currency")), F.lit("USD")).alias("currency"), string(at(r, "as_of")).alias("as_of"), F.posexplode_outer(placed).alias("place", "m"))
    of = F.col("m.value")
    bad = ~only(of, (), PRICED)
    for k in PRICED:
        bad = bad | (at(of, k).isNotNull() & ~F.coalesce(number(at(of, k)) >= 0, F.lit(False)))
    problem = F.when(F.col("m").isNull(), "models").when(F.col("m.key") == "", "pattern").when(bad, "prices")
    return one.select("path", "place", F.lower("m.key").alias("pattern"), *[number(at(of, k)).alias(k) for k in PRICED], "currency", "as_of", problem.alias("problem"))


def price_list(table: DataFrame) -> list[tuple[str, dict[str, float | None]]]:
    """The patterns of one valid price table for measures.priced, in its order. At most as many as a file has."""
    rows = table.where("problem IS NULL").collect()
    return [(r["pattern"], {k: r[k] for k in PRICED if r[k] is not None}) for r in sorted(rows, key=lambda r: r["place"])]
