"""Which deliverable an event was for, by all of its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .outcomes import open_during
from .workers import reference_matches


def references_in_context(events: DataFrame, hints: DataFrame, targets: DataFrame) -> DataFrame:
    """(event, deliverable) of what was referred to since the last context of the event's session, up to the event.

    events: event, session_id, us, ord. hints: session_id, us, ord, source (context or refs), kind, value (of refs). targets: deliverable, kind, value. A session's contexts are numbered;
    of each deliverable the first reference within a context is kept, so that a busy context is a row per deliverable.
    """
    none = lambda name: F.lit(None).cast("string").alias(name)
    key = events.schema["event"].dataType
    points = hints.select("session_id", "us", "ord", "source", "kind", "value", F.lit(None).cast(key).alias("event")).unionByName(events.select("session_id", "us", "ord", F.lit("event").alias("source"), none("kind"), none("value"), "event"))
    turn = F.when(F.col("source") == "context", 0).when(F.col("source") == "refs", 1).otherwise(2)
    w = Window.partitionBy("session_id").orderBy("us", "ord", turn).rowsBetween(Window.unboundedPreceding, 0)
    numbered = points.withColumns({"context": F.count_if(F.col("source") == "context").over(w), "at": F.struct("us", "ord")})
    named = reference_matches(numbered.where("source = 'refs'").select("session_id", "context", "at", "kind", "value"), targets, ("session_id", "context", "at"))
    first = named.groupBy("session_id", "context", "deliverable").agg(F.min("at").alias("first"))
    found = numbered.where("source = 'event'").select("session_id", "context", "at", "event").join(first, ["session_id", "context"]).where(F.col("first") <= F.col("at"))
    return found.select("event", "deliverable").distinct()


def linked_events(events: DataFrame, places: DataFrame, by_id: DataFrame, by_reference: DataFrame, deliverables: DataFrame) -> DataFrame:
    """J15. event, deliverable, bucket (linked, unallocated, unassigned, other), evidence and repository.

    events: event, us, bucket (project, other or unassigned), origin_known (whether its directory's origin is). places: event, repo, of the event's project. by_id, by_reference: event, deliverable, of mentions
    of an id in its directory or branch, and of references. deliverables: deliverable, dispatched_us, closed_us (null: open), repos.

    A mentioned id counts before a reference, and either before what was open in the event's repository at the time. Several deliverables of the strongest evidence there is are ambiguous; one must have been
    dispatched, and be of the event's repository. Without a repository of the event's own it has the deliverable's, unless its directory is known to be of another.
    """
    homes = deliverables.select("deliverable", F.explode("repos").alias("repo")).distinct()
    local = places.join(homes.select("repo").distinct(), "repo", "left_semi").distinct()
    each = local.groupBy("event").agg(F.count("*").alias("n_repos"), F.min("repo").alias("repo"))
    few = lambda df, name: df.groupBy("event").agg(F.count_distinct("deliverable").alias(f"n_{name}"), F.min("deliverable").alias(name))
    rows = events.select("event", "us", "bucket", "origin_known").join(each, "event", "left").join(few(by_id, "id"), "event", "left").join(few(by_reference, "ref"), "event", "left")
    strong = F.when(F.col("n_id") > 0, F.struct(F.col("n_id").alias("n"), F.col("id").alias("d"), F.lit("deliverable_id").alias("e"))).when(F.col("n_ref") > 0, F.struct(F.col("n_ref").alias("n"), F.col("ref").alias("d"), F.lit("tool_reference").alias("e")))
    rows = rows.withColumns({"strong": strong, "n_repos": F.coalesce("n_repos", F.lit(0))})
    # What was open, for events that have nothing stronger and one repository; more than one leave the event without any.
    weak = open_during(rows.where("strong IS NULL AND n_repos = 1 AND bucket <> 'other'").select(F.col("event").alias("ord"), F.col("repo").alias("project"), "us"), deliverables.select("deliverable", F.explode("repos").alias("project"), "dispatched_us", "closed_us"))
    rows = rows.join(weak.select(F.col("ord").alias("event"), F.col("deliverable").alias("open"), F.col("bucket").alias("how")), "event", "left")
    one = deliverables.select(F.col("deliverable").alias("d"), "dispatched_us", F.array_sort(F.array_distinct("repos")).alias("repos"))
    rows = rows.withColumn("d", F.when(F.col("strong.n") == 1, F.col("strong.d"))).join(one, "d", "left").join(local.groupBy("event").agg(F.collect_set("repo").alias("own")), "event", "left")  # a project's repositories
    borrowed = F.col("d").isNotNull() & (F.col("n_repos") == 0) & (F.col("bucket") != "other") & ~F.coalesce("origin_known", F.lit(False))
    repos = F.when(borrowed, F.col("repos")).otherwise(F.coalesce("own", F.array().cast("array<string>")))
    rows = rows.withColumn("own", repos)
    fits = (F.col("us") >= F.col("dispatched_us")) & ((F.size("own") == 0) | F.arrays_overlap("own", "repos"))
    chosen = F.when(F.col("strong").isNotNull(), F.when(fits, F.col("d"))).when(F.col("how") == "linked", F.col("open"))
    some = F.col("strong").isNotNull() | F.coalesce(F.col("how") != "unallocated", F.lit(False))
    rows = rows.withColumns({"chosen": chosen, "some": some, "single": F.size("own") == 1})
    kind = F.coalesce("strong.e", F.lit("project_time_weak"))
    bucket = F.when(F.col("bucket") == "other", "other").when(~F.col("single"), "unassigned").when(F.col("chosen").isNotNull(), "linked").otherwise("unallocated")
    evidence = (
        F.when(F.col("bucket") == "other", "other")
        .when(F.col("single"), F.when(F.col("chosen").isNotNull(), kind).when(F.col("some"), "ambiguous").otherwise("unallocated"))
        .otherwise(F.when(F.col("some") | (F.size("own") > 1), "ambiguous").otherwise("unassigned"))
    )
    return rows.select("event", F.when(F.col("single") & (F.col("bucket") != "other"), F.col("chosen")).alias("deliverable"), bucket.alias("bucket"), evidence.alias("evidence"), F.when(F.col("single"), F.get("own", F.lit(0))).alias("repository"))
