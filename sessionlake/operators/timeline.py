"""Running sums over long timelines, in tasks of equal size whatever their keys are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import durable


def running_sums(rows: DataFrame, key: str, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums (their own row included) of each key's rows in order.

    Rows are dealt out by range, so that a key's timeline lies in consecutive parts; a part's totals, a row per key and part, tell what came before it. ``order`` must tell the rows
    of a key apart for results that don't depend on their arrival.
    """
    part = "__part"
    with_values = rows.withColumns({f"__{k}": v for k, v in sums.items()})
    dealt = durable(with_values.repartitionByRange(key, *order).withColumn(part, F.spark_partition_id()))
    totals = dealt.groupBy(key, part).agg(*[F.sum(f"__{k}").alias(k) for k in sums])
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(key).alias("__key"), F.col(part).alias("__of"), *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"__before_{k}") for k in sums])
    within = Window.partitionBy(key, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({k: F.coalesce(F.sum(f"__{k}").over(within), F.lit(0)) for k in sums})
    both = own.join(before, (F.col(key) == F.col("__key")) & (F.col(part) == F.col("__of")))
    return both.select(*[c for c in rows.columns if c not in sums], *[(F.col(k) + F.col(f"__before_{k}")).alias(k) for k in sums])


def disjoint(spans: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """keys, start and end of the spans' union, per key in pieces that don't touch; a null end is open. Groups are the spans of one key."""
    last = F.coalesce(F.col(end), F.lit((1 << 63) - 1))
    w = Window.partitionBy(*keys).orderBy(start, last)
    reached = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.coalesce(F.col(start) > reached, F.lit(True)).cast("int"))
    numbered = marked.withColumn("__piece", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*keys, "__piece").agg(F.min(start).alias(start), F.max(last).alias(end)).drop("__piece")
    return out.withColumn(end, F.when(F.col(end) < (1 << 63) - 1, F.col(end)))
