"""Cutting lineage between rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, written as a table to the session's checkpoint folder (spark.checkpoint.dir). Where it is unset, a local session gets one of its own; on a cluster that is an
    error, as executors could not read what others wrote."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        given = context.getConf().get("spark.checkpoint.dir")
        if not given and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    path = f"{context._jsc.sc().getCheckpointDir().get()}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
