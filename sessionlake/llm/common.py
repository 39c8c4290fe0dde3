"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a folder of
    its own; on a cluster that is an error, as executors could not read what others wrote."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    given = context.getConf().get("spark.checkpoint.dir")
    if not given and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder: later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """As durable, in columns: later reads fetch only those that they need."""
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what lies at a path of ``scratch`` that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, for an operator's own use."""
    taken, end = {c.lower() for c in df.columns}, ""
    while any(f"__{n}{end}" in taken for n in names):
        end += "_"
    return [f"__{n}{end}" for n in names]


def per_row(make: Callable[[], Callable], returns: str, arrow: pa.DataType, *columns: Column) -> Column:
    """A column made by ``make()``'s function, called with the Python values of each row.

    ``make`` runs once per task, so that models and tokenizers load once.
    Strings arrive as UTF-8 bytes. ``arrow`` is the Arrow form of ``returns``.
    """

    def as_values(a: pa.Array) -> Iterator:
        if pa.types.is_string(a.type) or pa.types.is_large_string(a.type):
            a = a.cast(pa.large_binary() if pa.types.is_large_string(a.type) else pa.binary())
        return (x.as_py() for x in a)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for a in batches:
            yield pa.array((f(x) for x in as_values(a)), type=arrow)

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        f = make()
        for arrays in batches:
            yield pa.array((f(*x) for x in zip(*map(as_values, arrays), strict=True)), type=arrow)

    run = one if len(columns) == 1 else several
    run.__annotations__ = {
        "batches": Iterator[pa.Array] if len(columns) == 1 else Iterator[tuple[pa.Array, ...]],
        "return": Iterator[pa.Array],
    }
    return F.arrow_udf(run, returns)(*columns)


def put(df: DataFrame, **columns: Column) -> DataFrame:
    """withColumns for operators: a column of the same name (in any case) is replaced, others stay."""
    taken = {c.lower() for c in columns}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])
