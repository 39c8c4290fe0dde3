"""An index of log files beside the logs: what instants and sessions each can hold (S5), so that a window's files are known without opening the others.

A file's row: path, size, modified, ``latest`` (the largest instant of the named fields at any depth, null: none), ``provable`` (false if a value or a name could not be decoded: such a
file is never left out), ``ids`` (sessions that its records are of) and ``parents``. ``updated`` opens files that are new or whose size or time changed; the others' rows are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import strict_timestamp
from ..functions.storage import durable
from ..functions.variants import at, name, obj, string, type_of
from . import jsonl, vendor

SCHEMA = "path string, size bigint, modified bigint, latest bigint, provable boolean, ids array<string>, parents array<string>"
#: Fields with instants, and 1 / the seconds of their numbers (0: numbers are no instants).
MESSAGE_FIELDS = {"timestamp": 0}
ROLLOUT_FIELDS = {"timestamp": 0, "started_at": 1, "started_at_ms": 1000, "completed_at": 1, "completed_at_ms": 1000}
VALUE = r'\s*:\s*("(?:[^"\\]|\\.)*+"|[^\s,}\]]+)'


def line_instants(line: Column, fields: dict[str, int]) -> Column:
    """A line's values of the named fields, at any depth: an array of struct(us, sound). The text is searched, so that what isn't a field can only add instants."""

    def of(field: str, scale: int) -> Column:
        def read(text: Column) -> Column:
            v = F.try_parse_json(text)
            number = F.when(type_of(v).isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), F.try_variant_get(v, "$", "double")) if scale else F.lit(None).cast("double")
            us = F.coalesce((number * (1_000_000 // max(1, scale))).cast("bigint"), F.unix_micros(strict_timestamp(string(v))))
            nested = F.left(text, F.lit(1)).isin("{", "[")
            return F.struct(us.alias("us"), (nested | v.isNotNull()).alias("sound"))

        found = F.when(F.contains(line, F.lit(f'"{field}"')), F.regexp_extract_all(line, F.lit(f'"{field}"{VALUE}'), F.lit(1)))
        return F.transform(F.coalesce(found, F.array().cast("array<string>")), read)

    return F.concat(*[of(f, s) for f, s in fields.items()])


def escaped_name(line: Column, fields: dict[str, int]) -> Column:
    """Whether a name of the line, written with escapes, is one of the fields."""
    keys = F.filter(F.regexp_extract_all(line, F.lit(r'"([^"]*+)"\s*:'), F.lit(1)), lambda k: F.contains(k, F.lit("\\u")))
    spelled = F.transform(keys, lambda k: F.coalesce(string(F.try_parse_json(F.concat(F.lit('"'), k, F.lit('"')))), F.lit("")))
    return F.when(F.contains(line, F.lit("\\u")), F.exists(spelled, lambda k: k.isin(*fields))).otherwise(F.lit(False))


def latest(lines: DataFrame, fields: dict[str, int]) -> DataFrame:
    """S5. path, latest and provable of the files of some lines; a line that isn't UTF-8 makes its file unprovable."""
    text = F.when(F.is_valid_utf8(F.col("line").cast("string")), F.col("line").cast("string"))
    rows = lines.select("path", text.alias("text")).select("path", line_instants(F.col("text"), fields).alias("found"), (F.col("text").isNull() | escaped_name(F.col("text"), fields)).alias("hidden"))
    one = rows.select("path", F.array_max(F.transform("found", lambda x: x["us"])).alias("us"), (~F.col("hidden") & F.forall("found", lambda x: x["sound"])).alias("sound"))
    return one.groupBy("path").agg(F.max("us").alias("latest"), F.min(F.coalesce("sound", F.lit(False))).alias("provable"))


def message_keys(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """path, ids and parents of message logs: by the first record of each."""
    raw = jsonl.parsed(jsonl.read_files(files)).where("record IS NOT NULL")
    streams = vendor.message_streams(raw.select("path", "byte_offset", "record"), files, vendor.sidecars(spark, root), root)
    return streams.select("path", F.array("session_id").alias("ids"), F.array_compact(F.array("stream_parent")).alias("parents"))


def rollout_keys(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """path, ids and parents of rollout files: the first header's session and parent, and the file's own name if records come before it."""
    raw = jsonl.parsed(jsonl.read_files(files)).where("record IS NOT NULL")
    r = F.col("record")
    header = F.coalesce(string(at(r, "type")) == "session_meta", F.lit(False))
    payload = obj(at(r, "payload"))
    parent = string(at(obj(at(obj(at(obj(at(payload, "source")), "subagent")), "thread_spawn")), "parent_thread_id"))
    stem = F.regexp_extract("path", r"([^/]*)\.jsonl$", 1)
    own = F.struct(F.coalesce(name(at(payload, "id")), name(at(payload, "session_id")), stem).alias("id"), parent.alias("parent"), F.col("byte_offset").alias("since"))
    one = raw.groupBy("path").agg(F.min_by(own, F.when(header, F.col("byte_offset"))).alias("h"), F.min("byte_offset").alias("first"))
    before = F.col("h.since").isNull() | (F.col("first") < F.col("h.since"))
    ids = F.array_compact(F.array(F.col("h.id"), F.when(before, stem)))
    return one.select("path", F.array_distinct(ids).alias("ids"), F.array_compact(F.array("h.parent")).alias("parents"))


def scanned(spark: SparkSession, files: DataFrame, root: str, fields: dict[str, int], keys: Callable) -> DataFrame:
    """Index rows of files, which are all read."""
    times, known = latest(jsonl.read_files(files), fields), keys(spark, files, root)
    none = F.array().cast("array<string>")
    rows = files.select("path", "size", "modified").join(times, "path", "left").join(known, "path", "left")
    return rows.select("path", "size", "modified", "latest", F.coalesce("provable", F.lit(True)).alias("provable"), F.coalesce("ids", none).alias("ids"), F.coalesce("parents", none).alias("parents"))


def updated(spark: SparkSession, files: DataFrame, index: DataFrame | None, root: str, fields: dict[str, int], keys: Callable) -> tuple[DataFrame, DataFrame]:
    """S5. (index of all files, files that were opened for it). ``index`` is an earlier result, or None; rows of files that are gone go.

    Write the first to a new place before the old index is dropped.
    """
    old = spark.createDataFrame([], SCHEMA) if index is None else index
    same = ["path", "size", "modified"]
    changed = durable(files.join(old, same, "left_anti").select(*same))
    kept = old.join(files.select(*same), same, "left_semi")
    return kept.unionByName(scanned(spark, changed, root, fields, keys)), changed


def message_index(spark: SparkSession, root: str, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The index of the message logs under a projects folder. A sidecar that changes without its log is seen when the log changes."""
    return updated(spark, vendor.message_files(spark, root), index, root, MESSAGE_FIELDS, message_keys)


def rollout_index(spark: SparkSession, root: str, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The index of the rollout files under a sessions folder."""
    return updated(spark, vendor.rollout_files(spark, root), index, root, ROLLOUT_FIELDS, rollout_keys)
