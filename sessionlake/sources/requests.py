"""Requests of three engines' raw records in one form, for the live windows.

records: session_id, ord, value (a line's JSON). The result has a row per request: session_id, ord, us, id, rank, context, and ``invalid`` where
the record is a request that can't be read (its other columns are null). Other records make no row; text that is no JSON is invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strict_integer, strict_timestamp
from .open_events import field, text

# ---- fixed values: field names of the engines' records ----
MESSAGE_TOKENS = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")
COUNTER_TOKENS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
STORED_TOKENS = ("input", "cache.write", "cache.read", "output")
# ---- end of fixed values ----


def instant(path: str) -> Column:
    """Microseconds of a number of milliseconds, or of an instant in text."""
    v = field(path)
    kind = F.schema_of_variant(v)
    number = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), field(path, "double"))
    return F.coalesce((number * 1000).cast("long"), F.unix_micros(strict_timestamp(text(path))))


def filled(*paths: str) -> Column:
    """The first text that isn't empty; a value of another type in front of it is no text, and none."""
    out = F.lit(None).cast("string")
    for p in reversed(paths):
        empty = F.coalesce(F.schema_of_variant(field(p)) == "VOID", F.lit(True)) | F.coalesce(text(p) == "", F.lit(False))
        out = F.when(empty, out).otherwise(text(p))
    return out


def tokens(prefix: str, names: tuple[str, ...]) -> list[Column]:
    return [strict_integer(field(f"{prefix}.{n}")) for n in names]


def parsed(records: DataFrame) -> DataFrame:
    return records.withColumn("record", F.try_parse_json("value"))


def observed(rows: DataFrame, us: Column, id_: Column, rank: Column, context: Column, valid: Column) -> DataFrame:
    ok = F.coalesce(F.col("record").isNotNull() & us.isNotNull() & valid, F.lit(False))
    keep = lambda c, name: F.when(ok, c).alias(name)
    # What the rank compares, then time and place.
    full = F.struct(rank.cast("long").alias("value"), us.alias("us"), F.col("ord").alias("ord"))
    return rows.select("session_id", "ord", keep(us, "us"), keep(id_, "id"), keep(full, "rank"), keep(context, "context"), (~ok).alias("invalid"))


def message_requests(records: DataFrame) -> DataFrame:
    """L1. Requests of assistant messages, whose snapshots of one message id rank by their output."""
    rows = parsed(records).where(F.col("record").isNull() | (text("type") == "assistant"))
    new, written, read, output = tokens("message.usage", MESSAGE_TOKENS)
    valid = filled("message.id").isNotNull() & (new + written + read + output).isNotNull()
    return observed(rows, instant("timestamp"), text("message.id"), output, new + written + read, valid)


def counter_requests(records: DataFrame) -> DataFrame:
    """N8, L1. Requests of token counts, known by the counters' totals: input includes what was cached; unknown totals are invalid."""
    rows = parsed(records).where(F.col("record").isNull() | ((text("type") == "event_msg") & (text("payload.type") == "token_count")))
    last, total = tokens("payload.info.last_token_usage", COUNTER_TOKENS), tokens("payload.info.total_token_usage", COUNTER_TOKENS)
    valid = (last[1] <= last[0]) & last[2].isNotNull()
    for t in total:
        valid = valid & t.isNotNull()
    return observed(rows, instant("timestamp"), F.concat_ws(",", *[t.cast("string") for t in total]), F.lit(None), last[0], valid)


def stored_messages(rows: DataFrame) -> DataFrame:
    """S14. Assistant messages of a message table (session_id, id, time_created, data as JSON text) as records, in the table's order (``time_created``, then ``id``)."""
    role = F.try_variant_get(F.try_parse_json("data"), "$.role", "string")
    return rows.where(role == "assistant").select("session_id", F.struct("time_created", "id").alias("ord"), F.to_json(F.struct("id", "data")).alias("value"))


def stored_requests(records: DataFrame) -> DataFrame:
    """L1. Completed requests of stored messages; a record is the message, or holds it as ``data`` (an object or JSON text)."""
    outer = parsed(records).withColumn("outer_id", filled("id"))
    data = F.when(F.schema_of_variant(field("data")) == "STRING", F.try_parse_json(text("data"))).when(field("data").isNotNull(), field("data")).otherwise(F.col("record"))
    inner = outer.withColumn("record", data)
    done = (text("role") == "assistant") & F.coalesce(F.schema_of_variant(field("time.completed")) != "VOID", F.lit(False))
    rows = inner.where(F.col("record").isNull() | done)
    id_ = F.coalesce("outer_id", filled("id"))
    new, written, read, output = tokens("tokens", STORED_TOKENS)
    valid = id_.isNotNull() & (new + written + read + output).isNotNull()
    return observed(rows, instant("time.created"), id_, F.coalesce(instant("time.completed"), instant("time.created")), new + written + read, valid)
