"""The open event format: typing and validation of records (S2, N1 to N3, N9). Invalid records become diagnostics; none is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strict_integer, strict_timestamp

# The format's types and field names.
KINDS = ("session_start", "context", "token_usage", "tool_start", "tool_end", "command_execution", "file_edit", "session_end")
COMMAND_KEYS = ("command", "exit_code", "cwd", "started_at")
TOKENS = ("new_input", "cache_write", "cache_read", "output", "reasoning_output")


def field(path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col("record"), f"$.{path}", kind)


def text(path: str) -> Column:
    """A string field; null for other types."""
    v = field(path)
    return F.when(F.schema_of_variant(v) == "STRING", field(path, "string"))


def given(path: str) -> Column:
    """Whether a field is there and not null."""
    return F.coalesce(F.schema_of_variant(field(path)) != "VOID", F.lit(False))


def cwd_valid() -> Column:
    """No directory, or an absolute one (POSIX or with a drive; no network share)."""
    return ~given("cwd") | F.coalesce(text("cwd").rlike(r"^(?:/(?!/)|[A-Za-z]:[\\/])"), F.lit(False))


def tokens_valid() -> Column:
    """N2. Each kind is absent, null, or a whole number of 0 or more; reasoning is output at most; an absolute directory, if any."""
    ok = F.lit(True)
    for k in TOKENS:
        ok = ok & (~given(f"tokens.{k}") | strict_integer(field(f"tokens.{k}")).isNotNull())
    r, o = strict_integer(field("tokens.reasoning_output")), strict_integer(field("tokens.output"))
    return ok & F.coalesce(r <= o, r.isNull() | o.isNull()) & F.coalesce(F.schema_of_variant(field("tokens")).startswith("OBJECT"), F.lit(False)) & cwd_valid()


def command_valid() -> Column:
    """N3. All of command, exit_code, cwd and started_at are there; each may be null. Else: a string or a list of strings (perhaps empty), an
    integer, an absolute directory, and an instant that states its offset."""
    there = F.lit(True)
    for k in COMMAND_KEYS:
        there = there & field(k).isNotNull()
    command = ~given("command") | F.coalesce(F.schema_of_variant(field("command")).isin("STRING", "ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    nulls = F.exists(F.coalesce(field("command", "array<string>"), F.array().cast("array<string>")), lambda x: x.isNull())
    code = ~given("exit_code") | F.coalesce(F.schema_of_variant(field("exit_code")) == "BIGINT", F.lit(False))
    return there & command & ~nulls & code & cwd_valid() & (~given("started_at") | strict_timestamp(text("started_at")).isNotNull())


def typed(records: DataFrame) -> DataFrame:
    """N1. A row per record: kind, ids, instant, the fields of its kind, and ``problem`` (null: valid).

    records: path, byte_offset, record (variant). A command record with a problem stays an event whose directory and exit code are null.
    """
    known = records.where("record IS NOT NULL")
    kind, at = text("type"), strict_timestamp(text("timestamp"))
    version = strict_integer(field("schema_version"))
    problem = (
        F.when(~version.eqNullSafe(F.lit(1).cast("long")), "schema_version")
        .when(kind.isNull() | ~kind.isin(*KINDS), "unknown_type")
        .when(F.coalesce(text("event_id"), F.lit("")) == "", "event_id")
        .when(F.coalesce(text("session_id"), F.lit("")) == "", "session_id")
        .when((kind == "token_usage") & (at.isNull() | ~tokens_valid()), "token_usage")
        .when((kind == "command_execution") & ~command_valid(), "command_execution")
        .when((kind == "session_start") & ~F.coalesce(text("role").isin("worker", "orchestrator"), F.lit(False)), "role")
    )
    sound = (kind != "command_execution") | problem.isNull()
    return known.select(
        "path", "byte_offset", kind.alias("kind"), text("event_id").alias("event_id"), text("session_id").alias("session_id"), F.unix_micros(at).alias("us"), text("agent").alias("agent"), text("role").alias("role"), F.when(sound, text("cwd")).alias("cwd"),
        text("parent_session_id").alias("parent_id"), text("model").alias("model"), text("tool_call_id").alias("tool_call_id"), field("error", "boolean").alias("error"), F.when(sound, strict_integer(field("exit_code"))).alias("exit_code"),
        *[strict_integer(field(f"tokens.{k}")).alias(k) for k in TOKENS], F.sha2(F.to_json("record"), 256).alias("digest"), problem.alias("problem"),
    )


def unknown_types(events: DataFrame) -> DataFrame:
    """N9. Counts of types outside the format."""
    return events.where("problem = 'unknown_type'").groupBy(F.coalesce("kind", F.lit("(none)")).alias("label")).agg(F.count("*").alias("n"))
