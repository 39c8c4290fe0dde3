"""Queries of the two engines' log typing: the events table written as their records, typed, exploded and folded."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patches import patch_targets
from ..operators import fold
from ..sources import vendor
from .registry import Views, query


def written(v: Views, agent: str, *record) -> DataFrame:
    """Records of an engine's events, a session's file each, with what vendor.*_records adds."""
    own = v.ev.where(F.col("agent") == agent).withColumn("ms", F.expr("us div 1000"))
    at = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp")
    rows = own.select("session_id", F.col("ord").alias("byte_offset"), F.parse_json(F.to_json(F.struct(at, *record))).alias("record"))
    rows = vendor.digested(rows.withColumn("path", F.col("session_id")))
    return rows.withColumns({"agent": F.lit(agent), "ordinal": F.col("byte_offset"), "record_id": F.lit(None).cast("string"), "worker": F.lit(False), "stream_parent": F.lit(None).cast("string"), "inherited": F.lit(False)})


KINDS = ("usage", "tool_start", "tool_end", "command", "context", "file_edit", "unknown", "counter", "metadata")


def kept(events: DataFrame) -> DataFrame:
    """Types that both engines have; ``seq`` counts the kept ones of a record."""
    return events.where(F.col("kind").isin(*KINDS)).withColumn("what", F.coalesce("id", "message", "name", "label", "model")).select("session_id", F.col("byte_offset").alias("ord"), "kind", "what", "us", "cwd", "new_input", "cache_read", "output", "error", "exit_code")


@query("""
WITH e AS (SELECT *, {div:us:1000} * 1000 AS t_us, session_id || '#' || CAST(k % 20 AS STRING) AS id, CASE WHEN k % 4 <> 0 THEN '/r' || CAST(k % 4 AS STRING) END AS dir FROM ev WHERE agent = 'claude')
SELECT session_id, ord, kind, what, t_us AS us, cwd, new_input, cache_read, output, error, exit_code FROM (
 SELECT session_id, ord, t_us, 'usage' AS kind, 'm' || CAST(k % 30 AS STRING) AS what, dir AS cwd, cents AS new_input, k AS cache_read, CAST({div:k:3} AS BIGINT) AS output, CAST(NULL AS BOOLEAN) AS error, CAST(NULL AS BIGINT) AS exit_code FROM e WHERE kind = 'usage'
 UNION ALL SELECT session_id, ord, t_us, 'metadata', CASE WHEN kind = 'usage' THEN 'M' ELSE 'N' END, NULL, NULL, NULL, NULL, NULL, NULL FROM e WHERE kind IN ('usage', 'model')
 UNION ALL SELECT session_id, ord, t_us, 'tool_start', id, dir, NULL, NULL, NULL, NULL, NULL FROM e WHERE kind = 'tool_start'
 UNION ALL SELECT session_id, ord, t_us, 'command', id, dir, NULL, NULL, NULL, NULL, NULL FROM e WHERE kind = 'tool_start' AND k % 3 = 0
 UNION ALL SELECT session_id, ord, t_us, 'file_edit', id, dir, NULL, NULL, NULL, NULL, NULL FROM e WHERE kind = 'tool_start' AND k % 3 = 1
 UNION ALL SELECT session_id, ord, t_us, 'tool_end', id, dir, NULL, NULL, NULL, k % 5 = 0, NULL FROM e WHERE kind = 'tool_end'
 UNION ALL SELECT session_id, ord, t_us, 'command', id, NULL, NULL, NULL, NULL, k % 5 = 0, CASE WHEN k % 5 = 0 THEN k END FROM e WHERE kind = 'tool_end'
 UNION ALL SELECT session_id, ord, t_us, 'context', NULL, dir, NULL, NULL, NULL, NULL, NULL FROM e WHERE kind = 'context') x""")
def message_log_events(v: Views) -> DataFrame:
    k, kind = F.col("k"), F.col("kind")
    id_ = F.concat("session_id", F.lit("#"), (k % 20).cast("string"))
    mark = lambda c, value: F.when(c, value)  # noqa: E731  left out of the JSON where it is null
    start, end = kind == "tool_start", kind == "tool_end"
    used = F.struct(F.lit("tool_use").alias("type"), id_.alias("id"), F.when(k % 3 == 0, "Bash").when(k % 3 == 1, "Edit").otherwise("Look").alias("name"), F.struct(F.lit("/f").alias("file_path"), F.lit("ls").alias("command")).alias("input"))
    code = F.concat(F.lit("Exit code "), k.cast("string"), F.lit("\nbad"))
    ended = F.struct(F.lit("tool_result").alias("type"), id_.alias("tool_use_id"), (k % 5 == 0).alias("is_error"), code.alias("content"))
    blocks = F.coalesce(F.when(start, F.array(F.to_json(used))).when(end, F.array(F.to_json(ended))), F.array().cast("array<string>"))
    usage = F.struct(F.col("cents").alias("input_tokens"), k.alias("cache_read_input_tokens"), F.expr("k div 3").alias("output_tokens"))
    message = F.struct(
        mark(kind == "usage", F.concat(F.lit("m"), (k % 30).cast("string"))).alias("id"),
        F.when(kind == "usage", "M").when(kind == "model", "N").alias("model"),
        mark(kind == "usage", usage).alias("usage"),
        F.transform(blocks, lambda b: F.parse_json(b)).alias("content"),
    )
    type_ = F.when(kind.isin("usage", "model", "tool_start"), "assistant").otherwise("user").alias("type")
    cwd = mark(k % 4 != 0, F.concat(F.lit("/r"), (k % 4).cast("string"))).alias("cwd")
    return kept(vendor.message_events(written(v, "claude", type_, cwd, message.alias("message"))))


@query("""
WITH e AS (SELECT *, {div:us:1000} * 1000 AS t_us, session_id || '#' || CAST(k % 20 AS STRING) AS id FROM ev WHERE agent = 'codex'),
c AS (SELECT session_id, ord, t_us AS us, sum(cents) OVER w AS input, sum(k) OVER w AS cached, sum(k % 7) OVER w AS output FROM e WHERE kind = 'usage' WINDOW w AS (PARTITION BY session_id, {div:ord:500} ORDER BY us, ord ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, coalesce(lag(input) OVER w, 0) AS pi, coalesce(lag(cached) OVER w, 0) AS pc, coalesce(lag(output) OVER w, 0) AS po FROM c WHERE cached <= input WINDOW w AS (PARTITION BY session_id ORDER BY us, ord)),
d AS (SELECT *, input < pi OR cached < pc OR output < po AS reset FROM p),
f AS (SELECT session_id, ord, us, reset, input - CASE WHEN reset THEN 0 ELSE pi END AS di, cached - CASE WHEN reset THEN 0 ELSE pc END AS dc, output - CASE WHEN reset THEN 0 ELSE po END AS dd FROM d)
SELECT session_id, ord, reset, CAST(di - dc AS BIGINT) AS new_input, CAST(dc AS BIGINT) AS cache_read, CAST(dd AS BIGINT) AS output FROM f WHERE di <> 0 OR dc <> 0 OR dd <> 0""")
def rollout_log_tokens(v: Views) -> DataFrame:
    """Cumulative counters of rollout records, which begin anew now and then, folded to increments."""
    totals = v.ev.where("agent = 'codex' AND kind = 'usage'").selectExpr("session_id", "ord", "us", *[f"sum({c}) OVER (PARTITION BY session_id, ord div 500 ORDER BY us, ord ROWS UNBOUNDED PRECEDING) AS {n}" for c, n in (("cents", "i"), ("k", "c"), ("k % 7", "o"))])
    counters = F.struct(F.col("i").alias("input_tokens"), F.col("c").alias("cached_input_tokens"), F.col("o").alias("output_tokens"), F.lit(0).alias("reasoning_output_tokens"))
    payload = F.struct(F.lit("token_count").alias("type"), F.struct(counters.alias("total_token_usage")).alias("info"))
    at = F.date_format(F.timestamp_millis(F.expr("us div 1000")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp")
    rows = totals.select("session_id", F.col("ord").alias("byte_offset"), F.col("session_id").alias("path"), F.parse_json(F.to_json(F.struct(at, F.lit("event_msg").alias("type"), payload.alias("payload")))).alias("record"))
    records = vendor.digested(rows).withColumns({"agent": F.lit("codex"), "ordinal": F.col("byte_offset"), "record_id": F.lit(None).cast("string"), "worker": F.lit(False), "stream_parent": F.lit(None).cast("string"), "inherited": F.lit(False)})
    usage = vendor.rollout_events(records).where("kind = 'usage'").withColumns({"ord": F.col("byte_offset"), "input": F.col("input_total"), "cached": F.col("cache_read")})
    out = fold.counter_deltas(usage, ("input", "cached", "output"), ("input", "cached"))
    return out.select("session_id", "ord", "reset", F.col("d_fresh").alias("new_input"), F.col("d_cached").alias("cache_read"), F.col("d_output").alias("output"))


@query("""
SELECT id, CASE WHEN n > 0 THEN targets ELSE '?' END AS targets FROM (
 SELECT id, len(t) AS n, array_to_string(list_transform(range(1, len(t) + 1), lambda i: 'f' || CAST(i AS STRING)), ',') AS targets
 FROM (SELECT id, regexp_extract_all(text, '[^\\n]+') AS t FROM texts))""")
def text_patch_targets(v: Views) -> DataFrame:
    """Every text written as a patch that adds a file for each of its lines; its targets."""
    lines = F.regexp_extract_all("text", F.lit(r"[^\n]+"), F.lit(0))
    clean = F.transform(lines, lambda x, i: F.concat(F.lit("*** Add File: f"), (i + 1).cast("string"), F.lit("\n+"), F.regexp_replace(x, "[\\x0b\\f\\r\\x1c-\\x1e\\x85\\u2028\\u2029]", " ")))
    patch = F.concat(F.lit("*** Begin Patch\n"), F.array_join(clean, "\n"), F.lit("\n*** End Patch"))
    return v.texts.where("text IS NOT NULL").select("id", F.array_join(patch_targets(patch), ",", "?").alias("targets"))
