"""Query of the request readers: usage events written as the three engines' records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import requests as r
from .registry import Views, query


@query("""SELECT session_id, ord, bad AS invalid, CASE WHEN NOT bad THEN us END AS us, CASE WHEN NOT bad THEN id END AS id, CASE WHEN NOT bad THEN context END AS context FROM (
 SELECT session_id, ord, CASE WHEN agent = 'codex' THEN k * 100 > new_input ELSE cache_write IS NULL END AS bad, {div:us:1000} * 1000 AS us,
  CASE WHEN agent = 'codex' THEN CAST(new_input AS STRING) || ',' || CAST(k AS STRING) || ',' || CAST(output AS STRING) || ',0' ELSE 'm' || CAST(k % 30 AS STRING) END AS id, CASE WHEN agent = 'codex' THEN new_input ELSE new_input + cache_write + cache_read END AS context FROM usage)""")
def raw_requests(v: Views) -> DataFrame:
    u = v.usage.withColumns({"ms": F.expr("us div 1000"), "m": F.concat(F.lit("m"), (F.col("k") % 30).cast("string"))})
    at = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp")
    named = lambda names: [F.col(c).alias(n) for n, c in zip(names, ("new_input", "cache_write", "cache_read", "output"), strict=True)]
    message = F.struct(F.lit("assistant").alias("type"), at, F.struct(F.col("m").alias("id"), F.struct(*named(r.MESSAGE_TOKENS)).alias("usage")).alias("message"))
    counters = lambda *c: F.struct(*[x.alias(n) for n, x in zip(r.COUNTER_TOKENS, c, strict=True)])
    zero = F.lit(0)
    info = F.struct(counters(F.col("new_input"), F.col("k") * 100, F.col("output"), zero).alias("last_token_usage"), counters(F.col("new_input"), F.col("k"), F.col("output"), zero).alias("total_token_usage"))
    counter = F.struct(F.lit("event_msg").alias("type"), at, F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload"))
    stored = F.struct(F.lit("assistant").alias("role"), F.struct(F.col("ms").alias("created"), F.col("ms").alias("completed")).alias("time"), F.struct(F.col("new_input").alias("input"), F.col("output"), F.struct(F.col("cache_write").alias("write"), F.col("cache_read").alias("read")).alias("cache")).alias("tokens"))
    lines = lambda agent, value: u.where(F.col("agent") == agent).select("session_id", "ord", F.to_json(value).alias("value"))
    table = u.where("agent = 'open'").select("session_id", F.col("m").alias("id"), F.col("ord").alias("time_created"), F.to_json(stored).alias("data"))
    last = r.stored_requests(r.stored_messages(table)).withColumn("ord", F.col("ord.time_created"))
    out = [r.message_requests(lines("claude", message)), r.counter_requests(lines("codex", counter)), last]
    keep = ("session_id", "ord", "invalid", "us", "id", "context")
    return out[0].select(*keep).union(out[1].select(*keep)).union(out[2].select(*keep))
