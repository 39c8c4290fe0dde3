"""Views over the given tables that have the shape of agent-session data, in SQL that Spark and DuckDB both run.

A view is written once; the engines differ in integer division and in reading an instant's microseconds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "orders", "lineitem", "events", "documents", "conversations", "pages")

#: The report window: two weeks of the month that ``events`` covers.
SINCE, UNTIL = 1_704_672_000_000_000, 1_705_881_600_000_000

VIEWS = {
    "ev": """
        SELECT event_id AS ord, 'u' || CAST(user_id AS STRING) AS session_id, user_id,
          CASE user_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'open' END AS agent,
          {us:ts} AS us, CAST(round(value * 100) AS BIGINT) AS cents,
          CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
          CASE event_type WHEN 'view' THEN 'usage' WHEN 'click' THEN 'tool_start' WHEN 'purchase' THEN 'tool_end'
            WHEN 'error' THEN 'context' ELSE 'model' END AS kind
        FROM events""",
    "usage": """
        SELECT ord, session_id, agent, us, k, cents AS new_input, CASE WHEN k % 7 <> 0 THEN k * 10 END AS cache_write,
          {div:cents:2} AS cache_read, k AS output, CASE WHEN agent = 'codex' THEN {div:k:2} END AS reasoning_output,
          cents + CASE WHEN k % 7 <> 0 THEN k * 10 ELSE 0 END + {div:cents:2} + k AS total
        FROM ev WHERE kind = 'usage'""",
    "counters": """
        SELECT ord, session_id, us,
          sum(cents) OVER (PARTITION BY session_id ORDER BY us, ord ROWS UNBOUNDED PRECEDING) % 100000 AS input,
          sum({div:cents:3} + CASE WHEN k % 13 = 0 THEN cents ELSE 0 END) OVER (PARTITION BY session_id ORDER BY us, ord ROWS UNBOUNDED PRECEDING) % 90000 AS cached,
          sum(k) OVER (PARTITION BY session_id ORDER BY us, ord ROWS UNBOUNDED PRECEDING) % 7000 AS output
        FROM ev WHERE kind IN ('usage', 'model')""",
    "snapshots": "SELECT ord, session_id, session_id || '-' || CAST(k % 10 AS STRING) AS message, {div:k:5} AS output, us, cents FROM ev WHERE kind = 'usage'",
    "pairs": "SELECT ord, session_id, agent, us, k, cents, kind, session_id || '#' || CAST(k % 20 AS STRING) AS id FROM ev WHERE kind IN ('tool_start', 'tool_end')",
    "contexts": """
        SELECT ord, session_id, agent, us, k, CASE WHEN k % 11 <> 0 THEN '/r' || CAST(k % 4 AS STRING) || '/s' || CAST(k % 2 AS STRING) END AS cwd
        FROM ev WHERE kind = 'context'""",
    "models": "SELECT ord, session_id, agent, us, k, CASE k % 5 WHEN 0 THEN 'Alpha-1' WHEN 1 THEN 'alpha-2' WHEN 2 THEN 'beta-1' WHEN 3 THEN 'gamma' END AS model FROM ev WHERE kind = 'model'",
    "sessions": """
        SELECT DISTINCT session_id, user_id, agent, CASE WHEN user_id % 5 <> 0 THEN 'u' || CAST({div:user_id:2} AS STRING) END AS parent_id,
          CASE WHEN user_id % 5 <> 0 THEN 'worker' ELSE 'orchestrator' END AS role
        FROM ev""",
    "dups": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS event_id, 'c' || CAST(l_suppkey AS STRING) AS session_id, {us:l_shipdate} AS us,
          md5(CAST(l_partkey % 3 AS STRING)) AS digest, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
        FROM lineitem""",
    "units": """
        SELECT o_orderkey AS unit_id, {us:o_orderdate} AS dispatched_us, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'unverified' END AS state,
          t.tokens, CASE WHEN t.ship_us IS NOT NULL THEN greatest(t.ship_us - {us:o_orderdate}, 0) END AS elapsed_us, c_mktsegment AS agent,
          o_orderpriority AS model, o_orderpriority AS task_type
        FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS tokens, max({us:l_shipdate}) AS ship_us FROM lineitem GROUP BY l_orderkey) t
          ON t.l_orderkey = o_orderkey""",
    "pulls": """
        SELECT o_orderkey AS pr, c_nationkey AS repo, o_custkey AS author, {us:o_orderdate} AS merged_us, o_orderstatus AS status,
          o_orderkey % 4 AS slot
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "checks": """
        SELECT l_orderkey AS pr, CAST(l_linenumber % 3 AS STRING) AS name, {us:l_shipdate} AS us, l_returnflag <> 'R' AS ok, l_suppkey AS pos, l_partkey AS part
        FROM lineitem""",
    "quota": "SELECT ord, session_id AS account, agent AS engine, us, k AS used, {div:us:86400000000} AS reset_day FROM ev WHERE kind <> 'model'",
    "texts": "SELECT 'd' || CAST(doc_id AS STRING) AS id, text FROM documents UNION ALL SELECT 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id, text FROM conversations",
}


def written(sql: str, engine: str) -> str:
    """The SQL with {div:a:b} and {us:column} in the engine's form."""
    div, us = {"spark": (r"(\1 div \2)", r"timestampdiff(MICROSECOND, TIMESTAMP'1970-01-01 00:00:00', \1)"), "duckdb": (r"(\1 // \2)", r"epoch_us(\1)")}[engine]
    return re.sub(r"\{us:([a-z_.]+)\}", us, re.sub(r"\{div:([a-z_.]+):([a-z_0-9.]+)\}", div, sql))


def needed(names: set[str]) -> list[str]:
    """The views that the named ones are made of, in an order that they can be written in."""
    out: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", VIEWS[name]) and re.search(rf"(FROM|JOIN) {other}\b", VIEWS[name]):
                add(other)
        if name not in out:
            out.append(name)

    for name in sorted(names):
        add(name)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    names = needed({name})
    tables = {t for t in TABLES if any(re.search(rf"(FROM|JOIN) {t}\b", VIEWS[n]) for n in names)}
    ctes = ", ".join(f"{n} AS ({written(VIEWS[n], 'spark')})" for n in names)
    for t in tables:
        ctes = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", ctes)
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}", **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def oracle(sql: str) -> str:
    """A DuckDB query over views: their definitions in front."""
    used = {n for n in VIEWS if re.search(rf"\b{n}\b", sql)}
    ctes = [f"{n} AS ({written(VIEWS[n], 'duckdb')})" for n in needed(used)]
    sql = written(sql, "duckdb").strip()
    if not ctes:
        return sql
    first = "WITH RECURSIVE" if sql.startswith("WITH RECURSIVE ") else "WITH"
    return f"{first} {', '.join(ctes)}{', ' + sql[len(first) + 1 :] if sql.startswith('WITH ') else ' ' + sql}"
