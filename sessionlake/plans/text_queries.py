"""Queries of text functions, live windows and quotas."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import scalars as s
from ..operators import live, texts
from .bridge import UNTIL
from .measure_queries import rounded
from .registry import Views, query

NOW = UNTIL


@query("SELECT id, length(text) AS chars, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, length(text) - length(regexp_replace(text, '\\p{Latin}', '', 'g')) AS latin, length(text) - length(regexp_replace(text, '\\p{Han}', '', 'g')) AS han FROM texts")
def text_scripts(v: Views) -> DataFrame:
    t = v.texts
    return texts.scripts(t).join(t.select("id", F.length("text").alias("chars")), "id").select("id", F.col("chars").cast("long").alias("chars"), F.col("letters").cast("long").alias("letters"), F.col("latin").cast("long").alias("latin"), F.col("han").cast("long").alias("han"))


@query("SELECT id, CAST(ceil((length(text) - (length(text) - length(regexp_replace(text, '[\\p{Hangul}\\p{Han}\\p{Hiragana}\\p{Katakana}]', '', 'g')))) / 4.0) AS BIGINT) + (length(text) - length(regexp_replace(text, '[\\p{Hangul}\\p{Han}\\p{Hiragana}\\p{Katakana}]', '', 'g'))) AS tokens FROM texts")
def token_estimates(v: Views) -> DataFrame:
    return v.texts.select("id", s.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT id, 'id_' || substr(sha256(text), 1, 24) AS pseudonym FROM texts")
def pseudonyms(v: Views) -> DataFrame:
    return v.texts.select("id", s.pseudonym("id", F.col("text")).alias("pseudonym"))


@query("SELECT id, CASE WHEN regexp_full_match(w, '[A-Za-z0-9_<][A-Za-z0-9_.:<>-]{0,95}') THEN w ELSE 'label_' || substr(sha256(w), 1, 24) END AS label FROM (SELECT id, split_part(text, ' ', 1) AS w FROM texts)")
def bounded_labels(v: Views) -> DataFrame:
    return v.texts.select("id", s.bounded_label(F.split_part("text", F.lit(" "), F.lit(1))).alias("label"))


@query("SELECT id, md5(regexp_replace(text || ' ghp_abc123 github_pat_x1 xghp_no', '\\b(gh[pousr]_[A-Za-z0-9_]+|github_pat_[A-Za-z0-9_]+)\\b', '[credential]', 'g')) AS digest FROM texts")
def credential_redaction(v: Views) -> DataFrame:
    return v.texts.select("id", F.md5(s.redact_credentials(F.concat("text", F.lit(" ghp_abc123 github_pat_x1 xghp_no"))).cast("binary")).alias("digest"))


REASONS = "r AS (SELECT id, CASE length(text) % 6 WHEN 0 THEN 'Slot wait over ' WHEN 1 THEN 'File is TOO LARGE: ' WHEN 2 THEN 'Outside the ' WHEN 3 THEN 'Forbidden tool ' WHEN 4 THEN 'Accepted: ' ELSE 'No ' END || '\"a b\" /tmp/x.y ' || CAST(length(text) AS STRING) || ' items. Then; more' AS reason FROM texts)"


def reasons(v: Views) -> DataFrame:
    first = F.element_at(F.array(*map(F.lit, ("Slot wait over ", "File is TOO LARGE: ", "Outside the ", "Forbidden tool ", "Accepted: ", "No "))), F.length("text") % 6 + 1)
    return v.texts.where("text IS NOT NULL").select("id", F.concat(first, F.lit('"a b" /tmp/x.y '), F.length("text").cast("string"), F.lit(" items. Then; more")).alias("reason"))


@query("WITH " + REASONS + " SELECT id, CASE WHEN starts_with(reason, 'Slot') THEN 'wait_timeout' WHEN starts_with(reason, 'File') THEN 'size_limit' WHEN starts_with(reason, 'Outside') THEN 'path_scope' WHEN starts_with(reason, 'Forb') THEN 'tool_not_allowed' WHEN starts_with(reason, 'Acc') THEN 'command_form' ELSE 'other' END AS class, CASE WHEN starts_with(reason, 'Slot') THEN 'slot wait over items' WHEN starts_with(reason, 'File') THEN 'file is too large: items' WHEN starts_with(reason, 'Outside') THEN 'outside the items' WHEN starts_with(reason, 'Forb') THEN 'forbidden tool items' WHEN starts_with(reason, 'Acc') THEN 'accepted: items' ELSE 'no items' END AS normal FROM r")
def denial_reasons(v: Views) -> DataFrame:
    return reasons(v).select("id", s.reason_class(F.col("reason")).alias("class"), s.normalize_reason(F.col("reason")).alias("normal"))


@query("SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) || '/' || regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/+$', '') AS origin FROM pages WHERE regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) <> ''")
def page_origins(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", s.normalize_origin(F.col("url")).alias("origin")).where("origin IS NOT NULL")


TOLD = "CASE k % 5 WHEN 0 THEN './a//b' WHEN 1 THEN '../b' WHEN 2 THEN '/abs//c/' WHEN 3 THEN 'd/../' || CAST(k AS STRING) ELSE '$X/y' END"


@query(f"""WITH p AS (SELECT ord, cwd, {TOLD} AS told FROM contexts), x AS (SELECT ord, CASE WHEN starts_with(told, '$') THEN NULL WHEN starts_with(told, '/') THEN told ELSE cwd || '/' || told END AS x FROM p)
SELECT ord, regexp_replace(regexp_replace(regexp_replace(rtrim(x, '/'), '/+', '/', 'g'), '/\\./', '/', 'g'), '/[^/]+/\\.\\.', '', 'g') AS path FROM x""")
def resolved_paths(v: Views) -> DataFrame:
    return v.contexts.select("ord", paths.resolve_path(F.expr(TOLD), F.col("cwd")).alias("path"))


@query("SELECT k, count(*) AS n, CASE k % 8 WHEN 0 THEN 'read' WHEN 1 THEN 'shell' WHEN 2 THEN 'mcp' WHEN 3 THEN 'search' WHEN 4 THEN 'other' WHEN 5 THEN 'unnamed' WHEN 6 THEN 'web' ELSE 'agent' END AS class FROM ev GROUP BY 1")
def tool_classes(v: Views) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("Read", "BASH", "mcp__a.read", "x.y.Grep", "made_up", "", "WebFetch", "Task"))), (F.col("k") % 8 + 1).cast("int"))
    return v.ev.groupBy("k").agg(F.count("*").alias("n")).withColumn("class", s.tool_class(name))


@query("SELECT 'd' || CAST(doc_id AS STRING) AS id, c AS convention, CASE WHEN max(r) = 2 THEN 'present' WHEN max(r) = 1 THEN 'unknown' ELSE 'absent' END AS status FROM (SELECT doc_id, c, CASE WHEN c = 'a' AND regexp_matches(l, 'zu ') THEN 0 WHEN c = 'a' AND regexp_matches(l, '^Th') THEN 2 WHEN c = 'a' AND regexp_matches(l, 'tion') THEN 1 WHEN c = 'b' AND regexp_matches(l, '^En') THEN 2 ELSE 0 END * CASE WHEN regexp_matches(l, 'of') THEN 0 ELSE 1 END AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents), (VALUES ('a'), ('b')) t(c)) GROUP BY 1, 2")
def convention_status(v: Views) -> DataFrame:
    docs = v.table("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    lexicon = [("a", "denial", "zu "), ("a", "directive", "^Th"), ("a", "topic", "tion"), ("b", "directive", "^En")]
    return texts.conventions(docs, lexicon, "of")


@query("SELECT DISTINCT id, trim(l) AS line FROM (SELECT id, unnest(string_split(CASE WHEN length(text) % 3 = 0 THEN 'Harness friction: ' || text ELSE text || chr(10) || '  Harness friction: end ' END, chr(10))) AS l FROM texts) WHERE starts_with(ltrim(l), 'Harness friction:')")
def friction_lines(v: Views) -> DataFrame:
    marked = F.when(F.length("text") % 3 == 0, F.concat(F.lit("Harness friction: "), "text")).otherwise(F.concat("text", F.lit("\n  Harness friction: end ")))
    return texts.friction_lines(v.texts.where("text IS NOT NULL").select("id", marked.alias("text")))


@query("SELECT session_id || CAST(ord AS STRING) AS id, 'o' || CAST(k % 3 AS STRING) || '/n#' || CAST(k AS STRING) AS pr FROM ev WHERE k % 2 = 0")
def pull_urls(v: Views) -> DataFrame:
    t = F.expr("CASE WHEN k % 2 = 0 THEN 'see https://github.com/o' || (k % 3) || '/n/pull/' || k || ' and https://github.com/o' || (k % 3) || '/n/pull/' || k || '.' ELSE 'https://github.com/o/n/issues/1' END")
    return texts.pull_urls(v.ev.select(F.concat("session_id", F.col("ord").cast("string")).alias("id"), t.alias("text")))


@query("SELECT ord AS id, 'git@h:r' || CAST(k % 3 AS STRING) AS repo, 'b' || CAST(k AS STRING) AS branch FROM ev WHERE kind = 'model' UNION SELECT ord, 'git@h:z', 'main' FROM ev WHERE kind = 'model' AND k % 2 = 0")
def push_results(v: Views) -> DataFrame:
    t = F.expr("'To git@h:r' || (k % 3) || '\\n   1a2b..3c4d  x -> b' || k || CASE WHEN k % 2 = 0 THEN '\\nnoise\\nTo git@h:z\\n * [new branch]      main -> main' ELSE '' END")
    return texts.push_results(v.ev.where("kind = 'model'").select(F.col("ord").alias("id"), t.alias("text")))


REQ = f"""q AS (SELECT session_id, ord, {{div:us:300000000}} * 300000000 AS us, 'r' || CAST(k % 30 AS STRING) AS id, k % 3 AS rank, new_input + output AS context FROM usage WHERE us < {NOW} + 86400000000),
m AS (SELECT session_id, id, min(us) AS us, arg_max(context, (rank, ord)) AS context FROM q GROUP BY 1, 2),
h AS (SELECT session_id, count(*) FILTER (us >= $A AND us < $N) AS current_calls, CAST(coalesce(sum(context) FILTER (us >= $A AND us < $N), 0) AS BIGINT) AS current_tokens, count(*) FILTER (us >= $B AND us < $A) AS previous_calls, CAST(coalesce(sum(context) FILTER (us >= $B AND us < $A), 0) AS BIGINT) AS previous_tokens,
 arg_min(context, (us, id)) FILTER (us >= $B AND us < $N) AS first_context, arg_max(context, (us, id)) FILTER (us >= $B AND us < $N) AS last_context, count(*) FILTER (us >= $N) AS future, max(us) FILTER (us < $N) AS last_us FROM m GROUP BY 1) """.replace("$N", str(NOW)).replace("$A", str(NOW - live.HOUR)).replace("$B", str(NOW - 2 * live.HOUR))
#: The bridge's events are sparse; hours are stretched to reach them.
WIDE = REQ.replace(str(NOW - 2 * live.HOUR), str(NOW - 96 * live.HOUR)).replace(str(NOW - live.HOUR), str(NOW - 48 * live.HOUR))


def requests(v: Views, squeeze: int = 48) -> DataFrame:
    us = F.expr("us div 300000000 * 300000000")
    q = v.usage.where(F.col("us") < NOW + 86_400_000_000).select("session_id", "ord", us.alias("us"), F.concat(F.lit("r"), (F.col("k") % 30).cast("string")).alias("id"), (F.col("k") % 3).alias("rank"), (F.col("new_input") + F.col("output")).alias("context"))
    m = live.merged_updates(q)
    return m.withColumn("us", NOW - F.ceil((NOW - F.col("us")) / squeeze)) if squeeze != 1 else m


@query("WITH " + WIDE + "SELECT session_id, current_calls, current_tokens, previous_calls, previous_tokens, future FROM h")
def trailing_hours(v: Views) -> DataFrame:
    return live.trailing_hours(requests(v), NOW).select("session_id", "current_calls", "current_tokens", "previous_calls", "previous_tokens", "future")


@query("WITH " + WIDE + f", s AS (SELECT *, CASE WHEN last_us IS NULL THEN 'unknown' WHEN {NOW} - last_us > {48 * live.HOUR} THEN 'stale' ELSE 'ok' END AS status FROM h) SELECT session_id, status, CASE WHEN status = 'ok' THEN current_calls END AS current_calls, CASE WHEN status = 'ok' THEN previous_tokens END AS previous_tokens FROM s")
def live_status(v: Views) -> DataFrame:
    return live.status(live.trailing_hours(requests(v), NOW), NOW).select("session_id", "status", "current_calls", "previous_tokens")


@query("WITH " + WIDE + "SELECT session_id, 'context' AS alert FROM h WHERE last_context > 8000 UNION ALL SELECT session_id, 'surge' FROM h WHERE previous_calls >= 1 AND current_calls >= 2 AND current_calls >= 2 * previous_calls")
def live_alerts(v: Views) -> DataFrame:
    return live.alerts(live.trailing_hours(requests(v), NOW), 8000, 1, 2)


@query("WITH " + WIDE + "SELECT count(*) AS sessions, CAST(sum(current_calls) AS BIGINT) AS current_calls, CAST(sum(current_tokens) AS BIGINT) AS current_tokens, CAST(sum(previous_calls) AS BIGINT) AS previous_calls FROM h")
def fleet_totals(v: Views) -> DataFrame:
    return live.fleet(live.trailing_hours(requests(v), NOW))


@query("""WITH c AS (SELECT session_id, ord, k, CASE WHEN ord > min(ord) OVER (PARTITION BY session_id) AND (k % 4) <> lag(k % 4) OVER (PARTITION BY session_id ORDER BY ord) THEN 1 ELSE 0 END AS c FROM models),
e AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS e FROM c) SELECT session_id, ord FROM e WHERE e = (SELECT max(e) FROM e f WHERE f.session_id = e.session_id)""")
def last_epochs(v: Views) -> DataFrame:
    return live.last_epoch(v.models.withColumn("identity", F.col("k") % 4), "identity").select("session_id", "ord")


@query(f"""WITH s AS (SELECT *, reset_day * 86400000000 + 2592000000000 AS reset_us, lag(used) OVER w AS u0, lag(us) OVER w AS t0, lag(reset_day) OVER w AS r0, row_number() OVER (PARTITION BY account, engine ORDER BY us DESC, ord DESC) AS n FROM quota WHERE us < {NOW} WINDOW w AS (PARTITION BY account, engine ORDER BY us, ord)),
x AS (SELECT account, engine, us, used, reset_us, CASE WHEN u0 IS NOT NULL AND r0 = reset_day AND us > t0 AND reset_us > {NOW} THEN (used - u0) * 3600 / ((us - t0) / 1e6) END AS slope FROM s WHERE n = 1),
y AS (SELECT *, CASE WHEN slope IS NULL THEN NULL WHEN used = 100 THEN 0.0 WHEN slope > 0 THEN greatest(0.0, (100 - used) * 3600 / slope - ({NOW} - us) / 1e6) END AS seconds FROM x)
SELECT account, engine, round(slope, 6) AS slope, round(seconds, 4) AS seconds, CASE WHEN seconds IS NULL THEN 'unknown' WHEN seconds <= 3600 AND seconds < (reset_us - {NOW}) / 1e6 THEN 'signal' ELSE 'clear' END AS status FROM y""")
def quota_exhaustion(v: Views) -> DataFrame:
    q = v.quota.where(F.col("us") < NOW).withColumn("reset_us", F.col("reset_day") * 86_400_000_000 + 2_592_000_000_000)
    return rounded(live.quota_exhaustion(q, NOW).withColumn("seconds", F.round("seconds", 4)))


@query("SELECT account, engine, arg_max(us, (us, ord)) AS us, arg_max(used, (us, ord)) AS used FROM quota GROUP BY 1, 2")
def latest_quota(v: Views) -> DataFrame:
    return live.latest_samples(v.quota)


@query("SELECT account, us, 'primary' AS limit_name, used FROM quota WHERE used % 3 <> 0 UNION ALL SELECT account, us, 'secondary', used * 2 FROM quota WHERE used % 5 <> 0 AND used * 2 <= 100")
def rate_limits(v: Views) -> DataFrame:
    part = lambda c, f: F.when(c, F.struct((F.col("used") * f).alias("used"), F.lit(300).alias("window_minutes"), F.lit(0).cast("long").alias("reset_us")))
    r = v.quota.select("account", "us", part(F.col("used") % 3 != 0, 1).alias("primary"), part(F.col("used") % 5 != 0, 2).alias("secondary"))
    return live.rate_limits(r).select("account", "us", F.col("limit").alias("limit_name"), "used")
