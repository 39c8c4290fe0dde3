"""Two engines' own logs as typed events.

``message_records`` and ``rollout_records`` give the records of log files with the stream that each belongs to; ``message_events`` and
``rollout_events`` turn a record into its events, several at once, in one pass over the JSON variant and without a shuffle. An event has all columns of
``EVENT``; those that its kind doesn't have are null. Types outside a format become events of kind ``unknown``, invalid token counts of kind ``invalid``; nothing is dropped.

Whose session a record is depends on its file's first record or header, wherever the splits of the file lie; these are aggregated by path, a row
for each file, and joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patches import argument_patch, change_targets, unknown
from ..functions.scalars import strict_integer, strict_timestamp
from ..functions.variants import at, elements, flag, name, obj, said, scalar, string, type_of
from . import jsonl

# ---- fixed values: types, field names and envelopes of the two formats ----
MESSAGE_TYPES = (
    "assistant", "user", "system", "progress", "attachment", "summary", "file-history-snapshot", "file-history-delta", "queue-operation", "pr-link", "frame-link", "last-prompt", "custom-title", "agent-name",
    "agent-color", "saved_hook_context", "worktree", "bridge_status", "legacy_bridge_status",
)
SYSTEM_TYPES = ("compact_boundary", "api_error", "stop_hook_summary", "local_command", "informational", "turn_duration", "request_start", "request_end")
MESSAGE_TOKENS = {"new_input": "input_tokens", "cache_write": "cache_creation_input_tokens", "cache_read": "cache_read_input_tokens", "output": "output_tokens"}
EDIT_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
ROLLOUT_TYPES = ("session_meta", "turn_context", "event_msg", "response_item", "compacted", "token_usage_record", "inter_agent_communication_metadata", "world_state")
EVENT_TYPES = (
    "token_count", "item_completed", "item_started", "exec_command_begin", "exec_command_end", "task_started", "task_complete", "task_completed", "thread_settings_applied", "user_message", "agent_message", "agent_reasoning",
    "agent_reasoning_raw_content", "agent_reasoning_section_break", "turn_aborted", "error", "warning", "shutdown_complete", "context_compacted", "mcp_tool_call_begin", "mcp_tool_call_end", "request_user_input",
)
RESPONSE_TYPES = ("message", "agent_message", "reasoning", "function_call", "function_call_output", "custom_tool_call", "custom_tool_call_output", "web_search_call", "local_shell_call", "image_generation_call", "compaction")
ITEM_TYPES = ("UserMessage", "AgentMessage", "Reasoning", "CommandExecution", "McpToolCall", "Extension", "FileChange", "ContextCompaction", "SubAgentActivity", "ImageView", "CollabAgentToolCall", "WebSearch")
TOOL_ITEMS = ("CommandExecution", "McpToolCall", "FileChange", "ImageView", "CollabAgentToolCall", "WebSearch")
COUNTERS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
CALLS, OUTPUTS = ("function_call", "custom_tool_call", "local_shell_call", "web_search_call"), ("function_call_output", "custom_tool_call_output")
INPUT_REQUESTS = ("request_user_input", "request_user_input_async")
EXITED, FAILED = r"(?m)^Process exited with code (-?\d+)\s*$", r"\AExit code(?::)? (-?\d+)\n"
# ---- end of fixed values ----

TOKENS = ("new_input", "cache_write", "cache_read", "output", "reasoning_output")
#: Columns of an event and their types. ``at_us``: an instant that the event states itself; ``input_total``: the counter that includes what was cached.
EVENT = {
    "kind": "string", "id": "string", "at_us": "bigint", "cwd": "string", "cwd_given": "boolean", "parent_id": "string", "role": "string", "provenance": "string", "dispatch": "string", "model": "string", "effort": "string",
    "cli_version": "string", "branch": "string", **dict.fromkeys(TOKENS, "bigint"), "input_total": "bigint", "counters": "array<bigint>", "message": "string", "selection": "string", "error": "boolean", "exit_code": "bigint", "command": "string",
    "phase": "string", "pairing": "string", "deferred": "boolean", "require_pair": "boolean", "interval": "boolean", "counts": "boolean", "name": "string", "value": "string", "targets": "array<string>", "label": "string",
}
RECORD = ("agent", "session_id", "path", "byte_offset", "us", "ordinal", "digest", "record_id", "worker", "stream_parent")


def event(kind: str | Column, when: Column | None = None, **values: object) -> Column:
    """An event, null where ``when`` doesn't hold."""
    values = {"kind": kind, **values}
    of = lambda k: values[k] if isinstance(values.get(k), Column) else F.lit(values.get(k))
    row = F.struct(*[of(k).cast(t).alias(k) for k, t in EVENT.items()])
    return row if when is None else F.when(F.coalesce(when, F.lit(False)), row)


def several(*events: Column) -> Column:
    return F.filter(F.array(*events), lambda e: e.isNotNull())


def exploded(records: DataFrame, events: Column) -> DataFrame:
    """A row per event; ``seq`` is its place among its record's."""
    rows = records.select(*RECORD, F.posexplode(events).alias("seq", "e"))
    return rows.select(*RECORD, "seq", "e.*")


def instant(v: Column) -> Column:
    """Microseconds of text with an instant."""
    return F.unix_micros(strict_timestamp(string(v)))


def epoch(v: Column, scale: int) -> Column:
    """Microseconds of a number of 1 / ``scale`` seconds, or of text with an instant."""
    number = F.when(type_of(v).isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), F.try_variant_get(v, "$", "double"))
    return F.coalesce((number * (1_000_000 // scale)).cast("bigint"), instant(v))


def whole(v: Column) -> Column:
    """A machine's integer, also a negative one."""
    return F.when(type_of(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def said_code(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("bigint")


def digested(raw: DataFrame) -> DataFrame:
    """Parsed records with ``us`` and ``digest``, by which repeated ones are known; lines that are no objects are left out (``jsonl.coverage`` counts them)."""
    known = raw.where("record IS NOT NULL")
    return known.withColumns({"us": instant(at(F.col("record"), "timestamp")), "digest": F.sha2(F.to_json("record"), 256)})


# ---------------------------------------------------------------- message logs


def message_files(spark: SparkSession, root: str) -> DataFrame:
    """S3. The log files under a projects folder (path, size, modified): those of its projects, and those of their subagents at any depth; each once."""
    found = jsonl.listing(spark, root)
    inside = relative(F.col("path"), root)
    return found.where(inside.rlike(r"^[^/]+/[^/]+\.jsonl$") | inside.rlike(r"^[^/]+/(?:.*/)?subagents/(?:.*/)?[^/]+\.jsonl$"))


def relative(path: Column, root: str) -> Column:
    """A path below ``root``."""
    top = jsonl.plain(root).rstrip("/") + "/"
    return F.substr(path, F.instr(path, top) + len(top))


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """S3. What the files beside subagents' logs say: path (of the log), request (unrequested, requested or unknown), depth, parent_agent. Unreadable ones say nothing."""
    text = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.meta.json")
    v = obj(F.try_parse_json(F.col("value")))
    model, depth = at(v, "model"), strict_integer(at(v, "spawnDepth"))
    none = F.coalesce(type_of(model) == "VOID", F.lit(True))
    request = F.when(v.isNull(), "unknown").when(none, "unrequested").when(string(model) != "", "requested").otherwise("unknown")
    log = F.regexp_replace(jsonl.plain_column(F.col("_metadata.file_path")), r"\.meta\.json$", ".jsonl")
    return text.select(log.alias("path"), request.alias("request"), F.when(depth >= 1, depth).alias("depth"), F.nullif(string(at(v, "parentAgentId")), F.lit("")).alias("parent_agent"))


def message_streams(records: DataFrame, files: DataFrame, meta: DataFrame, root: str) -> DataFrame:
    """S3. Whose each file is: path, session_id, stream_parent, worker, request, depth; from its path, its first record and its sidecar.

    files: path. A file of a subagents folder belongs to a worker, whose parent is the session of its first record (in workflows: of the folder), or the
    agent that the sidecar names, or the agents of the folders around it.
    """
    r = F.col("record")
    first = records.groupBy("path").agg(F.min_by(F.struct(name(at(r, "sessionId")).alias("session"), name(at(r, "agentId")).alias("agent_id"), flag(at(r, "isSidechain")).alias("side")), "byte_offset").alias("f"))
    parts = F.split(relative(F.col("path"), root), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "")
    bare = lambda x: F.regexp_replace(x, "^agent-", "")
    rows = files.select("path").join(meta, "path", "left").join(first, "path", "left").withColumns({"parts": parts, "stem": stem})
    folders = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.element_at("parts", i) == "subagents")
    rows = rows.withColumn("folders", folders)
    rows = rows.withColumn("in_folder", F.size("folders") > 0)
    last = F.try_element_at("folders", F.lit(-1))
    rows = rows.withColumns({
        "hint": F.when(F.col("in_folder"), F.get("parts", last - 2)).otherwise(F.col("stem")),
        "worker": F.col("in_folder") | (F.col("stem").startswith("agent-") & F.coalesce("f.side", F.lit(False))),
        "workflow": F.coalesce(F.col("in_folder") & (F.get("parts", last) == "workflows"), F.lit(False)),
    })
    rows = rows.withColumn("base", F.when(F.col("workflow") | F.col("f.session").isNull(), F.col("hint")).otherwise(F.col("f.session")))
    around = F.transform(F.slice("folders", F.lit(1), F.greatest(F.size("folders") - 1, F.lit(0))), lambda i: F.concat(F.lit(":subagent:"), bare(F.get(F.col("parts"), i))))
    named = F.col("worker") & F.col("parent_agent").isNotNull()
    nested = (F.size("folders") > 1) & ~F.contains("base", F.lit(":subagent:"))
    parent = F.when(named, F.concat("base", F.lit(":subagent:"), "parent_agent")).when(nested, F.concat("base", F.array_join(around, ""))).otherwise(F.col("base"))
    rows = rows.withColumn("parent", parent)
    own = F.concat(F.when(named, F.col("base")).otherwise(F.col("parent")), F.lit(":subagent:"), F.coalesce("f.agent_id", bare(F.col("stem"))))
    known = lambda c: F.when(F.col("worker"), F.col(c))
    return rows.select("path", F.when(F.col("worker"), own).otherwise(F.col("parent")).alias("session_id"), known("parent").alias("stream_parent"), "worker", F.coalesce(known("request"), F.lit("unknown")).alias("request"), known("depth").alias("depth"))


def message_records(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """S3. Records of the message logs under a projects folder, or of some of its ``files``, with the columns of RECORD, request and depth.

    The files' own columns are read once for the records and once, two fields of them, for the streams.
    """
    files = message_files(spark, root) if files is None else files
    raw = jsonl.parsed(jsonl.read_files(files)).where("record IS NOT NULL")
    streams = message_streams(raw.select("path", "byte_offset", "record"), files, sidecars(spark, root), root)
    rows = digested(raw).join(streams, "path")
    return rows.withColumns({"agent": F.lit("claude-code"), "ordinal": F.lit(None).cast("bigint"), "record_id": scalar(at(F.col("record"), "uuid"))})


def message_events(records: DataFrame) -> DataFrame:
    """N4. Typed events of message records. A tool's start and end come from different records, by the tool's id; a block's place makes no id of its own.

    Usage is a snapshot of its message (selection ``maximal_output``), of which several may be there.
    """
    r = F.col("record")
    names = {"type_": at(r, "type"), "message_": obj(at(r, "message")), "result_": obj(at(r, "toolUseResult"))}
    rows = records.withColumns(names)
    rows = rows.withColumns({"kind_": scalar(F.col("type_")), "cwd_": string(at(r, "cwd")), "content_": at(F.col("message_"), "content"), "usage_": obj(at(F.col("message_"), "usage"))})
    rows = rows.withColumn("blocks_", elements(F.col("content_")))
    kind, message, cwd, usage, blocks, result = (F.col(f"{c}_") for c in ("kind", "message", "cwd", "usage", "blocks", "result"))
    block_type = lambda b: string(at(b, "type"))
    answers = F.exists(blocks, lambda b: F.coalesce(block_type(b) == "tool_result", F.lit(False)))
    has_usage = F.coalesce(F.size(F.try_variant_get(usage, "$", "map<string,variant>")) > 0, F.lit(False))
    tokens = {k: strict_integer(at(usage, v)) for k, v in MESSAGE_TOKENS.items()}
    counted = (kind == "assistant") & has_usage
    valid = F.col("us").isNotNull() & tokens["output"].isNotNull()
    subtype = scalar(at(r, "subtype"))
    system = kind == "system"
    model = string(at(message, "model"))
    version, branch = scalar(at(r, "version")), scalar(at(r, "gitBranch"))
    role = F.when(F.col("worker"), "worker").otherwise("orchestrator")
    own = several(
        event("session_start", cwd=cwd, parent_id=F.col("stream_parent"), role=role, provenance="first-observed-cwd", dispatch=F.when(F.col("worker"), "subagent").otherwise("interactive")),
        event("metadata", version != "", cli_version=version),
        event("context", (kind == "user") & ~answers, cwd=cwd, branch=branch),
        event("unknown", ~F.coalesce(kind.isin(*MESSAGE_TYPES), F.lit(False)), label=F.coalesce(kind, F.lit("None"))),
        event("metadata", (kind == "assistant") & (model != "") & (model != "<synthetic>"), model=model),
        event("usage", counted & valid, cwd=cwd, message=F.coalesce(name(at(message, "id")), name(at(r, "uuid"))), selection="maximal_output", branch=branch, **tokens),
        event("invalid", counted & ~valid, label="invalid_token_records"),
        event("text", F.coalesce(type_of(F.col("content_")) != "VOID", F.lit(False)), value=said(F.col("content_"))),
        event("text", F.coalesce(type_of(at(r, "content")) != "VOID", F.lit(False)), value=said(at(r, "content"))),
        event("unknown", system & ~F.coalesce(subtype.isin(*SYSTEM_TYPES), F.lit(False)), label=F.concat(F.lit("system:"), F.coalesce(subtype, F.lit("None")))),
        event("counter", system & (subtype == "compact_boundary"), name="compactions"),
        event("counter", system & (subtype == "api_error"), name="api_errors"),
        event("request", system & subtype.isin("request_start", "request_end"), id=name(at(r, "requestId")), phase=F.when(subtype == "request_start", "start").otherwise("end")),
    )
    stopped = F.coalesce(flag(at(result, "interrupted")), F.lit(False)) | name(at(result, "backgroundTaskId")).isNotNull() | name(at(result, "taskId")).isNotNull()
    streams = (type_of(at(result, "stdout")) == "STRING") & (type_of(at(result, "stderr")) == "STRING") & flag(at(result, "interrupted")).eqNullSafe(F.lit(False))

    def of_block(b: Column) -> Column:
        used = (kind == "assistant") & (block_type(b) == "tool_use")
        ended = (kind == "user") & (block_type(b) == "tool_result")
        tool, input_, id_, answered = string(at(b, "name")), obj(at(b, "input")), name(at(b, "id")), name(at(b, "tool_use_id"))
        failed = F.coalesce(flag(at(b, "is_error")), F.lit(False))
        code = F.coalesce(whole(at(result, "exitCode")), whole(at(result, "exit_code")))
        code = F.when(stopped, None).when(code.isNotNull(), code).when(failed, said_code(string(at(b, "content")), FAILED)).when(F.coalesce(streams, F.lit(False)), 0)
        background = at(input_, "run_in_background")
        deferred = background.isNotNull() & ~F.coalesce(flag(background) == F.lit(False), F.lit(False))
        ran_in = F.when(at(input_, "cwd").isNotNull(), string(at(input_, "cwd"))).otherwise(cwd)
        target = F.coalesce(name(at(input_, "file_path")), name(at(input_, "notebook_path")))
        return several(
            event("command", used & (tool == "Bash"), id=id_, command=said(at(input_, "command")), at_us=F.col("us"), cwd=ran_in, phase="start", pairing="launch", deferred=deferred),
            event("file_edit", used & tool.isin(*EDIT_TOOLS), id=id_, targets=F.array(target), cwd=cwd),
            event("tool_start", used, id=id_, name=tool, value=said(at(b, "input")), cwd=cwd, branch=branch),
            event("counter", used & (tool == "AskUserQuestion"), id=id_, name="user_input_requests"),
            event("command", ended, id=answered, exit_code=code, phase="end", pairing="launch", require_pair=True, error=flag(at(b, "is_error")), deferred=stopped),
            event("tool_end", ended, id=answered, error=failed, value=said(at(b, "content")), cwd=cwd, branch=branch),
        )

    in_blocks = F.flatten(F.transform(F.filter(blocks, lambda b: type_of(b) == "OBJECT"), of_block))
    return exploded(rows, F.concat(own, in_blocks))


# ---------------------------------------------------------------- rollout logs


def rollout_files(spark: SparkSession, root: str) -> DataFrame:
    """S4. The rollout files under a sessions folder."""
    return jsonl.listing(spark, root).where(F.col("path").rlike(r"/rollout-[^/]*\.jsonl$"))


def rollout_records(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """S4. Records of rollout files with the columns of RECORD, and ``inherited``: a header of another session than the file's.

    A file's session is that of its first header, wherever it stands; records before it belong to the file's own name.
    """
    files = rollout_files(spark, root) if files is None else files
    raw = jsonl.parsed(jsonl.read_files(files))
    r = F.col("record")
    payload = obj(at(r, "payload"))
    own_id = F.coalesce(name(at(payload, "id")), name(at(payload, "session_id")))
    header = string(at(r, "type")) == "session_meta"
    headers = raw.where(header).groupBy("path").agg(F.min_by(F.struct(own_id.alias("id"), F.col("byte_offset").alias("since")), "byte_offset").alias("h"))
    rows = digested(raw).join(headers, "path", "left").withColumn("stem", F.regexp_extract("path", r"([^/]*)\.jsonl$", 1))
    session = F.when(F.col("byte_offset") >= F.col("h.since"), F.coalesce("h.id", F.col("stem"))).otherwise(F.col("stem"))
    rows = rows.withColumns({"agent": F.lit("codex"), "session_id": session, "ordinal": strict_integer(at(r, "ordinal")), "record_id": scalar(at(r, "ordinal"))})
    inherited = header & (F.col("byte_offset") > F.col("h.since")) & ~own_id.eqNullSafe(F.col("session_id"))
    return rows.withColumns({"inherited": F.coalesce(inherited, F.lit(False)), "worker": F.lit(None).cast("boolean"), "stream_parent": F.lit(None).cast("string")})


def counter_values(v: Column) -> tuple[dict[str, Column], Column, Column]:
    """(token columns, total input, validity) of counters that include what was cached."""
    total, cached, output, reasoning = (strict_integer(at(v, c)) for c in COUNTERS)
    valid = (cached <= total) & output.isNotNull()
    return {"new_input": total - cached, "cache_read": cached, "output": output, "reasoning_output": reasoning}, total, valid


def failed(payload: Column) -> Column:
    """Whether a tool's result states an exit code other than 0: its own, its output's, or that of the anchored line of a text output."""
    out = at(payload, "output")
    code = F.coalesce(whole(at(payload, "exit_code")), whole(at(obj(out), "exit_code")), said_code(string(out), EXITED), said_code(string(at(obj(out), "output")), EXITED))
    return F.coalesce(code != 0, F.lit(False))


def given(*vs: Column) -> Column:
    return reduce(lambda a, b: a | b, [v.isNotNull() for v in vs])


def rollout_events(records: DataFrame) -> DataFrame:
    """N6. Typed events of rollout records. Usage is a cumulative counter (selection ``cumulative``); ``request_usage`` is one request's own, with the counters it stands at."""
    r = F.col("record")
    rows = records.withColumns({"kind_": scalar(at(r, "type")), "p_": obj(at(r, "payload"))})
    rows = rows.withColumns({"sub_": scalar(at(F.col("p_"), "type")), "item_": obj(at(F.col("p_"), "item")), "info_": obj(at(F.col("p_"), "info"))})
    kind, p, sub, item, us = F.col("kind_"), F.col("p_"), F.col("sub_"), F.col("item_"), F.col("us")
    header, owned = kind == "session_meta", ~F.col("inherited")
    source = at(p, "source")
    subagent = obj(at(obj(source), "subagent"))
    some = F.coalesce(F.size(F.try_variant_get(subagent, "$", "map<string,variant>")) > 0, F.lit(False))
    dispatch = F.when(some, "subagent").when((string(source) == "exec") & (string(at(p, "originator")) == "codex_exec"), "noninteractive_exec").when(string(source).isin("vscode", "cli"), "interactive").otherwise("unknown")
    branch = F.coalesce(name(at(p, "branch")), scalar(at(obj(at(p, "git")), "branch")))
    unlisted = lambda value, names: ~F.coalesce(value.isin(*names), F.lit(False))
    labelled = lambda head, value: F.concat(F.lit(head), F.coalesce(value, F.lit("None")))
    ordinal = name(at(r, "ordinal"))
    top = several(
        event("metadata", header & owned & (scalar(at(p, "cli_version")) != ""), cli_version=scalar(at(p, "cli_version"))),
        event("session_start", header & owned, cwd=string(at(p, "cwd")), parent_id=string(at(obj(at(subagent, "thread_spawn")), "parent_thread_id")), role=F.when(some, "worker").otherwise("orchestrator"), provenance="session-header", dispatch=dispatch),
        event("unknown", unlisted(kind, ROLLOUT_TYPES), label=F.coalesce(kind, F.lit("None"))),
        event("context", kind.isin("session_meta", "turn_context") & owned, cwd=string(at(p, "cwd")), cwd_given=at(p, "cwd").isNotNull(), branch=branch),
        event("metadata", kind == "turn_context", model=scalar(at(p, "model")), effort=scalar(at(p, "effort")), selection="context"),
        event("counter", kind == "compacted", id=scalar(at(r, "ordinal")), name="compactions"),
    )
    msg = kind == "event_msg"
    id_ = F.coalesce(name(at(p, "call_id")), name(at(p, "turn_id")), ordinal)
    tokens, total, valid = counter_values(obj(at(F.col("info_"), "total_token_usage")))
    last, _, last_valid = counter_values(obj(at(F.col("info_"), "last_token_usage")))
    totals = obj(at(F.col("info_"), "total_token_usage"))
    has_totals = F.coalesce(F.size(F.try_variant_get(totals, "$", "map<string,variant>")) > 0, F.lit(False))
    counted, usable = msg & (sub == "token_count"), F.coalesce(us.isNotNull() & valid, F.lit(False))
    begun, done = msg & sub.isin("exec_command_begin", "mcp_tool_call_begin"), msg & sub.isin("exec_command_end", "mcp_tool_call_end")
    ran, ended = msg & (sub == "exec_command_begin"), msg & (sub == "exec_command_end")
    task_over = sub.isin("task_complete", "task_completed")
    events_ = several(
        event("unknown", msg & unlisted(sub, EVENT_TYPES), label=labelled("event_msg:", sub)),
        event("request_usage", counted & us.isNotNull() & last_valid, counters=F.when(has_totals, F.array(*[strict_integer(at(totals, c)) for c in COUNTERS])), **last),
        event("usage", counted & has_totals & usable, selection="cumulative", input_total=total, **tokens),
        event("invalid", counted & has_totals & ~usable, label="invalid_token_records"),
        event("resume", msg & (sub == "task_started")),
        event("session_end", msg & (task_over | (sub == "shutdown_complete"))),
        *[event("request", msg & ((sub == "task_started") | task_over) & (at(p, f).isNotNull()), id=id_, at_us=epoch(at(p, f), 1), phase=ph) for f, ph in (("started_at", "start"), ("completed_at", "end"))],
        event("command", ran, id=id_, command=said(F.coalesce(at(p, "command"), at(p, "cmd"))), at_us=us, cwd=string(F.coalesce(at(p, "cwd"), at(p, "workdir"))), cwd_given=given(at(p, "cwd"), at(p, "workdir")), phase="start", pairing="launch"),
        event("tool_start", begun, id=id_, name=F.when(sub == "exec_command_begin", "exec_command"), value=F.when(sub == "exec_command_begin", said(p))),
        event("command", ended, id=id_, command=said(at(p, "command")), exit_code=whole(at(p, "exit_code")), phase="end", pairing="launch", cwd_given=False),
        event("tool_end", done, id=id_, error=failed(p), value=said(at(p, "output"))),
        event("compaction", msg & (sub == "context_compacted")),
        event("counter", msg & sub.isin("error", "request_user_input"), id=id_, name=F.when(sub == "error", "api_errors").otherwise("user_input_requests")),
    )
    in_item = msg & sub.isin("item_started", "item_completed")
    complete = msg & (sub == "item_completed")
    what = scalar(at(item, "type"))
    item_id = F.coalesce(name(at(item, "id")), id_)
    start, end = epoch(at(p, "started_at_ms"), 1000), epoch(at(p, "completed_at_ms"), 1000)
    tool, command = in_item & what.isin(*TOOL_ITEMS), in_item & (what == "CommandExecution")
    items = several(
        event("unknown", in_item & unlisted(what, ITEM_TYPES), label=labelled("item:", what)),
        event("tool_start", tool, id=item_id, at_us=start, name=what, value=F.when(what.isin("CommandExecution", "FileChange"), said(item)), interval=start.isNotNull()),
        event("tool_end", tool & complete, id=item_id, error=failed(item), interval=False),
        event("tool_end", tool & end.isNotNull(), id=item_id, at_us=end, counts=False),
        event("context", command, cwd=string(at(item, "cwd")), label="execution"),
        event("command", command, id=item_id, command=said(at(item, "command")), exit_code=whole(at(item, "exit_code")), at_us=F.when(complete, start).otherwise(F.coalesce(start, us)), cwd=string(at(item, "cwd")), cwd_given=at(item, "cwd").isNotNull(), phase=F.when(complete, "complete").otherwise("start"), pairing="interval"),
        event("file_edit", complete & (what == "FileChange"), id=item_id, targets=F.coalesce(change_targets(at(item, "changes")), unknown())),
        event("text", in_item & (what == "AgentMessage"), value=said(at(item, "content"))),
        event("compaction", complete & (what == "ContextCompaction")),
    )
    response = kind == "response_item"
    called, returned = response & sub.isin(*CALLS), response & sub.isin(*OUTPUTS)
    call_id = F.coalesce(name(at(p, "call_id")), name(at(p, "id")), ordinal)
    full = F.coalesce(string(at(p, "name")), sub)
    short = F.element_at(F.split(F.coalesce(string(at(p, "name")), F.lit("")), r"\."), -1)
    arguments = F.coalesce(at(p, "arguments"), at(p, "input"))
    targets, patch_cwd = argument_patch(arguments)
    responses = several(
        event("unknown", response & unlisted(sub, RESPONSE_TYPES), label=labelled("response_item:", sub)),
        event("file_edit", called & (short == "apply_patch"), id=call_id, targets=targets, cwd=F.coalesce(string(at(p, "cwd")), patch_cwd)),
        event("tool_start", called, id=call_id, name=full, value=said(F.coalesce(arguments, at(p, "action")))),
        event("counter", called & short.isin(*INPUT_REQUESTS), id=call_id, name="user_input_requests"),
        event("tool_end", returned, id=call_id, error=failed(p), value=said(at(p, "output"))),
        event("text", response & sub.isin("message", "agent_message"), value=said(at(p, "content"))),
        event("compaction", response & (sub == "compaction")),
    )
    return exploded(rows, F.concat(top, events_, items, responses))


# ---------------------------------------------------------------- what both give to the folds


def in_order(events: DataFrame) -> DataFrame:
    """Events of distinct records (the first of a session's equal ones) with ``ord``, by which the folds break ties: ordinal, file, place."""
    place = F.struct("ordinal", "path", "byte_offset", "seq")
    least = F.struct("path", "byte_offset")
    firsts = events.groupBy("session_id", "digest").agg(F.min(least).alias("first"))
    kept = events.join(firsts, ["session_id", "digest"]).where(least == F.col("first")).drop("first")
    return kept.withColumn("ord", place)


def intervals(events: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Starts and ends of tools or requests for fold.pair_intervals: by their own instants if they state them, else the record's."""
    own = F.coalesce("at_us", "us")
    is_tool = kind == "tool"
    starts = events.where(F.col("kind") == "tool_start") if is_tool else events.where("kind = 'request' AND phase = 'start'")
    ends = events.where((F.col("kind") == "tool_end") & F.coalesce("interval", F.lit(True))) if is_tool else events.where("kind = 'request' AND phase = 'end'")
    starts = starts.where(F.coalesce("interval", F.lit(True)))
    return tuple(x.where(F.col("id").isNotNull() & own.isNotNull()).select("session_id", "id", own.alias("us")) for x in (starts, ends))


def unknown_types(events: DataFrame) -> DataFrame:
    """N9. Counts of types outside the formats, and of invalid token counts."""
    return events.where("kind IN ('unknown', 'invalid')").groupBy("agent", "label").agg(F.count("*").alias("n"))
