"""Column helpers: pseudonyms, bounded labels, strict times and numbers, globs, and text normalisation."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns, word lists and tables whose results are part of the contract ----
LABEL = r"^[A-Za-z0-9_<][A-Za-z0-9_.:<>-]{0,95}$"
CREDENTIAL = r"\b(?:gh[pousr]_[A-Za-z0-9_]+|github_pat_[A-Za-z0-9_]+)\b"
REASON_WORDS = {
    "wait_timeout": ["timeout", "timed out", "slot wait", "did not respond"],
    "size_limit": ["size limit", "too large", "too big", "maximum size", "file size"],
    "path_scope": ["path scope", "outside", "worktree", "allowed path", "allowed directory"],
    "tool_not_allowed": ["tool not allowed", "tool is not allowed", "disallowed tool", "forbidden tool", "unsupported tool"],
    "command_form": ["accepted:", "command form", "command format", "use the form"],
}
TOOLS = {
    "read": ["read", "read_file", "view_image", "ls", "list_dir", "notebookread"],
    "edit": ["write", "edit", "multiedit", "notebookedit", "write_file", "apply_patch", "filechange"],
    "search": ["glob", "grep", "grep_files", "toolsearch"],
    "shell": ["bash", "bashoutput", "killshell", "killbash", "powershell", "shell", "exec", "exec_command", "commandexecution", "local_shell_call", "write_stdin"],
    "agent": ["task", "agent", "sendmessage", "taskoutput", "taskstop", "spawn_agent", "send_input", "close_agent", "resume_agent", "wait_agent"],
    "web": ["webfetch", "websearch", "web_fetch", "web_search", "web_search_call"],
}
SCRIPTS = ("Hangul", "Han", "Hiragana", "Katakana", "Latin")
DENIAL_PREFIXES = ("Command blocked by PreToolUse hook:", "Tool call blocked by PreToolUse hook:")
# ---- end of fixed values ----


def pseudonym(category: str, value: Column, key: bytes | None = None) -> Column:
    """P1. category_ and 24 hex digits of SHA-256, or of HMAC-SHA256 with a key (a binary literal in the plan)."""
    data = value.cast("binary")
    if key is None:
        digest = F.sha2(data, 256)
    else:
        block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
        inner, outer = (F.lit(bytearray(b ^ x for b in block)) for x in (0x36, 0x5C))
        digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data), 256))), 256)
    return F.concat(F.lit(category + "_"), F.substring(digest, 1, 24))


def bounded_label(value: Column, category: str = "label", key: bytes | None = None) -> Column:
    """P2. A machine label as it is, other text as a pseudonym."""
    return F.when(value.rlike(LABEL) & ~value.contains("\n"), value).otherwise(pseudonym(category, value, key))


def strict_timestamp(value: Column) -> Column:
    """P3. An ISO-8601 instant that states its offset; else null."""
    stated = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2}(:\d{2})?)$")
    return F.when(stated, F.try_to_timestamp(value))


def epoch_or_timestamp(value: Column, milliseconds: bool = False) -> Column:
    """P3. Text that is an epoch number (seconds, or milliseconds) or an instant."""
    number = F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value.try_cast("double"))
    return F.coalesce(F.timestamp_micros((number * (1e3 if milliseconds else 1e6)).cast("long")), strict_timestamp(value))


def strict_integer(variant: Column) -> Column:
    """P4. A variant's whole number of 0 or more; booleans, strings and fractions are null."""
    number = F.try_variant_get(variant, "$", "bigint")
    return F.when((F.schema_of_variant(variant) == "BIGINT") & (number >= 0), number)


def fraction(value: Column, total: Column) -> Column:
    """P5. value / total, null on 0."""
    return F.try_divide(value, total)


def within(us: Column, since: int, until: int) -> Column:
    """P6. since <= us < until."""
    return (us >= since) & (us < until)


def glob_regex(glob: str, ignore_case: bool = False) -> str:
    """P7. An anchored Java pattern for a shell glob (*, ?, [set], [!set])."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "!")) if c == "[" else -1
        if c == "[" and close > 0:
            body = glob[i + 1 : close].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out += "[" + ("^" + body[1:] if body[0] == "!" else r"\^" + body[1:] if body[0] == "^" else body) + "]"
            i = close
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"(?{'i' if ignore_case else ''}s)^(?:{out})$"


def redact_credentials(text: Column) -> Column:
    """P8. Access tokens replaced by [credential]."""
    return F.regexp_replace(text, CREDENTIAL, "[credential]")


def letters(text: Column, script: str) -> Column:
    """N25. Letters of a script."""
    return F.length(text) - F.length(F.regexp_replace(text, rf"[\p{{Is{script}}}&&\p{{L}}]", ""))


def estimate_tokens(text: Column) -> Column:
    """P9. CJK characters, and a quarter of the others, rounded up. CR LF and CR count as LF."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    other = F.length(F.regexp_replace(t, r"[\p{IsHangul}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", ""))
    return (F.ceil(other / 4) + F.length(t) - other).cast("long")


def normalize_origin(value: Column) -> Column:
    """N13. host/path of a remote, without transport, credentials, usual ports and .git; null if it isn't one."""
    v = F.trim(value)
    url = r"^(?i:https|http|ssh|git)://(?:[^/@]*@)?([^/:@]+)(?::(\d+))?(/[^?#]*)?(?:[?#].*)?$"
    short = r"^(?:[^/@:]+@)?([^/:]+):(.+)$"
    is_url = v.contains("://")
    port = F.regexp_extract(v, url, 2)
    host = F.when(is_url, F.concat(F.lower(F.regexp_extract(v, url, 1)), F.when(port.isin("", "22", "80", "443", "9418"), "").otherwise(F.concat(F.lit(":"), port)))).otherwise(F.lower(F.regexp_extract(v, short, 1)))
    path = F.when(is_url, F.regexp_extract(v, url, 3)).otherwise(F.regexp_extract(v, short, 2))
    path = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), r"\.git$", "")
    matched = F.when(is_url, v.rlike(url)).otherwise(v.rlike(short))
    return F.when(matched & (path != ""), F.concat(host, F.lit("/"), path))


def reason_class(reason: Column) -> Column:
    """N20. The first class one of whose words occurs."""
    low, out = F.lower(reason), F.lit("other")
    for name, words in reversed(REASON_WORDS.items()):
        out = F.when(low.rlike("|".join(map(re.escape, words))), name).otherwise(out)
    return out


def operand_free(unit: Column) -> Column:
    """A run without white space, commas and semicolons, up to its first slash (a drive, tildes and dots before it go too) and without names that have an extension.

    A run that ends in its only slash keeps what stands before its first letter.
    """
    slashed = F.replace(unit, F.lit("\\"), F.lit("/"))
    n, before = F.length(unit), F.substring_index(slashed, "/", 1)
    drive = F.right(before, F.lit(1)) == ":"
    head = F.when(drive & F.left(F.right(before, F.lit(2)), F.lit(1)).rlike("[A-Za-z]"), F.left(before, F.length(before) - 2)).otherwise(F.rtrim(before, F.lit("~.")))
    open_end = F.length(before) == n - 1
    cut = F.when(F.length(before) == n, unit).when(open_end & ~before.rlike(r"\w"), unit).when(open_end, F.regexp_extract(before, r"^\W*", 0)).otherwise(head)

    def named(run: Column) -> Column:
        name = F.rtrim(run, F.lit(".-"))
        last = F.element_at(F.split(name, r"\."), -1)
        return F.when((F.length(last) < F.length(name)) & last.rlike(r"^[A-Za-z]") & name.rlike(r"^\w"), F.concat(F.lit(" "), F.substr(run, F.length(name) + 1))).otherwise(run)

    return F.array_join(F.transform(F.regexp_extract_all(cut, F.lit(r"[\w.-]+|[^\w.-]+"), F.lit(0)), named), "")


def normalize_reason(reason: Column) -> Column:
    """N21. The first clause in lower case, without what is quoted, paths, file names and numbers: its line's words one by one, up to a semicolon or a word that ends a sentence."""
    line = F.regexp_replace(F.split(reason, "\n", 2)[0], r"""(["'`]).*?\1""", " ")
    pieces = F.transform(F.regexp_extract_all(line, F.lit(r"[\s;,]|[^\s;,]+"), F.lit(0)), lambda x: F.when(x.rlike(r"^[\s;,]$"), x).otherwise(operand_free(x)))
    ended = F.transform(pieces, lambda x, i: F.when((x == ";") | (x.rlike(r"^\s$") & F.coalesce(F.right(F.get(pieces, i - 1), F.lit(1)).isin(".", "!", "?"), F.lit(False))), i))
    clause = F.array_join(F.slice(pieces, F.lit(1), F.coalesce(F.array_min(ended), F.size(pieces))), "")
    words = F.filter(F.split(F.lower(F.regexp_replace(clause, r"[0-9](?:[0-9.,]*[0-9])?", " ")), r"\s+"), lambda w: w != "")
    return F.rtrim(F.rtrim(F.array_join(words, " "), F.lit(".!?")))


def tool_class(name: Column) -> Column:
    """N22. The class of a tool name; its name space is dropped."""
    low = F.lower(name)
    last = F.element_at(F.split(low, r"\."), -1)
    out = F.lit("other")
    for kind, names in TOOLS.items():
        out = F.when(last.isin(names), kind).otherwise(out)
    return F.when(name.isNull() | (name == ""), "unnamed").when(low.startswith("mcp__"), "mcp").otherwise(out)


def denial_reason(output: Column) -> Column:
    """N19. What follows an anchored denial prefix; null for other outputs."""
    out = F.lit(None).cast("string")
    for p in DENIAL_PREFIXES:
        out = F.when(output.startswith(p), F.trim(F.substring(output, len(p) + 1, 1 << 30))).otherwise(out)
    return out


def exit_code(code: Column, output: Column) -> Column:
    """N7. The machine field, else the number in the anchored completion line."""
    said = F.regexp_extract(output, r"(?m)^Process exited with code (-?\d+)\s*$", 1)
    return F.coalesce(code, said.try_cast("int"))


def envelope_exit_code(is_error: Column, content: Column, code: Column, background: Column, interrupted: Column, has_streams: Column) -> Column:
    """N5. Unknown in the background or when interrupted; the machine field; the error envelope; 0 for a clean result."""
    said = F.regexp_extract(content, r"\AExit code(?::)? (-?\d+)\n", 1).try_cast("int")
    failed = F.coalesce(is_error, F.lit(False))
    clean = ~failed & interrupted.eqNullSafe(F.lit(False)) & has_streams
    stopped = F.coalesce(background, F.lit(False)) | F.coalesce(interrupted, F.lit(False))
    return F.when(stopped, None).when(code.isNotNull(), code).when(failed, said).when(clean, 0)
