"""Files that an edit touches (N10): headers of patches, and maps of changed files. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .variants import at, obj, string, type_of

# ---- fixed values: the patch format ----
BEGIN, END, END_OF_FILE = "*** Begin Patch", "*** End Patch", "*** End of File"
HEADER = r"\A\*\*\* (Add File|Update File|Delete File|Move to): ([^\n]+)\z"
# ---- end of fixed values ----
BREAKS = "\r\n|[\n\v\f\r\x1c-\x1e\x85  ]"


def unknown() -> Column:
    """One target that isn't known."""
    return F.array(F.lit(None).cast("string"))


def change_targets(changes: Column) -> Column:
    """Paths of a map (variant) of changed files, each followed by where it moved; one unknown target if there is no such map."""
    entries = F.map_entries(F.try_variant_get(changes, "$", "map<string,variant>"))

    def of(e: Column) -> Column:
        moved = at(obj(e["value"]), "move_path")
        there = F.coalesce(type_of(moved) != "VOID", F.lit(False))
        return F.when(there, F.array(e["key"], string(moved))).otherwise(F.array(e["key"]))

    found = F.flatten(F.transform(entries, of))
    return F.when((type_of(changes) == "OBJECT") & (F.size(entries) > 0), found).otherwise(unknown())


def line_kind(line: Column) -> Column:
    """One letter of a patch line: A, U, D or M for a header; E the end of a file, + - and space for what they begin with, @ a hunk, e an empty line, ? another."""
    header = F.regexp_extract(line, HEADER, 1)
    return (
        F.when(header != "", F.left(header, F.lit(1)))
        .when(line == END_OF_FILE, "E")
        .when(line.startswith("*** "), "?")
        .when(F.left(line, F.lit(1)).isin("+", "-", " "), F.left(line, F.lit(1)))
        .when(line.startswith("@@"), "@")
        .when(line == "", "e")
        .otherwise("?")
    )


#: A patch in letters: sections that begin with a header. An added file has only added lines; a deleted one has none; an updated one moves at most once,
#: before its lines, and has a line that isn't only a mark, unless it moved.
SHAPE = r"\A(?:A\+*|D|U[@eE]*(?:M[-+ @eE]*|[-+ ][-+ @eE]*))*\z"


def patch_lines(patch: Column) -> Column:
    return F.split(F.regexp_replace(patch, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""), BREAKS, -1)


def patch_targets(patch: Column) -> Column:
    """Files of a patch's headers in order, each once, moves included; one unknown target if the text is no sound patch, or has no header."""
    lines = patch_lines(patch)
    n = F.size(lines)
    body = F.slice(lines, 2, F.greatest(n - 2, F.lit(0)))
    framed = (n >= 3) & (F.element_at(lines, 1) == BEGIN) & (F.element_at(lines, -1) == END)
    sound = F.array_join(F.transform(body, line_kind), "").rlike(SHAPE)
    targets = F.array_distinct(F.filter(F.transform(body, lambda x: F.regexp_extract(x, HEADER, 2)), lambda x: x != ""))
    return F.when(framed & sound & (F.size(targets) > 0), targets).otherwise(unknown())


def argument_patch(arguments: Column) -> tuple[Column, Column]:
    """(targets, directory) of a patch tool's arguments: a variant that is the patch, JSON text, or an object with ``patch`` or ``input`` and perhaps ``workdir`` or ``cwd``."""
    text = string(arguments)
    inner = F.try_parse_json(text)
    value = F.when(text.isNotNull(), F.coalesce(inner, F.to_variant_object(F.struct(text.alias("raw"))))).otherwise(arguments)
    raw = F.when(text.isNotNull() & inner.isNull(), text)
    map_ = obj(F.when(raw.isNull(), value))
    patch = F.coalesce(raw, F.when(map_.isNotNull(), string(F.coalesce(at(map_, "patch"), at(map_, "input")))).otherwise(string(inner)))
    return patch_targets(F.coalesce(patch, F.lit(""))), string(F.coalesce(at(map_, "workdir"), at(map_, "cwd")))
