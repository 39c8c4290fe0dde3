"""Paths in logs: normalised, resolved against a directory, working directories (N12). Column expressions only.

Separators become slashes. A path with a drive or a network share is a Windows path, compared in lower case; all others keep their case. Trailing slashes go, so that the root is empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARE = r"^//[^/]+/[^/]+"
EXPANSION = r"[$`*?{}\n\r\x00]|^~"


def is_windows(path: Column) -> Column:
    return path.rlike(r"^(?:[A-Za-z]:|[\\/]{2})")


def folded(rest: Column, absolute: Column) -> Column:
    """``rest`` without empty and dot parts; two dots take the part before away, at the root nothing, and stay where a relative path has none."""
    parts = F.filter(F.split(rest, "/"), lambda x: (x != "") & (x != "."))

    def step(done: Column, part: Column) -> Column:
        n = F.size(done)
        stays = (n == 0) | (F.try_element_at(done, F.lit(-1)) == "..")
        return F.when(part != "..", F.array_append(done, part)).when(~stays, F.slice(done, 1, F.greatest(n - 1, F.lit(0)))).when(absolute, done).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def normalize_path(path: Column) -> Column:
    """The normal form of a path; null of null, a dot of an empty relative one."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    share = F.regexp_extract(p, SHARE, 0)
    anchor = F.when(share != "", share).when(p.rlike("^[A-Za-z]:"), F.substring(p, 1, 2)).otherwise("")
    rest = F.substr(p, F.length(anchor) + 1)
    rooted = rest.startswith("/")
    body = folded(rest, rooted | (share != ""))
    out = F.concat(anchor, F.when(body == "", F.when(rooted | (anchor != ""), "").otherwise(".")).when(rooted, F.concat(F.lit("/"), body)).otherwise(body))
    return F.when(is_windows(p), F.lower(out)).otherwise(out)


def resolve_path(value: Column, cwd: Column) -> Column:
    """N12. ``value`` as seen from ``cwd``: null if it is empty, holds an expansion or a line break, or is relative without a directory."""
    v = F.when((value != "") & ~value.rlike(EXPANSION), value)
    drive, slash = v.rlike(r"^(?:[A-Za-z]:[\\/]|[\\/]{2})"), v.startswith("/")
    windows = is_windows(cwd)
    rooted = windows & v.startswith("\\")  # on the directory's drive
    return (
        F.when(drive | slash, normalize_path(v))
        .when(rooted, normalize_path(F.concat(F.regexp_extract(cwd, r"^[A-Za-z]:|^[\\/]{2}[^\\/]+[\\/][^\\/]+", 0), v)))
        .when(windows & v.rlike(r"^[A-Za-z]:"), normalize_path(F.when(F.lower(F.substring(cwd, 1, 2)) == F.lower(F.substring(v, 1, 2)), F.concat(cwd, F.lit("/"), F.substr(v, F.lit(3)))).otherwise(v)))
        .when(cwd.isNotNull() & (cwd != ""), normalize_path(F.concat(cwd, F.lit("/"), v)))
    )


def execution_cwd(value: Column) -> Column:
    """N12. A working directory in normal form; of file URIs only local Windows ones without encoded separators, of other URIs none."""
    uri = F.lower(F.substring(value, 1, 5)) == "file:"
    path = F.regexp_extract(value, r"^(?i:file):(?://)?(/[A-Za-z]:/[^?#\\\x00-\x1f\x7f]*)$", 1)
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    good = (path != "") & ~path.rlike(r"%(?![0-9A-Fa-f]{2})|%(?i:2f|5c)") & ~decoded.rlike(r"[\x00-\x1f\x7f]|\uFFFD")
    return F.when(uri, F.when(good, normalize_path(F.substr(decoded, F.lit(2))))).when((value != "") & ~value.contains("://") & ~value.contains("\x00"), normalize_path(value))
