"""Files that a window needs (S6): those that may hold an instant of it, and those that share a session with them or hold a parent's, however far.

The fixpoint runs over a table of files and one of their keys: each round joins what the last one added, by key, so that rounds follow the depth of the
sessions' ancestry, and files and keys that are settled aren't joined again. Leaving files out never changes a result: every session that is returned is folded from all of its files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import durable


def may_matter(since: int) -> Column:
    """Whether a file's own instants can't tell that it lies before ``since``. Its time is a first sieve only: some writers leave it at creation."""
    before = (F.col("modified") < since) & F.col("provable") & (F.col("latest") < since)
    return ~F.coalesce(before, F.lit(False))


def edges(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, path) of the sessions that files hold, and (path, key) of all sessions that they name."""
    held = files.select(F.explode("ids").alias("key"), "path")
    named = files.select("path", F.explode(F.array_union("ids", "parents")).alias("key"))
    return held, named


def closure(files: DataFrame, needed: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, int]:
    """S6. (path of all files that are needed, rounds): ``needed`` (path), files that hold a key of ``wanted`` (key), and, again and again, files that hold a session which a needed file names.

    files: path, ids, parents. Keys and files may lie in cycles.
    """
    held, named = edges(files)
    done = durable(needed.select("path").distinct())
    fresh_keys = named.join(done, "path", "left_semi").select("key")
    if wanted is not None:
        fresh_keys = fresh_keys.union(wanted.select("key"))
    keys = fresh_keys = durable(fresh_keys.distinct())
    rounds = 0
    while True:
        rounds += 1
        fresh = durable(held.join(fresh_keys, "key", "left_semi").select("path").distinct().join(done, "path", "left_anti"))
        if fresh.isEmpty():
            return done, rounds
        done = done.union(fresh)
        fresh_keys = durable(named.join(fresh, "path", "left_semi").select("key").distinct().join(keys, "key", "left_anti"))
        if fresh_keys.isEmpty():
            return done, rounds
        keys = keys.union(fresh_keys)


def window_files(files: DataFrame, since: int) -> DataFrame:
    """S6. Rows of the index whose files a window from ``since`` on needs."""
    needed, _ = closure(files, files.where(may_matter(since)))
    return files.join(needed, "path", "left_semi")


def collect_window(files: DataFrame, since: int, events: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """S6. (events of the needed files, rows of these files). ``events`` reads files and gives session_id and parent_id among its columns.

    A file's key rows come from its first record; sessions and parents that only the events show, such as those of a later header, are sought in the index again until none is new.
    """
    needed, _ = closure(files, files.where(may_matter(since)))
    while True:
        chosen = durable(files.join(needed, "path", "left_semi"))
        found = events(chosen)
        keys = durable(found.select("session_id", "parent_id").distinct())
        every = keys.select(F.explode(F.array_compact(F.array("session_id", "parent_id"))).alias("key")).distinct()
        held, _ = edges(files)
        if held.join(every, "key", "left_semi").join(needed, "path", "left_anti").isEmpty():
            return found, chosen
        needed, _ = closure(files, needed, every)
