"""JSONL lines with their places, as a batch and an incremental source."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, byte_offset long, line binary"
ARROW = pa.schema([("path", pa.string()), ("byte_offset", pa.int64()), ("line", pa.binary())])
BLOCK = 1 << 20
#: Bytes of a file's start by which it is known again.
HEAD = 1024


@dataclass
class Range(InputPartition):
    """Bytes of a file; a line belongs to the range in which it starts."""

    path: str
    start: int
    end: int
    whole: bool = True


def filesystem(path: str):
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    return fs.FileSystem.from_uri(path)


def files(path: str, suffix: str) -> list[tuple[str, int]]:
    """Sorted (path, size) of the files under path."""
    from pyarrow import fs

    system, root = filesystem(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        return []
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))


def lines(root: str, r: Range) -> Iterator[pa.RecordBatch]:
    """Lines that start in the range, without their newline; a last line without one counts if ``whole``."""
    system, _ = filesystem(root)
    with system.open_input_file(r.path) as f:
        yield from split(f, r)


def split(f: pa.NativeFile, r: Range) -> Iterator[pa.RecordBatch]:
    """Each block is split once; what a line has in earlier blocks is kept in pieces until its newline comes."""
    at = max(0, r.start - 1)
    f.seek(at)
    skip = r.start > 0  # up to the newline at or before the start, the line is another range's
    kept: list[bytes] = []
    while at < r.end:
        block = f.read(BLOCK)
        if not block:
            if not r.whole or not any(kept):
                return
            found, kept = [b"".join(kept)], []
        else:
            found = block.split(b"\n")
            if len(found) == 1:
                kept += found
                continue
            found[0] = b"".join([*kept, found[0]])
            kept = [found.pop()]
        starts = at + np.cumsum([0, *(len(x) + 1 for x in found)])
        at = int(starts[-1])
        keep = slice(int(skip), int(np.searchsorted(starts[:-1], r.end)))
        skip = False
        rows, places = found[keep], starts[:-1][keep]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.repeat(r.path, len(rows)), pa.array(places, pa.int64()), pa.array(rows, pa.binary())], schema=ARROW)


def plain(path: str) -> str:
    """A path as ``listing`` writes it: local ones without a scheme."""
    return re.sub("^file:(//)?(?=/)", "", path)


def plain_column(uri: Column) -> Column:
    """As plain, of a URI with encoded characters."""
    return F.url_decode(F.replace(F.regexp_replace(uri, "^file:(//)?(?=/)", ""), F.lit("+"), F.lit("%2B")))


def listing(spark: SparkSession, root: str, suffix: str = ".jsonl") -> DataFrame:
    """path, size and modified (microseconds) of the files under a folder, at any depth, listed by Spark; none is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    return found.select(F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))


def read_files(files: DataFrame, size: int = 64 << 20) -> DataFrame:
    """Lines of a table of files (path, size), which is read in ranges of ``size`` bytes by as many tasks as there are; the files' number and sizes don't matter.

    A file that no task can open is an error.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size).cast("long"))
    ranges = files.where("size > 0").select("path", F.explode(starts).alias("start"), "size").repartition("path", "start")

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inside = filesystem(path)
                with system.open_input_file(inside) as f:
                    yield from split(f, Range(path, start, min(end, start + size)))

    return ranges.mapInArrow(read_all, SCHEMA)


class BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.size = int(options.get("partitionbytes", 64 << 20))

    def partitions(self) -> list[Range]:
        out = [Range(p, at, min(at + self.size, n)) for p, n in files(self.path, self.suffix) for at in range(0, n, self.size)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return lines(self.path, partition) if partition.path else iter(())


class AppendReader(DataSourceStreamReader):
    """Offsets are the bytes of each file up to its last newline, and a digest of its first bytes: a partial last line waits; a file that shrank, or that another has
    replaced, is read anew."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def head(self, path: str, size: int) -> str:
        system, _ = filesystem(self.path)
        with system.open_input_file(path) as f:
            return sha256(f.read(min(size, HEAD))).hexdigest()

    def complete(self, path: str, size: int) -> int:
        system, _ = filesystem(self.path)
        with system.open_input_file(path) as f:
            end = size
            while end:
                start = max(0, end - (1 << 16))
                f.seek(start)
                cut = f.read(end - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                end = start
        return 0

    def latestOffset(self) -> dict:  # noqa: N802
        ends = {p: self.complete(p, n) for p, n in files(self.path, self.suffix)}
        return {"files": json.dumps({p: [n, self.head(p, n)] for p, n in ends.items()}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        a, b = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for p, (n, _) in sorted(b.items()):
            begin, head = a.get(p, (0, ""))
            if begin > n or (begin and self.head(p, begin) != head):
                begin = 0
            if n > begin:
                out.append(Range(p, begin, n))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return lines(self.path, partition)

    def commit(self, end: dict) -> None:
        """Nothing to free: the log files are the writers'."""


class JsonLines(DataSource):
    """``path``: a file or folder; ``suffix`` (.jsonl); ``partitionBytes`` of a batch partition. Lines keep their bytes and their order by (path, byte_offset)."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> AppendReader:  # noqa: N802
        return AppendReader(self.options)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(JsonLines)
    return spark.read.format("jsonl_lines").options(**options).load(path)


def stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(JsonLines)
    return spark.readStream.format("jsonl_lines").options(**options).load(path)


def parsed(raw: DataFrame) -> DataFrame:
    """raw with ``text`` (null: not UTF-8) and ``record``, a variant (null: broken JSON or repeated keys, or not an object)."""
    text = F.when(F.is_valid_utf8(F.col("line").cast("string")), F.col("line").cast("string"))
    v = F.try_parse_json(text)
    return raw.withColumn("text", text).withColumn("record", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def coverage(records: DataFrame, blank_ok: bool = False) -> DataFrame:
    """Lines, and how many aren't records. One row."""
    blank = F.length(F.trim(F.col("text"))) == 0
    broken = F.col("record").isNull() & (~F.coalesce(blank, F.lit(False)) if blank_ok else F.lit(True))
    return records.agg(F.count("*").alias("lines"), F.count_if(broken).alias("malformed"), F.count_if(F.col("text").isNull()).alias("undecodable"))
