"""Operator 2. WARC archives: a PySpark data source that writes them, with revisit records, and reads them.

Writing: each task writes one file, a gzip member per record. A member's header names its own length and that of its
content (extra field ``sl``, as the format's annex on compression describes it). Files get their names when the job
commits; what lost or repeated tasks wrote keeps a name that is never read. Of equal payloads one is stored.

Reading: a partition is a range of bytes of one large file, or a group of small files. A range begins at the first member
that starts in it. A record's headers are parsed first; where the pushed filters on record type, ids or header values
rule it out, or its payload isn't asked for, the rest of its member is neither decompressed nor, where the length is
known, read. Archives of other writers are read too: members without lengths are decompressed to their end, a file of one
member for all records, or an uncompressed one, is read by one task.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

VERSION, END = "WARC/1.1", b"\r\n\r\n"
#: A gzip header with an extra field of two lengths, and how members of any writer begin.
MEMBER, MAGIC = struct.Struct("<4sIBBHccHII"), b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, refers_to_uri string, content_type string, payload_bytes long, payload binary, headers map<string,string>, path string, byte_offset long"
#: Columns that stand for one header each.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "refers_to_uri": "warc-refers-to-target-uri", "content_type": "content-type"}


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: 5 hex digits are 4 base-32 digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = 0) -> DataFrame:
    """A row per page (an empty table: none): page_id, url, payload (UTF-8; null: empty), payload_bytes, payload_digest, record_type, refers_to.

    Of pages with equal payloads of ``least`` bytes or more, the one with the smallest page_id is the response and the
    others revisit it. Rows that repeat that page_id are responses each. A null page_id is largest: such a row
    revisits a page with an id, and is a response where there is none.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    # Copies only: most payloads occur once. The second key keeps this side apart from the join's own exchange, so that a hot payload can be split.
    first = rows.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(first.drop("n"), (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"), F.lit(date).alias("date"))


def uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write(recs: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archives of the rows of ``records``, added to what lies at path. A record's block is an HTTP response; a revisit's has no body. A page of any length
    is one record, which must fit a Python worker (2 GB at most).

    compression: gzip (a member per record) or none.
    """
    recs.sparkSession.dataSource.register(WarcSource)
    line = "\r\n"
    clean = F.regexp_replace("url", r"[\x00-\x20\x7f]", "")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(line + line))
    is_revisit = F.col("record_type") == "revisit"
    body = F.when(is_revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    size = F.octet_length(http) + F.octet_length(body)
    head = F.concat(
        F.lit(f"{VERSION}{line}WARC-Type: "), F.col("record_type"), F.lit(f"{line}WARC-Record-ID: "), uri(F.col("page_id")), F.lit(f"{line}WARC-Date: "), F.col("date"),
        F.lit(f"{line}WARC-Target-URI: "), clean, F.lit(f"{line}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(is_revisit, F.concat(F.lit(f"{line}WARC-Profile: {PROFILE}{line}WARC-Refers-To: "), uri(F.col("refers_to")))).otherwise(""),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "), size.cast("string"), F.lit(line + line), http,
    )
    recs.select(head.cast("binary").alias("head"), body.alias("body")).write.format("warc").mode("append").option("compression", compression).save(path)


def member(content: tuple[bytes, ...]) -> bytes:
    """A gzip member of the parts' bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    crc, size, out = 0, 0, []
    for part in content:
        crc, size = zlib.crc32(part, crc), size + len(part)
        out.append(z.compress(part))
    out.append(z.flush())
    end = struct.pack("<II", crc, size)
    return MEMBER.pack(MAGIC + b"\x04", 0, 0, 255, 12, b"s", b"l", 8, MEMBER.size + sum(map(len, out)) + len(end), size) + b"".join(out) + end


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.packed = options["path"], options.get("compression", "gzip") != "none"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = filesystem(self.path)
        name, out = f"{root}/_{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}", None
        for batch in iterator:
            for head, body in zip(batch.column("head"), batch.column("body"), strict=True):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(name, compression=None, buffer_size=1 << 20)
                content = (head.as_py(), body.as_py(), END)
                out.write(member(content) if self.packed else b"".join(content))
        if out is not None:
            out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        """Gives the files their names; other files that begin with _ are of lost tasks and are never read."""
        system, root = filesystem(self.path)
        system.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.path:
                system.move(m.path, f"{root}/{m.path.rpartition('/')[2][1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = filesystem(self.path)
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.path)


@dataclass
class Files(InputPartition):
    """Files, and the range of bytes of each."""

    parts: tuple[tuple[str, int, int], ...]


def filesystem(path: str):
    """(file system, path in it); a path without a scheme is local."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    return fs.FileSystem.from_uri(path)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.group = int(options.get("partitionbytes", 64 << 20))
        self.decode = options.get("payload", "true").lower() != "false"
        self.wanted: dict[str, set | None] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality, membership and presence of header columns; what it can't take goes back to Spark."""
        for f in filters:
            column = ".".join(f.attribute) if isinstance(f, (EqualTo, In, IsNotNull)) else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, IsNotNull):
                self.wanted.setdefault(column, None)
            else:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                known = self.wanted.get(column)
                self.wanted[column] = values if known is None else known & values

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = filesystem(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")
        groups: list[Files] = []
        held, size = [], 0
        for path, n in files:
            step = self.group if path.endswith(".gz") else max(n, 1)
            for at in range(0, n, step):
                part = (path, at, min(n, at + step))
                if held and size + part[2] - at > self.group:
                    groups.append(Files(tuple(held)))
                    held, size = [], 0
                held.append(part)
                size += part[2] - at
        return [*groups, *([Files(tuple(held))] if held else [])] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.path)
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        kinds = {"payload_bytes": pa.int64(), "byte_offset": pa.int64(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        rows, size = [], 0
        for path, begin, end in partition.parts:
            with system.open_input_file(path) as file:
                found = in_members(file, begin, end, self.wanted, self.decode) if path.endswith(".gz") else parse(Plain(file), self.wanted, self.decode)
                for row in found:
                    rows.append(row | {"path": path})
                    size += len(row["payload"] or b"") + 512
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Plain:
    """The bytes of a file; those that are skipped aren't read."""

    whole = None

    def __init__(self, file) -> None:
        self.file = file

    def read(self, n: int) -> bytes:
        return self.file.read(n)

    def skip(self, n: int) -> None:
        self.file.seek(n, 1)


class Member:
    """The content of the gzip member at a place of a file, decompressed as it is read. ``whole``: its length if the member's header names it."""

    CHUNK = 1 << 16

    def __init__(self, file, at: int) -> None:
        self.file, self.at, self.begin = file, at, at
        self.z, self.held = zlib.decompressobj(31), b""
        file.seek(at)
        self.first = file.read(min(4096, self.CHUNK))
        self.at += len(self.first)
        self.size = self.whole = None
        if len(self.first) >= MEMBER.size:
            magic, *_, s, l, n, size, whole = MEMBER.unpack_from(self.first)
            if (magic, s, l, n) == (MAGIC + b"\x04", b"s", b"l", 8):
                self.size, self.whole = size, whole

    def read(self, n: int) -> bytes:
        out = b""
        while not out and not self.z.eof:
            if self.z.unconsumed_tail:
                data = self.z.unconsumed_tail
            else:
                data, self.first = self.first or self.more(), b""
            out = self.z.decompress(data, max(n, 1))
            if not data and not out and not self.z.eof:
                raise ValueError(f"member at byte {self.begin} has no end")
        return out

    def more(self) -> bytes:
        self.file.seek(self.at)
        data = self.file.read(self.CHUNK)
        self.at += len(data)
        return data

    def skip(self, n: int) -> None:
        while n > 0 and (got := self.read(min(n, 1 << 20))):
            n -= len(got)

    def next(self) -> int:
        """Where the next member begins."""
        if self.size is not None:
            return self.begin + self.size
        while not self.z.eof:
            self.read(1 << 20)
        return self.at - len(self.z.unused_data) - len(self.first)


def first_member(file, begin: int, end: int) -> int | None:
    """Where the first member that starts in a range of the file begins: a gzip header whose content is a record's, with a whole member behind it."""
    at, size = begin, file.size()
    while at < end:
        file.seek(at)
        window = file.read((1 << 20) + len(MAGIC) - 1)
        found = window.find(MAGIC)
        while found >= 0 and at + found < end:
            if at + found == 0:
                return 0
            try:
                m = Member(file, at + found)
                if m.read(16).startswith(b"WARC/"):
                    after = m.next()
                    file.seek(min(after, size))
                    if after == size or file.read(len(MAGIC)) == MAGIC:
                        return at + found
            except (zlib.error, ValueError):
                pass
            found = window.find(MAGIC, found + 1)
        at += 1 << 20
    return None


def in_members(file, begin: int, end: int, wanted: dict[str, set | None], decode: bool) -> Iterator[dict]:
    """Records of the members that start in a range of the file; ``byte_offset`` is the member's."""
    at = first_member(file, begin, end) if begin else 0
    size = file.size()
    while at is not None and at < min(end, size):
        m = Member(file, at)
        for row in parse(m, wanted, decode):
            yield row | {"byte_offset": at}
        at = m.next()


def parse(stream, wanted: dict[str, set | None], decode: bool) -> Iterator[dict]:
    """Records of a stream. Blocks of records that the header filters rule out are skipped; where such a record fills a stream of known length, the stream is left."""
    held, at = b"", 0

    def more(n: int) -> bytes:
        nonlocal held
        if len(held) < n:
            parts, size = [held], len(held)
            while size < n and (got := stream.read(max(1 << 14, n - size))):
                parts.append(got)
                size += len(got)
            held = b"".join(parts)
        return held

    def take(n: int, keep: bool) -> bytes:
        nonlocal held, at
        at += n
        if keep or len(held) >= n:
            out, held = more(n)[:n] if keep else b"", held[n:]
            return out
        stream.skip(n - len(held))
        held = b""
        return b""

    while True:
        while more(2)[:2] == b"\r\n":
            take(2, False)
        if not held:
            return
        begin = at
        while (end := held.find(b"\r\n\r\n")) < 0:
            before = len(held)
            if len(more(before + 1)) == before:
                raise ValueError(f"record headers at byte {begin} have no end")
        first, *lines = take(end + 4, True)[:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {begin}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        fills = stream.whole is not None and at + length + len(END) >= stream.whole
        row = {c: headers.get(h) for c, h in HEADERS.items()}
        if any(row[c] is None or (values is not None and row[c] not in values) for c, values in wanted.items()):
            if fills:
                return
            take(length, False)
            continue
        row |= {"headers": headers, "byte_offset": begin, "payload": None, "payload_bytes": length}
        if not headers.get("content-type", "").startswith("application/http"):
            if not decode and fills:
                yield row
                return
            row["payload"] = take(length, decode) if decode else take(length, False) or None
        else:
            more(min(length, 1 << 14))
            if (split := held[:length].find(b"\r\n\r\n")) < 0:
                split = more(min(length, 1 << 20))[:length].find(b"\r\n\r\n")
            split = split + 4 if split >= 0 else 0
            block = take(split, True).decode("utf-8", "replace").lower()
            sizes = [int(x.partition(":")[2]) for x in block.split("\r\n") if x.startswith("content-length:")]
            row["payload_bytes"] = sizes[0] if sizes else length - split
            stored = decode and headers.get("warc-type") != "revisit"
            if not stored and fills:
                yield row
                return
            body = take(length - split, stored)
            row["payload"] = body if stored else None
        yield row


class WarcSource(DataSource):
    """``path``: a file or folder. ``payload``: false leaves payloads undecoded (null). ``partitionBytes``: size of a partition.
    ``compression`` (writing): gzip or none. Written rows are (head, body): a record's headers with those of its block, and the block's body."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def read(spark, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives under path. Filters on header columns are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def store(pages: DataFrame, path: str, **names: str) -> None:
    write(records(pages, **names), path)


def page_number(record_id: str) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
