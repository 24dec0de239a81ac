"""WARC archives as a PySpark data source: read with pushed filters, write one file a task."""

from __future__ import annotations

import base64
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from ._shared import joined_by_share, narrow, scratch_path

SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, content_length long, "
    "payload_digest string, refers_to string, headers map<string,string>, payload binary"
)
#: Columns that come from a single header, so that their filters are decided before the block is touched.
HEADER_OF = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
FORMAT = b"WARC/1.1\r\n"
#: Subfield of a gzip member's header that holds the member's length, so that members can be skipped unread.
SKIP = b"GL"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "_manifest-"


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI that pyarrow knows; a bare path is local."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return FORMAT + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """One gzip member whose header tells its own length (RFC 1952 extra field)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 8) + SKIP + struct.pack("<HI", 4, size)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_length(head: bytes) -> int | None:
    """Length of a gzip member by its extra field, if it has ours."""
    if len(head) < 20 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        return None
    (extra,) = struct.unpack_from("<H", head, 10)
    at, end = 12, min(12 + extra, len(head))
    while at + 4 <= end:
        (n,) = struct.unpack_from("<H", head, at + 2)
        if head[at : at + 2] == SKIP and n == 4 and at + 8 <= end:
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + n
    return None


def parse_head(head: bytes) -> dict[str, str]:
    """Headers of a record by lower-case name; continuation lines are joined."""
    if not head.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {head[:20]!r}")
    found: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            found[last] = value.strip()
    return found


class _Source:
    """Sequential reading of one archive: headers first, then the block if it is wanted."""

    CHUNK = 1 << 16

    def __init__(self, file):
        self.file, self.buffer, self.at = file, b"", 0

    def more(self, n: int) -> bool:
        """Have n bytes at hand; False at the end of the file."""
        while len(self.buffer) - self.at < n:
            read = self.file.read(max(self.CHUNK, n - (len(self.buffer) - self.at)))
            if not read:
                return False
            self.buffer, self.at = self.buffer[self.at :] + read, 0
        return True

    def skip(self, n: int) -> None:
        have = len(self.buffer) - self.at
        if n <= have:
            self.at += n
        else:
            self.file.seek(n - have, 1)
            self.buffer, self.at = b"", 0


def _inflated_head(inflate, data: bytes) -> bytes:
    out = inflate.decompress(data, 4096)
    while b"\r\n\r\n" not in out:
        more = inflate.decompress(inflate.unconsumed_tail, 4096)
        if not more:
            break
        out += more
    return out


def records(file, wanted, with_block: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of the records whose headers are wanted; other blocks are not inflated or decoded.

    Plain archives are skipped by Content-Length. In compressed ones each record is a gzip
    member; a member that tells its length is skipped by it, any other is inflated to its end.
    """
    source = _Source(file)
    while source.more(4):
        if source.buffer[source.at : source.at + 2] == b"\x1f\x8b":
            source.more(20)
            length = member_length(source.buffer[source.at : source.at + 64])
            inflate = zlib.decompressobj(31)
            if length is not None:
                if not source.more(length):
                    raise EOFError("an archive ends within a record")
                member = source.buffer[source.at : source.at + length]
                source.skip(length)
                data = _inflated_head(inflate, member)
                head, _, rest = data.partition(b"\r\n\r\n")
                headers = parse_head(head)
                if not wanted(headers):
                    continue
                if with_block:
                    rest += inflate.decompress(inflate.unconsumed_tail) + inflate.flush()
            else:
                data = b""
                while not inflate.eof:
                    if not source.more(1):
                        raise EOFError("an archive ends within a record")
                    data += inflate.decompress(source.buffer[source.at :])
                    source.at = len(source.buffer) - len(inflate.unused_data)
                head, _, rest = data.partition(b"\r\n\r\n")
                headers = parse_head(head)
                if not wanted(headers):
                    continue
            yield headers, rest[: int(headers.get("content-length", 0))] if with_block else None
            continue
        if source.buffer[source.at : source.at + 2] == b"\r\n":
            source.skip(2)
            continue
        while (end := source.buffer.find(b"\r\n\r\n", source.at)) < 0:
            if not source.more(len(source.buffer) - source.at + 1):
                raise EOFError("an archive ends within a header")
        headers = parse_head(source.buffer[source.at : end])
        length = int(headers.get("content-length", 0))
        source.at = end + 4
        if not wanted(headers):
            source.skip(length)
            continue
        block = None
        if with_block:
            if not source.more(length):
                raise EOFError("an archive ends within a block")
            block = source.buffer[source.at : source.at + length]
        source.skip(length)
        yield headers, block


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block behind its HTTP header, if it has one."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def hex_digest(value: str | None) -> str | None:
    """A payload digest as bare lower-case hex; WARC writes base 32."""
    if not value:
        return None
    name, _, digest = value.partition(":")
    if name.lower() == "sha1" and len(digest) == 32:
        return base64.b32decode(digest.upper()).hex()
    return digest.lower()


class _Part(InputPartition):
    def __init__(self, value: int):
        super().__init__(value)
        self.files: list[str] = []


@dataclass
class _Test:
    """One pushed filter on a header."""

    column: str
    kind: str
    value: object

    def holds(self, headers: dict[str, str]) -> bool:
        found = headers.get(HEADER_OF[self.column])
        if self.column == "payload_digest":
            found = hex_digest(found)
        if found is None:
            return False
        return {
            "=": lambda: found == self.value,
            "in": lambda: found in self.value,
            "set": lambda: True,
            "starts": lambda: found.startswith(self.value),
            ">": lambda: found > self.value,
            ">=": lambda: found >= self.value,
            "<": lambda: found < self.value,
            "<=": lambda: found <= self.value,
        }[self.kind]()


_PUSHED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", StringStartsWith: "starts"}


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        self.options = dict(options)
        self.tests: list[_Test] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column not in HEADER_OF:
                yield f
            elif isinstance(f, IsNotNull):
                self.tests.append(_Test(column, "set", None))
            elif isinstance(f, In):
                self.tests.append(_Test(column, "in", tuple(f.value)))
            elif type(f) in _PUSHED:
                self.tests.append(_Test(column, _PUSHED[type(f)], f.value))
            else:
                yield f

    def partitions(self):
        """Whole archives, put together up to `maxPartitionBytes`; archives are not cut."""
        system, path = _opened(self.options["path"])
        names = archive_files(system, path)
        most = int(self.options.get("maxpartitionbytes", 128 << 20))
        parts, size = [_Part(0)], 0
        for name, n in names:
            if parts[-1].files and size + n > most:
                parts.append(_Part(len(parts)))
                size = 0
            parts[-1].files.append(name)
            size += n
        return parts

    def read(self, partition):
        system, _ = _opened(self.options["path"])
        wanted = lambda headers: all(test.holds(headers) for test in self.tests)
        types = {c: pa.binary() if c == "payload" else pa.int64() if c == "content_length" else pa.map_(pa.string(), pa.string()) if c == "headers" else pa.string() for c in self.columns}
        schema = pa.schema(list(types.items()))
        rows: list[list] = [[] for _ in self.columns]
        size = 0
        for name in partition.files:
            with system.open_input_file(name) as file:
                for headers, block in records(file, wanted, "payload" in self.columns):
                    for column, values in zip(self.columns, rows):
                        if column == "payload":
                            values.append(payload_of(headers, block))
                            size += len(values[-1])
                        elif column == "content_length":
                            values.append(int(headers.get("content-length", 0)))
                        elif column == "headers":
                            values.append(list(headers.items()))
                        elif column == "payload_digest":
                            values.append(hex_digest(headers.get("warc-payload-digest")))
                        else:
                            values.append(headers.get(HEADER_OF[column]))
                    if len(rows[0]) >= 5000 or size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(v, types[c]) for c, v in zip(self.columns, rows)], schema=schema)
                        rows, size = [[] for _ in self.columns], 0
        if rows and rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(v, types[c]) for c, v in zip(self.columns, rows)], schema=schema)


def archive_files(system: pafs.FileSystem, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the archives at path: those of committed writes, or all where none was ours."""
    info = system.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = {f.path: f.size for f in system.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File}
    manifests = [p for p in found if os.path.basename(p).startswith(MANIFEST)]
    if manifests:
        names = []
        for manifest in manifests:
            with system.open_input_stream(manifest) as file:
                names += [os.path.join(os.path.dirname(manifest), name) for name in json.loads(file.read())]
        return sorted((name, found[name]) for name in names)
    return sorted((p, n) for p, n in found.items() if p.endswith((".warc", ".warc.gz")))


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """Each task writes one archive under a name of its own; the manifest lists those of tasks that counted."""

    def __init__(self, options):
        self.options = dict(options)

    def write(self, iterator):
        system, path = _opened(self.options["path"])
        name, out, compressed = None, None, self.options.get("compression", "gzip") == "gzip"
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc" + (".gz" if compressed else "")
                        system.create_dir(path, recursive=True)
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    data = encoded_record(row)
                    out.write(gzip_member(data) if compressed else data)
        finally:
            if out is not None:
                out.close()
        return _Written(name)

    def commit(self, messages):
        system, path = _opened(self.options["path"])
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(m.name for m in messages if m and m.name)).encode())

    def abort(self, messages):
        system, path = _opened(self.options["path"])
        for message in messages:
            if message and message.name:
                system.delete_file(f"{path}/{message.name}")


def encoded_record(row: dict) -> bytes:
    """A record from the columns record_type, record_id, target_uri, warc_date, payload_digest (hex SHA-1), refers_to, headers and payload.

    Responses get an HTTP header before their payload; revisits have an empty block.
    """
    revisit = row["record_type"] == "revisit"
    digest = row.get("payload_digest")
    headers = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Target-URI", None if row.get("target_uri") is None else re.sub(r"[\r\n]+\s*", " ", row["target_uri"])),
        ("WARC-Date", row.get("warc_date")),
        ("WARC-Payload-Digest", digest and "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Refers-To", row.get("refers_to")),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        *(row.get("headers") or []),
        ("Content-Type", None if revisit else "application/http;msgtype=response"),
    ]
    return record_bytes(headers, b"" if revisit else HTTP_HEAD + (row.get("payload") or b""))


class WarcDataSource(DataSource):
    """format("warc"): options path, maxPartitionBytes; for writing compression (gzip or none)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


#: Header that carries the length of the payload, which a revisit does not hold.
PAYLOAD_LENGTH = "X-Payload-Length"
#: Equal payloads are stored once from so many bytes on.
DEDUP_BYTES = 1000
PAGE_ID = "urn:page:"


def page_records(pages: DataFrame, least: int = DEDUP_BYTES) -> DataFrame:
    """(page_id, url, html) -> WARC records; of equal payloads that of the largest page_id is stored.

    Digests are aggregated before they are shuffled, and only those that occur twice with
    `least` bytes or more are joined to the pages, hot ones by broadcast; smaller payloads
    pass the join. Null html is an empty payload. Rows with an equal payload and an equal largest
    page_id are all stored. A null page_id is written as an empty id and never referred to.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"n": F.length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    same = rows.where(F.col("n") >= least).groupBy(F.col("payload_digest").alias("d"))
    kept = same.agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and kept is not null")
    kept = narrow(kept, "warc-repeats")
    rows = joined_by_share(rows, kept, F.when(F.col("n") >= least, F.col("payload_digest")), "d", "copies")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    urn = lambda c: F.concat(F.lit(f"<{PAGE_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        "payload_digest",
        F.when(revisit, urn(F.col("kept"))).alias("refers_to"),
        F.create_map(F.lit(PAYLOAD_LENGTH), F.col("n").cast("string")).alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archives(records: DataFrame, path: str, compression: str = "gzip") -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").option("path", path).option("compression", compression).save()


def read_archives(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """Records at path. Name fewer columns than SCHEMA to leave the rest undecoded; filters on headers are pushed down."""
    register(spark)
    size = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower())
    most = int(size[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[size[2]] if size else 128 << 20
    reader = spark.read.format("warc").option("path", path).option("maxPartitionBytes", most)
    return (reader.schema(columns) if columns else reader).load()


def archive_pages(pages: DataFrame, least: int = DEDUP_BYTES) -> DataFrame:
    """Write pages to WARC archives in the shared scratch folder and read back a row for each.

    Responses are read with their payload, whose length and digest are computed anew; of
    revisits only headers are read, and no block is decoded. Columns: page_id, payload_bytes,
    payload_digest, record_type, refers_to. See page_records() for nulls and repeated rows;
    no row, no result.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(page_records(pages, least), path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '{PAGE_ID}(-?[0-9]+)', 1) as bigint)")
    stored = read_archives(spark, path, "record_type string, record_id string, payload binary").where("record_type = 'response'")
    stored = stored.select(
        number("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    again = read_archives(
        spark, path, "record_type string, record_id string, payload_digest string, refers_to string, headers map<string,string>"
    ).where("record_type = 'revisit'")
    again = again.select(
        number("record_id").alias("page_id"), F.col("headers")[PAYLOAD_LENGTH.lower()].cast("long").alias("payload_bytes"), "payload_digest",
        "record_type", number("refers_to").alias("refers_to"),
    )
    return stored.unionByName(again)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND n >= 1000
"""
