"""WARC archives as a Spark data source, written and read by Python workers.

Writing: each task writes gzip members, one per record, into files of bounded size. The driver's commit
names the files of the successful attempts in a manifest, and only those are read; files of lost or
repeated attempts are never seen. Reading: files are the partitions; predicates on the record type and on
header columns are pushed into the scan, headers are parsed first, and the payload of a record that is not
wanted is skipped by the member's length in its gzip header (archives without it are still read).

Defined cases: null html is an empty payload; an empty table writes an archive without records; rows that
repeat a page_id with the same payload are responses together if that id is the smallest of its payload;
a null page_id is written as ``null`` and sorts after every id; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from tallymark.llm.common import Scratch, bounded_batches, table

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Header of each column.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "payload_length": "warc-payload-length",
}
#: A file is closed when it is larger; Arrow batches are cut at the second figure.
FILE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
MANIFEST = "manifest.json"


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member that tells its own compressed length in an extra field ``SL``."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 12 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def one_line(value: object) -> str:
    """A header value without line breaks."""
    return " ".join(str(value).split())


def record(row, date: str) -> bytes:
    """A WARC/1.1 response, or a revisit whose block has the HTTP header alone."""
    payload = bytes(row.payload or b"") if row.record_type == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_length}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: {one_line(row.record_id)}", f"WARC-Date: {date}"]
    if row.target_uri is not None:
        head.append(f"WARC-Target-URI: {one_line(row.target_uri)}")
    if row.record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {one_line(row.refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{row.payload_digest}", f"WARC-Payload-Length: {row.payload_length}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.date, self.level = options["path"], options.get("date", "2000-01-01T00:00:00Z"), int(options.get("level", "1"))

    def write(self, rows: Iterator) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size, name = [], None, 0, ""
        for row in rows:
            if out is None:
                name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            out.write(data := member(record(row, self.date), self.level))
            size += len(data)
            if size > FILE_BYTES:
                out.close()
                files.append((name, size))
                out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


class Part(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class Members:
    """Records of one archive: headers first, payloads on demand."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at = file, size, 0

    def __iter__(self) -> Iterator[tuple[dict[str, str], Member]]:
        while self.at < self.size:
            self.file.seek(self.at)
            m = Member(self.file, self.at)
            yield m.headers(), m
            self.at = m.end()


class Member:
    def __init__(self, file, at: int):
        self.file, self.start = file, at
        self.inflate, self.plain, self.read = zlib.decompressobj(31), bytearray(), 0
        self.length = None
        first = self.file.read(1 << 12)
        if first[3] & 4 and first[12:14] == b"SL":
            self.length = struct.unpack_from("<I", first, 16)[0]
        self.feed(first)

    def feed(self, data: bytes) -> None:
        self.read += len(data)
        self.plain += self.inflate.decompress(data)

    def more(self) -> bool:
        if self.inflate.eof or not (data := self.file.read(1 << 16)):
            return False
        self.feed(data)
        return True

    def headers(self) -> dict[str, str]:
        while (stop := self.plain.find(b"\r\n\r\n")) < 0 and self.more():
            pass
        self.body = stop + 4
        lines = bytes(self.plain[: max(stop, 0)]).decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    def block(self) -> bytes:
        """The payload: what follows the HTTP header, without the record's closing line breaks."""
        while self.more():
            pass
        content = bytes(self.plain[self.body : -4])
        return content[content.index(b"\r\n\r\n") + 4 :]

    def end(self) -> int:
        if self.length:
            return self.start + self.length
        while self.more():
            pass
        return self.start + self.read - len(self.inflate.unused_data)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true") == "true"
        self.wanted: list[tuple[str, frozenset[str]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership on header columns are checked here, before a payload is decoded."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In | IsNotNull) and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and isinstance(f.value, str) and name in HEADERS:
                self.wanted.append((HEADERS[name], frozenset([f.value])))
            elif isinstance(f, In) and name in HEADERS and all(isinstance(v, str) for v in f.value):
                self.wanted.append((HEADERS[name], frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> list[Part]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())
        parts, size = [[]], 0
        for name, n in sorted(files, key=lambda x: -x[1]):
            if size and size + n > FILE_BYTES // 4:
                parts.append([])
                size = 0
            parts[-1].append(name)
            size += n
        return [Part(x) for x in parts]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for name in part.names:
            with fs.open_input_file(f"{root}/{name}") as file:
                for head, body in Members(file, file.size()):
                    if any(head.get(k) not in values for k, values in self.wanted):
                        continue
                    payload = body.block() if self.payload and head.get("warc-type") == "response" else None
                    digest = head.get("warc-payload-digest")
                    rows.append((head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-refers-to"), digest and digest.removeprefix("sha256:"), int(head.get("warc-payload-length", -1)), payload))
                    size += len(payload or b"") + 500
                    if size > BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*HEADERS, "payload"])


class WarcSource(DataSource):
    """``format("warc")``: options ``path``; reading ``payload=false`` leaves payloads undecoded; writing ``date``, ``level``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 100) -> None:
    """Write a record per row; equal payloads of at least ``least_bytes`` are revisits of the smallest page_id's."""
    register(pages.sparkSession)
    bounded_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), html.alias("payload"))
    own = own.withColumns({"payload_digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long")})
    first = own.filter(F.col("payload_length") >= least_bytes).groupBy(F.col("payload_digest").alias("first_digest")).agg(F.min("page_id").alias("first_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("first_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    records = own.join(first, own.payload_digest == F.col("first_digest"), "left").select(
        name("page_id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, name("first_id")).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive ``pages``, read the archives back; bytes and digest of a response are those of the payload read."""
    path = Scratch(spark, "warc").path("archive")
    archive_pages(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) AS BIGINT)")
    response = F.col("record_type") == "response"
    return read_archive(spark, path).select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


OP7_SQL = """
SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages
"""
