"""WARC archives as a Spark data source, with revisit records for payloads seen before.

Reading plans a partition for each range of files, from a manifest of split points where the
writer left one and else by whole files. Predicates on header columns are taken over by the
source: a record's WARC headers are inflated and parsed first, and if a predicate fails the
record is passed over without reading its payload (by the skip length in its gzip member, where
there is one). A schema without `payload` never decodes payloads.

Writing makes a gzip member of each record. Tasks write files of their own names and only those
that the driver commits are in the manifest, so a lost or repeated task leaves nothing to see.
Names of header fields are read whatever their case. A record that is cut short, or has no
length, is an error; with the option badRecords=skip reading goes on behind the file's range.

Null payloads are empty ones, null urls leave the target header out, and null ids are never
chosen as the response of a group unless there is no other (then the group's rows all are
responses). Rows that repeat the response's id are responses too. Payloads are written and read
whole, however long. Other columns have no influence; an empty table makes an archive without
records.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
                                    LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

from .common import new_path, salted_left_join, small_batches, table

#: Header of each column; fixed names of the format (the payload's length is an extension field).
HEADERS = {
    "record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To", "profile": "WARC-Profile", "content_type": "Content-Type", "content_length": "Content-Length", "payload_length": "WARC-Payload-Length",
}
NUMBERS = ("content_length", "payload_length")
SCHEMA = ", ".join(f"{c} {'long' if c in NUMBERS else 'string'}" for c in HEADERS) + ", headers map<string,string>, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"
#: Bytes of files that a reading task takes, of a written file, and between its split points.
PARTITION, FILE, SPLIT = 64 << 20, 1 << 30, 16 << 20
#: Bytes inflated in search of the end of a record's headers, at a time.
HEAD = 2048
#: Payloads of at least so many bytes become revisits when repeated.
MIN_PAYLOAD = 0
DATE = "2000-01-01T00:00:00Z"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def member(block: bytes, level: int = 4) -> bytes:
    """A gzip member that says in its `sl` field how long it is, compressed and not."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(block) + z.flush()
    extra = b"sl" + struct.pack("<HII", 8, len(body) + 32, len(block) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    """A response or revisit record in full, of a row with the columns of HEADERS and payload."""
    payload = row.get("payload") or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.get('payload_length') or len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1"]
    for c, name in HEADERS.items():
        value = {"content_type": "application/http; msgtype=response", "content_length": len(http) + len(payload)}.get(c, row.get(c))
        if value is not None:
            head.append(f"{name}: {one_line(str(value))}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = opened(self.path)
        store.create_dir(base, recursive=True)
        files, out, at, mark = [], None, 0, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or at >= FILE:
                    if out:
                        out.close()
                        files[-1]["bytes"] = at
                    files.append({"name": f"part-{uuid.uuid4().hex}.warc.gz", "splits": []})
                    out, at, mark = store.open_output_stream(f"{base}/{files[-1]['name']}", compression=None), 0, 0
                if at - mark >= SPLIT:
                    files[-1]["splits"].append(at)
                    mark = at
                data = member(record(row))
                out.write(data)
                at += len(data)
        if out:
            out.close()
            files[-1]["bytes"] = at
        return Written(files)

    def commit(self, messages) -> None:
        store, base = opened(self.path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages) -> None:
        store, base = opened(self.path)
        for x in (x for m in messages if m for x in m.files):
            store.delete_file(f"{base}/{x['name']}")


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class BadRecord(ValueError):
    """A record that cannot be read to its end."""


class Members:
    """Reads the records of a range of a file: headers first, the rest on demand."""

    def __init__(self, file, name: str, start: int, end: int, zipped: bool):
        self.file, self.name, self.at, self.end, self.zipped = file, name, start, end, zipped

    def bad(self, what: str) -> BadRecord:
        return BadRecord(f"{self.name}: the record at byte {self.at} {what}")

    def heads(self) -> Iterator[list[tuple[str, str]]]:
        """Header fields of each record; until the next is asked for, payload() gives the record's."""
        while self.at < self.end:
            self.file.seek(self.at)
            skip = 0
            if self.zipped:
                fixed = self.file.read(12)
                if len(fixed) < 12 or fixed[:2] != b"\x1f\x8b":
                    raise self.bad("has no whole gzip header")
                if fixed[3] & 4:
                    extra = self.file.read(struct.unpack("<H", fixed[10:12])[0])
                    if extra[:2] == b"sl" and len(extra) >= 12:
                        skip = struct.unpack("<I", extra[4:8])[0]
                self.file.seek(self.at)
            self.inflate = zlib.decompressobj(31) if self.zipped else None
            self.taken, self.buffer = 0, b""
            while b"\r\n\r\n" not in self.buffer.lstrip(b"\r\n") and self.more(HEAD):
                pass
            blank = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
            if blank == len(self.buffer) and not self.zipped:
                return  # nothing but line ends behind the last record
            head, sep, self.buffer = self.buffer[blank:].partition(b"\r\n\r\n")
            if not sep:
                raise self.bad("ends in its headers")
            fields = [(n.strip(), v.strip()) for n, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])]
            length = next((v for n, v in fields if n.lower() == "content-length"), "")
            if not length.isdigit():
                raise self.bad("has no length")
            self.body = int(length)
            self.headed = blank + len(head) + 4
            yield fields
            if skip:
                self.at += skip
            elif not self.zipped:
                self.at += self.headed + self.body + 4
            else:
                while not self.inflate.eof and self.more(1 << 16):
                    self.buffer = b""
                if not self.inflate.eof:
                    raise self.bad("ends before its gzip member does")
                self.at += self.taken - len(self.inflate.unused_data)
            if self.at > self.end + (0 if self.zipped else 4):  # the last line ends may be left out
                raise self.bad(f"was to end there, behind byte {self.end}")

    def more(self, size: int) -> bool:
        data = self.file.read(size)
        self.taken += len(data)
        if self.inflate is not None:
            self.buffer += self.inflate.decompress(data) if not self.inflate.eof else b""
            return bool(data) and not self.inflate.eof
        self.buffer += data
        return bool(data)

    def payload(self, http: bool) -> bytes:
        while len(self.buffer) < self.body and self.more(max(HEAD, self.body - len(self.buffer))):
            pass
        if len(self.buffer) < self.body:
            raise self.bad("ends in its payload")
        block = self.buffer[: self.body]
        return block.partition(b"\r\n\r\n")[2] if http else block


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition: int, skip: bool = False):
        self.path, self.names, self.partition, self.skip = path, schema.fieldNames(), partition, skip
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        """Takes over what can be said of a single header column."""
        known = (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        for f in filters:
            if isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        store, base = opened(self.path)
        if store.get_file_info(f"{base}/{MANIFEST}").type == pafs.FileType.File:
            with store.open_input_stream(f"{base}/{MANIFEST}", compression=None) as f:
                files = json.loads(f.read())
            files = [(f"{base}/{x['name']}", [0, *x["splits"], x["bytes"]]) for x in files]
        else:
            info = [store.get_file_info(base)]
            if info[0].type == pafs.FileType.Directory:
                info = store.get_file_info(pafs.FileSelector(base, recursive=True))
            files = [(x.path, [0, x.size]) for x in info if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))]
        out, size = [], self.partition
        for name, marks in sorted(files):
            for a, b in zip(marks, marks[1:], strict=False):
                if size + b - a > self.partition:
                    out.append(Ranges([]))
                    size = 0
                out[-1].ranges.append((name, a, b))
                size += b - a
        return out or [Ranges([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        for f in self.filters:
            c = f.attribute[0]
            v = headers.get(HEADERS[c].lower())
            v = int(v) if v is not None and c in NUMBERS else v
            if isinstance(f, IsNotNull):
                ok = v is not None
            elif v is None:
                ok = False
            else:
                ok = {EqualTo: lambda: v == f.value, In: lambda: v in f.value, StringStartsWith: lambda: v.startswith(f.value), StringEndsWith: lambda: v.endswith(f.value), StringContains: lambda: f.value in v,  # noqa: B023
                      GreaterThan: lambda: v > f.value, GreaterThanOrEqual: lambda: v >= f.value, LessThan: lambda: v < f.value, LessThanOrEqual: lambda: v <= f.value}[type(f)]()  # noqa: B023
            if not ok:
                return False
        return True

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        kinds = {**{c: pa.int64() if c in NUMBERS else pa.string() for c in HEADERS}, "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        schema = pa.schema([(n, kinds[n]) for n in self.names])
        rows, size = [], 0
        for name, start, end in partition.ranges:
            with store.open_input_file(name) as file:
                records = Members(file, name, start, end, name.endswith(".gz"))
                try:
                    for fields in records.heads():
                        headers = {n.lower(): v for n, v in fields}
                        if not self.wanted(headers):
                            continue
                        row = {c: headers.get(HEADERS[c].lower()) for c in self.names if c in HEADERS}
                        row |= {c: int(row[c]) for c in NUMBERS if row.get(c) is not None}
                        if "headers" in self.names:
                            row["headers"] = list(dict(fields).items())
                        if "payload" in self.names:
                            row["payload"] = records.payload(headers.get("content-type", "").lower().startswith("application/http"))
                            size += len(row["payload"])
                        rows.append(row)
                        if len(rows) >= 4096 or size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                except BadRecord:
                    if not self.skip:
                        raise
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """format("warc"): option path; for reading partitionBytes, and badRecords (fail or skip)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partitionbytes", PARTITION)), self.options.get("badrecords", "fail") == "skip")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def use_warc(spark: SparkSession) -> None:
    """Registers the source; pushdown to Python sources is off in Spark unless asked for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records under path; only the columns named are parsed."""
    use_warc(spark)
    kinds = dict(x.rsplit(" ", 1) for x in SCHEMA.split(", "))
    return spark.read.format("warc").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).option("path", path).load()


def base32(hexed: Column) -> Column:
    """Base32 of a digest given in hexadecimal, five digits to four letters."""
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_pages(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD) -> None:
    """A record of every row of pages(page_id, url, html); see the module on who is a revisit."""
    use_warc(pages.sparkSession)
    small_batches(pages.sparkSession)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", base32(F.sha1("payload"))).withColumn("n", F.octet_length("payload").cast("long"))
    large = rows if min_payload <= 0 else rows.where(F.col("n") >= min_payload)
    keepers = large.groupBy("digest").agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND keep_id IS NOT NULL").select("digest", "keep_id")
    joined = salted_left_join(rows, keepers, "digest", F.col("page_id"))
    again = F.col("keep_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep_id")) & (F.col("n") >= min_payload)
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    joined.select(
        urn("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("warc_type"), F.col("url").alias("target_uri"), F.lit(DATE).alias("date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"), F.when(again, urn("keep_id")).alias("refers_to"), F.when(again, F.lit(PROFILE)).alias("profile"),
        F.col("n").alias("payload_length"), F.when(~again, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").option("path", path).save()


def pages_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri of each record.

    A response's length and digest are of the payload as read, a revisit's are its headers'.
    """
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1)
    page = lambda c: F.when(number(c) != "", number(c).cast("long"))
    columns = ["record_id", "warc_type", "target_uri", "payload_digest", "refers_to", "payload_length"]
    shape = lambda df, n, digest: df.select(page("record_id").alias("page_id"), n.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"), "target_uri")
    full = read_warc(spark, path, [*columns, "payload"]).where("warc_type = 'response'")
    again = read_warc(spark, path, columns).where("warc_type = 'revisit'")
    return shape(full, F.octet_length("payload"), base32(F.sha1("payload"))).unionByName(shape(again, F.col("payload_length"), F.substring("payload_digest", 6, 32)))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    return pages_back(spark, path)


OP1_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, url, html, h, ('0x' || h[1:10])::BIGINT AS a0, ('0x' || h[11:20])::BIGINT AS a1, ('0x' || h[21:30])::BIGINT AS a2, ('0x' || h[31:40])::BIGINT AS a3 FROM p),
d AS (SELECT *, list_aggregate(list_transform(range(32), lambda i:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(([a0, a1, a2, a3][i // 8 + 1] >> (35 - 5 * (i % 8))) & 31) + 1]), 'string_agg', '') AS digest,
        max(page_id) OVER (PARTITION BY h) AS keep FROM b)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to, url AS target_uri
FROM d
"""
