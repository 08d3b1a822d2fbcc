r"""Converter of legacy ARC archives to WARC.

ARC files are read whole, a file to a row, and parsed by the lengths that their header lines declare:
version 1 lines have five fields, version 2 lines ten, and the file's first record says which. Each
record gets what its WARC twin needs: a name-based UUID of where and what it was, its 14-digit time as
an ISO time, its type, and SHA-256 digests of block and payload. Equal payloads of at least
``min_bytes`` become revisits of the one with the smallest key. Spark's text writer puts records into
archives, as its rows may hold any bytes and any line end, so archives go to and come from any store
that Spark has.

Only a file's first record can describe it; elsewhere such a URL is a record like others.

Defined cases: a null payload is empty; a null URL is ``-``; blanks and controls in a URL are
percent-encoded. Rows that repeat are records of their own; of records with equal key and payload the
one with the smallest record id is the response. An empty table gives archives without records. A
header line or a length that doesn't fit raises, as what follows it can't be found.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, text_batches

#: Bytes of records in a file, about.
FILE_BYTES = 64 << 20
#: Hadoop's name for a low compression level, which takes a third of the time.
FAST = {"zlib.compress.level": "BEST_SPEED"}
#: The field names of both ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_SCHEMA = "archive string, offset long, arc_version int, url string, ip string, arc_date string, mime string, status string, block binary"
RECORD_SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, ip string, mime string, key long, payload_bytes long, payload_digest string, block_digest string, block binary"
WARC_SCHEMA = "archive string, record_id string, warc_type string, target_uri string, warc_date string, mime string, key long, payload_bytes long, payload_digest string, refers_to_id string, refers_to_key long, block binary"


def http_payload(block: bytes) -> bytes:
    """What follows the headers of an HTTP response, or the whole block if it has none."""
    if not block.startswith(b"HTTP/"):
        return block
    head, found, body = block.partition(b"\r\n\r\n")
    return body if found else b""


def _http_header(block: bytes, name: str) -> str | None:
    head = block.partition(b"\r\n\r\n")[0].decode("latin-1")
    m = re.search(rf"^{re.escape(name)}:[ \t]*(.*?)[ \t]*$", head, re.IGNORECASE | re.MULTILINE)
    return m[1].strip() or None if m and block.startswith(b"HTTP/") else None


def clean_url(url: Column) -> Column:
    """A URL as one field of a header line."""
    coded = url
    for c in [*range(0x21), 0x7F]:
        if c:
            coded = F.replace(coded, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    coded = F.when(url.rlike(r"[\x01-\x20\x7F]"), coded).otherwise(url)
    return F.when(coded != "", coded).otherwise(F.lit("-"))


def _per_file(df: DataFrame, size: Column) -> int:
    """Records in a file of about FILE_BYTES."""
    mean = df.agg(F.avg(size)).first()[0] or 1
    return max(2, int(FILE_BYTES / (mean + 512)))


def _write_blocks(rows: DataFrame, path: str, line_sep: str, per_file: int) -> None:
    """Rows of one binary column as gzip files in which they follow each other."""
    column = rows.columns[0]
    rows.select(F.col(column).cast("string").alias("value")).write.option("lineSep", line_sep).options(compression="gzip", maxRecordsPerFile=per_file, **FAST).text(path)


def write_arc(responses: DataFrame, path: str, version: int = 1) -> int:
    """Archives of a table (url, ip, arc_date, mime, status, block): what legacy crawls left behind.

    Returns how many records a file holds at most.
    """
    per_file = _per_file(responses, F.octet_length("block"))
    columns = ["url", "ip", "arc_date", "mime", "status", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, about = 0, f"{version} 0 labelgrow\n{ARC_FIELDS[version]}\n".encode()
        rest = " 200 - - 0 archive.arc" if version == 2 else ""
        first = f"filedesc://archive.arc 0.0.0.0 19960923142103 text/plain{rest} {len(about)}\n".encode() + about
        for batch in batches:
            out = []
            for url, ip, date, mime, status, block in zip(*(batch.column(i).to_pylist() for i in range(len(columns))), strict=True):
                if n % per_file == 0:
                    out.append(first)
                    n += 1
                rest = f" {status or '-'} - - 0 archive.arc" if version == 2 else ""
                out.append(f"{url} {ip} {date} {mime}{rest} {len(block)}\n".encode() + block)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _write_blocks(text_batches(responses).select(*columns).mapInArrow(run, "record binary"), path, "\n", per_file)
    return per_file


def parse_arc(data: bytes) -> Iterator[tuple[int, int, str, str, str, str, str | None, bytes]]:
    """(offset, version, url, ip, date, type, status, block) of each record of an ARC file."""
    at, version = 0, 1
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        if at == 0 and line.startswith("filedesc://"):
            length = int(line.rsplit(" ", 1)[-1])
            m = re.match(rb"([12]) ", data[end + 1 : end + 1 + length])
            if end < 0 or not m:
                raise ValueError(f"no ARC version at byte {at}")
            version = int(m[1])
        fields = line.rsplit(" ", 4 if version == 1 else 9)
        if end < 0 or len(fields) != (5 if version == 1 else 10) or not fields[-1].isdigit() or end + 1 + int(fields[-1]) > len(data):
            raise ValueError(f"ARC header line at byte {at} doesn't fit: {line[:200]!r}")
        length = int(fields[-1])
        yield at, version, fields[0], fields[1], fields[2], fields[3], fields[4] if version == 2 else None, data[end + 1 : end + 1 + length]
        at = end + 1 + length


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _unpacked(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _batches(rows: Iterator[tuple], schema: pa.Schema, n: int = 500) -> Iterator[pa.RecordBatch]:
    while chunk := list(islice(rows, n)):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*chunk, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the ARC files in a folder, the file descriptions among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(((name, *x) for x in parse_arc(_unpacked(content.as_py()))), _arrow(ARC_SCHEMA))

    return _files(spark, path).mapInArrow(run, ARC_SCHEMA)


def iso_time(date: str) -> str:
    """A 14-digit time (12 digits: without seconds) as WARC writes it."""
    d = re.sub(r"\D", "", date).ljust(14, "0")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def convert(arc: DataFrame, key_header: str = "X-Page-Id", with_block: bool = True) -> DataFrame:
    """WARC fields of ARC records; ``key`` is the number in the HTTP header ``key_header``, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for x in batch.to_pylist():
                    block, about = x["block"], x["offset"] == 0 and x["url"].startswith("filedesc://")
                    payload = http_payload(block)
                    http = block.startswith(b"HTTP/")
                    key = _http_header(block, key_header)
                    made = uuid.uuid5(uuid.NAMESPACE_URL, f"{x['archive'].rsplit('/', 1)[-1]} {x['offset']} {x['url']} {x['arc_date']}")
                    yield (
                        f"<urn:uuid:{made}>",
                        "warcinfo" if about else "response" if http else "resource",
                        x["url"],
                        iso_time(x["arc_date"]),
                        x["ip"],
                        "application/http; msgtype=response" if http else x["mime"],
                        int(key) if key else None,
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        hashlib.sha256(block).hexdigest() if with_block else None,
                        block if with_block else None,
                    )

        yield from _batches(rows(), _arrow(RECORD_SCHEMA))

    return arc.mapInArrow(run, RECORD_SCHEMA)


def mark_revisits(records: DataFrame, plain: DataFrame | None = None, min_bytes: int = 100) -> DataFrame:
    """Adds ``refers_to_id`` and ``refers_to_key``: the response that a record repeats, else null.

    ``plain`` is the same table without blocks, where that is cheaper to make. Each digest's response
    comes from partial aggregates; only digests of several records are joined back, so Spark's size
    limit decides whether they are broadcast or joined with skewed digests split.
    """
    plain = records.drop("block") if plain is None else plain
    order = F.struct(F.col("key").isNull().alias("without"), "key", "record_id")
    same = plain.filter((F.col("warc_type") == "response") & (F.col("payload_bytes") >= min_bytes))
    first = same.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = stored(first.select("payload_digest", F.col("first.record_id").alias("refers_to_id"), F.col("first.key").alias("refers_to_key")), "responses")
    joined = records.join(first, "payload_digest", "left")
    again = (F.col("warc_type") == "response") & (F.col("payload_bytes") >= min_bytes) & (F.col("record_id") != F.col("refers_to_id"))
    return joined.select(
        *[F.when(again, F.lit("revisit")).otherwise(F.col(c)).alias(c) if c == "warc_type" else F.col(c) for c in records.columns],
        F.when(again, F.col("refers_to_id")).alias("refers_to_id"),
        F.when(again, F.col("refers_to_key")).alias("refers_to_key"),
    )


def write_warc(records: DataFrame, path: str, per_file: int | None = None) -> None:
    """WARC 1.1 archives of marked records; a revisit keeps its HTTP headers only.

    ``per_file`` is the most records in a file; where it isn't known, records are made once more for their mean size.
    """
    per_file = per_file or _per_file(records, F.octet_length("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                block = x["block"]
                digest = x["block_digest"]
                if x["warc_type"] == "revisit":
                    block = block[: len(block) - x["payload_bytes"]]
                    digest = hashlib.sha256(block).hexdigest()
                head = {
                    "WARC-Type": x["warc_type"],
                    "WARC-Record-ID": x["record_id"],
                    "WARC-Date": x["warc_date"],
                    "WARC-Target-URI": x["target_uri"],
                    "WARC-IP-Address": x["ip"],
                    "WARC-Payload-Digest": f"sha256:{x['payload_digest']}",
                    "WARC-Block-Digest": f"sha256:{digest}",
                    "WARC-Refers-To": x["refers_to_id"],
                    "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if x["refers_to_id"] else None,
                    "X-Payload-Length": x["payload_bytes"],
                    "X-Key": x["key"],
                    "X-Refers-To-Key": x["refers_to_key"],
                    "Content-Type": x["mime"],
                    "Content-Length": len(block),
                }
                out.append("".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items() if v is not None), "\r\n"]).encode() + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _write_blocks(text_batches(records).mapInArrow(run, "record binary"), path, "\r\n\r\n", per_file)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, names in lower case, and block of each record of a WARC file."""
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(at, end)].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = head.get("content-length", "")
        if end < 0 or not lines[0].startswith("WARC/") or not length.isdigit() or end + 4 + int(length) > len(data):
            raise ValueError(f"WARC record at byte {at} doesn't fit")
        at = end + 4 + int(length)
        yield head, data[end + 4 : at]


def read_warc(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """All records of the WARC files in a folder; a payload that doesn't have its digest raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for head, block in parse_warc(_unpacked(content.as_py())):
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        size = int(head["x-payload-length"])
                        if head["warc-type"] != "revisit":
                            payload = http_payload(block)
                            size = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{head['warc-record-id']} in {name} has another payload than its digest says")
                        number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                        yield (
                            name,
                            head["warc-record-id"],
                            head["warc-type"],
                            head.get("warc-target-uri"),
                            head["warc-date"],
                            head.get("content-type"),
                            number("x-key"),
                            size,
                            digest,
                            head.get("warc-refers-to"),
                            number("x-refers-to-key"),
                            block if with_block else None,
                        )

        yield from _batches(rows(), _arrow(WARC_SCHEMA))

    return _files(spark, path).mapInArrow(run, WARC_SCHEMA)


def page_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", arc_date: str = "20240101000000") -> DataFrame:
    """Pages as archived HTTP responses (see ``write_arc``) that carry their id in a header."""
    html = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return pages.select(
        clean_url(F.col(url_col)).alias("url"),
        F.lit("0.0.0.0").alias("ip"),
        F.lit(arc_date).alias("arc_date"),
        F.lit("text/html").alias("mime"),
        F.lit("200").alias("status"),
        F.concat(head.cast("binary"), html).alias("block"),
    )
