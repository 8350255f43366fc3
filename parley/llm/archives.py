"""Legacy archive converter: ARC records to WARC records.

An ARC file starts with a version block, whose second line names the version and whose third line names the fields of
the header lines that follow.  Version 1 lines are ``URL IP-address Archive-date Content-type Archive-length``; version
2 lines add ``Result-code Checksum Location Offset Filename`` before the length.  Each header line declares how many
bytes follow; nothing inside them is looked at for record ends.  A URL may hold spaces, so fields are taken from the
right.  From each record the converter makes an identifier (a name-based UUID of URL, date, digest and the record's place
in its archive), an ISO timestamp (14 digits, or 12 in old files), the record type, and block and payload digests.
Payloads are bytes all the way, in whatever character set.

Of records with equal payloads the one with the smallest key is the response; the others are revisits that refer to it and
carry no payload.  Where rows repeat, each of the smallest key is a response, and revisits refer to one of them.  Null payloads are empty; a null or malformed date becomes
the epoch; a null URL becomes the empty one, which ``-`` stands for in a header line; rows that repeat keep a record each,
since their places in the archive differ.  Null keys are the largest.

Each record is a gzip member of its own, so a reader can start at any of them.  Files are written and read by Spark only,
in the folder that executors share, at about FILE_BYTES of payload a file.  Payloads are shuffled once, by record, so a
group of copies never meets in one task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import bounded_batches, materialize, work_path

CRLF = "\r\n"
#: Payload bytes that one archive file holds about.
FILE_BYTES = 32 << 20
KEY_HEADER = "X-Page-Id"
#: Header fields of the two versions, as the format defines them.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    place: int = 0  # the byte where the record starts


def digest(data: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def clean_url(url: str | None) -> str:
    """A URL without line breaks; ``-`` for none."""
    return re.sub(r"[\r\n]", "", url or "").strip() or "-"


def arc_version_block(version: int, name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    body = f"{version} 0 parley\n{' '.join(FIELDS[version])}\n"
    n = len(body)
    tail = {1: f"text/plain {n}", 2: f"text/plain 200 - - 0 {name} {n}"}[version]
    return f"filedesc://{name} 0.0.0.0 {date} {tail}\n{body}".encode()


def http_block(key: int | None, payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html{CRLF}{KEY_HEADER}: {'' if key is None else key}{CRLF}{CRLF}".encode() + payload


def arc_record(version: int, url: str | None, date: str, block: bytes, offset: int = 0, name: str = "pages.arc") -> bytes:
    n = len(block)
    tail = {1: f"text/html {n}", 2: f"text/html 200 {digest(block)} - {offset} {name} {n}"}[version]
    return f"{clean_url(url)} 0.0.0.0 {date} {tail}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of one ARC file of either version, without its version block."""
    at, names = 0, FIELDS[1]
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # records are parted by a line end
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line at byte {at} has no end")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        start = not at and line.startswith("filedesc://")  # elsewhere it is a page's address
        parts = line.rsplit(" ", len(names) - 1)
        if start:  # the block names its own fields, so its length is the last field of either version
            parts = line.split(" ")
        if not parts[-1].isdigit() or (not start and len(parts) != len(names)):
            raise ValueError(f"ARC header line at byte {at} doesn't have the fields {names}")
        n = int(parts[-1])
        block, place = data[end + 1 : end + 1 + n], at
        if len(block) < n:
            raise ValueError(f"ARC record at byte {at} declares {n} bytes; the file has {len(block)}")
        at = end + 1 + n
        if start:
            lines = block.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0])
            names = tuple(lines[1].split(" ")) if len(lines) > 1 and lines[1] else FIELDS[version]
        else:
            got = dict(zip(names, parts, strict=True))
            yield ArcRecord(got["URL"], got.get("IP-address", "-"), got.get("Archive-date", ""), got.get("Content-type", ""), block, place)


def warc_date(date: str | None) -> str:
    """14 digits, or the 12 of old files, as an ISO time."""
    d = (date or "").ljust(14, "0") if re.fullmatch(r"\d{12}|\d{14}", date or "") else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, payload_digest: str, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {payload_digest} {place}')}>"


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, head with its empty line, payload) of an HTTP response."""
    at = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or at < 0:
        return {}, b"", block
    head = block[: at + 4]
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split(CRLF)[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}, head, block[at + 4 :]


def warc_record(kind: str, url: str, date: str, ident: str, payload_digest: str, head: bytes, payload: bytes, refers: str | None = None, size: int | None = None) -> bytes:
    """One record with its trailing line ends.  A revisit keeps the HTTP head only, and ``size`` is that of its payload."""
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Payload-Length: {len(payload) if size is None else size}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return (CRLF.join(lines) + CRLF + CRLF).encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one WARC file, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        headers = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        n = int(headers["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n:
            raise ValueError(f"WARC record at byte {at} declares {n} bytes; the file has {len(block)}")
        yield headers, block
        at = end + 4 + n


def _files(df: DataFrame, size) -> int:
    return max(1, -(-int(df.agg(F.sum(size)).first()[0] or 0) // FILE_BYTES))


def _sized(df: DataFrame, size) -> DataFrame:
    """Partitions of about FILE_BYTES; as they are where the largest of them holds no more than four times that."""
    most = df.groupBy(F.spark_partition_id()).agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0]
    return df if (most or 0) <= 4 * FILE_BYTES else df.repartition(_files(df, size))


#: An empty gzip member.  Spark's text files need a separator between values; this one is valid in a file of members.
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
#: DEFLATE level of the members.
LEVEL = 6
#: Bytes that are fed to a decompressor at once.
SLICE = 8 << 10


def member(data: bytes) -> bytes:
    return gzip.compress(data, LEVEL, mtime=0)


def write_members(members: DataFrame, path: str) -> None:
    """A binary column of gzip members -> files of members.  Spark writes a string's bytes as they are."""
    text = members.select(F.col("value").cast("string"))
    text.write.options(lineSep=_EMPTY_MEMBER.decode("latin-1"), encoding="ISO-8859-1", compression="none").text(path)


def unpacked(data: bytes) -> bytes:
    """The bytes of a file of gzip members, or of one that isn't compressed.

    Members are fed in short slices: what a decompressor leaves over is copied, so feeding it the whole rest of the file
    would cost its square.
    """
    if not data.startswith(b"\x1f\x8b"):
        return data
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        one = zlib.decompressobj(zlib.MAX_WBITS | 16)
        while not one.eof and at < len(data):
            part = view[at : at + SLICE]
            out.append(one.decompress(part))
            at += len(part)
        if not one.eof:
            raise ValueError(f"the gzip member before byte {at} is cut short")
        at -= len(one.unused_data)
    return b"".join(out)


def _packed(members: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Members, at most about 4 MB in a batch."""
    held, n = [], 0
    for r in members:
        held.append(r)
        n += len(held[-1])
        if n > 4 << 20:
            yield pa.record_batch([pa.array(held, pa.binary())], ["value"])
            held, n = [], 0
    if held:
        yield pa.record_batch([pa.array(held, pa.binary())], ["value"])


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20240101000000") -> None:
    """Pages (page_id, url, html as text or bytes) as ARC files, each with its version block."""
    bounded_batches(pages.sparkSession)

    def run(batches):
        def records():
            yield arc_version_block(version)
            for b in batches:
                for key, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                    yield arc_record(version, url, date, http_block(key, html or b""))

        yield from _packed(map(member, records()))

    rows = _sized(pages.select("page_id", "url", F.col("html").cast("binary").alias("html")), F.octet_length("html"))
    write_members(rows.mapInArrow(run, "value binary"), path)


CONVERTED = "page_id bigint, url string, date string, record_id string, payload_digest string, payload_bytes bigint, head binary, payload binary"


def convert_arc(spark, path: str) -> DataFrame:
    """What a WARC record needs of each ARC record: its identity, time, digests, HTTP head and payload."""

    def run(batches):
        names = [c.split(" ")[0] for c in CONVERTED.split(", ")]
        for b in batches:
            for source, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                file = source.rsplit("/", 1)[-1]

                def rows(data=data, file=file):
                    for r in parse_arc(unpacked(data.as_py())):
                        headers, head, payload = split_http(r.block)
                        key, d, when = headers.get(KEY_HEADER.lower(), ""), digest(payload), warc_date(r.date)
                        yield int(key) if key else None, r.url, when, record_id(r.url, when, d, f"{file}:{r.place}"), d, len(payload), head, payload

                for some in batched(rows(), 256):
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*some, strict=True), _CONVERTED, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CONVERTED)


_CONVERTED = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]


def write_warc(records: DataFrame, path: str, min_payload: int = 0) -> None:
    """Converted records as WARC files; equal payloads of at least ``min_payload`` bytes become revisits of one response.

    ``record_id`` names a record, so every join here is one to one or many to one, whatever rows repeat.
    """
    index = materialize(records.select("page_id", "record_id", "payload_digest", "payload_bytes"), "arc-index")
    # Per digest the smallest key, of all records: one row a digest, summed before it is shuffled.
    key = F.coalesce("page_id", F.lit((1 << 63) - 1))
    first = index.filter(F.col("payload_bytes") >= min_payload).groupBy("payload_digest").agg(F.min(F.struct(key.alias("k"), "record_id")).alias("first"))
    later = index.join(first, "payload_digest").filter(key > F.col("first.k")).select("record_id", F.col("first.record_id").alias("refers"))
    n = _files(index, "payload_bytes")
    names = ("url", "date", "record_id", "payload_digest", "payload_bytes", "head")

    def responses(batches):
        """Each record as the member of a response: what is shuffled is compressed, and compressed once."""
        for b in batches:
            made = [member(warc_record("response", *x)) for x in zip(*(b.column(c).to_pylist() for c in ("url", "date", "record_id", "payload_digest", "head", "payload")), strict=True)]
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(made, pa.binary())], [*names, "value"])

    kept = records.mapInArrow(responses, "url string, date string, record_id string, payload_digest string, payload_bytes bigint, head binary, value binary")
    rows = kept.repartition(n, "record_id").join(later.repartition(n, "record_id"), "record_id", "left")

    def run(batches):
        def final(r):
            if r["refers"] is None:
                return r["value"]
            return member(warc_record("revisit", r["url"], r["date"], r["record_id"], r["payload_digest"], r["head"], b"", r["refers"], r["payload_bytes"]))

        yield from _packed(final(r) for b in batches for r in b.to_pylist())

    write_members(rows.select(*names, "value", "refers").mapInArrow(run, "value binary"), path)


READ = "page_id bigint, record_id string, record_type string, target_uri string, payload_bytes bigint, payload_digest string, refers_id string, payload binary"


def read_warc(spark, path: str, payloads: bool = False) -> DataFrame:
    """Every record of the WARC files under a path; a response's digest and length are those of the bytes read."""

    def run(batches):
        for b in batches:
            for data in b.column("content"):

                def rows(data=data):
                    for h, block in parse_warc(unpacked(data.as_py())):
                        headers, _, payload = split_http(block)
                        key, declared = headers.get(KEY_HEADER.lower(), ""), h["warc-payload-digest"].removeprefix("sha1:")
                        whole = h["warc-type"] == "response"
                        d, n = (digest(payload), len(payload)) if whole else (declared, int(h["x-payload-length"]))
                        if d != declared or digest(block) != h["warc-block-digest"].removeprefix("sha1:"):
                            raise ValueError(f"{h['warc-record-id']}: a digest doesn't fit its bytes")
                        yield int(key) if key else None, h["warc-record-id"], h["warc-type"], h["warc-target-uri"], n, d, h.get("warc-refers-to"), payload if payloads and whole else None

                for some in batched(rows(), 256):
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*some, strict=True), _READ, strict=True)], [c.split(" ")[0] for c in READ.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


_READ = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """All pages as legacy ARC files, converted to WARC files, and what those hold for each page."""
    bounded_batches(spark)
    arc, warc = work_path(spark, "arc"), work_path(spark, "warc")
    write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), arc)
    write_warc(convert_arc(spark, arc), warc)
    found = materialize(read_warc(spark, warc).drop("payload", "target_uri"), "warc-index")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses = found.filter("record_type = 'response'")
    named = responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    revisits = found.filter("record_type = 'revisit'").join(named, "refers_id", "left")
    return responses.select(*columns, F.lit(None).cast("bigint").alias("refers_to")).unionByName(revisits.select(*columns, "refers_to"))


#: DuckDB SQL for op9_warc: base32 from the hexadecimal digest, five digits (20 bits) to four letters.
OP9_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, octet_length(b) as payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4)::int)) & 31)::int, 1)), 'string_agg', '') as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to from f
"""
