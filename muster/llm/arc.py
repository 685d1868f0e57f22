"""Legacy ARC archives: written, parsed by version, converted to WARC, and read back.

An ARC file begins with a ``filedesc:`` block whose body names the version; version 1 header lines have 5 fields, version 2
lines have 10, the last is the declared length of what follows. The converter parses by those lengths alone and
synthesises what ARC lacks: record ids (from the record's key), ISO timestamps, types, block and payload digests.
Records with equal payloads become one ``response`` and ``revisit`` records that name it.

A WARC file here is the concatenation of its records, written compressed by Spark's text writer into the shared folder; it
holds at most ``RECORDS_PER_FILE`` records. Payloads are opaque bytes. A null payload is an empty one, a null or empty url
has no target URI; spaces and control characters of a url are percent-encoded, as an ARC header line needs. A record
without a key never becomes the one others refer to; if no record of a payload has a key, each is a response. Repeated keys
are separate records, and equal payloads under the smallest key are all responses. No rows make no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.session import workspace

#: Bytes of content in an ARC segment, unless one record is longer.
SEGMENT_BYTES = 4 << 20
RECORDS_PER_FILE = 1000
DATE = "20000101000000"

_FIELDS = {
    "1": ["url", "ip", "date", "type", "length"],
    "2": ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"],
}


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def _line(version: str, url: str, date: str, kind: str, length: int) -> bytes:
    middle = [] if version == "1" else ["200", "-", "-", "0", "pages.arc"]
    return " ".join([url, "0.0.0.0", date, kind, *middle, str(length)]).encode() + b"\n"


def arc_file(version: str, records: list[tuple[str | None, bytes]], date: str = DATE) -> bytes:
    """An ARC file of (url, content) records."""
    about = f"{version} 0 muster\n{' '.join(_FIELDS[version])}\n".encode()
    parts = [_line(version, "filedesc://pages.arc", date, "text/plain", len(about)), about, b"\n"]
    for url, content in records:
        parts += [_line(version, _clean(url), date, "text/html", len(content)), content, b"\n"]
    return b"".join(parts)


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record but the file's own description."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 47)
    at, fields = 0, None
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line:  # the line end after a record
            at = end + 1
            continue
        length = int(line.rpartition(" ")[2])
        content = data[end + 1:end + 1 + length]
        if len(content) < length:
            raise ValueError(f"a record declares {length} bytes and has {len(content)}")
        if fields is None:
            version = content[:1].decode()
            if not line.startswith("filedesc:") or version not in _FIELDS:
                raise ValueError("not an ARC file of version 1 or 2")
            fields = _FIELDS[version]
        else:
            values = line.split(" ")
            if len(values) != len(fields):
                raise ValueError(f"a header line has {len(values)} fields; this version has {len(fields)}")
            yield dict(zip(fields, values, strict=True)), content
        at = end + 1 + length


def http_block(key: str | None, payload: bytes) -> bytes:
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    return b"\r\n".join([*head, *([b"X-Record-Key: " + key.encode()] if key is not None else []), b"", payload])


def split_http(block: bytes) -> tuple[dict[str, str], int]:
    """Header fields, lower-cased, and where the payload begins."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return {}, 0
    pairs = (x.partition(":") for x in block[:end].decode("latin-1").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, end + 4


def to_arc(pages: DataFrame, key: str, url: str, payload: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Pages as ARC segments (``content``), in turn of version 1 and 2. ``payload`` is a string or binary column."""
    rows = pages.select(F.col(key).cast("string"), F.col(url).cast("string"), F.col(payload).cast("binary"))

    def segments(batches):
        held, size, made = [], 0, 0
        for batch in batches:
            for k, u, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((u, http_block(k, p or b"")))
                size += len(held[-1][1])
                if size >= segment_bytes:
                    yield pa.record_batch([pa.array([arc_file("12"[made % 2], held)], pa.binary())], ["content"])
                    held, size, made = [], 0, made + 1
        if held:
            yield pa.record_batch([pa.array([arc_file("12"[made % 2], held)], pa.binary())], ["content"])

    return rows.mapInArrow(segments, "content binary")


_RECORD = (
    "key string, uri string, date string, record_id string, http boolean, payload_digest string, block_digest string, "
    "payload_bytes bigint, payload_at int, block binary"
)
_KINDS = [pa.string()] * 4 + [pa.bool_()] + [pa.string()] * 2 + [pa.int64(), pa.int32(), pa.binary()]
_NAMES = re.findall(r"(\w+) \w+", _RECORD)


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(key.encode()).hexdigest())}>"


def convert(arcs: DataFrame, content: str = "content") -> DataFrame:
    """What a WARC record needs, for each record of ARC files in a binary column."""
    def synthesised(batches):
        for batch in batches:
            for data in batch.column(0):
                out: list[tuple] = []
                for n, (line, block) in enumerate(arc_records(data.as_py() or b"") if data.is_valid else []):
                    headers, at = split_http(block)
                    d = line["date"].ljust(14, "0")
                    own = headers.get("x-record-key")
                    identity = own if own is not None else f"{line['url']} {line['date']} {n} {base32_sha1(block)}"
                    out.append((
                        own, None if line["url"] == "-" else line["url"],
                        f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", record_id(identity), at > 0,
                        base32_sha1(block[at:]), base32_sha1(block), len(block) - at, at, block,
                    ))
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], _NAMES)

    return arcs.select(content).mapInArrow(synthesised, _RECORD)


def _uuid(key: Column) -> Column:
    h = F.md5(key.cast("string").cast("binary"))
    return F.format_string("<urn:uuid:%s-%s-%s-%s-%s>", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def as_warc(records: DataFrame, key_type: str = "bigint", min_bytes: int = 0) -> DataFrame:
    """Each converted record as the text of a WARC record, less its last line feed.

    Of records with equal payloads of at least ``min_bytes``, that with the smallest key is the response.
    """
    key = F.col("key").cast(key_type)
    counted = records.select("payload_digest", "payload_bytes", key.alias("k")).filter(F.col("payload_bytes") >= min_bytes)
    smallest = counted.groupBy("payload_digest", "payload_bytes").agg(F.min("k").alias("refers_to"))
    same = records.join(smallest, ["payload_digest", "payload_bytes"], "left")
    again = ~key.eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull()
    kind = F.when(again, "revisit").when(F.col("http"), "response").otherwise("resource")
    block = F.when(again, F.substring("block", 1, F.col("payload_at"))).otherwise(F.col("block"))
    media = F.when(F.col("http"), "application/http; msgtype=response").otherwise("application/octet-stream")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    optional = F.coalesce(line("WARC-Target-URI", F.col("uri")), F.lit(""))
    referring = F.when(again, F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
        line("WARC-Refers-To", _uuid(F.col("refers_to"))), line("X-Refers-To-Key", F.col("refers_to").cast("string")),
    )).otherwise(line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.col("block_digest"))))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")), optional, line("Content-Type", media),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")), referring,
        F.coalesce(line("X-Record-Key", F.col("key")), F.lit("")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return same.select(F.concat(head.cast("binary"), block, F.lit("\r\n\r").cast("binary")).cast("string").alias("value"))


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archives of WARC records under ``path``, compressed."""
    writer = records.write.option("compression", "gzip").option("lineSep", "\n")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def warc_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, lower-cased, and block of each record; holds one record and one chunk at a time."""
    held, more = bytearray(), True

    def fill(n: int) -> bool:
        nonlocal more
        while len(held) < n and more:
            part = next(chunks, None)
            more = part is not None
            held.extend(part or b"")
        return len(held) >= n

    while fill(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("a record's header does not end")
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        if not fill(end + 4 + length + 4):
            raise ValueError("a record is shorter than it declares")
        yield headers, bytes(held[end + 4:end + 4 + length])
        del held[:end + 8 + length]


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        reader = zlib.decompressobj(47)
        yield reader.decompress(data, step)
        while not reader.eof:
            part = reader.decompress(reader.unconsumed_tail, step)
            if not part and not reader.eof:
                raise ValueError("an archive is cut short")
            yield part
        data = reader.unused_data


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``; the digests of every response are checked against its bytes."""
    schema = "key string, record_type string, uri string, payload_bytes bigint, payload_digest string, refers_to string, payload binary"
    kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()]
    names = re.findall(r"(\w+) \w+", schema)

    def parsed(batches):
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for headers, block in warc_records(_inflated(content.as_py())):
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                    payload = None
                    if kind != "revisit":
                        payload = block[split_http(block)[1]:]
                        if base32_sha1(payload) != digest or f"sha1:{base32_sha1(block)}" != headers["warc-block-digest"]:
                            raise ValueError(f"digest of {headers['warc-record-id']} does not fit")
                    length = int(headers["x-payload-length"]) if payload is None else len(payload)
                    out.append((headers.get("x-record-key"), kind, headers.get("warc-target-uri"), length, digest,
                                headers.get("x-refers-to-key"), payload))
                    size += len(block)
                    if size >= SEGMENT_BYTES:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, size = [], 0
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parsed, schema)


def archived(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", key_type: str = "bigint") -> DataFrame:
    """Pages by way of ARC segments and WARC archives: the records read back, without payloads."""
    records = convert(to_arc(pages, key, url, payload))
    path = workspace(pages.sparkSession, "warc")
    write_warc(as_warc(records, key_type), path)
    found = read_warc(pages.sparkSession, path)
    return found.select(
        F.col("key").cast(key_type).alias(key), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(key_type).alias("refers_to"), "uri",
    )
