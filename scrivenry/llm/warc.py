"""WARC archives compressed with Zstandard: a dictionary in the leading skippable frame, then one frame per record.

Archives are written by Spark's own text writer, so that its commit protocol and any Hadoop file system serve: a row is
one frame, and the "line separator" is an empty skippable frame, which every reader of the format passes over.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import text_column

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, error string"


def train_dictionary(pages: DataFrame, sample_pages: int = 400, size: int = 32_768) -> bytes:
    """A compression dictionary from the first ``sample_pages`` pages that Spark finds; only the archives' size depends on it."""
    rows = pages.select(F.substring(text_column(pages, "html"), 1, 20_000).alias("html")).where("html <> ''").take(sample_pages)
    try:
        return zstandard.train_dictionary(size, [r.html.encode() for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        return b""


def with_originals(pages: DataFrame, archive_bytes: int = 128 << 20) -> DataFrame:
    """page_id, url, html, size, digest, original (the largest page_id with the same payload), dealt to archives.

    Payloads are the same when length, SHA-1 and a second hash agree. Only ids meet by payload, so one that very many pages
    share makes no large group of texts; pages are then dealt by id to as many partitions as hold about
    ``archive_bytes`` of payload each.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_column(pages, "html").alias("html"))
    rows = rows.select("*", F.expr("octet_length(html)").cast("long").alias("size"), F.sha1("html").alias("digest"), F.xxhash64("html").alias("second"))
    same = ["size", "digest", "second"]
    # One key that names a page and its payload, so dealing to archives and finding the response take one shuffle.
    rows = rows.withColumn("row_key", F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), *same))
    ids = rows.select("page_id", "row_key", *same).distinct()
    several = ids.groupBy(*same).agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = ids.join(several, same).where(~F.col("page_id").eqNullSafe(F.col("original"))).select("row_key", "original", F.lit(True).alias("is_revisit"))
    archives = max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / archive_bytes))
    out = rows.repartition(archives, "row_key").join(revisits, "row_key", "left")
    is_response = F.col("is_revisit").isNull()
    return out.select("page_id", "url", "html", "size", "digest", F.when(is_response, F.col("page_id")).otherwise(F.col("original")).alias("original"), is_response.alias("is_response"))


def _header(name: bytes, value: str) -> bytes:
    return name + b": " + value.replace("\r", "%0D").replace("\n", "%0A").encode() + b"\r\n"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, original: int | None) -> bytes:
    """One response or revisit record; a revisit keeps the HTTP header, which has the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    out = VERSION + b"\r\n" + _header(b"WARC-Type", "revisit" if payload is None else "response") + _header(b"WARC-Record-ID", _name(page_id)) + _header(b"WARC-Date", "2024-01-01T00:00:00Z")
    if url is not None:
        out += _header(b"WARC-Target-URI", url)
    if payload is None:
        out += _header(b"WARC-Profile", PROFILE.decode()) + _header(b"WARC-Refers-To", _name(original))
    out += _header(b"WARC-Payload-Digest", f"sha1:{digest}") + _header(b"Content-Type", "application/http; msgtype=response") + _header(b"Content-Length", str(len(block)))
    return out + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, dictionary: bytes | None = None, archive_bytes: int = 128 << 20) -> None:
    """Write a record for each page into archives of about ``archive_bytes`` of payload under ``path``.

    Of pages with equal payloads (null html is empty) the largest page_id is the response, the others revisit it; a page
    without an id is named so and revisits one that has an id. A page_id that repeats with one payload gives as many
    records, with several payloads one of its kind for each; other columns are ignored; no pages give no archive.
    """
    words = train_dictionary(pages) if dictionary is None else dictionary
    rows = with_originals(pages, archive_bytes).select("page_id", "url", "size", F.when(F.col("is_response"), F.col("html")).alias("html"), "digest", "original")

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        out = [struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words]
        held = 0
        for batch in batches:
            for page_id, url, size, html, digest, original in zip(*(c for c in batch.columns), strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else None
                name = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                out.append(packer.compress(record(page_id.as_py(), url.as_py(), payload, size.as_py(), name, original.as_py())))
                held += len(out[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    rows.mapInArrow(framed, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def frames(data: memoryview) -> Iterator[memoryview]:
    """The frames of a Zstandard file in order, skippable ones too; a cut or unknown frame raises ValueError."""
    at, n = 0, len(data)
    while at < n:
        if n - at < 8:
            raise ValueError("cut frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + size
        elif magic == FRAME_MAGIC:
            try:
                checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
                end = at + zstandard.frame_header_size(data[at : at + 18])
            except zstandard.ZstdError as e:
                raise ValueError("bad frame header") from e
            last = False
            while not last:
                if end + 3 > n:
                    raise ValueError("cut frame")
                block = int.from_bytes(data[end : end + 3], "little")
                last, kind, length = bool(block & 1), block >> 1 & 3, block >> 3
                if kind == 3:
                    raise ValueError("bad block")
                end += 3 + (1 if kind == 1 else length)
            end += 4 * checksum
        else:
            raise ValueError("unknown frame")
        if end > n:
            raise ValueError("cut frame")
        yield data[at:end]
        at = end


def _fields(lines: list[bytes]) -> dict[bytes, bytes]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        out[name.strip().lower()] = value.strip()
    return out


def _number(value: bytes) -> int:
    if not value.isdigit():
        raise ValueError("bad number")
    return int(value)


def _page(value: bytes) -> int | None:
    if not value.startswith(b"<urn:page:") or not value.endswith(b">"):
        raise ValueError("bad record id")
    return None if value == b"<urn:page:none>" else int(value[10:-1])


def parse_record(raw: bytes) -> dict:
    """A record's fields; headers, lengths and digests are checked, and what is wrong raises ValueError."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    fields = _fields(lines[1:])
    if missing := [k for k in REQUIRED if k not in fields]:
        raise ValueError(f"no {missing[0].decode()}")
    length = _number(fields[b"content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("length differs")
    kind = fields[b"warc-type"]
    if kind not in (b"response", b"revisit"):
        raise ValueError("unknown type")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    lines = http.split(b"\r\n")
    if not gap or not lines[0].startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    size = _number(_fields(lines[1:]).get(b"content-length", b""))
    digest = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:")
    if kind == b"response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()) != digest):
        raise ValueError("payload differs")
    if kind == b"revisit" and (payload or fields.get(b"warc-profile") != PROFILE):
        raise ValueError("bad revisit")
    return {"page_id": _page(fields[b"warc-record-id"]), "url": fields[b"warc-target-uri"].decode() if b"warc-target-uri" in fields else None, "payload_bytes": size, "payload_digest": digest.decode(), "record_type": kind.decode(), "refers_to": _page(fields[b"warc-refers-to"]) if kind == b"revisit" else None, "payload": payload if kind == b"response" else None, "error": None}


def parse_archive(data: memoryview) -> Iterator[dict]:
    """The records of one archive; a bad record or a cut archive gives a row whose ``error`` says so."""
    bad = dict.fromkeys(x.split()[0] for x in RECORD.split(", "))
    opener = zstandard.ZstdDecompressor()
    try:
        for i, frame in enumerate(frames(data)):
            magic, size = struct.unpack_from("<II", frame)
            if i == 0 and magic == DICTIONARY_MAGIC and size:
                words = bytes(frame[8:])
                if words[:4] == struct.pack("<I", FRAME_MAGIC):
                    words = opener.decompress(words)
                opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
            if magic != FRAME_MAGIC:
                continue
            try:
                yield parse_record(opener.decompressobj().decompress(frame))
            except (ValueError, zstandard.ZstdError) as e:
                yield bad | {"error": str(e)[:200]}
    except (ValueError, zstandard.ZstdError) as e:
        yield bad | {"error": str(e)[:200]}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives under ``path``: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload (null for revisits or without ``payloads``) and error (null for a sound record).

    A task holds one archive at a time, of 2 GB at most, as Spark's reader of whole files has it; it decodes frame by frame, and
    a record may be as large as a value of Spark's. The writer here keeps archives far smaller.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in parse_archive(memoryview(content.as_buffer())):
                    held += 400 + len(row["payload"] or b"") * payloads
                    rows.append(row if payloads else row | {"payload": None})
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(read, RECORD)


def sound_records(records: DataFrame) -> DataFrame:
    """The records without ``error``; one that isn't sound fails the job and says why, so that a page can't be lost unseen."""
    sound = F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("archive record: "), "error")).cast("boolean"))
    return records.where(sound).drop("error")
