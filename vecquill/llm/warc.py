"""Zstandard WARC archives (.warc.zst): writer and reader.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds its dictionary, followed by one Zstandard frame
for each record. Spark's own text writer puts whole archives to any store that Spark can reach: each row is one
archive, ``maxRecordsPerFile`` is 1, and the line separator is an empty skippable frame, which every reader skips.

The reader takes files as binary rows, loads the dictionary from the leading frame if there is one (trained or raw,
compressed or not), decodes frame by frame and checks each record by the standard: version line (1.0 and 1.1), folded
header lines, mandatory headers, Content-Length against the block, block and payload digests where they are given. All
record types are read. A record that fails is a row of its own with the reason in ``error`` and what could be read of
it; bytes that are no sound frame end their archive with such a row. No bad record ends the job.

Equal payloads: of those of ``min_revisit_bytes`` or more, the one with the smallest id is a response and the others
are revisits without payload that name it. Payloads go through one shuffle as compressed frames; the table of repeated
digests is aggregated before it is shuffled and joined with skew handling by AQE, so a payload that a third of the
pages share lands in no single task.

Defined results: a null payload counts as empty; null ids sort after all others, and a record without id has "null"
in its URIs; rows that share a payload and the smallest id are one response, the first in order of url, the others
revisit it; of rows that are repeated with id, url and payload one is the response, which the plan sees to by adding
such rows up; a null url is the empty string; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecquill.llm.shared import BATCH_BYTES, batches_of, bounded_batches, durable, shared_folder

# Fixed values of the formats.
DICTIONARY_MAGIC, EMPTY_SKIPPABLE = 0x184D2A5D, b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
WRITTEN_AT = "2024-01-01T00:00:00Z"
#: Uncompressed bytes after which an archive is closed, rows read for the dictionary, and its size.
ARCHIVE_BYTES, DICTIONARY_ROWS, DICTIONARY_BYTES = 8 << 20, 400, 64 << 10


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """The bytes of one response or revisit record."""
    block = HTTP_HEAD + (b"" if refers_to is not None else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{page}>",
        f"WARC-Date: {WRITTEN_AT}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[6:6] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(records: list[bytes]) -> bytes:
    """The record that describes an archive of these frames."""
    block = b"software: vecquill\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.UUID(bytes=hashlib.sha1(b"".join(records)).digest()[:16])
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {WRITTEN_AT}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def digest_differs(given: str, content: bytes) -> bool:
    """Whether a labelled digest (algorithm:value, base 32 or hexadecimal) is of a known kind and not the content's."""
    kind, _, value = given.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return False
    own = hashlib.new(kind, content).digest()
    return value.strip().lower() not in (own.hex(), base64.b32encode(own).decode().lower(), base64.b32encode(own).decode().lower().rstrip("="))


def header_fields(lines: list[str]) -> dict[str, str]:
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:  # a folded line goes on with the field before
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"header line without a field name: {line[:80]!r}")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def parse_record(raw: bytes) -> dict:
    """The fields of a record; "error" tells what is wrong with it, if anything is."""
    out: dict = dict.fromkeys(("record_id", "url", "date", "bytes", "digest", "type", "refers_to", "payload", "error"))
    try:
        head, gap, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
            raise ValueError("no header block of version 1.0 or 1.1")
        fields = header_fields(lines[1:])
        out |= {"record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "type": fields.get("warc-type", "").lower() or None, "refers_to": fields.get("warc-refers-to")}
        for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
            if name not in fields:
                raise ValueError(f"no {name}")
        if not fields["content-length"].isdecimal():
            raise ValueError("Content-Length is no number")
        n = int(fields["content-length"])
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise ValueError("Content-Length differs from the block")
        block = rest[:n]
        http = fields.get("content-type", "").lower().startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        given, cut_off = fields.get("warc-payload-digest"), "warc-truncated" in fields
        if out["type"] == "revisit":
            # its payload is the other record's: length and digest are known only as far as they are told
            told = fields.get("x-payload-length", "")
            out |= {"bytes": int(told) if told.isdecimal() else None, "digest": given.partition(":")[2] if given else None}
        else:
            out |= {"bytes": len(payload), "digest": payload_digest(payload), "payload": payload}
            if given and not cut_off and digest_differs(given, payload):
                raise ValueError("payload differs from its digest")
        if "warc-block-digest" in fields and not cut_off and digest_differs(fields["warc-block-digest"], block):
            raise ValueError("block differs from its digest")
        if out["type"] == "revisit" and "warc-profile" not in fields:
            raise ValueError("a revisit without profile")
    except ValueError as e:
        out["error"] = str(e)
    return out


def records(content: bytes) -> Iterator[dict]:
    """The records of an archive; one with only an error ends an archive that goes on with no sound frame."""
    try:
        for raw in frames(content):
            yield parse_record(raw)
    except (ValueError, zstandard.ZstdError) as e:
        yield parse_record(b"") | {"error": f"archive: {e}"}


def dictionary(pages: DataFrame, payload_col: str) -> bytes:
    """A dictionary trained on a bounded sample of payloads; b"" if there are too few."""
    texts_ = pages.select(F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("p")).where("p <> ''").withColumn("h", F.xxhash64("p"))
    least = [r.h for r in texts_.select("h").distinct().orderBy("h").limit(DICTIONARY_ROWS).collect()]  # hashes alone are ranked
    if not least:
        return b""
    texts = [r.p.encode() for r in texts_.where(F.col("h") <= max(least)).dropDuplicates(["h"]).select("p").collect()]  # DICTIONARY_ROWS texts at most
    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def leading_frame(dictionary_: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary_)) + dictionary_


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, with the dictionary of its leading skippable frame."""
    if len(content) < 8:
        raise ValueError("an archive shorter than a frame header")
    magic, size = struct.unpack_from("<II", content, 0)
    at, trained = 0, None
    if magic == DICTIONARY_MAGIC:
        packed = content[8 : 8 + size]
        if len(packed) != size:
            raise ValueError("the dictionary frame is cut off")
        if packed[:4] == struct.pack("<I", 0xFD2FB528):
            packed = zstandard.ZstdDecompressor().decompress(packed, max_output_size=1 << 27)
        trained = zstandard.ZstdCompressionDict(packed) if packed else None
        at = 8 + size
    opener = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    view = memoryview(content)
    while at < len(content):
        if at + 4 > len(content):
            raise ValueError("bytes after the last frame")
        magic = struct.unpack_from("<I", content, at)[0]
        if magic in SKIPPABLE:
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        one = opener.decompressobj()
        out = one.decompress(view[at : at + (1 << 16)])
        fed = at + (1 << 16)
        while not one.eof:
            if fed >= len(content):
                raise ValueError("the last frame is cut off")
            out += one.decompress(view[fed : fed + (1 << 16)])
            fed += 1 << 16
        at = min(fed, len(content)) - len(one.unused_data)
        yield out


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write one record for each row to archives in ``folder`` (any store that Spark can write)."""
    spark = pages.sparkSession
    bounded_batches(spark)
    words = dictionary(pages, payload_col)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string").cast("binary"), F.lit("").cast("binary"))
    base = pages.select(F.col(f"`{id_col}`").cast("string").alias("page"), F.col(f"`{id_col}`").alias("key"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("size"), payload.alias("payload"))
    # the digests that recur, with the first row of each and how often that row is repeated: aggregated before the shuffle
    alike = base.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "key", "url").agg(F.count("*").alias("rows"))
    first = durable(
        alike.groupBy("digest")
        .agg(F.sum("rows").alias("n"), F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("url"), F.col("rows"))).alias("first"))
        .where("n > 1")
        .select("digest", F.coalesce(F.col("first.key").cast("string"), F.lit("null")).alias("first_page"), F.col("first.url").alias("first_url"), F.col("first.rows").alias("repeats"))
    )

    def compress(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for b in batches_of(it):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page", "url", "digest", "size")), pa.array([shrink.compress(p) for p in b.column("payload").to_pylist()], pa.binary())], names=["page", "url", "digest", "size", "packed"])

    def archive(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = zstandard.ZstdCompressionDict(words) if words else None
        shrink = zstandard.ZstdCompressor(level=3, dict_data=trained) if trained else zstandard.ZstdCompressor(level=3)
        grow = zstandard.ZstdDecompressor()
        parts, size = [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([leading_frame(words) + shrink.compress(warcinfo(parts)) + b"".join(parts)], pa.binary())], names=["archive"])

        for b in it:
            for page, url, digest, packed, first_page, first_url, rows in zip(*(b.column(c).to_pylist() for c in ("page", "url", "digest", "packed", "first_page", "first_url", "rows"))):
                payload, page = grow.decompress(packed), page if page is not None else "null"
                named = base64.b32encode(digest).decode()
                is_first = first_page is None or (first_page == page and first_url == url)
                for again in range(rows):
                    raw = record(page, url, payload, named, None if is_first and not again else first_page)
                    parts.append(shrink.compress(raw))
                    size += len(raw)
                    if size >= ARCHIVE_BYTES:
                        yield closed()
                        parts, size = [], 0
        if parts:
            yield closed()

    packed = base.mapInArrow(compress, "page string, url string, digest binary, size int, packed binary")
    typed = packed.join(first, "digest", "left").select("page", "url", "digest", "packed", "first_page", "first_url", "repeats", F.lit(1).cast("long").alias("rows"))
    if not first.where("repeats > 1").isEmpty():  # equal rows that come first: one row for all of them
        is_first = F.coalesce((F.col("repeats") > 1) & (F.coalesce("page", F.lit("null")) == F.col("first_page")) & (F.col("url") == F.col("first_url")), F.lit(False))
        same = typed.where(is_first).groupBy("page", "url", "digest", "first_page", "first_url", "repeats").agg(F.min("packed").alias("packed"), F.count("*").alias("rows"))
        typed = typed.where(~is_first).unionByName(same)
    (
        typed.mapInArrow(archive, "archive binary")
        .select(F.col("archive").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("lineSep", EMPTY_SKIPPABLE.decode("latin-1"))
        .mode("overwrite")
        .text(folder)
    )


#: Columns of the records that are read, with their Arrow and Spark types.
READ = {"record_id": (pa.string(), "string"), "url": (pa.string(), "string"), "date": (pa.string(), "string"), "bytes": (pa.int64(), "long"), "digest": (pa.string(), "string"), "type": (pa.string(), "string"), "refers_to": (pa.string(), "string"), "error": (pa.string(), "string"), "payload": (pa.binary(), "binary")}


def read_archives(spark: SparkSession, folder: str, id_type: str = "bigint", payloads: bool = False, pattern: str = "part-*") -> DataFrame:
    """All records of the archives in a folder: page_id and refers_to (ids of records that name pages, else null), record_id,
    url, date, payload_bytes, payload_digest, record_type, error (and payload)."""
    bounded_batches(spark)
    names = [n for n in READ if payloads or n != "payload"]

    def open_(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], READ[n][0]) for n in names], names=names)

        for b in it:
            for content in b.column(0):
                rows, size = [], 0
                for r in records(content.as_py()):
                    rows.append(r)
                    size += len(r["payload"] or b"") if payloads else 0
                    if len(rows) == 512 or size >= BATCH_BYTES:
                        yield told(rows)
                        rows, size = [], 0
                if rows:
                    yield told(rows)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("content")
    rows = raw.mapInArrow(open_, ", ".join(f"{n} {READ[n][1]}" for n in names))
    page = lambda c: F.regexp_extract(c, "^<urn:x-page:(.*)>$", 1).try_cast(id_type)
    return rows.select(page("record_id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"), "record_id", "url", "date", "error", *(["payload"] if payloads else []))


def archive_and_read(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Write all pages to archives in the shared folder and read them back; rows with an error, if any, stay visible."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, id_col)
    back = read_archives(pages.sparkSession, folder, dict(pages.dtypes)[id_col])
    return back.where("error is not null or record_type in ('response', 'revisit')").select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
