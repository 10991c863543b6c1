"""WARC archives in Zstandard, with a dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed or not; then
comes one Zstandard frame per record. ``read_archive`` decodes frame by frame and validates what each record states:
its version line, its mandatory headers, its Content-Length, the line breaks that end it, and its digests.

Archives are values of a binary column, so that Spark's own readers and writers move them, whatever store they are in;
each has a bounded size. Pages with equal payloads are written once, as the response of the smallest page_id; the
others become revisit records that refer to it.

Defined results: a null html is an empty payload; pages with a null id are written, with an empty record id, and never
are what others refer to; repeated rows with the smallest page_id are all responses; an empty table gives an empty
result; other columns of the input are ignored. The reader takes any archive of this kind: header names in any case,
digests that are missing or of other kinds, ids of any form, and records without a page.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops, workspace

SKIPPABLE_DICTIONARY = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 8_000_000
DICTIONARY_BYTES = 32_768
SAMPLE_BYTES = 1_000_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
LENGTH_FIELD = "X-Payload-Length"
#: Header names are case-insensitive; these are read as they are spelled here.
KNOWN = {n.lower(): n for n in (*MANDATORY, LENGTH_FIELD, "WARC-Target-URI", "WARC-Refers-To", "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Type")}


class BadRecord(ValueError):
    """A record or archive that breaks the format."""


def digest(payload: bytes) -> str:
    """Base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _differs(stated: str, data: bytes) -> bool:
    """Whether a SHA-1 that a header states, in base32 or hexadecimal, isn't that of ``data``. Other digests pass."""
    kind, _, value = stated.partition(":")
    if kind.lower() != "sha1":
        return False
    return value.lower() != hashlib.sha1(data).hexdigest() if len(value) == 40 else value.upper() != digest(data)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None, refers_url: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record: a response with an HTTP head and the payload, or a revisit with the head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    url = re.sub(r"[\r\n]+", " ", url or "")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        (LENGTH_FIELD, str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Refers-To-Target-URI", re.sub(r"[\r\n]+", " ", refers_url or ""))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for these records; if they are too few or too alike to train one, a part of them as raw content."""
    sample, total = [], 0
    for r in records:
        sample.append(r)
        total += len(r)
        if total >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[:2048] for r in sample)[:size]


def write_archive(records: list[bytes], level: int = 3) -> bytes:
    dictionary = train_dictionary(records)
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    writer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
    return struct.pack("<II", SKIPPABLE_DICTIONARY, len(packed)) + packed + b"".join(map(writer.compress, records))


def frame_end(archive: bytes, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, from its own block headers."""
    if archive[at : at + 4] != ZSTD_MAGIC:
        raise BadRecord(f"no frame at byte {at}")
    if at + 5 > len(archive):
        raise BadRecord("the archive ends inside a frame header")
    flags = archive[at + 4]
    single, has_sum = flags & 32, flags & 4
    p = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if p + 3 > len(archive):
            raise BadRecord("the archive ends inside a frame")
        head = int.from_bytes(archive[p : p + 3], "little")
        p += 3 + (1 if (head >> 1) & 3 == 1 else head >> 3)
        if head & 1:
            break
    p += 4 if has_sum else 0
    if p > len(archive):
        raise BadRecord("the archive ends inside a frame")
    return p


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and block, validated."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise BadRecord("no version line or no end of headers")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name or name != name.strip():
            raise BadRecord(f"bad header line {line[:60]!r}")
        fields[KNOWN.get(name.lower(), name)] = value.strip()
    for name in MANDATORY:
        if not fields.get(name):
            raise BadRecord(f"{name} is missing")
    if not fields["Content-Length"].isdigit():
        raise BadRecord("Content-Length is no number")
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadRecord(f"Content-Length is {size}, the block has {len(rest) - 4} bytes")
    block = rest[:size]
    if _differs(fields.get("WARC-Block-Digest", ""), block):
        raise BadRecord("the block's digest differs")
    return fields, block


def read_archive(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record; raises BadRecord where the archive breaks the format."""
    at, dictionary = 0, None
    if len(archive) >= 8 and struct.unpack("<I", archive[:4])[0] == SKIPPABLE_DICTIONARY:
        size = struct.unpack("<I", archive[4:8])[0]
        if 8 + size > len(archive):
            raise BadRecord("the archive ends inside the dictionary")
        packed, at = archive[8 : 8 + size], 8 + size
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == ZSTD_MAGIC else packed)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(archive):
        if len(archive) >= at + 8 and struct.unpack("<I", archive[at : at + 4])[0] & 0xFFFFFFF0 == 0x184D2A50:  # another skippable frame
            at += 8 + struct.unpack("<I", archive[at + 4 : at + 8])[0]
            continue
        end = frame_end(archive, at)
        try:
            raw = reader.decompressobj().decompress(archive[at:end])
        except zstandard.ZstdError as e:
            raise BadRecord(f"the frame at byte {at} can't be decoded: {e}") from e
        yield parse_record(raw)
        at = end


def http_payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def _page_id(urn: str) -> int | None:
    """The page's number in a record id of ``record``; other ids have none."""
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(m[1]) if m else None


def _row(fields: dict[str, str], block: bytes) -> tuple:
    """A row of ``read_archives``."""
    kind, payload = fields["WARC-Type"].lower(), None
    is_http = fields.get("Content-Type", "").lower().startswith("application/http")
    stated, length = fields.get("WARC-Payload-Digest", ""), fields.get(LENGTH_FIELD)
    if kind != "revisit":
        payload = http_payload(block) if is_http else block
        if _differs(stated, payload) or (length is not None and int(length) != len(payload)):
            raise BadRecord("the payload's digest or length differs")
        length, stated = len(payload), stated or digest(payload)
    return (
        _page_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), None if length is None else int(length), stated.removeprefix("sha1:") or None, kind,
        _page_id(fields.get("WARC-Refers-To", "")), payload, fields["WARC-Record-ID"], fields.get("WARC-Refers-To"),
    )


def write_archives(pages: DataFrame) -> DataFrame:
    """Archives (one binary column) of rows page_id, url, html, refers_to, refers_url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            ids, urls, refs, ref_urls = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for at, data, bounds in textops.utf8_batches(batch.column(2)):
                raw = data.tobytes()
                for k, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), at):
                    waiting.append(record(ids[k], urls[k], raw[s:e], refs[k], ref_urls[k]))
                    size += len(waiting[-1])
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([write_archive(waiting)], pa.binary())], names=["archive"])
                        waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array([write_archive(waiting)], pa.binary())], names=["archive"])

    return pages.select("page_id", "url", "html", "refers_to", "refers_url").mapInArrow(run, "archive binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of any kind: page_id (null for ids that aren't those of ``record``), url, payload_bytes and
    payload_digest (null where a revisit doesn't state them), record_type, refers_to (a page_id), payload (null for
    revisits), record_id, refers_to_id (as they stand)."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "record_id", "refers_to_id"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for archive in one.column(0):
                rows, size = [], 0
                for fields, block in read_archive(archive.as_py()):
                    rows.append(_row(fields, block))
                    size += len(block) + 300
                    if size > 2_000_000:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)

    return archives.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string, refers_to_id string")


def archive_pages(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url", min_payload: int = 0) -> DataFrame:
    """Writes a record per page and reads the archives back: ``read_archives``'s columns.

    Payloads of fewer than ``min_payload`` bytes are always responses.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html")})
    slim = workspace.stage(rows.select("page_id", "url", "sha", "n"), "warc-digests")
    first = slim.where(F.col("n") >= min_payload).groupBy("sha", "n").agg(F.count("*").alias("copies"), F.min("page_id").alias("least"))
    first = first.where("copies > 1 and least is not null")
    urls = slim.join(first.select("sha", "n", F.col("least").alias("page_id")), ["sha", "n", "page_id"]).groupBy("sha", "n").agg(F.min("page_id").alias("refers_to"), F.min("url").alias("refers_url"))
    urls = workspace.stage(urls, "warc-first")  # written first, so that the pages of a very common payload can be split over tasks in the join
    met = rows.join(urls, ["sha", "n"], "left")
    again = ~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull()
    flagged = met.select("page_id", "url", "html", F.when(again, F.col("refers_to")).alias("refers_to"), F.when(again, F.col("refers_url")).alias("refers_url"))
    return read_archives(workspace.stage(write_archives(flagged), "warc"))
