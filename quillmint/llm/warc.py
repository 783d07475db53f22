"""Operator 10: WARC archives with one Zstandard frame per record and a shared dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every record is one frame
compressed with it. The writer sends frames through Spark's text sink with an empty skippable frame as its line
separator, so archives land on whatever file system the path names, under Spark's commit protocol. The reader loads
the dictionary from the leading frame, decodes frame by frame, and validates versions, header lines, block and payload
lengths and digests; anything else in an archive raises WarcError with the file's path.

Records of equal payload are one response, of the largest page id, and revisits of it, which carry the payload's
length and digest but no payload.

Defined results: a null or empty html is an empty payload; a null id is written as an empty id and read back as null
(such a record is a response only where no record of the payload has an id); rows repeated with one id and payload
each get a record of the same type; other columns are left alone; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmint.llm.staging import low_share, new_path

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 16 << 20  # of payloads in one archive, about
DICTIONARY_BYTES, DICTIONARY_PAGES = 64 << 10, 2000
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    if not (name.startswith("<urn:page:") and name.endswith(">")):
        raise WarcError(f"record name {name!r}")
    number = name[10:-1]
    return int(number) if number else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: header, HTTP block and the closing blank lines."""
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    clean = "".join(c for c in url or "" if c not in "\r\n")
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {clean}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """A record's values, its header, lengths and digest validated."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] != VERSION:
        raise WarcError(f"record starts with {raw[:16]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or name.lower() in fields:
            raise WarcError(f"header line {line!r}")
        fields[name.lower()] = value.strip(" ")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise WarcError(f"no header {name}")
    if not fields["content-length"].isdigit():
        raise WarcError(f"length {fields['content-length']!r}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, header says {length}")
    http, mark, body = rest[:length].partition(b"\r\n\r\n")
    said = [x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not mark or len(said) != 1:
        raise WarcError("no HTTP header with one length")
    size, kind = int(said[0]), fields["warc-type"]
    method, _, digest = fields["warc-payload-digest"].partition(":")
    if kind not in ("response", "revisit") or method != "sha1":
        raise WarcError(f"record type {kind!r}, digest {method!r}")
    if kind == "response" and (len(body) != size or digest_of(body) != digest):
        raise WarcError(f"payload of {len(body)} bytes does not fit its length or digest")
    if kind == "revisit" and (body or "warc-refers-to" not in fields):
        raise WarcError("revisit with a payload or without a reference")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": size,
        "payload_digest": digest, "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": body if kind == "response" else None,
    }


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive: dictionary from the leading skippable frame, then one frame after another."""
    view, at = memoryview(data), 0
    dictionary = None
    while at < len(view):
        if len(view) - at < 8:
            raise WarcError("truncated frame")
        magic, size = struct.unpack_from("<II", view, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if len(view) - at - 8 < size:
                raise WarcError("truncated skippable frame")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise WarcError("dictionary frame after the start")
                held = bytes(view[8 : 8 + size])
                if held[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
                    held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                dictionary = zstandard.ZstdCompressionDict(held) if held else None
            at += 8 + size
            continue
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        one = decoder.decompressobj()
        # Frames carry no compressed length: feed growing pieces until the frame ends.
        parts, end, step = [], at, 1 << 14
        try:
            while not one.eof and end < len(view):
                parts.append(one.decompress(view[end : end + step]))
                end = min(end + step, len(view))
                step *= 2
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from e
        if not one.eof:
            raise WarcError("truncated frame")
        at = end - len(one.unused_data)
        yield b"".join(parts)


def train_dictionary(pages: DataFrame, pages_used: int = DICTIONARY_PAGES, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the first 16 KB of at most ``pages_used`` pages; empty where they are too few to train on."""
    drawn = F.xxhash64("page_id", "sha")
    lowest = pages.where(low_share(drawn, pages_used * 5 // 4, pages.count()))
    some = lowest.select(drawn.alias("drawn"), F.substring(F.col("payload"), 1, 1 << 14).alias("p")).orderBy("drawn").limit(pages_used).collect()
    samples = [bytes(r["p"]) for r in some if r["p"]]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record per row into archives under ``path``."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    key = ["known", "number", "sha"]
    rows = rows.withColumn("known", F.col("page_id").isNotNull()).withColumn("number", F.coalesce("page_id", F.lit(0).cast("long")))
    first = rows.groupBy("sha").agg(F.max("page_id").alias("first_id"))
    # The payloads move once, dealt by page and not by payload, so that many copies of a page spread over the archives.
    role = rows.select(*key).distinct().join(first, "sha")
    total = rows.agg(F.sum(F.length("payload")), F.count("*")).first()
    archives = max(1, -(-(total[0] or 0) // ARCHIVE_BYTES), -(-total[1] // 200_000))
    lead = struct.pack("<II", DICTIONARY_MAGIC, len(held := train_dictionary(rows))) + held

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = zstandard.ZstdCompressionDict(held) if held else None
        press = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
        started = False
        for batch in batches:
            ids, urls, firsts = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for a in range(0, len(ids), 256):
                out = [] if started else [lead]
                started = True
                for i in range(a, min(a + 256, len(ids))):
                    revisit = ids[i] != firsts[i] and firsts[i] is not None
                    record = record_bytes(ids[i], urls[i], batch.column(2)[i].as_py(), firsts[i], revisit)
                    out.append(press.compress(record))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    dealt = rows.repartition(archives, *key).join(role.repartition(archives, *key), key).select("page_id", "url", "payload", "first_id")
    lines = dealt.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    lines.write.option("lineSep", EMPTY_FRAME.decode("latin-1")).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``, validated; one archive is held in memory at a time.

    Without ``payloads`` every payload is still decoded and validated, but does not leave the task.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(len(batch)):
                held, size = [], 0
                try:
                    for raw in read_archive(batch.column(1)[i].as_py()):
                        held.append(parse_record(raw))
                        if not payloads:
                            held[-1]["payload"] = None
                        size += len(raw) if payloads else 256
                        if size > 4 << 20:
                            yield batch_of(held)
                            held, size = [], 0
                except WarcError as e:
                    raise WarcError(f"{batch.column(0)[i].as_py()}: {e}") from e
                if held:
                    yield batch_of(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(records, RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
