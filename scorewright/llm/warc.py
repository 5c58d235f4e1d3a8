"""Web archives with a shared Zstandard dictionary, written and read by Spark.

An archive file is a sequence of Zstandard frames: first a skippable frame (magic 0x184D2A5D) that holds the
dictionary, then every WARC record compressed on its own with that dictionary, so a reader can start at any record.

*Writing.* Spark's text sink writes the frames as raw bytes, with all it brings: commit protocol, retries, any file system.
The sink puts a separator behind every row; the separator used is itself an empty skippable frame, which readers skip.
*Reading.* The binary file source hands each archive, of bounded size, to one task, which walks its frames. Archives
of other writers, without separators or without dictionary, read the same way.

*Revisits.* Of records with equal payloads of at least ``least_bytes``, the one with the largest id is a response and
the others are revisit records without payload that refer to it. Rows that share this largest id are all responses.

*Scale.* Payloads are shuffled once, by id and digest, to the archives; copies are found on digests alone. The
dictionary is trained on a bounded sample (about ``SAMPLE_ROWS`` records of at most ``SAMPLE_BYTES``, chosen by hash),
which only affects the compression.

Cases: null html is an empty payload, null url an empty target. A null id is written as such, comes back as null and
is the response only if no row with an id holds the payload. Repeated rows are records each. No rows give no archives.
"""

from __future__ import annotations

import hashlib
import logging
import math
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm.store import scratch

_LOG = logging.getLogger(__name__)

# Fixed values of the format
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = "P*M\x18\x00\x00\x00\x00"  # an empty skippable frame
RECORD_MAGIC = 0xFD2FB528

ARCHIVE_BYTES = 64 << 20  # of payload, so that a task can hold an archive
DICTIONARY_BYTES = 112_640
SAMPLE_ROWS = 1000
SAMPLE_BYTES = 16_384
LEVEL = 6


def train_dictionary(payloads: list[bytes]) -> bytes:
    """A Zstandard dictionary of the records; empty, and said so in the log, if they are too few or too short to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes()
    except zstandard.ZstdError as error:
        _LOG.warning("archives without a dictionary: %d training pieces of %d bytes (%s)", len(payloads), sum(map(len, payloads)), error)
        return b""


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: headers and, of a response, the HTTP message."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>")
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def frames(compressor: zstandard.ZstdCompressor, data: bytes) -> bytes:
    """The record as one frame, or as several if the frame would hold the separator."""
    frame = compressor.compress(data)
    if SEPARATOR.encode() not in frame or len(data) < 2:
        return frame
    half = len(data) // 2
    return frames(compressor, data[:half]) + frames(compressor, data[half:])


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    words = zstandard.ZstdCompressionDict(dictionary)
    words.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)


def _encode(dictionary: bytes):
    """Records of a task's rows, which come sorted by ``rk``; a row with ``refers_to`` comes before the pages that revisit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, opened = _compressor(dictionary), False
        revisiting, response = None, None
        for batch in batches:
            if not len(batch):
                continue
            out = []
            if not opened:
                out.append(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                opened = True
            for rk, page_id, url, html, digest, refers_to in zip(*(batch.column(c) for c in ("rk", "page_id", "url", "html", "digest", "refers_to")), strict=True):
                if refers_to.is_valid:
                    revisiting, response = rk.as_py(), refers_to.as_py()
                    continue
                revisit = rk.as_py() == revisiting
                payload = (html.as_py() or "").encode()
                out.append(frames(compressor, record_bytes(page_id.as_py(), url.as_py(), payload, digest.as_py(), response if revisit else None, revisit)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    return run


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) below ``path``. (job)"""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    base = base.withColumn("size", F.octet_length("html").cast("long")).withColumn("rk", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest"))
    pieces = F.ceil(F.col("size") / SAMPLE_BYTES)
    totals = base.agg(F.sum("size"), F.count("*"), F.sum(pieces)).first()
    archives = max(1, math.ceil(((totals[0] or 0) + 512 * totals[1]) / archive_bytes))

    def piece(k):
        chance = F.pmod(F.xxhash64(F.lit("sample"), "rk", k), F.lit(1 << 30)) / float(1 << 30)
        return F.when(chance < SAMPLE_ROWS / max(totals[2] or 0, 1), F.substr("html", (k * SAMPLE_BYTES + 1).cast("int"), F.lit(SAMPLE_BYTES)))

    drawn = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), pieces - 1), piece), lambda p: p != "")
    sample = base.where("size > 0").select(F.explode(drawn).alias("piece"))
    dictionary = train_dictionary(sorted(r["piece"].encode() for r in sample.collect()))

    groups = base.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    copies = base.where(F.col("size") >= least_bytes).select("rk", "page_id", "digest").join(groups, "digest")
    revisits = copies.where("response is not null and not (page_id <=> response)").select("rk", F.col("response").alias("refers_to")).distinct()
    # payloads are shuffled once: what revisits what goes along as rows of its own, that the encoder meets first
    rows = base.select("rk", "page_id", "url", "html", "digest").unionByName(revisits, allowMissingColumns=True)
    dealt = rows.repartition(archives, "rk").sortWithinPartitions("rk", F.col("refers_to").asc_nulls_last())
    encoded = dealt.mapInArrow(_encode(dictionary), "frame binary")
    encoded.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def walk(data: bytes) -> Iterator[bytes]:
    """The records of an archive, decompressed. A record ends where its headers say, in one frame or several."""
    at, decoder, held = 0, zstandard.ZstdDecompressor(), b""
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            length = struct.unpack_from("<I", data, at + 4)[0]
            if magic == DICTIONARY_MAGIC and length:
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[at + 8 : at + 8 + length]))
            at += 8 + length
            continue
        if magic != RECORD_MAGIC:
            raise ValueError(f"no frame at byte {at} of the archive")
        one = decoder.decompressobj()
        held += one.decompress(data[at : at + (1 << 16)])
        end = at + (1 << 16)
        while not one.eof:
            if end >= len(data):
                raise ValueError("the archive ends within a frame")
            held += one.decompress(data[end : end + (1 << 20)])
            end += 1 << 20
        at = min(end, len(data)) - len(one.unused_data)
        while held and (end_of := _record_end(held)) is not None:
            yield held[:end_of]
            held = held[end_of:]
    if held:
        raise ValueError("the archive ends within a record")


def _record_end(data: bytes) -> int | None:
    head = data.find(b"\r\n\r\n")
    if head < 0:
        return None
    length = next(int(x[15:]) for x in data[:head].split(b"\r\n") if x.lower().startswith(b"content-length:"))
    end = head + 4 + length + 4
    return end if len(data) >= end else None


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content"):
            rows: list[tuple] = []
            held = 0
            for record in walk(data.as_py()):
                rows.append(parsed(record))
                held += len(record)
                if held > 1 << 23:
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)


def parsed(record: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of a record; a response is verified."""
    head, _, block = record.partition(b"\r\n\r\n")
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    ident = lambda x: int(x[len("<urn:page:") : -1]) if len(x or "") > len("<urn:page:>") else None
    kind, digest, length = named["warc-type"], named["warc-payload-digest"].removeprefix("sha1:"), int(named["x-payload-length"])
    payload = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2][:-4]
        if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of record {named['warc-record-id']} doesn't match its digest")
    return ident(named["warc-record-id"]), named["warc-target-uri"], kind, ident(named.get("warc-refers-to")), length, digest, payload


_READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``. A payload is null for revisits."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_decode, _READ)


def archived(pages: DataFrame, path: str | None = None, least_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` to archives and read them back. (job)"""
    path = path or scratch(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
