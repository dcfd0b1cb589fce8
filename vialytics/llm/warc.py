"""WARC archives with dictionary-compressed records.

Each archive starts with a skippable Zstandard frame that holds a dictionary trained on records of that archive;
every record is a frame of its own. Repeated payloads are written as revisit records of one response.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, batches, frugal, materialize, shared_path

#: Fixed values of the format: the skippable frame's magic number and the revisit profile.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 16 << 20
DICT_BYTES, SAMPLE_BYTES, SAMPLE_RECORD = 64 << 10, 4 << 20, 32 << 10
LEVEL = 3
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _record_id(kind: str, url: str | None, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}|{kind}')}>"


def _uri(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def info_bytes(name: str) -> bytes:
    """The warcinfo record that opens an archive."""
    block = b"software: vialytics\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id('warcinfo', name, None, '')}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_bytes(kind: str, url: str | None, page_id: int | None, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One WARC record. A revisit holds the HTTP head alone; its length and digest are the full payload's, and it names its response."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = HTTP + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(kind, url, page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _uri(url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
        head.append(f"WARC-Refers-To: {_record_id('response', refers_url, refers_to, digest)}")
        if refers_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + _uri(refers_url))
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records (at most SAMPLE_BYTES of them); raw content where there are too few to train on."""
    samples, total = [], 0
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    for r in records[::step]:
        samples.append(r[:SAMPLE_RECORD])
        total += len(samples[-1])
        if total >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def archive_bytes(records: list[bytes]) -> bytes:
    """A whole archive: the dictionary's frame and a frame for each record."""
    raw = build_dictionary(records)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw)).compress
    return struct.pack("<II", SKIPPABLE, len(raw)) + raw + b"".join(compress(r) for r in records)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, read as a stream of frames."""
    head = stream.read(8)
    if not head:
        return
    magic, n = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(stream.read(n)))
    rest = b""
    while data := rest or stream.read(1 << 20):
        frame, out = decompressor.decompressobj(), []
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                break
            if not (data := stream.read(1 << 20)):
                raise ValueError("an archive ends inside a record")
        rest = frame.unused_data
        head, _, body = b"".join(out).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, body[: int(headers["Content-Length"])]


def write_archives(pages: DataFrame, directory: str | None = None) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); returns the archives' paths and record counts.

    Null html is an empty payload; null ids and urls are left out of the record. Of rows with equal payloads the one
    with the largest page_id (null ids last, the first of repeated rows) is the response, the others revisit it.
    An archive closes at ARCHIVE_BYTES. Each task attempt writes files of its own; only those in the returned table count.
    """
    spark = pages.sparkSession
    directory = directory or shared_path(spark, "warc")
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("row"),
    )
    base = materialize(base.withColumn("key", F.unhex(F.sha2("html", 256))), "pages")
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", (-F.col("row")).alias("row"), "url"))
    winners = materialize(base.groupBy("key").agg(best.alias("w")).select("key", F.col("w.page_id").alias("to"), F.col("w.url").alias("to_url"), (-F.col("w.row")).alias("winner")), "responses")
    named = base.join(winners, "key").select("page_id", "url", "html", (F.col("row") == F.col("winner")).alias("first"), "to", "to_url")
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(it):
        context = TaskContext.get()
        files, folder = fs.FileSystem.from_uri(directory) if "://" in directory else (fs.LocalFileSystem(), directory)
        files.create_dir(folder, recursive=True)
        held, size, made = [], 0, 0

        def close():
            name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}-{made:05d}.warc.zst"
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write(archive_bytes([info_bytes(name), *held]))
            return arrow_rows(schema, path=[f"{directory}/{name}"], records=[len(held)])

        for ids, urls, html, first, to, to_url in batches(it, "page_id", "url", "html", "first", "to", "to_url"):
            for i, u, h, f, t, tu in zip(ids.to_pylist(), urls.to_pylist(), html, first.to_pylist(), to.to_pylist(), to_url.to_pylist()):
                held.append(record_bytes("response" if f else "revisit", u, i, h.as_py().encode(), None if f else t, None if f else tu))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size, made = [], 0, made + 1
        if held:
            yield close()

    return materialize(named.mapInArrow(frugal(run), "path string, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, html) of every record; revisits have no html."""
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string())]
    schema = pa.schema(kinds + [("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())])

    def run(it):
        for (paths,) in batches(it, "path"):
            for path in paths.to_pylist():
                files, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with files.open_input_stream(inner) as stream:
                    out, size = [], 0
                    for h, block in read_records(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
                        digest, n = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                        if payload is not None and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"a damaged record in {path}")
                        ids = [int(h[k]) if k in h else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")]
                        out.append((ids[0], n, digest, h["WARC-Type"], ids[1], h.get("WARC-Target-URI"), None if payload is None else payload.decode()))
                        size += len(block)
                        if size >= 4 << 20:
                            yield arrow_rows(schema, **dict(zip(schema.names, zip(*out))))
                            out, size = [], 0
                    if out:
                        yield arrow_rows(schema, **dict(zip(schema.names, zip(*out))))

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = archives.repartition(n, "path")
    return spread.mapInArrow(frugal(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")
