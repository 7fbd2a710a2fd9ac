"""Web archives of independently compressed Zstandard frames with a seek table at the end.

Method: records of a task are gathered into frames, frames into bundles. A bundle is one stream of Zstandard frames followed by
a seek table in a skippable frame, so any Zstandard tool reads it and a seeking reader decompresses single frames. A map
gives each record's bundle, frame and offset inside the frame. Bundles are stored by Spark as rows of a table, which any
store takes and which is committed whole or not at all; ``export`` writes them as plain files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conform.session import stage

#: Raw bytes after which a frame, and compressed bytes after which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 4 << 20
#: Fixed values of the public formats: skippable frame, seek table footer, record prefix.
SKIPPABLE, SEEKABLE, PREFIX = 0x184D2A5E, 0x8F92EAB1, "urn:page:"
BUNDLE = "bundle string, data binary, records array<struct<record_id: string, frame: int, offset: long, length: long>>"
#: Pages carry no capture time: their records get this one, so archives of equal pages are equal. Fixed value: what a page's payload is.
DATE, CONTENT = "1970-01-01T00:00:00Z", "text/html; charset=utf-8"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed size, raw size)."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(data: bytes) -> list[tuple[int, int, int]]:
    """(position, compressed size, raw size) of every frame, read from the footer of a bundle."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8
    entries = np.frombuffer(data[len(data) - 9 - n * width:len(data) - 9], "<u4").reshape(n, -1)[:, :2].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(entries[:, 0])))
    return [(int(p), int(c), int(r)) for p, (c, r) in zip(at, entries, strict=False)]


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[frame[0]:frame[0] + frame[1]], max_output_size=max(1, frame[2]))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, kept_by: str | None, date: str = DATE) -> bytes:
    """One WARC record; ``kept_by`` names the record whose equal payload this one refers to, ``date`` says when it was captured."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if kept_by is not None else 'response'}", f"WARC-Record-ID: <{PREFIX}{record_id}>", f"WARC-Date: {date}", f"Content-Type: {CONTENT}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if kept_by is not None:
        head += [f"WARC-Refers-To: <{PREFIX}{kept_by}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content of one record; raises where the content does not fit its headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    content = rest[:int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(content):] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    if fields["WARC-Type"] == "response" and (fields["WARC-Payload-Digest"] != f"sha1:{digest(content)}" or int(fields["X-Payload-Length"]) != len(content)):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
    return fields, content


def _bundler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    task, made = TaskContext.get().partitionId(), 0
    frame, frames, body, where = [], [], [], []
    raw = size = 0

    def close_frame() -> None:
        nonlocal raw, size
        if frame:
            body.append(squeeze.compress(b"".join(frame)))
            frames.append((len(body[-1]), raw))
            size += len(body[-1])
            frame.clear()
            raw = 0

    def close_bundle() -> Iterator[pa.RecordBatch]:
        nonlocal made, size
        close_frame()
        if where:
            row = {"bundle": f"{task:06d}-{made:06d}", "data": b"".join(body) + seek_table(frames), "records": list(where)}
            yield pa.RecordBatch.from_pylist([row], SCHEMA)
            made += 1
            for x in (frames, body, where):
                x.clear()
            size = 0

    for batch in batches:
        for rid, url, html, kept_by in zip(*(batch[c] for c in ("_rid", "_url", "_html", "_kept_by")), strict=True):
            item = record(rid.as_py(), url.as_py(), (html.as_py() or "").encode(), kept_by.as_py())
            where.append({"record_id": rid.as_py(), "frame": len(frames), "offset": raw, "length": len(item)})
            frame.append(item)
            raw += len(item)
            if raw >= FRAME_BYTES:
                close_frame()
            if size >= BUNDLE_BYTES:
                yield from close_bundle()
    yield from close_bundle()


SCHEMA = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("records", pa.list_(pa.struct(
    [("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])


def with_digest(pages: DataFrame, id_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """Find, for every payload that occurs more than once, the record that keeps it: adds ``_kept_by``."""
    rows = pages.withColumn("_sha", F.sha2(F.coalesce(F.col(html_col), F.lit("")).cast("binary"), 256))
    known = rows.select("_sha", F.col(id_col).alias("_id"), F.octet_length(F.coalesce(F.col(html_col), F.lit(""))).alias("_bytes"))
    keepers = known.filter(F.col("_bytes") >= least_bytes).groupBy("_sha").agg(F.max("_id").alias("_keeper"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    keepers = stage(keepers, "keepers")
    joined = rows.join(keepers, "_sha", "left")
    return joined.withColumn("_kept_by", F.when(F.col("_keeper").isNotNull() & ~F.col("_keeper").eqNullSafe(F.col(id_col)), F.col("_keeper").cast("string")))


def write(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row into bundles under ``path`` and return the table of bundles.

    The payload is the html in UTF-8; null is an empty payload. Of records with equal payloads of at least ``least_bytes``
    bytes that with the largest id is a response and the others revisit it; shorter ones are all responses. Rows that share
    the largest id are all responses. A null id is written as an empty record id and is never the largest; where a group has
    only null ids all are responses. A null url gives no target header; white space in a url becomes one space. A record longer
    than a frame has a frame of its own. No rows: no bundles. Other columns are not written.
    """
    own = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    rows = with_digest(own, "_id", "_html", least_bytes).select(F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_rid"), "_url", "_html", "_kept_by")
    rows.mapInArrow(_bundler, BUNDLE).write.mode("errorifexists").parquet(path)
    return bundles(pages.sparkSession, path)


def bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUNDLE).parquet(path)


def read(stored: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Records of the bundles (or those with an id in ``only``): ``record_id``, ``record_type``, ``url``, ``payload_bytes``,
    ``payload_digest``, ``refers_to`` and ``payload`` (null for a revisit). Only frames that hold a wanted record are decompressed;
    a damaged record or footer raises."""
    wanted = set(only) if only is not None else None
    if wanted is not None:
        stored = stored.filter(F.exists("records", lambda r: r["record_id"].isin(list(wanted))))
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])

    def unbundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, records in zip(batch["data"], batch["records"], strict=True):
                data, rows, at, raw = data.as_py(), [], -1, b""
                frames = frames_of(data)
                for r in records.as_py():
                    if wanted is not None and r["record_id"] not in wanted:
                        continue
                    if r["frame"] != at:
                        at, raw = r["frame"], read_frame(data, frames[r["frame"]])
                    f, content = parse(raw[r["offset"]:r["offset"] + r["length"]])
                    name = f["WARC-Record-ID"][1 + len(PREFIX):-1]
                    if name != r["record_id"]:
                        raise ValueError(f"the map says {r['record_id']}, the record {name}")
                    back = f.get("WARC-Refers-To")
                    rows.append({"record_id": name, "record_type": f["WARC-Type"], "url": f.get("WARC-Target-URI"), "payload_bytes": int(f["X-Payload-Length"]),
                                 "payload_digest": f["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": back and back[1 + len(PREFIX):-1],
                                 "payload": content if f["WARC-Type"] == "response" else None})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return stored.mapInArrow(unbundle, "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def export(stored: DataFrame, folder: str) -> None:
    """Write each bundle as ``<bundle>.warc.zst`` into a folder that all executors mount; a retry replaces its own files."""

    def save(rows) -> None:
        for r in rows:
            part = os.path.join(folder, f".{r.bundle}.{os.getpid()}")
            with open(part, "wb") as f:
                f.write(r.data)
            os.replace(part, os.path.join(folder, f"{r.bundle}.warc.zst"))

    stored.select("bundle", "data").foreachPartition(save)
