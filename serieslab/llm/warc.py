"""WARC archives: written one file a task, read back as records, assembled into one nested row per capture.

A capture is a request, a response (or a revisit that refers to one) and a metadata record; request and metadata name
the response's record in WARC-Concurrent-To, and the assembly joins them through it. Payload digests are SHA-1 in
base32 over the whole payload.

Files are gzip members, one a record, in the folder that the caller names (any file system that pyarrow or Spark's
shared folder reaches); a retried task writes to a name of its own and only files named by finished tasks are read.

Edge cases: null html is an empty payload; a null url is the empty target; equal payloads have the largest page_id's
record as response (rows that repeat it too), the others are revisits; rows with a null page_id are never referred to
unless no other has that payload, when each is a response; an empty table gives an empty result; columns other than
page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import materialise, maybe_broadcast, scratch

DATE = "2024-01-01T00:00:00Z"
SALTS = 16
#: Rows of a batch that the reader hands to Spark, and bytes of payload after which it does so earlier.
ROWS, BYTES = 2000, 8 << 20

RECORD = pa.schema([("file", pa.string()), ("record_id", pa.string()), ("kind", pa.string()), ("target", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary())])


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


def _record(kind: str, rid: str, block: bytes, **headers: str | None) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {DATE}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + pack.flush()


def _line(x: str) -> str:
    """A header's value on one line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in x)


def plan_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest_hex and refers_to (null for a response) of each page.

    The largest page_id of each repeated payload is a pre-aggregated maximum. It goes back by a broadcast while there
    are few repeated payloads, else by a join on (digest, salt), so that SALTS tasks meet a payload of a third of all
    pages.
    """
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest_hex", F.sha1(F.encode("html", "utf-8")))
    sized = rows.where(F.octet_length("html") >= min_bytes)
    firsts = sized.groupBy("digest_hex").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = materialise(firsts.select("digest_hex", "first"), "payloads")
    small = maybe_broadcast(firsts)
    if small is not firsts:
        rows = rows.join(small, "digest_hex", "left")
    else:
        salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest_hex", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= min_bytes)
    return rows.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"))


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write planned pages (page_id, url, html, refers_to) as archives under folder: one row (file, n_records) a file."""

    def run(batches):
        target, n = None, 0
        copies: Counter = Counter()  # of each page_id in this file
        for batch in batches:
            if not batch.num_rows:
                continue
            if target is None:
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                fs, path = _fs(name)
                fs.create_dir(path.rsplit("/", 1)[0])
                target = fs.open_output_stream(path, compression=None)
            for page, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = html.encode()
                rid, uri = f"urn:page:{page}" + (f":{copies[page]}" if copies[page] else ""), _line(url)
                copies[page] += 1
                digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
                common = {"WARC_Target_URI": uri}
                refers = None if first is None else f"<urn:page:{first}>"
                target.write(_record("request", rid.replace("page", "request", 1), f"GET {uri} HTTP/1.1\r\n\r\n".encode(), **common, WARC_Concurrent_To=f"<{rid}>"))
                target.write(_record("response" if first is None else "revisit", rid, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (body if first is None else b""), **common, WARC_Payload_Digest=digest, WARC_Refers_To=refers, WARC_Profile=None if first is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
                target.write(_record("metadata", rid.replace("page", "metadata", 1), f"payloadBytes: {len(body)}\r\n".encode(), **common, WARC_Concurrent_To=f"<{rid}>"))
                n += 3
        if target is not None:
            target.close()
            yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_records"])

    return planned.select("page_id", "url", "html", "refers_to").mapInArrow(run, "file string, n_records long")


def _records(data):
    """(headers, block) of each record of an archive stream, one gzip member at a time; what a read holds beyond a member is copied, so reads are short."""
    unpack, parts, pending = zlib.decompressobj(31), [], b""
    while pending or (pending := data.read(1 << 16)):
        parts.append(unpack.decompress(pending))
        pending = unpack.unused_data
        if unpack.eof:
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            unpack, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("an archive ends within a record")


def read(files: DataFrame, with_block: bool = True) -> DataFrame:
    """The records of the archives that files (file) names; with_block=False leaves payloads out, but measures them."""

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = _fs(name)
                with fs.open_input_stream(path, compression=None) as data:
                    for h, block in _records(data):
                        kind = h["WARC-Type"]
                        size, digest = None, None
                        if kind in ("response", "revisit"):
                            payload = block.partition(b"\r\n\r\n")[2]
                            digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                            if kind == "response":
                                size = len(payload)
                                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                    raise ValueError(f"a payload of {name} differs from its digest")
                        elif kind == "metadata":
                            size = int(block.removeprefix(b"payloadBytes: "))
                        clean = lambda x: x and x.strip("<>")
                        rows.append((name, clean(h["WARC-Record-ID"]), kind, h.get("WARC-Target-URI", ""), clean(h.get("WARC-Concurrent-To")), clean(h.get("WARC-Refers-To")), digest, size, block if with_block else None))
                        held += len(block) if with_block else 0
                        if len(rows) >= ROWS or held > BYTES:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)
                            rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)

    schema = "file string, record_id string, kind string, target string, concurrent_to string, refers_to string, payload_digest string, payload_bytes long, block binary"
    return files.select("file").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, target, payload_digest, kind, refers_to, and the structs request, response and metadata.

    Records of a capture share its id: the response's own, which the others name as concurrent. Each id has at most a
    few records, so one equi-join by id (written as a grouped union) has no hot key.
    """
    with_key = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    body = F.struct("record_id", "block", "payload_bytes")
    main = F.col("kind").isin("response", "revisit")
    pick = lambda cond, x: F.max_by(F.when(cond, x), F.when(cond, F.col("record_id")))
    return with_key.groupBy("capture_id", "file").agg(
        pick(main, F.col("target")).alias("target"), pick(main, F.col("payload_digest")).alias("payload_digest"), pick(main, F.col("kind")).alias("kind"), pick(main, F.col("refers_to")).alias("refers_to"),
        pick(F.col("kind") == "request", body).alias("request"), pick(main, body).alias("response"), pick(F.col("kind") == "metadata", body).alias("metadata"),
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder, read them back and give the digest of each capture."""
    spark = pages.sparkSession
    files = materialise(write(plan_revisits(pages, min_bytes), scratch(spark, "warc")), "archives")
    one_each = files.repartition(max(1, min(files.count(), 100_000)), "file")
    captures = assemble(read(one_each, with_block=False))
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)", 1).try_cast("long")
    return captures.select(page(F.col("capture_id")).alias("page_id"), F.col("metadata.payload_bytes").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), page(F.col("refers_to")).alias("refers_to"))
