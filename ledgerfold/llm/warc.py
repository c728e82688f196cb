"""WARC archives with an index first: write, select in the index, read back by coalesced byte ranges.

``write`` gives every page one gzip member in a ``.warc.gz`` file (a member for
each record, so any record can be read by itself): a ``response`` with the HTTP
head and the payload, or, for a payload that another page's response already
holds, a ``revisit`` (identical-payload-digest profile) with the HTTP head
alone, whose Content-Length still tells the full payload's size. While it
writes, it notes offset, length, URL and digest of each record; that index is
a table. ``read`` takes index rows, sorts them by file and offset inside byte
blocks of ``BLOCK``, joins ranges that touch or nearly touch into one read, and
parses the records.

Defined results: a null html is an empty payload; of equal payloads the page
with the smallest page_id is the response (null ids last; rows that repeat its
page_id too); payloads under ``least`` bytes are always responses; a null url
is written as ``urn:page:<id>``; page_ids need not be distinct; an empty table
writes nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import shared_path, slices, written
from ledgerfold.llm.token_files import filesystem

INDEX = "file string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, page_id long, refers_to long"
BLOCK, GAP = 8 << 20, 64 << 10
DATE = "2020-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record, not compressed. Its id is derived from page, payload digest, kind and (of a revisit) address, so a
    retry writes the same and rows that repeat a page_id with another payload differ."""
    own = lambda i, *rest: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(['page', str(i), digest, *rest]))}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"") if refers_to is None else head
    clean = lambda s: re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", s)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own(page_id) if refers_to is None else own(page_id, 'revisit', str(url))}",
             f"WARC-Target-URI: {clean(url) if url is not None else f'urn:page:{page_id}'}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
             f"X-Page-Id: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {own(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    block = rest[:int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?mi)^Content-Length: *(\d+)", http)[1])
    return {"headers": headers, "payload": payload, "payload_bytes": size}


def pages_view(pages: DataFrame) -> DataFrame:
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    return p.withColumn("sha256", F.sha2("payload", 256)).withColumn("payload_bytes", F.length("payload").cast("long"))


def write(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Write all pages; the index (one row for each record) as a table."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    p = pages_view(pages)
    # payload_bytes stands beside the digest, so groups are digest and size; minima shrink before the shuffle
    groups = p.groupBy("sha256").agg(F.min("page_id").alias("first_id")).withColumnRenamed("sha256", "of")
    refers = (F.col("payload_bytes") >= least) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = p.join(groups, F.col("sha256") == F.col("of")).select(
        "page_id", "url", "payload", "payload_bytes", F.when(refers, F.col("first_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyspark import TaskContext
        fs, root = filesystem(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in batches:
            for part in slices(batch):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                index = {f: [] for f in ("file", "offset", "length", "url", "payload_digest", "payload_bytes", "record_type", "page_id", "refers_to")}
                for r in part.to_pylist():
                    digest = base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
                    data = gzip_member(record(r["page_id"], r["url"], r["payload"], r["payload_bytes"], digest, r["refers_to"]))
                    out.write(data)
                    for k, v in (("file", name), ("offset", at), ("length", len(data)), ("url", r["url"]), ("payload_digest", digest), ("payload_bytes", r["payload_bytes"]),
                                 ("record_type", "response" if r["refers_to"] is None else "revisit"), ("page_id", r["page_id"]), ("refers_to", r["refers_to"])):
                        index[k].append(v)
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(index[k], pa.string() if k in ("file", "url", "payload_digest", "record_type") else pa.int64()) for k in index], names=list(index))
        if out is not None:
            out.close()

    return written(rows.mapInArrow(run, INDEX), "warc-index").withColumn("folder", F.lit(folder))


def read(index: DataFrame) -> DataFrame:
    """The records that index rows name: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits).

    Rows are dealt by (file, byte block), so a task holds one stretch at a time, however large a file is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

        def fetched(run_: list[tuple[int, int]], path: str, folder: str) -> Iterator[pa.RecordBatch]:
            fs, root = filesystem(folder)
            first, stop = run_[0][0], max(a + n for a, n in run_)
            with fs.open_input_file(f"{root}/{path}") as f:
                data = f.read_at(stop - first, first)
            got = {k: [] for k in kinds}
            for a, n in run_:
                r = parse(zlib.decompress(data[a - first:a - first + n], 31))
                h, revisit = r["headers"], r["headers"]["warc-type"] == "revisit"
                values = (int(h["x-page-id"]) if h["x-page-id"] else None, h["warc-target-uri"], h["warc-type"], r["payload_bytes"],
                          h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-refers-to-page-id"]) if revisit else None, None if revisit else r["payload"])
                for k, v in zip(kinds, values, strict=True):
                    got[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(got[k], t) for k, t in kinds.items()], names=list(kinds))

        own: list[tuple[int, int]] = []
        at = ("", "")
        for batch in batches:
            for folder, file, a, n in zip(*(batch.column(c).to_pylist() for c in ("folder", "file", "offset", "length")), strict=True):
                if own and (at != (folder, file) or a > own[-1][0] + own[-1][1] + GAP or a + n - own[0][0] > BLOCK):
                    yield from fetched(own, at[1], at[0])
                    own = []
                at = (folder, file)
                own.append((a, n))
        if own:
            yield from fetched(own, at[1], at[0])

    dealt = index.select("folder", "file", "offset", "length", F.floor(F.col("offset") / BLOCK).alias("block"))
    n = math.ceil((index.agg(F.sum("length")).first()[0] or 0) / BLOCK)  # as many tasks as there are byte blocks
    ordered = dealt.repartition(max(1, n), "file", "block").sortWithinPartitions("folder", "file", "offset")
    return ordered.select("folder", "file", "offset", "length").mapInArrow(
        run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
