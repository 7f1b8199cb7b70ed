"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames of about ``FRAME_BYTES``. Behind the last frame come a
skippable frame with the record index (record id, frame, offset in the frame, length) and one with
the seek table of the public seekable format (sizes of all frames, then the frame count, a
descriptor byte and the magic number), so any Zstandard decoder reads a bundle as plain WARC and a
record costs one frame. A bundle is closed at ``BUNDLE_BYTES``.

Payloads of at least ``DEDUP_BYTES`` that occur more than once are stored by the smallest page id;
the other records revisit it. Only digests, ids and urls are shuffled to count the rows and to find the
first of each digest. A revisit has no block, so revisits are made from those counts alone; payloads travel
only where more digests repeat than may be broadcast, and then only those that repeat or may.
Which of several equal rows is the response is thereby a matter of counts, not of the task that meets them.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import files
from lamina.llm.common import counted_broadcast, materialize, parted_by_keys, prepare, shared_dir

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 256 * 1024 * 1024
DEDUP_BYTES = 100
#: Fixed values of the seekable format: skippable-frame and seek-table magic numbers.
SKIPPABLE, INDEX_SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A capture has no date of its own here, so that equal input gives equal bytes.
DATE = "1970-01-01T00:00:00Z"


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record. Revisits carry the digest and size of the full payload but no block."""
    revisit = row["revisit"]
    block = b"" if revisit else row["payload"]
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{row['record_id']}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}", "Content-Type: text/html; charset=utf-8",
    ]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{row['first_key']}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    p = 0
    while p < len(data):
        end = data.index(b"\r\n\r\n", p)
        lines = data[p:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        p = end + 4 + size + 4


class BundleWriter:
    def __init__(self, out):
        self.out, self.packer = out, zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.frame, self.bytes = bytearray(), 0

    def add(self, record_id: str, data: bytes) -> None:
        self.index.append((record_id, len(self.frames), len(self.frame), len(data)))
        self.frame += data
        if len(self.frame) >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.frame:
            data = self.packer.compress(bytes(self.frame))
            self.out.write(data)
            self.frames.append((len(data), len(self.frame)))
            self.bytes += len(data)
            self.frame = bytearray()

    def close(self) -> None:
        self.flush()
        listed = self.packer.compress("\n".join(json.dumps(x) for x in self.index).encode())
        self.out.write(struct.pack("<II", INDEX_SKIPPABLE, len(listed)) + listed)
        entries = [*self.frames, (8 + len(listed), 0)]  # the index frame holds no data
        table = b"".join(struct.pack("<II", *x) for x in entries) + struct.pack("<IBI", len(entries), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Bundle:
    """Random access to a bundle: ``record(id)`` decompresses one frame."""

    def __init__(self, f):
        self.f = f
        end = f.size()
        f.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError("not a seekable bundle")
        f.seek(end - 9 - 8 * n)
        table = f.read(8 * n)
        self.frames, at = [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", table, 8 * i)
            self.frames.append((at, packed, plain))
            at += packed
        self.at, self.size, _ = self.frames.pop()

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        self.f.seek(at)
        return zstandard.decompress(self.f.read(packed), max_output_size=plain)

    def index(self) -> dict[str, tuple[int, int, int]]:
        self.f.seek(self.at + 8)
        lines = zstandard.decompress(self.f.read(self.size - 8)).decode()
        return {k: tuple(v) for k, *v in map(json.loads, lines.split("\n"))} if lines else {}

    def record(self, record_id: str) -> tuple[dict[str, str], bytes]:
        frame, offset, size = self.index()[record_id]
        return next(parse_records(self.frame(frame)[offset : offset + size]))

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for i in range(len(self.frames)):
            yield from parse_records(self.frame(i))


#: Revisits of one row that a task makes at a time.
CHUNK = 65_536
DECIDED = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "first_id", "first_key", "key", "copy"]


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, first_id, first_key, key, copy), one row per page.

    Of the rows with one digest, the least (id, url) is the response; ``first_key`` names its record in the rows
    that revisit it, whose ``payload`` is null. Of several rows that equal the first in id, url and payload, one
    is the response and the others revisit it; ``copy`` numbers equal rows that revisit. Null payloads are empty.
    Payloads under 100 bytes, and pages without an id, are stored whole and nothing refers to them. Very long
    payloads are never gathered: a row's payload is in one task at a time. Without a url column, urls are null;
    other columns are ignored, whatever their names; an empty table gives no rows.
    """
    url = F.col(url_col) if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), url.alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)})
    able = (F.col("payload_bytes") >= DEDUP_BYTES) & F.col("page_id").isNotNull()
    light = rows.filter(able).groupBy("payload_digest", "payload_bytes", "page_id", "url").agg(F.count("*").alias("n"))
    light = materialize(light, "pages", small=True)
    first = light.groupBy("payload_digest").agg(F.min(F.struct("page_id", F.col("url").isNull().alias("no_url"), "url")).alias("f"), F.sum("n").alias("copies")).filter("copies > 1")
    first = materialize(first.select("payload_digest", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url")), "firsts", small=True)
    n = first.count()

    name = lambda page, url: F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("none")), F.substring("payload_digest", 1, 16), F.hex(F.xxhash64(url)))
    none = F.lit(None)
    own = [none.cast("bigint").alias("first_id"), none.cast("string").alias("first_key"), name(F.col("page_id"), F.col("url")).alias("key"), F.lit(0).cast("bigint").alias("copy")]
    repeated = counted_broadcast(first, n)
    may, not_ = parted_by_keys(rows.filter(able), "payload_digest", first, "payload_digest", n)
    single = rows.filter(~able).unionByName(may.join(repeated.select("payload_digest"), "payload_digest", "left_anti"))
    single = single.unionByName(not_) if not_ is not None else single
    is_first = (F.col("page_id") == F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    # Copies of the first meet before the shuffle: one payload of each task and digest is left.
    held = may.join(repeated, "payload_digest").filter(is_first).groupBy("payload_digest", "page_id", "url", "payload_bytes").agg(F.first("payload").alias("payload"))
    others = light.join(repeated, "payload_digest").withColumn("n", F.col("n") - is_first.cast("int")).filter("n > 0")
    chunks = others.withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {CHUNK}L)")))
    spread = chunks.withColumn("copy", F.explode(F.expr(f"sequence(at, least(n - 1, at + {CHUNK - 1}))")))
    revisits = spread.select(
        "page_id", "url", none.cast("binary").alias("payload"), "payload_bytes", "payload_digest", "first_id", name(F.col("first_id"), F.col("first_url")).alias("first_key"),
        name(F.col("page_id"), F.col("url")).alias("key"), (F.col("copy") + 1).alias("copy"),
    )
    stored = single.unionByName(held).select("page_id", "url", "payload", "payload_bytes", "payload_digest", *own)
    return stored.unionByName(revisits).select(*DECIDED)


MANIFEST = "path string, records bigint, frames bigint, bytes bigint"
ROWS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, path string, frame int"
INDEX = "record_id string, path string, frame int, offset bigint, bytes bigint"


def write(decided: DataFrame) -> DataFrame:
    """Write bundles, one or more for each partition; returns (path, records, frames, bytes).

    Record ids are unique: rows that may be equal carry the place of their record in the write.
    """
    spark = prepare(decided.sparkSession)
    folder = shared_dir(spark, "warc")

    def rows_of(batches):
        for b in batches:
            columns = [b.column(c) for c in DECIDED]
            for i in range(b.num_rows):  # one payload as a Python object at a time
                yield dict(zip(DECIDED, (c[i].as_py() for c in columns), strict=True))

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, rows, k = TaskContext.get().partitionId(), rows_of(batches), 0
        row, made, running = next(rows, None), [], 0
        while row is not None:
            path = f"{folder}/part-{part:05d}-{k:04d}.warc.zst"
            with files.publish(path) as out:
                w = BundleWriter(out)
                while row is not None and w.bytes < BUNDLE_BYTES:
                    running += 1
                    row["revisit"] = row["first_key"] is not None
                    # The first of a digest is named by its key, which revisits refer to.
                    unique = row["page_id"] is not None and row["payload_bytes"] >= DEDUP_BYTES
                    row["record_id"] = f"{row['key']}:{row['copy']}" if row["revisit"] else row["key"] if unique else f"{row['key']}:{part}:{running}"
                    w.add(row["record_id"], record_bytes(row))
                    row = next(rows, None)
                w.close()
            made.append((path, len(w.index), len(w.frames), w.bytes))
            k += 1
        if made:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], ["path", "records", "frames", "bytes"])

    return spark.createDataFrame(decided.mapInArrow(task, MANIFEST).collect(), MANIFEST)  # a row per bundle


def index(manifest: DataFrame) -> DataFrame:
    """(record_id, path, frame, offset, bytes): where each record lies, from the bundles' own indexes; frames aren't read."""

    def task(batches):
        import pyarrow as pa

        for b in batches:
            for path in b.column(0).to_pylist():
                with files.opened(path) as f:
                    listed = [(k, path, *v) for k, v in Bundle(f).index().items()]
                if listed:
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*listed, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

    return dealt(manifest).mapInArrow(task, INDEX)


def lookup(stored_index: DataFrame, record_id: str) -> tuple[dict[str, str], bytes] | None:
    """Head and block of a record by ``index``, stored once: one frame is read. None if there is no such record."""
    at = stored_index.filter(F.col("record_id") == record_id).first()
    if at is None:
        return None
    with files.opened(at["path"]) as f:
        return next(parse_records(Bundle(f).frame(at["frame"])[at["offset"] : at["offset"] + at["bytes"]]))


def dealt(manifest: DataFrame) -> DataFrame:
    n = max(1, min(manifest.count(), 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("path").repartition(n)


def read(manifest: DataFrame) -> DataFrame:
    """One row per record. Responses are measured again from their payload, revisits from their headers."""

    def task(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32())
        names = [x.split()[0] for x in ROWS.split(", ")]
        for b in batches:
            for path in b.column(0).to_pylist():
                with files.opened(path) as f:
                    bundle = Bundle(f)
                    for i in range(len(bundle.frames)):
                        out = []
                        for head, block in parse_records(bundle.frame(i)):
                            kind = head["WARC-Type"]
                            seen = (len(block), hashlib.sha256(block).hexdigest()) if kind == "response" else (int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].partition(":")[2])
                            to = int(head["WARC-Refers-To"].split(":")[2]) if kind == "revisit" else None
                            out.append((int(x) if (x := head.get("X-Page-ID")) else None, *seen, kind, to, path, i))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return dealt(manifest).mapInArrow(task, ROWS)
