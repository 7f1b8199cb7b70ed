"""Token-id shards as sorted string tables.

A shard holds documents in ascending key order::

    block*   entries [shared u16][rest u16][bytes u32][key rest][ids]; each block is compressed,
             keys keep only what differs from the key before, a block's first key is whole
    index    zstd: per block [offset u64][bytes u32][entries u32][key length u16][first key]
    Bloom    [hashes u32][bits]
    footer   JSON (places, counts, tokens, first and last key, id width), its length u32, MAGIC

A key is a sign-flipped big-endian id behind a byte that is 0 for null, so bytes sort as ids do.
A lookup reads the footer, the filter and the index, finds the block by binary search and reads
that block alone. Rows reach shards by range partitioning on (id, text hash): the shards are in
order, a repeated id may continue in the next shard, and no key is too frequent for one task.
"""

from __future__ import annotations

import bisect
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import files, tokens
from lamina.llm.common import prepare, shared_dir

MAGIC = b"LMSST001"
BLOCK_BYTES = 64 * 1024
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
ENTRY = struct.Struct("<HHI")
INDEX = struct.Struct("<QIIH")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (int(doc_id) + 2**63).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - 2**63 if key[0] else None


def bloom_slots(keys: np.ndarray, n_bits: int) -> np.ndarray:
    """Bit places of 64-bit keys, one row per key (double hashing of a multiplicative mix)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        h1, h2 = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
        return (h1[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * h2[:, None]) % np.uint64(n_bits)


def write_shard(uri: str, rows: Iterable[tuple[int | None, np.ndarray]], id_bytes: int) -> dict:
    """Write rows that come in ascending key order; returns the footer."""
    index, ids, last, first, least = [], [], b"", b"", None
    block, in_block, at, n_tokens, n_docs = bytearray(), 0, 0, 0, 0
    packer = zstandard.ZstdCompressor(level=1)
    kind = "<u2" if id_bytes == 2 else "<u4"
    with files.publish(uri) as out:

        def flush():
            nonlocal block, in_block, at
            if in_block:
                data = packer.compress(bytes(block))
                index.append(INDEX.pack(at, len(data), in_block, len(first)) + first)
                out.write(data)
                at += len(data)
                block, in_block = bytearray(), 0

        for doc_id, values in rows:
            key = key_of(doc_id)
            least = key if least is None else least
            if len(block) >= BLOCK_BYTES:
                flush()
            if not in_block:
                first = key
                shared = 0
            else:
                shared = next((i for i, (a, b) in enumerate(zip(key, last, strict=False)) if a != b), min(len(key), len(last)))
            data = values.astype(kind).tobytes()
            block += ENTRY.pack(shared, len(key) - shared, len(data)) + key[shared:] + data
            in_block += 1
            n_docs += 1
            n_tokens += len(values)
            last = key
            ids.append(-(2**63) if doc_id is None else int(doc_id))
        flush()
        n_bits = max(64, BLOOM_BITS_PER_KEY * n_docs)
        bits = np.zeros(n_bits, dtype=np.uint8)
        bits[bloom_slots(np.array(ids, dtype=np.int64), n_bits).ravel().astype(np.int64)] = 1
        bloom = struct.pack("<I", n_bits) + np.packbits(bits).tobytes()
        packed = packer.compress(b"".join(index))
        footer = {
            "index": [at, len(packed)], "bloom": [at + len(packed), len(bloom)], "documents": n_docs, "tokens": n_tokens,
            "blocks": len(index), "id_bytes": id_bytes, "first": (least or b"").hex(), "last": last.hex(),
        }
        tail = json.dumps(footer).encode()
        out.write(packed + bloom + tail + struct.pack("<I", len(tail)) + MAGIC)
    return footer


class Shard:
    """Reads a shard by block."""

    def __init__(self, f):
        self.f = f
        end = f.size()
        f.seek(end - 12)
        size, magic = struct.unpack("<I8s", f.read(12))
        if magic != MAGIC:
            raise ValueError("not a shard")
        f.seek(end - 12 - size)
        self.footer = json.loads(f.read(size))
        at, n = self.footer["index"]
        f.seek(at)
        data, self.blocks, p = zstandard.decompress(f.read(n)) if n else b"", [], 0
        while p < len(data):
            offset, size, entries, klen = INDEX.unpack_from(data, p)
            p += INDEX.size + klen
            self.blocks.append((data[p - klen : p], offset, size, entries))
        self.kind = "<u2" if self.footer["id_bytes"] == 2 else "<u4"

    def block(self, i: int) -> Iterator[tuple[int | None, np.ndarray]]:
        _, offset, size, _ = self.blocks[i]
        self.f.seek(offset)
        data, p, key = zstandard.decompress(self.f.read(size)), 0, b""
        while p < len(data):
            shared, rest, n = ENTRY.unpack_from(data, p)
            p += ENTRY.size
            key = key[:shared] + data[p : p + rest]
            p += rest
            yield id_of(key), np.frombuffer(data, dtype=self.kind, count=n // self.footer["id_bytes"], offset=p).astype("<u4")
            p += n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_hold(self, doc_id: int | None) -> bool:
        at, _ = self.footer["bloom"]
        self.f.seek(at)
        n_bits = struct.unpack("<I", self.f.read(4))[0]
        key = np.array([-(2**63) if doc_id is None else doc_id], dtype=np.int64)
        for slot in bloom_slots(key, n_bits).ravel().tolist():  # a byte of the file for each hash, most significant bit first
            self.f.seek(at + 4 + slot // 8)
            if not self.f.read(1)[0] >> (7 - slot % 8) & 1:
                return False
        return True

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every row with this key, in order; none if there is no such row."""
        if not self.blocks or not self.may_hold(doc_id):
            return []
        key = key_of(doc_id)
        i, out = max(0, bisect.bisect_left([b[0] for b in self.blocks], key) - 1), []
        while i < len(self.blocks) and self.blocks[i][0] <= key:
            out += [v for d, v in self.block(i) if d == doc_id]
            i += 1
        return out


#: ``first`` and ``last`` are the least and greatest key of a shard, as hex text.
MANIFEST = "shard int, path string, documents bigint, tokens bigint, first string, last string"
ROWS = "shard int, position bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def write(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Tokenise ``docs`` into shards; returns the manifest (shard, path, documents, tokens, first, last), one row per shard.

    Null texts count as empty, null ids come first, equal ids and repeated rows lie together in the order of their
    text hashes; very long texts are encoded whole; other columns are ignored, whatever their names. An empty table
    gives an empty manifest. ``vocabulary`` is a path that executors can read, or a public vocabulary's name.
    """
    spark = prepare(docs.sparkSession)
    folder = shared_dir(spark, "tokens")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def task(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        wide = tokens.encoder(vocabulary).tokenizer.get_vocab_size() > 2**16

        def entries():
            for b in batches:
                ids = [None if x is None else int(x) for x in b.column(0).to_pylist()]
                yield from zip(ids, tokens.documents(b.column(1).to_pylist(), vocabulary), strict=True)

        stream = entries()
        if (head := next(stream, None)) is not None:
            from itertools import chain

            import pyarrow as pa

            path = f"{folder}/shard-{shard:05d}.sst"
            footer = write_shard(path, chain([head], stream), 4 if wide else 2)
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()), "path": [path], "documents": pa.array([footer["documents"]], pa.int64()),
                    "tokens": pa.array([footer["tokens"]], pa.int64()), "first": [footer["first"]], "last": [footer["last"]],
                }
            )

    return spark.createDataFrame(rows.select("doc_id", "text").mapInArrow(task, MANIFEST).collect(), MANIFEST)


def read(manifest: DataFrame) -> DataFrame:
    """One row per stored document, with ``start``: the ids of all documents before it."""
    spark = manifest.sparkSession
    listed, begun = [], 0
    for m in sorted(manifest.collect(), key=lambda m: m["shard"]):  # a row per shard, bounded by the number of write tasks
        listed.append((m["shard"], m["path"], begun))
        begun += m["tokens"]
    schema = "shard int, path string, begun bigint"
    todo = spark.createDataFrame(listed, schema)
    todo = todo.repartitionByRange(max(1, len(listed)), "shard")

    def task(batches):
        import pyarrow as pa

        for b in batches:
            for m in b.to_pylist():
                start, out = m["begun"], []
                with files.opened(m["path"]) as f:
                    for position, (doc_id, ids) in enumerate(Shard(f)):
                        out.append((m["shard"], position, doc_id, start, len(ids), tokens.crc(ids)))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield batch(pa, out)
                            out = []
                if out:
                    yield batch(pa, out)

    def batch(pa, rows):
        names = ("shard", "position", "doc_id", "start", "n_tokens", "ids_crc32")
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names)

    return todo.mapInArrow(task, ROWS)


def lookup(manifest: DataFrame, doc_id: int | None) -> list[list[int]]:
    """Ids of each row with this key: of the shards whose range holds it, by Bloom filter and binary search in each."""
    key, found = key_of(doc_id).hex(), []
    for m in manifest.filter((F.col("first") <= key) & (F.col("last") >= key)).orderBy("shard").collect():  # one, or the shards over which a repeated id goes on
        with files.opened(m["path"]) as f:
            found += [x.tolist() for x in Shard(f).get(doc_id)]
    return found
