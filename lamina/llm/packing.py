"""Packing: documents cut into pieces, pieces packed by shortest-pack-first over the length histogram.

A document of n ids becomes full pieces of ``size`` ids and one rest. The histogram of rests has at
most ``size - 1`` lengths however large the corpus, so the plan is made on the driver: lengths are
placed longest first, always into the pattern with most room (the shortest pack), and patterns are
split by count. The plan is a list of slots (length, first rank, last rank, first sequence, offset);
pieces take a rank among those of equal length and meet their slot by an interval join.

Ranks are counted within (length, salt), with the sums of the salts before as offsets, because one
length may hold a third of all pieces.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm import tokens
from lamina.llm.common import materialize, prepare

SIZE = 2048
SALTS = 16
PIECES = "doc_id bigint, part int, start bigint, length int, ids_crc32 bigint, doc_tokens bigint"


@dataclass(frozen=True)
class Slot:
    """Pieces of ``length`` with ranks first..last lie at ``offset`` of sequences sequence, sequence + 1, ..."""

    length: int
    first: int
    last: int
    sequence: int
    offset: int


def pack(histogram: dict[int, int], size: int = SIZE) -> list[Slot]:
    """Shortest-pack-first: patterns of lengths with counts, returned as slots."""
    room: list[tuple[int, int, tuple[int, ...]]] = []  # heap by least -(room left); second number keeps ties in order
    counts: dict[tuple[int, ...], int] = {}
    done: dict[tuple[int, ...], int] = {}

    def put(pattern: tuple[int, ...], n: int) -> None:
        left = size - sum(pattern)
        if left == 0:
            done[pattern] = done.get(pattern, 0) + n
        elif pattern in counts:
            counts[pattern] += n
        else:
            counts[pattern] = n
            heapq.heappush(room, (-left, len(counts), pattern))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            while room and room[0][2] not in counts:
                heapq.heappop(room)
            if room and -room[0][0] >= length:
                _, _, pattern = heapq.heappop(room)
                there = counts.pop(pattern)
                used = min(n, there)
                if there > used:
                    put(pattern, there - used)
                put((*pattern, length), used)
                n -= used
            else:
                put((length,), n)
                n = 0
    slots, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, n in sorted([*done.items(), *counts.items()], reverse=True):
        offset = 0
        for length in pattern:
            slots.append(Slot(length, taken[length], taken[length] + n - 1, sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return slots


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, keep: bool = True) -> DataFrame:
    """Cut every document's ids (with the end id) into pieces; a narrow step, whole texts.

    ``keep``: workers keep their cache for the next task; without it they also cut less text at a time.
    """
    prepare(docs.sparkSession)

    def task(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for doc_id, ids in zip(b.column(0).to_pylist(), tokens.documents(b.column(1).to_pylist(), vocabulary, at_once=None if keep else tokens.AT_ONCE // 4), strict=True):
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    out.append((doc_id, k, at, len(part), tokens.crc(part), len(ids)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "part", "start", "length", "ids_crc32", "doc_tokens"])
        if not keep:
            tokens.forget(vocabulary)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, PIECES)


def assign(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """``cut`` plus sequence_id, offset. ``cut`` is read three times and must be a stored table."""
    spark = cut.sparkSession
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int"))
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()  # at most size * SALTS rows
    histogram: dict[int, int] = {}
    before = []
    for c in sorted(cells):
        before.append((c["length"], c["salt"], histogram.get(c["length"], 0)))
        histogram[c["length"]] = histogram.get(c["length"], 0) + c["n"]
    slots = [(s.length, s.first, s.last, s.sequence, s.offset) for s in pack(histogram, size)]
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    offsets = spark.createDataFrame(before, "length int, salt int, before bigint")
    ranked = salted.withColumn("n", F.row_number().over(w)).join(F.broadcast(offsets), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("n") - 1)
    # Slots of one length don't overlap, so each piece meets one. The plan has a row for each length of each
    # pattern; the number of lengths bounds the patterns, not the corpus.
    plan = spark.createDataFrame(slots, "length int, first bigint, last bigint, sequence bigint, offset bigint")
    where = (F.col("rank") >= F.col("first")) & (F.col("rank") <= F.col("last")) & (ranked.length == plan.length)
    placed = ranked.join(F.broadcast(plan), where).drop(plan.length)
    return placed.select(*cut.columns, (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("offset").cast("bigint").alias("offset"))


def packed(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, keep: bool = True) -> DataFrame:
    """One row per piece: doc_id, part, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of the end id alone; very long texts are encoded whole and cut into many
    pieces; repeated rows are packed each; null ids are kept; other columns are ignored, whatever their names; an
    empty table gives no pieces. ``vocabulary`` is a path that executors can read, or a public vocabulary's name.
    """
    return assign(materialize(pieces(docs, vocabulary, id_col, text_col, size, keep), "pieces"), size)
