"""Minimax contiguous partition of documents into shards.

Copies of a text are one atomic group. Groups are ordered by a digest of their text; the cuts lie
between groups and make the largest shard as small as any cuts of this order can: the capacity is
found by binary search, each trial filling shards greedily. Among cuts of that capacity, those nearest to
equal shares are taken.

The driver never holds the groups. It keeps the order as segments, each a digest prefix with its
bytes; at first 65,536 of them. Greedy filling over segments taken whole, or not at all where they
pass a cut, bounds the least capacity from both sides; only the segments in which a cut may lie are
split by two further hex digits, until the bounds meet at single groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import discard, materialize

SHARDS = 16
DIGITS = 4
SALTS = 32
#: Name of the group of null texts: no digest, so they are no copies of any text.
NO_TEXT = "0" * 32


def filled(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Greedy cuts: for each shard the number of segments that end within its capacity."""
    cuts, begun = [], 0
    for _ in range(shards):
        k = int(np.searchsorted(ends, begun + capacity, side="right"))
        cuts.append(k)
        begun = int(ends[k - 1]) if k else 0
        if k == len(ends):
            break
    return cuts


def least_capacity(sizes: np.ndarray, shards: int) -> int:
    """Smallest capacity at which greedy filling needs no more than ``shards`` shards."""
    ends = np.cumsum(sizes, dtype=np.int64)
    if not len(ends):
        return 0
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if filled(ends, middle, shards)[-1] == len(ends):
            high = middle
        else:
            low = middle + 1
    return low


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Segments before each cut: as near to equal shares as the capacity allows.

    Filling from the end gives, for each cut, the first place after which the rest still fits.
    """
    total = int(ends[-1])
    least, need = [], total
    for _ in range(shards - 1):
        k = int(np.searchsorted(ends, need - capacity, side="left")) + 1 if need > capacity else 0
        need = int(ends[k - 1]) if k else 0
        least.append(k)
    cuts, begun = [], 0
    for i, low in enumerate(reversed(least), 1):
        high = int(np.searchsorted(ends, begun + capacity, side="right"))
        near = int(np.searchsorted(ends, total * i / shards, side="left"))
        near += int(near < len(ends) and ends[near] - total * i / shards < total * i / shards - (ends[near - 1] if near else 0))
        k = min(max(near, low, cuts[-1] if cuts else 0), high)
        cuts.append(k)
        begun = int(ends[k - 1]) if k else 0
    return cuts


def bounds(sizes: np.ndarray, single: np.ndarray, shards: int) -> tuple[int, int, np.ndarray]:
    """Least and greatest value of the least capacity, and the segments that must be split to narrow it.

    Segments of many groups may be cut anywhere (lower bound) or nowhere (upper bound).
    """
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes

    def reach(capacity: int) -> tuple[bool, list[tuple[int, int]]]:
        spans, early, late = [], 0, 0  # a cut lies between these positions
        for _ in range(shards):
            k = int(np.searchsorted(ends, early + capacity, side="right"))
            early = int(ends[k - 1]) if k else 0
            p = late + capacity
            k = int(np.searchsorted(ends, p, side="right"))
            late = int(ends[-1]) if k == len(ends) else (int(starts[k]) if single[k] else p)
            spans.append((early, late))
        return late >= ends[-1], spans

    high = least_capacity(sizes, shards)
    low, top = max(int(sizes[single].max(initial=0)), -(-int(ends[-1]) // shards)), high
    while low < top:
        middle = (low + top) // 2
        if reach(middle)[0]:
            top = middle
        else:
            low = middle + 1
    split = np.zeros(len(sizes), dtype=bool)
    if low < high:
        for (early, _), (_, late) in zip(reach(low)[1], reach(high)[1], strict=True):
            split |= (ends > early) & (starts <= late)
    return low, high, split & ~single


def cut_points(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Least capacity and, for each shard but the first, the smallest key prefix in it. ``groups``: key, bytes; a stored table."""

    def segments(df: DataFrame, digits: int) -> dict[str, tuple[int, bool]]:
        rows = df.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
        return {r["p"]: (r["b"], r["n"] == 1) for r in rows}

    digits, known = DIGITS, segments(groups, DIGITS)
    while True:
        order = sorted(known)
        sizes = np.array([known[p][0] for p in order], dtype=np.int64)
        single = np.array([known[p][1] or len(p) >= 32 for p in order], dtype=bool)
        if not order:
            return 0, []
        low, high, split = bounds(sizes, single, shards)
        wanted = [p for p, s in zip(order, split, strict=True) if s]
        if low == high or not wanted:
            cuts = even_cuts(np.cumsum(sizes), high, shards)
            return high, [order[k] if k < len(order) else "~" for k in cuts]
        by_length: dict[int, list[str]] = {}
        for p in wanted:
            by_length.setdefault(len(p), []).append(p)
            del known[p]
        for digits, prefixes in by_length.items():
            known |= segments(groups.filter(F.substring("key", 1, digits).isin(prefixes)), digits + 2)


def shard(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per document.

    ``size`` is the bytes of the text plus 1 (null: 1). Null texts form a group of their own, empty ones too;
    very long texts count with all their bytes, and a group larger than an equal share has a shard to itself;
    repeated rows and null ids count each; other columns are ignored, whatever their names; an empty table gives
    no rows. Slots are gapless in each shard; they are numbered within (prefix, salt) cells, so that neither a
    group with very many copies nor very many null ids meet in one task.
    """
    text = F.col(text_col)
    # Ids spread over the salts; rows without one, by where they lie, which the stored table makes lasting.
    salt = F.when(F.col(id_col).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit(NO_TEXT)).alias("key"),
        salt.cast("int").alias("salt"),
    )
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    _, cuts = cut_points(groups, shards)
    discard(groups)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("key") >= c).cast("int")
    placed = rows.withColumn("shard", number).withColumn("cell", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    cells = sorted(placed.groupBy("shard", "cell", "salt").agg(F.count("*").alias("n")).collect())  # at most (4096 + shards) * SALTS rows
    before, last, base = [], None, 0
    for c in cells:
        base = 0 if c["shard"] != last else base
        last = c["shard"]
        before.append((c["shard"], c["cell"], c["salt"], base))
        base += c["n"]
    offsets = rows.sparkSession.createDataFrame(before, "shard int, cell int, salt int, before bigint")
    w = Window.partitionBy("shard", "cell", "salt").orderBy("key", "doc_id")
    out = placed.withColumn("n", F.row_number().over(w)).join(F.broadcast(offsets), ["shard", "cell", "salt"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("n") - 1).cast("bigint").alias("slot"))
