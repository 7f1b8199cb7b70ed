"""Groups of texts at a Jaccard similarity of word shingles: SimHash links, completed where 64 bits don't reach.

A link is a pair of texts that share at least 0.8 of their distinct five-word shingles, counted exactly over
the whole sets. Candidates come first from ``simhash``: fingerprints within 4 bits, by generalised pigeonhole.
At similarity 0.8 fingerprints lie 9.7 bits apart on average (standard deviation 2.9), so 99.9 % of such pairs
would need some 18 bits; there pigeonhole groups of few bits compare each text with a good part of all others.
The rest therefore comes from minima: texts that share one of ``BANDS`` bands of ``ROWS`` minima are
candidates; a pair at similarity 0.8 shares none with probability (1 - 0.8^6)^40, about 5e-6.

Texts are one row for all their copies. Candidates meet in three rounds, each in verified links and components:

1. fingerprints within the distance, and each band's text of most copies with the others of the band;
2. in bands of several components, one more text of the band, chosen by a hash, with the others;
3. in bands that still have several, all pairs across components that can reach the similarity at all.

What a pair can reach is bounded by bitmaps of 512 and of 1,024 bits for each text, in which its shingles set
bits: a bit that the other text lacks stands for at least one shingle outside the overlap. The bounds are inside
the join, the coarse one first, so a dense group of texts that are alike, or nearly, does not emit its pairs, and no candidate that could
be a link is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import simhash
from lamina.llm.common import counted_broadcast, discard, materialize, prepare
from lamina.llm.components import components

SHINGLE = 5
#: Least similarity of a link, as a fraction of whole numbers.
SIMILARITY = (4, 5)
BANDS, ROWS = 40, 6
#: Shingles hashed at a time.
CHUNK = 1024
#: 64-bit words of the coarse bitmap, whose test compiles to a short method, and of the fine one.
WORDS, FINE = 8, 16

_random = np.random.default_rng(5)
MASKS = _random.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64)
FACTORS = _random.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
MIX = _random.integers(0, 2**64, (1, ROWS), dtype=np.uint64) | np.uint64(1)
SALTS = _random.integers(0, 2**64, BANDS, dtype=np.uint64)
#: The one shingle of texts without words, which are copies of each other.
NO_WORDS = np.zeros(1, "<u8")


def key_of(text: Column) -> Column:
    """Name of a text and its copies; null is a copy of the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes) if len(hashes) else NO_WORDS


def bands_of(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        np.minimum(least, ((shingles[None, at : at + CHUNK] ^ MASKS) * FACTORS).min(axis=1), out=least)
    mixed = ((least ^ (least >> np.uint64(29))).reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64)
    return (mixed ^ SALTS).view(np.int64)


def bitmap_of(shingles: np.ndarray, words: int) -> np.ndarray:
    bits = np.zeros(64 * words, bool)
    bits[(shingles >> np.uint64(64 - (64 * words - 1).bit_length())).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def alike(overlap: Column, a: Column, b: Column) -> Column:
    """Whether overlap / (a + b - overlap) reaches the similarity."""
    over, under = SIMILARITY
    return (over + under) * overlap >= over * (a + b)


def verified(pairs: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The ``pairs`` (a, b) of keys whose whole shingle sets are alike. A stored table."""

    @F.pandas_udf("array<bigint>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(simhash.shingle_hashes(t, SHINGLE)).view(np.int64) for t in texts])

    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wanted", small=True)
    texts = docs.select(key_of(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).join(counted_broadcast(wanted, wanted.count()), "key", "left_semi")
    sets = materialize(texts.groupBy("key").agg(F.first("text").alias("text")).select("key", shingles("text").alias("s")), "sets", small=True)
    left = pairs.join(sets.select(F.col("key").alias("b"), F.col("s").alias("t")), "b")
    both = left.join(sets.select(F.col("key").alias("a"), "s"), "a")
    out = materialize(both.filter(alike(F.size(F.array_intersect("s", "t")), F.size("s"), F.size("t"))).select("a", "b"), "alike", small=True)
    discard(wanted, sets)
    return out


def rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (band, key, ...) of bands that hold several components of ``links``, with ``root``. A stored table."""
    roots = components(links)
    named = rows.join(roots, rows.key == roots.node, "left").select(*rows.columns, F.coalesce("root", "key").alias("root"))
    several = named.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band")
    out = materialize(named.join(several, "band", "left_semi"), "rooted", small=True)
    discard(roots)
    return out


def first_pairs(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of the first round. ``texts``: key, fp, copies; ``rows``: band, key, size, copies, bits. A stored table."""
    fps = materialize(texts.groupBy("fp").agg(F.sum("copies").alias("copies"), F.min("key").alias("head")), "prints", small=True)
    near = simhash.near_pairs(fps.select("fp", "copies"))
    head = lambda c: fps.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_key"))
    across = near.join(head("a"), "a").join(head("b"), "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    same = texts.join(fps.select("fp", "head"), "fp").select(F.col("head").alias("a"), F.col("key").alias("b"))
    heads = rows.groupBy("band").agg(F.max(F.struct("copies", (-F.col("key").cast("decimal(20,0)")).alias("least"), "key")).alias("h")).select("band", F.col("h.key").alias("head"))
    banded = rows.join(heads, "band").filter(F.col("key") != F.col("head")).select(F.col("head").alias("a"), F.col("key").alias("b"))
    out = ordered_pairs(across.unionByName(same).unionByName(banded))
    discard(fps, near)
    return out


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with a < b. A stored table."""
    return materialize(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs", small=True)


def reach(a: str, b: str) -> Column:
    """Whether texts of columns size_a, bits_a, fine_a and so on can be alike, by the bits that only one of them has."""
    sizes = F.col(f"size_{a}"), F.col(f"size_{b}")

    def coarse(x: str, y: str) -> Column:
        alone = [F.bit_count(F.get(f"bits_{x}", k).bitwiseAND(F.bitwise_not(F.get(f"bits_{y}", k)))) for k in range(WORDS)]
        return alike(F.col(f"size_{x}") - sum(alone[1:], alone[0]), *sizes)

    def fine(x: str, y: str) -> Column:
        alone = F.aggregate(F.zip_with(f"fine_{x}", f"fine_{y}", lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda t, n: t + n)
        return alike(F.col(f"size_{x}") - alone, *sizes)

    return coarse(a, b) & coarse(b, a) & fine(a, b) & fine(b, a)  # most pairs end at the first


def sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("band", *(F.col(c).alias(f"{c}_{side}") for c in ("key", "size", "bits", "fine", "root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, root), one row per document; ``root`` names the component of its text, ``key`` the text.

    Null, empty and wordless texts are copies of each other; texts of fewer than five words have one shingle,
    all their words; very long texts count with all their shingles; repeated rows and null ids keep a row each;
    other columns are ignored, whatever their names; an empty table gives no rows.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("fp bigint, size int, bits array<bigint>, fine array<bigint>, bands array<bigint>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            hashes = simhash.shingle_hashes(t, SHINGLE)
            s = shingle_set(hashes)
            out.append((simhash.majority(hashes), len(s), bitmap_of(s, WORDS), bitmap_of(s, FINE), bands_of(s)))
        return pd.DataFrame(out, columns=["fp", "size", "bits", "fine", "bands"])

    text = F.col(text_col)
    hashed = materialize(docs.select(F.col(id_col).alias("doc_id"), key_of(text).alias("key"), sketch(text).alias("k")), "sketches")
    texts = materialize(hashed.groupBy("key").agg(F.count("*").alias("copies"), F.first("k").alias("k")).select("key", "copies", "k.*"), "texts")
    spread = texts.select("key", "copies", F.explode("bands").alias("band"))
    crowded = spread.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    rows = materialize(spread.join(crowded, "band").select("band", "key", "copies"), "bands")

    first = first_pairs(texts.select("key", "fp", "copies"), rows)
    links = verified(first, docs, text_col)
    open_ = rooted(rows.select("band", "key"), links)
    measured = materialize(open_.join(texts.select("key", "size", "bits", "fine"), "key").select("band", "key", "size", "bits", "fine", "root"), "measured", small=True)
    heads = measured.groupBy("band").agg(F.min_by(F.struct("key", "size", "bits", "fine", "root"), F.xxhash64("key")).alias("h")).select("band", "h.*")
    met = sided(measured, "a").join(sided(heads, "b"), "band").filter((F.col("root_a") != F.col("root_b")) & reach("a", "b"))
    second = ordered_pairs(met.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).join(first, ["a", "b"], "left_anti"))
    more = verified(second, docs, text_col)
    links = links.unionByName(more)

    left = rooted(measured.drop("root"), links)
    a, b = sided(left, "a"), sided(left, "b")
    across = a.join(b, (a.band == b.band) & (F.col("key_a") < F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & reach("a", "b"))
    pairs = ordered_pairs(across.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))
    third = materialize(pairs.join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti"), "pairs", small=True)
    last = verified(third, docs, text_col)
    linked = components(links.unionByName(last))
    out = materialize(hashed.select("doc_id", "key").join(linked, hashed.key == linked.node, "left").select("doc_id", "key", F.coalesce("root", "key").alias("root")), "groups")
    discard(hashed, texts, rows, first, open_, measured, second, more, left, pairs, third, last, linked)
    return out
