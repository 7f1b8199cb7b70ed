"""SimHash near-duplicates under a Hamming distance, by the generalised pigeonhole principle.

Fingerprints of t bits apart agree, in at least one of m bit groups, up to that group's threshold,
if the thresholds sum to t - m + 1. Here

* correlated bits share a group, so that a group's values are skewed in the same rows;
* each fingerprint chooses its own thresholds: dynamic programming over the groups minimises keys
  probed plus candidates expected, estimated from histograms of half groups;
* it probes the index of group values with every value within its threshold, and candidates are
  verified by their distance inside the join.

Equal fingerprints are one row throughout. Before probing, each fingerprint takes an anchor: the
commonest fingerprint that shares a group value and lies within the distance. Pairs under one anchor
are linked already, so the join skips them and a dense group of near copies does not emit its pairs.
Links between anchors go to distributed connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import discard, materialize, prepare
from lamina.llm.components import components

BITS = 64
DISTANCE = 4
SHINGLE = 4
#: Groups of bits. Three keep a group's values apart up to some 10^8 distinct fingerprints.
GROUPS = 3
#: Cost of one probed key, in candidates verified.
PROBE_COST = 1.0


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of all runs of ``shingle`` words of a whole text, repeats included; of fewer words, the whole is the one run."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, 42)], "<u8")
    size = np.fromiter(map(len, words), np.int64, n)
    after = np.cumsum(size + 1) - 1
    starts, ends = (after - size)[: n - shingle + 1].tolist(), after[shingle - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), "<u8", n - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash: the bits set in over half the hashes; 0 for none."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        votes += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a whole text; 0 for null and for texts without words."""
    return majority(shingle_hashes(text, shingle))


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` plus ``fp``; a column of that name is replaced."""
    prepare(docs.sparkSession)

    @F.pandas_udf("bigint")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn("fp", fingerprint(F.col(text_col)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), one row per document."""
    return with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", shingle).select("doc_id", "fp")


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Row count and the matrix of joint bit counts; a row per pair of bits reaches the driver."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        n = 0
        for f in frames:
            x = bits_of(f["fp"].to_numpy()).astype(np.float32)
            total += x.T @ x
            n += len(f)
        if n:
            i, j = np.divmod(np.arange(BITS * BITS), BITS)
            yield pd.DataFrame({"i": i, "j": j, "n": n, "both": total.ravel().astype(np.int64)})

    rows = fps.mapInPandas(task, "i bigint, j bigint, n bigint, both bigint").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("both").alias("both")).collect()
    joint = np.zeros((BITS, BITS))
    for r in rows:
        joint[r["i"], r["j"]] = r["both"]
    return (rows[0]["n"] if rows else 0), joint


def group_bits(n: int, joint: np.ndarray, groups: int) -> list[list[int]]:
    """Split the bits into groups of equal size, correlated bits together (greedy by mean |correlation|)."""
    p = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((joint / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for g in range(groups):
        size = -(-len(left) // (groups - g))
        order = sorted(left)
        first = max(order, key=lambda b: (corr[b, order].sum(), -b))
        group = [first]
        left.discard(first)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


class Layout:
    """Bit groups as contiguous ranges of a permuted fingerprint, and the half groups of the estimate."""

    def __init__(self, groups: list[list[int]]):
        self.order = np.array([b for g in groups for b in g])
        self.widths = [len(g) for g in groups]
        self.begins = np.concatenate([[0], np.cumsum(self.widths)[:-1]]).tolist()
        self.halves = [[(b, w // 2), (b + w // 2, w - w // 2)] for b, w in zip(self.begins, self.widths, strict=True)]

    def permuted(self, fps: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.packbits(bits_of(fps)[:, self.order], axis=1, bitorder="little")).view("<i8").ravel()

    @staticmethod
    def cut(values: np.ndarray, begin: int, width: int) -> np.ndarray:
        return ((values.view(np.uint64) >> np.uint64(begin)) & np.uint64(2**width - 1)).astype(np.int64)


def near_counts(histogram: np.ndarray, width: int, most: int) -> np.ndarray:
    """For each value of a half group, the share of rows at distance 0..most of it.

    Adding one bit at a time: rows at distance d agree in the bit and lie at d before, or differ in it and lie at d - 1.
    """
    share = np.zeros((most + 1, len(histogram)))
    share[0] = histogram / max(histogram.sum(), 1)
    values = np.arange(len(histogram))
    for bit in range(width):
        other = share[:, values ^ (1 << bit)]
        share = share + np.vstack([np.zeros(len(histogram)), other[:-1]])
    return share


def thresholds(expected: np.ndarray, probes: np.ndarray, total: int) -> np.ndarray:
    """Per row the thresholds (-1: group unused) that sum to ``total`` at least cost.

    ``expected[g, e + 1, row]`` candidates and ``probes[g, e + 1]`` keys at threshold e of group g.
    """
    groups, options, rows = expected.shape
    cost = expected + PROBE_COST * probes[:, :, None]
    low, high = -groups, total + groups  # later groups may take -1 each
    best = np.full((high - low + 1, rows), np.inf)
    best[-low] = 0
    choice = []
    for g in range(groups):
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for k in range(options):
            e = k - 1
            for s in range(best.shape[0]):
                t = s + e
                if 0 <= t < best.shape[0]:
                    c = best[s] + cost[g, k]
                    better = c < new[t]
                    new[t][better] = c[better]
                    pick[t][better] = e
        best = new
        choice.append(pick)
    out, at = np.zeros((groups, rows), np.int8), np.full(rows, total - low)
    for g in reversed(range(groups)):
        out[g] = choice[g][at, np.arange(rows)]
        at = at - out[g]
    return out


def masks(width: int, radius: int) -> np.ndarray:
    """All words of ``width`` bits with at most ``radius`` ones."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], dtype=np.int64)


#: Places of a key: group number above, group value below.
KEY_SHIFT = 40


def probe(fps: DataFrame, distance: int = DISTANCE, groups: int = GROUPS) -> tuple[DataFrame, DataFrame]:
    """Labels (fp, p, anchor) of distinct ``fps`` (fp, copies), and pairs (q, p, q_anchor, anchor) within the distance.

    p and q are fingerprints with their bits put in another order. Each fingerprint lies within the distance of its
    anchor; pairs under one anchor are left out. ``fps`` is read several times and must be a stored table, as the
    labels are.
    """
    spark = prepare(fps.sparkSession)
    n, joint = bit_moments(fps.select("fp"))
    layout = Layout(group_bits(n, joint, groups))

    @F.pandas_udf("bigint")
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(layout.permuted(x.to_numpy()))

    def value(begin: int, width: int):
        return F.shiftrightunsigned("p", begin).bitwiseAND(F.lit(2**width - 1))

    def near(a: str, b: str):
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance

    rows = materialize(fps.select("fp", "copies", permuted("fp").alias("p")), "permuted")
    halves = [h for g in layout.halves for h in g]
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), value(*h).alias("v")) for k, h in enumerate(halves)])).alias("c"))
    counted = cells.groupBy("c.k", "c.v").agg(F.count("*").alias("n")).collect()  # at most 2 * groups * 2^(half width) rows
    most = distance  # a group may take it all if the others are not used
    shares = []
    for k, (_, width) in enumerate(halves):
        h = np.zeros(2**width)
        for r in counted:
            if r["k"] == k:
                h[r["v"]] = r["n"]
        shares.append(near_counts(h, width, most))
    total = distance - groups + 1
    radii = [masks(w, max(0, most)) for w in layout.widths]
    sizes = np.array([[0] + [int(sum(1 for m in r.tolist() if m.bit_count() <= e)) for e in range(most + 1)] for r in radii], dtype=float)

    keys = F.explode(F.array(*[F.lit(g << KEY_SHIFT) + value(b, w) for g, (b, w) in enumerate(zip(layout.begins, layout.widths, strict=True))]))

    # Anchors: of each group value the fingerprint with most copies, then the least one.
    spread = rows.select("p", "copies", keys.alias("key"))
    heads = spread.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("copies", (-F.col("p")).alias("q"), "p")).alias("h")).filter("n > 1").select("key", F.col("h.p").alias("head"), F.col("h.copies").alias("head_copies"))
    anchored = spread.join(heads, "key").filter(near("p", "head")).groupBy("p").agg(F.max(F.struct("head_copies", (-F.col("head")).alias("q"), "head")).alias("h")).select("p", F.col("h.head").alias("anchor"))
    labelled = materialize(rows.join(anchored, "p", "left").select("fp", "p", F.coalesce("anchor", "p").alias("anchor")), "anchors")
    discard(rows)

    def probes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = f["p"].to_numpy()
            expected = np.zeros((groups, most + 2, len(p)))
            for g in range(groups):
                a, b = (shares[2 * g + k][:, Layout.cut(p, *layout.halves[g][k])] for k in (0, 1))
                at = np.array([sum(a[i] * b[d - i] for i in range(d + 1)) for d in range(most + 1)])
                expected[g, 1:] = n * np.cumsum(at, axis=0)
            chosen = thresholds(expected, sizes, total)
            for g in range(groups):
                v = Layout.cut(p, layout.begins[g], layout.widths[g])
                for e in range(most + 1):
                    mine = np.flatnonzero(chosen[g] == e)
                    if len(mine):
                        m = radii[g][: int(sizes[g, e + 1])]
                        for at in range(0, len(mine), 4096):
                            rows_ = mine[at : at + 4096]
                            key = (v[rows_, None] ^ m[None, :]).ravel() + (g << KEY_SHIFT)
                            i = np.repeat(rows_, len(m))
                            yield pd.DataFrame({"key": key, "q": p[i], "q_anchor": f["anchor"].to_numpy()[i]})

    probed = labelled.select("p", "anchor").mapInPandas(probes, "key bigint, q bigint, q_anchor bigint")
    index = labelled.select("p", "anchor", keys.alias("key"))
    # A pair is probed from both sides; the lesser one is enough, as its own thresholds find all others.
    found = probed.join(index, (probed.key == index.key) & (F.col("q") < F.col("p")) & (F.col("q_anchor") != F.col("anchor")) & near("q", "p"))
    return labelled, found.select("q", "p", "q_anchor", "anchor")


def link(fps: DataFrame, distance: int = DISTANCE, groups: int = GROUPS) -> DataFrame:
    """(fp, root) for distinct ``fps`` (fp, copies): fingerprints of one component share ``root``. A stored table."""
    labelled, found = probe(fps, distance, groups)
    edges = found.select(F.col("q_anchor").alias("a"), F.col("anchor").alias("b")).unionByName(labelled.filter("p <> anchor").select(F.col("p").alias("a"), F.col("anchor").alias("b")))
    linked = components(edges)
    out = materialize(labelled.join(linked, labelled.p == linked.node, "left").select("fp", F.coalesce("root", "p").alias("root")), "roots")
    discard(labelled, linked)
    return out


def near_pairs(fps: DataFrame, distance: int = DISTANCE, groups: int = GROUPS) -> DataFrame:
    """(a, b): pairs of distinct ``fps`` (fp, copies) within the distance that connect all that are. A stored table.

    Each fingerprint is paired with its anchor, and with every other within the distance that has another anchor.
    """
    labelled, found = probe(fps, distance, groups)
    named = lambda c: labelled.select(F.col("p").alias(c), F.col("fp").alias(f"fp_{c}"))
    across = found.select("q", "p").join(named("p"), "p").join(named("q"), "q").select(F.col("fp_q").alias("a"), F.col("fp_p").alias("b"))
    under = labelled.filter("p <> anchor").select("fp", "anchor").join(named("anchor"), "anchor").select(F.col("fp_anchor").alias("a"), F.col("fp").alias("b"))
    out = materialize(across.unionByName(under), "near-pairs", small=True)
    discard(labelled)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, root, component_id), one row per document; ``root`` names the component.

    ``component_id`` is the least id reachable over links of at most ``distance`` differing bits.
    Null, empty and wordless texts have fingerprint 0 and are linked like others; very long texts are
    hashed whole, 65,536 shingles at a time; repeated rows each keep theirs; a null id is never a component's least id unless all its ids are null; other
    columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    hashed = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(hashed.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "distinct")
    roots = link(distinct.select("fp", "copies"), distance)
    # Stored, so that the join below meets two plain exchanges: adaptive execution may split a root of very many fingerprints.
    least = materialize(distinct.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = materialize(roots.join(least, "root").select("fp", "root", "component_id"), "components")
    discard(distinct, roots, least)
    return hashed.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
