"""Near-duplicates and decontamination against brute force, with nulls, copies, ties and empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from lamina.llm import components, decontaminate, simhash

VOCABULARY = [f"w{i}" for i in range(400)] + ["Über", "ÉTÉ", "naïve", "Σς"]


def text(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        base = text(rng, rng.randrange(0, 400)).split(" ")
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            rows.append((len(rows) * 3 - 50, " ".join(w)))
    rows += [(9001, None), (9000, ""), (9002, " \t\n"), (None, rows[0][1]), (9003, "one two"), (9003, "one two"), (9004, "ONE TWO"), (9005, "x " * 30_000)]
    docs = spark.createDataFrame([(*r, 7, 7) for r in rows], "doc_id bigint, text string, fp int, root int")
    got = simhash.near_duplicates(docs).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps, 4)
    least = {}
    for r, (i, _) in zip(roots, rows):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    want = collections.Counter((i, signed(f), least.get(r)) for (i, _), f, r in zip(rows, fps, roots))
    assert collections.Counter((r.doc_id, r.fp, r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_of_random_fingerprints(spark):
    """Dense balls of fingerprints: every link within four bits is found, at any bit."""
    rng = np.random.default_rng(2)
    fps = set()
    for _ in range(25):
        centre = int(rng.integers(-(2**63), 2**63))
        for _ in range(25):
            x = centre
            for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                x ^= 1 << int(b)
            fps.add((x + 2**63) % 2**64 - 2**63)
    fps = sorted(fps)
    for groups in (2, 3, 5):
        table = spark.createDataFrame([(f, 1) for f in fps], "fp bigint, copies bigint")
        got = {r.fp: r.root for r in simhash.link(table, 4, groups).collect()}
        want = plain_components([f % 2**64 for f in fps], 4)
        pairs = lambda label: {tuple(sorted(v)) for v in label.values()}
        a, b = collections.defaultdict(list), collections.defaultdict(list)
        for f, w in zip(fps, want):
            a[got[f]].append(f)
            b[w].append(f)
        assert pairs(a) == pairs(b)


def test_thresholds_are_cheapest():
    import itertools

    rng = np.random.default_rng(3)
    expected, probes = rng.random((3, 6, 4)) * 100, rng.random((3, 6)) * 50
    expected[:, 0], probes[:, 0] = 0, 0
    expected, probes = np.sort(expected, axis=1), np.sort(probes, axis=1)
    got = simhash.thresholds(expected, probes, 2)
    cost = lambda t, r: sum(expected[g, e + 1, r] + simhash.PROBE_COST * probes[g, e + 1] for g, e in enumerate(t))
    for r in range(4):
        assert got[:, r].sum() == 2
        assert cost(got[:, r], r) == pytest.approx(min(cost(t, r) for t in itertools.product(range(-1, 5), repeat=3) if sum(t) == 2))


def test_near_counts():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 5, 32).astype(float)
    got = simhash.near_counts(h, 5, 4)
    for v in range(32):
        for d in range(5):
            assert got[d, v] == pytest.approx(sum(h[u] for u in range(32) if (u ^ v).bit_count() == d) / h.sum())


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got.get(i, i) for i in range(61)} == {0} and {got.get(i, i) for i in range(100, 140)} == {100}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_overlap(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(13, len(w))
        for a in range(len(w) - k + 1) if w else ():
            windows[tuple(w[a : a + k])].add(None if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    ids |= windows[tuple(w[a : a + k])]
        ids.discard(None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return collections.Counter(out)


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, text(rng, rng.choice([3, 12, 13, 14, 30, 60]))) for i in range(40)] + [(90, None), (91, "..."), (92, "solo"), (None, text(rng, 20)), (10, text(rng, 15)), (95, "a a a a a a a a a a a a a a a")]
    items.append((96, items[5][1]))
    docs = [(900, None), (901, ""), (902, "-- !!"), (903, "solo"), (904, "SOLO, é solo"), (905, "a " * 40), (906, "A a " * 6 + "b"), (None, items[3][1]), (907, text(rng, 30_000) + " " + items[7][1])]
    for i in range(120):
        parts = [text(rng, rng.randrange(0, 60)) for _ in range(3)]
        w = (rng.choice(items)[1] or "").split(" ")
        a = rng.randrange(0, max(1, len(w)))
        docs.append((i // 2, parts[0] + " " + " ".join(w[a : a + rng.randrange(1, 40)]).upper() + ", " + parts[1]))
    docs += [docs[20]] * 50
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, overlap string, item int")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, words int")
    got = decontaminate.digest(decontaminate.find(frame, bench)).collect()
    assert collections.Counter(map(tuple, got)) == plain_overlap(docs, items)
    assert decontaminate.find(frame.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.digest(decontaminate.find(frame, bench.limit(0))).collect())
    clean = decontaminate.find(frame, bench).filter("not overlap.contaminated").select("doc_id", "text")
    assert clean.count() == sum(n for k, n in plain_overlap(docs, items).items() if not k[5])
