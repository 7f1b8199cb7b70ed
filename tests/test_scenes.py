"""Scene boundaries, guards, tone and the other frame measures against plain loops."""

import numpy as np
import pytest
from lamina import catalog
from lamina.functions import kernels
from lamina.operators import scenes
from lamina.sources import adapters

DATA = "/root/testdata/sf0.001"


def backdrop(h=60, w=80, x=30, colour=(40, 45, 50)):
    a = np.full((h, w, 3), 220, np.uint8)
    a[15:40, x : x + 12] = colour
    return a


def test_subject_bounds():
    x, y, w, h = scenes.subject_bounds(backdrop())
    assert abs(x - 30) <= 1 and abs(y - 15) <= 1 and abs(w - 12) <= 2 and abs(h - 25) <= 2
    edge = backdrop()
    edge[:, :6] = 20  # a stand at the border is no subject
    assert scenes.subject_bounds(edge)[0] >= 28
    assert scenes.subject_bounds(np.full((60, 80, 3), 220, np.uint8)) is None
    assert scenes.subject_bounds(np.full((60, 80, 3), 100, np.uint8)) is None
    coloured = backdrop()
    coloured[:, :, 2] = 30
    assert scenes.subject_bounds(coloured) is None


def test_subject_difference_allows_small_shifts():
    box = lambda a: scenes.subject_bounds(a)
    d = lambda a, b: scenes.subject_difference(scenes.soft(a, 2.0), box(a), scenes.soft(b, 2.0), box(b))
    a = backdrop()
    assert d(a, a) == 0 and d(a, backdrop(x=31)) < 0.01 and d(a, backdrop(x=52)) > scenes.SUBJECT_CHANGE
    plain = np.full((4, 5, 3), 0.1)
    lit = plain.copy()
    lit[0, 0] = 0.9
    assert scenes.composition_difference(plain, plain + 0.02) == pytest.approx(0.02) and scenes.composition_difference(plain, lit) == pytest.approx(0.8)


def previews(spark, rows):
    return spark.createDataFrame([(1, f, f"{a.shape[0]}x{a.shape[1]}", float(t), *a.shape[:2], a.ravel().astype(int).tolist(), issue) for f, (a, t, issue) in enumerate(rows)], "g int, f bigint, shape string, at double, height int, width int, rgb array<int>, issue string")


def test_boundaries(spark):
    a, moved, wide, bright = backdrop(), backdrop(x=52), backdrop(80, 60, 20), np.minimum(backdrop().astype(int) + 3, 255).astype(np.uint8)
    cases = [(a, 0, None), (a, 1, None), (moved, 2, None), (moved, 3, None), (wide, 4, None), (wide, 3, None), (wide, 90, None), (wide, 91, "broken"), (wide, 92, None), (a, 93, None), (bright, 94, None), (a, 118, None)]
    got = [r.group_no for r in scenes.split(scenes.features(previews(spark, cases))).orderBy("f").collect()]
    # moved subject, turned, time backwards, long pause, unreadable alone, after it, turned back, a slight change alone, a slight change with a pause
    assert got == [0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 7, 8]
    rows = scenes.split(scenes.features(previews(spark, cases))).orderBy("f").collect()
    assert [r.excluded_reason for r in rows if r.excluded_reason] == ["broken"] and rows[7].confidence == 0.0
    assert scenes.split(scenes.features(previews(spark, cases).limit(0))).count() == 0


def test_scene_split_query(spark):
    rows = scenes.fixture(spark.read.parquet(f"{DATA}/embeddings.parquet")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.g, r.f)):
        by.setdefault(r.g, []).append(r)
    want = {}
    for g, frames in by.items():
        no, last = 0, None
        for r in frames:
            rgb = np.array(r.rgb, np.uint8).reshape(r.height, r.width, 3)
            if last is not None:
                cut = r.issue is not None or last[0].issue is not None or r.shape != last[0].shape
                gap = r.at - last[0].at
                cut = cut or gap < 0 or gap > 60
                if not cut:
                    change = scenes.composition_difference(scenes.soft(last[1], 3.0) / 255, scenes.soft(rgb, 3.0) / 255)
                    a, b = scenes.subject_bounds(last[1]), scenes.subject_bounds(rgb)
                    other = a is not None and b is not None and scenes.subject_difference(scenes.soft(last[1], 2.0), a, scenes.soft(rgb, 2.0), b) > 0.09
                    cut = change > 0.025 or other or (gap >= 20 and change > 0.006)
                no += bool(cut)
            want[g, r.f] = (no, r.issue)
            last = (r, rgb)
    got = {(r.g, r.f): (r.group_no, r.excluded_reason) for r in catalog.queries()["scene_split"](spark, DATA).collect()}
    assert got == want and max(n for n, _ in got.values()) > 3


@pytest.fixture(scope="module")
def groups(spark):
    out = {}
    for r in adapters.maps(spark, DATA).orderBy("g", "f").collect():
        out.setdefault(r.g, []).append((r.f, np.array(r.m).reshape(8, 8) / 65535))
    return out


def rows(spark, name, *key):
    return {tuple(r[k] for k in key): r for r in catalog.queries()[name](spark, DATA).collect()}


def test_edge_guard_query(spark, groups):
    got = rows(spark, "edge_guard", "g", "p")
    for g, frames in groups.items():
        s = np.array([kernels.gaussian(np.abs(kernels.laplacian(x)), 1.0) for _, x in frames])
        ids, best = np.array([f for f, _ in frames]), s.max(axis=0)
        want = kernels.edge_guard(ids[s.argmax(axis=0)], s, ids, best > np.percentile(best, 65))
        assert [got[g, p].owner for p in range(64)] == want.ravel().tolist()


def test_gains_contours_and_centrelines(spark, groups):
    from lamina.functions import align

    gains, energy, lines = rows(spark, "gain_overlap", "g", "f"), rows(spark, "contour_energy", "g", "f", "p"), rows(spark, "centreline_check", "g", "f")
    for g, frames in list(groups.items())[:3]:
        ref = frames[0][1]
        for f, x in frames[:12]:
            t, _, _ = align.register(ref[None], x[None])
            moved, inside = align.warp(x[None], t)[0], align.valid((8, 8), t[0])
            block = lambda a, f: np.array([[f(a[2 * i : 2 * i + 2, 2 * j : 2 * j + 2]) for j in range(4)] for i in range(4)])
            a, b, use = block(ref, np.mean), block(moved, np.mean), block(inside, np.all)
            good = use & (a > 0.02) & (b > 0.02) & (a < 0.98) & (b < 0.98)
            assert gains[g, f].overlap == pytest.approx(use.mean())
            assert gains[g, f].gain == pytest.approx(min(1.1, max(0.9, np.median(a[good] / b[good]))) if good.any() else 1.0)
            seeds = x > np.percentile(x, 70)
            d = kernels.gaussian(seeds.astype(float), 2.0)
            want = kernels.gaussian(kernels.gradient(x) * np.sqrt(np.abs(kernels.laplacian(x))) * seeds, 2.0) / d
            assert np.allclose([energy[g, f, p].energy for p in range(64)], want.ravel(), atol=1e-8)
            found = kernels.centreline(ref > 0.12, x > 0.12, 6, 3)
            assert lines[g, f].strips == (None if found is None else found[0])


def test_centreline_of_long_shapes():
    a = np.zeros((60, 300), bool)
    a[25:35, 20:280] = True
    shifted, bent = np.roll(a, 5, axis=0), a.copy()
    bent[:, 200:] = np.roll(a, 12, axis=0)[:, 200:]
    n, offset, length, width = kernels.centreline(a, a)
    assert n >= 20 and offset == 0 and length == pytest.approx(1) and width == pytest.approx(1)
    assert kernels.centreline(a, shifted)[1] == pytest.approx(5) and kernels.centreline(a, bent)[1] > 5
    assert kernels.centreline(np.ones((20, 20), bool), a) is None and kernels.centreline(a, a & False) is None


def test_tone_of_materials(spark):
    got = {}
    for r in catalog.queries()["tone_harmonised"](spark, DATA).collect():
        got.setdefault((r.g, r.f), {})[r.p] = (r.r, r.gr, r.b)
    frames = {}
    for r in adapters.colours(spark, DATA).collect():
        frames.setdefault(r.g, []).append((r.f, np.stack([np.array(c).reshape(8, 8) for c in (r.r, r.gr, r.b)], axis=2)))
    kind = lambda c: (4 + int(np.argmax(c))) if max(c) - min(c) >= 50 else (0 if max(c) < 64 else 1 if max(c) < 160 else 2)
    changed = 0
    for g, listed in list(frames.items())[:2]:
        ref = min(listed, key=lambda x: x[0])[1]
        for f, own in listed[:8]:
            m, n = (np.array([[kind(a[y, x]) for x in range(8)] for y in range(8)]) for a in (own, ref))
            want = own.astype(float)
            for k in set(m.ravel()):
                core = (m == k) & (n == k)
                if core.sum() < 4:
                    continue
                density = kernels.gaussian(core.astype(float), 2.0)
                for y, x in np.argwhere(m == k):
                    off = np.array([kernels.gaussian((ref[:, :, c] - own[:, :, c].astype(float)) * core, 2.0)[y, x] for c in range(3)]) / max(density[y, x], 1e-6)
                    top = np.abs(off).max()
                    weight = np.clip((top - 1) / 3, 0, 1) * np.clip((40 - top) / 20, 0, 1) * np.clip(density[y, x] / 0.2, 0, 1)
                    want[y, x] = own[y, x] + off * weight
            want = np.clip(np.rint(want), 0, 255).astype(int)
            assert [got[g, f][p] for p in range(64)] == [tuple(want[p // 8, p % 8]) for p in range(64)]
            changed += int((want != own).sum())
    assert changed > 0
