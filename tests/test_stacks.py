"""Whole-stack queries without SQL against plain versions: loops over frames and positions, one group at a time."""

import itertools

import numpy as np
import pytest
from lamina import catalog
from lamina.functions import align, cover, kernels, passes, paths
from lamina.operators import stacks
from lamina.sources import adapters

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def groups(spark):
    """{group: (frames, values 0..1 as frames x 64)}"""
    out = {}
    for r in adapters.maps(spark, DATA).orderBy("g", "f").collect():
        out.setdefault(r.g, []).append((r.f, r.m))
    return {g: ([f for f, _ in v], np.array([m for _, m in v]) / 65535) for g, v in out.items()}


def rows(spark, name, *key):
    return {tuple(r[k] for k in key): r for r in catalog.queries()[name](spark, DATA).collect()}


def reflected(i, n):
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i


def plain_gaussian(a, sigma):
    r = max(1, int(np.ceil(3 * sigma)))
    if min(a.shape) <= r:  # a border wider than the image carries the edge on
        at = lambda i, n: min(max(i, 0), n - 1)
    else:
        at = reflected
    k = {d: np.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)}
    total, (h, w) = sum(k.values()), a.shape
    rows_ = np.array([[sum(k[d] * a[at(y + d, h), x] for d in k) for x in range(w)] for y in range(h)]) / total
    return np.array([[sum(k[d] * rows_[y, at(x + d, w)] for d in k) for x in range(w)] for y in range(h)]) / total


def plain_laplacian(a):
    h, w = a.shape
    return np.array([[sum(a[reflected(y + dy, h), reflected(x + dx, w)] for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))) - 4 * a[y, x] for x in range(w)] for y in range(h)])


def plain_normal(a):
    lo, hi = np.percentile(a, 1), np.percentile(a, 99)
    if hi <= lo:
        lo, hi = a.min(), a.max()
    return np.clip((a - lo) / (hi - lo), 0, 1) if hi > lo else a * 0


def plain_focus(a):
    total, (h, w) = 0, a.shape
    for s in (0.8, 1.6, 3.2):
        b = plain_gaussian(a, s)
        at = lambda y, x: b[reflected(y, h), reflected(x, w)]
        grad, var = np.zeros(a.shape), np.zeros(a.shape)
        for y, x in itertools.product(range(h), range(w)):
            gx = sum(c * (at(y + d, x + 1) - at(y + d, x - 1)) for d, c in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(c * (at(y + 1, x + d) - at(y - 1, x + d)) for d, c in ((-1, 1), (0, 2), (1, 1)))
            grad[y, x] = np.hypot(gx, gy)
            var[y, x] = np.var([at(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        total = total + 0.5 * plain_normal(abs(plain_laplacian(b))) + 0.3 * plain_normal(grad) + 0.2 * plain_normal(var)
    total = total / 3
    total = np.where((a <= 0.01) | (a >= 0.99), 0.65 * total, total)
    return np.clip(plain_gaussian(total, 0.6), 0, 1)


def plain_texture(a):
    return plain_gaussian((plain_gaussian(a, 0.6) - plain_gaussian(a, 2.4)) ** 2, 2.0)


def test_kernels():
    a = np.random.default_rng(1).random((11, 14))
    for s in (0.6, 1.0, 3.2):
        assert np.allclose(kernels.gaussian(a, s), plain_gaussian(a, s))
    assert np.allclose(kernels.laplacian(a), plain_laplacian(a))
    assert np.allclose(kernels.focus_map(a), plain_focus(a))
    assert np.allclose(kernels.texture_energy(a), plain_texture(a))
    near = lambda y, x: [a[reflected(y + i, 11), reflected(x + j, 14)] for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert np.allclose(kernels.box_variance(a), [[np.var(near(y, x)) for x in range(14)] for y in range(11)])
    mask = np.zeros((20, 20), bool)
    for i in range(15):
        mask[3 + i // 2, 2 + i] = mask[4 + i // 2, 2 + i] = True
    angle, major, minor = kernels.principal_axis(mask)
    y, x = np.nonzero(mask)
    t = np.radians(np.arange(0, 180, 0.05))
    spread = [np.var(x * np.cos(u) + y * np.sin(u)) for u in t]
    assert angle == pytest.approx(np.degrees(t[int(np.argmax(spread))]), abs=0.1) and major == pytest.approx(max(spread), rel=1e-5) and minor == pytest.approx(min(spread), rel=1e-3)
    m = np.random.default_rng(2).random((9, 13)) < 0.8
    assert (kernels.shrunk(m, 4) == [[m[4 * i : 4 * i + 4, 4 * j : 4 * j + 4].all() for j in range(4)] for i in range(3)]).all()
    assert kernels.padded(a).shape == (64, 64) and (kernels.padded(a)[:11, :14] == a).all()
    assert np.allclose(kernels.masked_smooth(a * 0 + 3.0, np.random.default_rng(3).random(a.shape) < 0.6, 1.0), 3.0)
    detail, seeds = np.random.default_rng(4).random(a.shape), a > 0.5
    d = plain_gaussian(seeds.astype(float), 2.0)
    assert np.allclose(kernels.contour_energy(a, detail, seeds, 2.0), plain_gaussian(a * np.sqrt(detail) * seeds, 2.0) / d)


def test_blends():
    rng = np.random.default_rng(4)
    stack, w = rng.random((3, 20, 23)), rng.random((3, 20, 23))
    assert np.allclose(kernels.pyramid_blend(np.stack([stack[0]] * 3), w), stack[0])  # equal frames come back
    assert np.allclose(kernels.pyramid_blend(stack, w, levels=1), (w * stack).sum(0) / w.sum(0))
    hard = np.stack([np.ones((20, 23)), np.zeros((20, 23)), np.zeros((20, 23))])
    assert np.allclose(kernels.pyramid_blend(stack, hard), stack[0])
    labels = np.zeros((12, 12), int)
    labels[:, 6:] = 5
    n = kernels.narrow(labels, np.array([0, 5]))
    assert np.allclose(n.sum(axis=0), 1) and (n[0][:, :5] == 1).all() and (n[1][:, 7:] == 1).all() and (0 < n[0][:, 5:7]).all() and (n[0][:, 5:7] < 1).all()


def test_settled_gives_small_regions_away():
    a = np.full((10, 10), 3)
    a[:, 5:] = 7
    a[2, 2] = 9
    a[5:8, 6:9] = 1  # nine positions stay
    out = kernels.settled(a, 8)
    want = a.copy()
    want[2, 2] = 3
    assert (out == want).all()


def test_edge_guard():
    labels, edges = np.zeros((9, 9), int), np.zeros((9, 9), bool)
    edges[4, 2:7] = True
    strength = np.ones((2, 9, 9))
    strength[1, 4, 2:7] = 3
    strength[0, 2, 2] = 5
    out = kernels.edge_guard(labels, strength, np.array([10, 20]), edges, 2)
    assert out[4, 4] == 20 and out[2, 4] == 20 and out[2, 2] == 0 and out[0, 0] == 0


def plain_cover(sharp, support, quality, frames, least, enough, bonus):
    total, covered, taken, gains = max(1, support.sum()), np.zeros(len(support), bool), [], {}
    left = list(frames)
    while left:
        new = {i: int((sharp[i] & support & ~covered).sum()) for i in left}
        i = max(left, key=lambda c: (new[c] + (bonus[c] if taken else 0), quality[c], -c))
        gains[i] = new[i] / total
        if taken and gains[i] < least:
            break
        taken.append(i)
        left.remove(i)
        covered |= sharp[i] & support
        if covered.sum() / total >= enough:
            break
    return taken, gains, covered.sum() / total


def test_cover_equals_plain_greedy():
    rng = np.random.default_rng(5)
    for n, p in ((1, 5), (6, 64), (9, 130), (12, 300)):
        for _ in range(30):
            x = rng.integers(0, 12, (n, p)) / 11
            quality, failed = rng.integers(0, 4, n) / 3, rng.random(n) < 0.2
            best = x.max(axis=0)
            useful = best > max(0.002 * best.max(), 1e-7)
            got = cover.near_best(x, quality, failed)
            assert (got.taken, got.gains, got.covered) == plain_cover(x >= 0.9 * best, useful, quality, np.flatnonzero(~failed), 0.0005, 0.9995, quality * 0)
            support = best >= 0.15 if (best >= 0.15).any() else best > 0
            got = cover.library(x, quality)
            bonus = 0.01 * quality / n * max(1, support.sum())
            want = plain_cover(x >= 0.95 * np.maximum(best, 1e-6), support, quality, range(n), 0.002, 0.995, bonus)
            assert (got.taken, got.gains, got.covered) == want


def test_cover_of_bands():
    m = np.full((5, 60), 0.05)
    for i in range(3):
        m[i, 20 * i : 20 * i + 20] = 1.0
    m[3] = m[0]
    got = cover.near_best(m, m.mean(axis=1), np.zeros(5, bool))
    assert sorted(got.taken) == [0, 1, 2] and got.covered == 1.0 and got.gains[0] == pytest.approx(1 / 3)
    assert cover.near_best(m, m.mean(axis=1), np.array([True, False, False, False, False])).taken[:3] == [1, 2, 3]
    assert cover.near_best(np.zeros((2, 5)), np.zeros(2), np.zeros(2, bool)).covered == 0
    soft = np.full((4, 60), 0.1)
    for i in range(3):
        soft[i, 20 * i : 20 * i + 20] = 1.0
    soft[3] = 0.5
    got = cover.library(soft, soft.mean(axis=1))
    assert sorted(got.taken) == [0, 1, 2] and got.reason(3) == "nothing new" and got.reason(got.taken[0]) == "seed"


def test_library_coverage(spark, groups):
    got = rows(spark, "library_coverage", "g", "f")
    for g, (frames, x) in groups.items():
        top = x.max(axis=0)
        support = top >= 0.15
        taken, gains, covered = plain_cover(x >= 0.95 * top, support, x.mean(axis=1), range(len(x)), 0.002, 0.995, 0.01 * x.mean(axis=1) / len(x) * support.sum())
        order, left = [taken[0]], taken[1:]
        while left:
            order.append(min(left, key=lambda k: (1 - kernels.similarity(x[order[-1]], x[k]), k)))
            left.remove(order[-1])
        for i, f in enumerate(frames):
            r = got[g, f]
            assert r.place == (order.index(i) if i in taken else None) and r.coverage == pytest.approx(covered)
            assert r.gain == pytest.approx(gains.get(i, 0.0)) and r.reason == ("seed" if i == taken[0] else "new positions" if i in taken else "too few new positions" if i in gains else "nothing new")


def test_whole_frame_selection(spark, groups):
    got = rows(spark, "whole_frame_selection", "g", "f")
    for g, (frames, x) in list(groups.items())[:3]:
        images = [a.reshape(8, 8) for a in x]
        quality = np.array([kernels.image_quality(a) for a in images])
        reference = int(quality.argmax())
        maps = []
        for a in images:
            t, _, _ = align.register(images[reference][None], a[None])
            maps.append(plain_focus(np.rint(align.warp(a[None], t)[0] * 65535) / 65535).ravel())
        maps = np.array(maps)
        best = maps.max(axis=0)
        taken, gains, covered = plain_cover(maps >= 0.9 * best, best > max(0.002 * best.max(), 1e-7), quality, range(len(x)), 0.0005, 0.9995, quality * 0)
        for i, f in enumerate(frames):
            r = got[g, f]
            assert r.selected == (i in taken or i == reference) and r.gain == pytest.approx(gains[i] if i in taken else 0) and r.coverage == pytest.approx(covered)


def test_clusters_and_kept(spark, groups):
    got, kept = rows(spark, "focus_clusters", "g", "f"), rows(spark, "dedup_keep_best", "g", "f")
    for g, (frames, x) in groups.items():
        heads, label = [], []
        for i in range(len(x)):
            k = next((k for k, h in enumerate(heads) if kernels.similarity(x[i], x[h]) >= stacks.CLUSTER), None)
            if k is None:
                heads.append(i)
                k = len(heads) - 1
            elif x[i].mean() > x[heads[k]].mean():
                heads[k] = i
            label.append(k)
        for i, f in enumerate(frames):
            assert got[g, f].cluster == label[i] and got[g, f].representative == (heads[label[i]] == i)
        assert {f: r.reason for (h, f), r in kept.items() if h == g} == {
            frames[i]: "only frame of its cluster" if label.count(k) == 1 else f"best of {label.count(k)} alike" for k, i in enumerate(heads)
        }


def test_alignment_order(spark, groups):
    got = rows(spark, "alignment_order", "g", "f")
    for g, (frames, x) in groups.items():
        path = [f for _, f in sorted((got[g, f].place, f) for f in frames)]
        assert sorted(path) == frames
        s = np.array([[kernels.similarity(a, b) for b in x] for a in x])
        at = [frames.index(f) for f in path]
        steps = [s[a, b] for a, b in zip(at, at[1:])]
        assert got[g, frames[0]].confidence == pytest.approx(np.mean(steps) if steps else 1.0)
        length = sum(1 - v for v in steps)
        for i, j in itertools.combinations(range(1, len(at)), 2):  # no turned part is shorter
            other = at[:i] + at[i : j + 1][::-1] + at[j + 1 :]
            assert length <= sum(1 - s[a, b] for a, b in zip(other, other[1:])) + 1e-6


def test_anchor_split(spark, groups):
    got = rows(spark, "anchor_split", "g", "f")
    for g, (frames, x) in groups.items():
        same = lambda a, b: kernels.similarity(x[a], x[b]) >= 0.55
        scenes, now, waiting = [], [], []
        for i in range(len(x)):
            if not now or any(same(i, a) for a in (now[0], now[-1], max(now, key=lambda k: (x[k].std(), -k)))):
                now += [*waiting, i]
                waiting = []
            else:
                waiting.append(i)
                if len(waiting) == 2:
                    scenes.append(now)
                    now, waiting = waiting, []
        scenes.append(now + waiting)
        assert [got[g, f].scene for f in frames] == [k for k, s in enumerate(scenes) for _ in s]


def plain_owner(images):
    s = np.array([plain_gaussian(abs(plain_laplacian(a)), 1.0) for a in images])
    return s, s.argmax(axis=0)


def moved(images):
    t, c, model = align.register(np.stack([images[0]] * len(images)), np.stack(images))
    return [np.rint(a * 65535) / 65535 for a in align.warp(np.stack(images), t)], c, model


def test_registration(spark, groups):
    got = rows(spark, "registration", "g", "f")
    for g, (frames, x) in groups.items():
        images = [a.reshape(8, 8) for a in x]
        for i, f in enumerate(frames):
            t = np.array(got[g, f].transform).reshape(1, 2, 3)
            c = np.corrcoef(images[0].ravel(), align.warp(images[i][None], t)[0].ravel())[0, 1]
            assert got[g, f].correlation == pytest.approx(c) and c >= np.corrcoef(images[0].ravel(), images[i].ravel())[0, 1] - 1e-9
            assert got[g, f].accepted == (c >= 0.9 and 0.8 <= float(align.scale_of(t)[0]) <= 1.25)
        assert got[g, frames[0]].model == "identity" and got[g, frames[0]].accepted


def disc_scene(seed, size=96):
    rng = np.random.default_rng(seed)
    a = np.full((size, size), 0.5)
    y, x = np.mgrid[0:size, 0:size]
    for _ in range(60):
        cy, cx, r, v = rng.integers(0, size), rng.integers(0, size), rng.integers(2, 9), rng.random()
        a[(y - cy) ** 2 + (x - cx) ** 2 <= r * r] = v
    return kernels.gaussian(a, 0.7)


def test_registration_of_shifts_and_turns():
    big = disc_scene(3, 128)
    fixed = big[16:112, 16:112]
    near = big[18:114, 15:111]
    t, c, model = align.register(fixed[None], near[None])
    assert c[0] > 0.98 and abs(t[0, 0, 2] - 1) < 0.3 and abs(t[0, 1, 2] + 2) < 0.3
    u = np.radians(9)
    m = np.array([[[1.05 * np.cos(u), -1.05 * np.sin(u), 9.0], [1.05 * np.sin(u), 1.05 * np.cos(u), -6.0]]])
    turned = align.warp(big[None], m)[0]
    found = align.by_features(turned, big)
    assert found is not None and np.abs(found[0][:, :2] - m[0, :, :2]).max() < 0.05 and found[1] > 0.5
    assert align.by_features(np.zeros((40, 40)), fixed) is None
    flat = np.full((1, 20, 20), 0.3)
    t, c, model = align.register(flat, flat)
    assert model[0] == "identity" and (t == align.identity(1)).all()
    assert align.valid((10, 10), np.array([[1.0, 0, 3], [0, 1, 0]])).sum() == 6 * 10
    random = np.random.default_rng(6).random((3, 24, 24))
    t, c, model = align.register(np.stack([random[0]] * 3), random)
    assert list(model) == ["identity"] * 3 and c[0] == pytest.approx(1.0)


def test_consensus_ignores_outliers():
    rng = np.random.default_rng(7)
    src = rng.random((60, 2)) * 100
    m = np.array([[0.9, 0.1, 5.0], [-0.2, 1.1, -3.0]])
    dst = src @ m[:, :2].T + m[:, 2]
    dst[:20] += rng.normal(0, 60, (20, 2))
    found, inside = align.consensus(src, dst)
    assert np.allclose(found, m, atol=0.05) and inside[20:].all()
    a = rng.integers(0, 2**63, (5, 4), dtype=np.uint64)
    b = np.vstack([a[::-1], rng.integers(0, 2**63, (9, 4), dtype=np.uint64)])
    d = np.array([[int(np.bitwise_count(x ^ y).sum()) for y in b] for x in a])
    want = [(i, int(np.argmin(r))) for i, r in enumerate(d) if np.sort(r)[0] < 0.75 * np.sort(r)[1]]
    assert align.matched(a, b) == want == [(i, 4 - i) for i in range(5)]


def locked(labels, s, images):
    best = s.max(axis=0)
    regions, n = kernels.components(best < np.percentile(best, 40))
    out = labels.copy()
    for k in range(1, n + 1):
        inside = regions == k
        if inside.sum() >= 6:
            tone = images[:, inside].mean(axis=1)
            out[inside] = int(np.abs(tone - np.median(tone)).argmin())
    return out


@pytest.mark.parametrize("name", ["fuse_quality", "fuse_narrow", "fuse_model"])
def test_fusion(spark, groups, name):
    got = rows(spark, name, "g", "p")
    for g, (frames, x) in list(groups.items())[:2]:
        images, _, _ = moved([a.reshape(8, 8) for a in x])
        s, owner = plain_owner(images)
        if name == "fuse_model":
            r = np.array([stacks.at_scales(lambda a: (plain_gaussian(abs(plain_laplacian(a)), 1.0) + plain_texture(a)) / 2, a) for a in images])
            e = np.exp((r - r.max(axis=0)) / r.std())
            want = (e * images).sum(axis=0) / e.sum(axis=0)
        else:
            labels = kernels.settled(owner)
            if name == "fuse_quality":
                labels = kernels.edge_guard(locked(labels, s, np.array(images)), s, np.arange(len(images)), s.max(axis=0) > np.percentile(s.max(axis=0), 65))
            used = sorted(set(labels.ravel()))
            w = np.array([plain_gaussian((labels == k).astype(float), 1.0) for k in used])
            if name == "fuse_narrow":
                wide = np.pad(labels, 1, mode="edge")
                seam = np.array([[len(set(wide[y : y + 3, x_ : x_ + 3].ravel())) > 1 for x_ in range(8)] for y in range(8)])
                w = np.where(seam, w / w.sum(axis=0), np.array([labels == k for k in used]))
            want = (w * np.array(images)[used]).sum(axis=0) / w.sum(axis=0)
        assert np.allclose([got[g, p].fused for p in range(64)], want.ravel())


def test_settled_owner_and_background(spark, groups):
    settled, background = rows(spark, "settled_owner", "g", "p"), rows(spark, "background_owner", "g", "p")
    for g, (frames, x) in groups.items():
        images = np.array([a.reshape(8, 8) for a in x])
        s, owner = plain_owner(images)
        assert [settled[g, p].owner for p in range(64)] == [frames[i] for i in kernels.settled(owner).ravel()]
        want = locked(owner, s, images)
        assert [background[g, p].owner for p in range(64)] == [frames[i] for i in want.ravel()]


def test_features_and_scores(spark, groups):
    got, scores, residual = rows(spark, "frame_features", "g", "f"), rows(spark, "scored_frames", "g", "f"), rows(spark, "residual_diagnostics", "g")
    for g, (frames, x) in groups.items():
        lengths = []
        for i, f in enumerate(frames):
            a, r = x[i].reshape(8, 8), got[g, f]
            t = np.percentile(a, 70)
            assert r.focus == pytest.approx(plain_focus(a).mean()) and r.texture == pytest.approx(plain_texture(a).mean())
            assert sum(r.histogram) == pytest.approx(1) and r.histogram[3] == pytest.approx(((a >= 3 / 32) & (a < 4 / 32)).mean())
            ys, xs = np.nonzero(a > t)
            assert r.major + r.minor == pytest.approx(np.var(xs) + np.var(ys))
            big = kernels.resize(a, 32, 32)
            n = np.arange(32)
            dct = np.array([[(big * np.outer(np.cos(np.pi * (2 * n + 1) * u / 64), np.cos(np.pi * (2 * n + 1) * v / 64))).sum() for v in range(8)] for u in range(8)])
            bits = (dct > np.median(dct.ravel()[1:])).ravel()
            assert r.hash % 2**64 == int("".join(str(int(b)) for b in bits), 2)
            lap, flat = plain_laplacian(a), np.abs(np.diff(a, axis=1, prepend=a[:, :1])) + np.abs(np.diff(a, axis=0, prepend=a[:1])) < 0.04
            flat = flat if flat.sum() >= 32 else np.ones((8, 8), bool)
            clip = lambda v: min(1.0, max(0.0, v))
            p2, p50, p98 = np.percentile(a, [2, 50, 98])
            t_, c_, model = align.register(x[0].reshape(1, 8, 8), a[None])
            (m00, m01, tx), (m10, m11, ty) = t_[0]
            size = np.sqrt(abs(m00 * m11 - m01 * m10))
            base = clip(c_[0])
            if model[0] == "identity" and not (c_[0] >= 0.9 and 0.8 <= size <= 1.25):
                base = max(base, 0.45 + 0.2 * clip(c_[0]))
            still = clip(0.95 * base + 0.05 * (1 - min(1, (abs(tx) + abs(ty)) / 80 + abs(np.log(size)) + abs(np.degrees(np.arctan2(m10, m00))) / 15)))
            assert scores[g, f].stability == pytest.approx(still, abs=1e-6)
            want = 0.45 * clip(np.log1p(lap.var() * 1200) / np.log1p(1200)) + 0.2 * scores[g, f].stability + 0.15 * clip(0.65 * clip(1 - abs(p50 - 0.5) * 1.35) + 0.35 * clip((p98 - p2) / 0.7))
            want += 0.1 * (1 - clip(((a <= 0.01) | (a >= 0.99)).mean() / 0.01)) + 0.1 * (1 - clip(((a - plain_gaussian(a, 1.2))[flat].std() - 0.008) / 0.08))
            assert scores[g, f].quality == pytest.approx(want, abs=1e-8)
            if r.peak >= 0.1:
                lengths.append(np.hypot(r.dy, r.dx))
        assert residual[g,].n == len(lengths) and residual[g,].residual == pytest.approx(np.median(lengths))


def test_strategies_models_and_bounds(spark, groups):
    @stacks.register_strategy("first")
    def first(maps):
        from pyspark.sql import functions as F

        m = maps.groupBy("g").agg(F.min_by("m", "f").alias("m"))
        return m.select("g", F.posexplode("m").alias("p", "fused"))

    maps = adapters.maps(spark, DATA)
    got = {(r.g, r.p): r.fused for r in stacks.fuse(maps, "first").collect()}
    assert all(got[g, p] == pytest.approx(x[0][p] * 65535) for g, (_, x) in groups.items() for p in range(64))
    with pytest.raises(ValueError, match="no strategy"):
        stacks.fuse(maps, "nothing")
    del stacks.STRATEGIES["first"]
    a = np.random.default_rng(8).random((150, 90))
    assert np.allclose(stacks.tiled(lambda t: t * 2, a, 64, 16), a * 2)
    assert stacks.tile_starts(1000, 256, 64) == [0, 192, 384, 576, 744] and stacks.tile_starts(100, 256, 64) == [0]
    assert stacks.at_scales(lambda t: t * 0 + 1, a).mean() == pytest.approx(1)
    stacks_bound, stacks.MOST_BYTES = stacks.MOST_BYTES, 1000
    try:
        with pytest.raises(Exception, match="split the group"):
            stacks.focus_clusters(maps).count()
    finally:
        stacks.MOST_BYTES = stacks_bound


def test_fusion_picks_the_sharp_half(spark):
    rng = np.random.default_rng(5)
    scene = rng.random((24, 24))
    soft = kernels.gaussian(scene, 2.5)
    left, right = scene.copy(), scene.copy()
    left[:, 12:], right[:, :12] = soft[:, 12:], soft[:, :12]
    maps = spark.createDataFrame([(1, f, (a * 65535).round().ravel().tolist()) for f, a in enumerate((left, right))], "g int, f bigint, m array<double>")
    for name in ("quality", "narrow"):
        fused = np.array([r.fused for r in stacks.fuse(maps, name).orderBy("p").collect()]).reshape(24, 24)
        assert np.abs(fused - scene).mean() < 0.5 * np.abs(left - scene).mean()


def onnx_square(path):
    """A network of one node, y = x * x, written in the format's own bytes."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    number = lambda tag, n: varint(tag << 3) + varint(n)
    part = lambda tag, data: varint(tag << 3 | 2) + varint(len(data)) + data
    dims = part(2, b"".join(part(1, d) for d in (number(1, 1), number(1, 1), part(2, b"h"), part(2, b"w"))))
    value = lambda name: part(1, name) + part(2, part(1, number(1, 1) + dims))
    node = part(1, b"x") + part(1, b"x") + part(2, b"y") + part(4, b"Mul")
    graph = part(1, node) + part(2, b"g") + part(11, value(b"x")) + part(12, value(b"y"))
    path.write_bytes(number(1, 8) + part(7, graph) + part(8, part(1, b"") + number(2, 13)))


def test_network_by_its_file(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    onnx_square(tmp_path / "m.onnx")
    model = stacks.OnnxModel(str(tmp_path / "m.onnx"))
    a = np.random.default_rng(9).random((70, 33))
    assert np.allclose(model(a), a * a, atol=1e-5) and np.allclose(stacks.at_scales(model, a, (1,)), a * a, atol=1e-5)
    maps = adapters.maps(spark, DATA).filter("g = 1 and f < 100")
    fused = [r.fused for r in stacks.fuse_by_model(maps, model).orderBy("p").collect()]
    images, _, _ = moved([np.array(r.m).reshape(8, 8) / 65535 for r in maps.orderBy("f").collect()])
    r = np.array([stacks.at_scales(lambda x: x * x, x) for x in images])
    e = np.exp((r - r.max(axis=0)) / r.std())
    assert np.allclose(fused, ((e * images).sum(axis=0) / e.sum(axis=0)).ravel(), atol=1e-4)


@pytest.fixture()
def long_stack(spark, monkeypatch):
    """A group of more frames than positions, with copies, where the matrix of all pairs is beyond the bound and the stack isn't."""
    x = np.random.default_rng(3).integers(0, 65536, (90, 64)).astype(float)
    x[60:] = x[:30]
    monkeypatch.setattr(stacks, "MOST_BYTES", 8 * 90 * 64)
    return x / 65535, spark.createDataFrame([(1, f, m.tolist()) for f, m in enumerate(x)], "g int, f bigint, m array<double>")


def test_path_of_a_stack_whose_pairs_have_no_place(long_stack):
    x, maps = long_stack
    s = np.array([[kernels.similarity(a, b) for b in x] for a in x])
    want = kernels.path_order(1 - np.where(s > 1 - 1e-12, 1, s))
    got = sorted((r.place, r.f) for r in stacks.alignment_order(maps).collect())
    steps = [s[a, b] for a, b in zip(want, want[1:])]
    assert [f for _, f in got] in (want, want[::-1]) and sum(steps) == pytest.approx(s[[f for _, f in got][:-1], [f for _, f in got][1:]].sum())
    assert paths.path_order(paths.Costs(x)) == paths.path_order(paths.Costs(x, 0)) == [f for _, f in got]
    rows = kernels.strong_rows(x)
    assert all((rows[i] == kernels.strong(x[i])).all() for i in range(len(x))) and not kernels.strong_rows(np.ones((2, 9))).any()


def test_selection_over_a_long_stack(long_stack):
    x, maps = long_stack
    got = {r.f: r for r in stacks.whole_frame_selection(maps).collect()}
    images = x.reshape(-1, 8, 8)
    quality = np.array([kernels.image_quality(a) for a in images])
    reference = int(quality.argmax())
    t, _, _ = align.register(np.stack([images[reference]] * len(x)), images)
    focus = np.array([kernels.focus_map(np.rint(a * 65535) / 65535).ravel() for a in align.warp(images, t)])
    choice = cover.near_best(focus, quality, np.zeros(len(x), bool))
    assert sorted(got) == list(range(len(x))) and {f for f, r in got.items() if r.selected} == {*choice.taken, reference}
    assert np.array_equal(kernels.focus_map(images), [kernels.focus_map(a) for a in images]) and kernels.image_qualities(images) == quality.tolist()


def test_scenes_of_a_long_stack(long_stack):
    x, maps = long_stack
    got = [r.scene for r in stacks.anchor_split(maps).orderBy("f").collect()]
    assert got == kernels.anchored_groups(x, lambda a, b: kernels.similarity(a, b) >= 0.55)


def test_clusters_of_a_long_stack(long_stack):
    x, maps = long_stack
    label, heads = kernels.clusters(x, x.mean(axis=1), lambda a, b: kernels.similarity(a, b) >= stacks.CLUSTER)
    got = stacks.focus_clusters(maps).orderBy("f").collect()
    assert [(r.cluster, r.representative) for r in got] == [(k, heads[k] == i) for i, k in enumerate(label)]


def test_best_of_the_clusters_of_a_long_stack(long_stack, spark, monkeypatch):
    from lamina.plans import stack_queries

    x, maps = long_stack
    monkeypatch.setattr(stack_queries, "maps", lambda spark, sf: maps)
    label, heads = kernels.clusters(x, x.mean(axis=1), lambda a, b: kernels.similarity(a, b) >= stacks.CLUSTER)
    got = {r.f: r.reason for r in stack_queries.dedup_keep_best(spark, DATA).collect()}
    assert got == {h: "only frame of its cluster" if label.count(k) == 1 else f"best of {label.count(k)} alike" for k, h in heads.items()}


def test_library_over_a_long_stack(long_stack):
    x, maps = long_stack
    choice = cover.library(x, x.mean(axis=1))
    got = sorted((r.place, r.f) for r in stacks.library_selection(maps).collect() if r.place is not None)
    assert [f for _, f in got] == kernels.nearest_order(choice.taken, x)


def streams(x, size):
    """A stack's maps in batches."""
    return [x[k : k + size] for k in range(0, len(x), size)]


def test_scenes_of_a_stack_beyond_the_bound(spark, monkeypatch):
    """Drifting maps with flat, equal and stray ones; two groups and frames without one; no place for any stack."""
    monkeypatch.setattr(stacks, "MOST_BYTES", 1000)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.clip(rng.random(64) + rng.normal(0, s, (n, 64)), 0, 1) for n, s in ((7, 0.2), (1, 0.1), (2, 0.3), (40, 0.35), (1, 0.1), (9, 0.0), (60, 0.4))])
    x[20:23], x[30:32] = 0.5, x[3]
    x = np.rint(x * 65535)
    rows = [(g, f, m.tolist()) for g in (1, 2, None) for f, m in enumerate(x[: 120 if g == 1 else 50])]
    rng.shuffle(rows)
    maps = spark.createDataFrame(rows, "g int, f bigint, m array<double>")
    same = lambda a, b: kernels.similarity(a, b) >= 0.55
    want = {n: kernels.anchored_groups(x[:n] / 65535, same) for n in (120, 50)}
    assert len(set(want[120])) > 3
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {(r.g, r.f): r.scene for r in stacks.anchor_split(maps).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert got == {(g, f): k for g in (1, 2, None) for f, k in enumerate(want[120 if g == 1 else 50])}
    for confirm in (1, 3):
        for size in (1, 7, 120):
            scenes = passes.Scenes(0.55, confirm)
            assert [k for part in streams(x / 65535, size) for k in scenes.take(part)] + scenes.end() == kernels.anchored_groups(x / 65535, same, confirm)


def test_clusters_of_a_stack_beyond_the_bound(spark, monkeypatch):
    """Near copies of few maps, flat and equal ones, better ones late; the representatives have a place, the stack has none."""
    rng = np.random.default_rng(6)
    x = np.clip(rng.random((12, 64))[rng.integers(0, 12, 300)] * rng.uniform(0.6, 1.0, (300, 1)) + rng.normal(0, 0.12, (300, 64)), 0, 1)
    x[50:53], x[200:220] = 0.25, x[20:40]
    x = np.rint(x * 65535) / 65535
    plain = lambda x: kernels.clusters(x, x.mean(axis=1), lambda a, b: kernels.similarity(a, b) >= stacks.CLUSTER)
    label, heads = plain(x)
    assert 8 < len(heads) < 60 and [label.index(k) for k in heads] != list(heads.values())
    monkeypatch.setattr(stacks, "MOST_BYTES", 8 * 64 * len(heads))
    rows = [(g, f, (m * 65535).tolist()) for g in (1, None) for f, m in enumerate(x)]
    got = {(r.g, r.f): (r.cluster, r.representative) for r in stacks.focus_clusters(spark.createDataFrame(rows, "g int, f bigint, m array<double>")).collect()}
    assert got == {(g, f): (k, heads[k] == f) for g in (1, None) for f, k in enumerate(label)}
    wide = rng.random((400, 64))
    for y, size in ((x, 1), (x, 70), (wide, 400), (wide, 33)):
        label, heads = plain(y)
        clusters, found, begin = passes.Clusters(stacks.CLUSTER), [], 0
        for part in streams(y, size):
            found += clusters.take(part, part.mean(axis=1), list(range(begin, begin + len(part))))
            begin += len(part)
        assert sorted(found + clusters.end()) == [(f, k, heads[k] == f) for f, k in enumerate(label)]


def test_library_over_stacks_beyond_the_bound(spark, monkeypatch):
    """Steps with copies, dark, black and lone frames, a frame that is refused, frames without a group or with one number."""
    monkeypatch.setattr(stacks, "MOST_BYTES", 1000)
    rng = np.random.default_rng(9)
    steps = np.rint(np.clip(rng.normal(0.6, 0.3, (150, 64)), 0, 1) * 8) / 8
    steps[100:] = steps[:50]
    wide = np.repeat(rng.random((1, 600)), 9, axis=0) * 0.9
    wide[1:] *= 0.5
    for k in range(8):
        wide[k + 1, k * 60 : k * 60 + 40] = 0.95
    wide[7:, 300:] = 0
    wide[8, :] = 0
    wide[8, 599] = 0.99
    sets = {1: steps, 2: np.zeros((5, 64)), 3: steps[:1], 4: rng.random((40, 64)) * 0.1, 5: wide, None: steps[20:60]}
    sets = {g: np.rint(x * 65535) for g, x in sets.items()}
    rows = [(g, f, m.tolist()) for g, x in sets.items() for f, m in enumerate(x)] + [(6, 7, m.tolist()) for m in [sets[1][0]] * 3]
    rng.shuffle(rows)
    got = stacks.library_selection(spark.createDataFrame(rows, "g int, f bigint, m array<double>")).collect()
    reasons = set()
    for g, x in sets.items():
        x = x / 65535
        choice = cover.library(x, x.mean(axis=1))
        place = {i: k for k, i in enumerate(kernels.nearest_order(choice.taken, x))}
        want = [(i, place.get(i), choice.gains.get(i, 0.0), choice.reason(i), choice.covered) for i in range(len(x))]
        assert sorted((r.f, r.place, r.gain, r.reason, r.coverage) for r in got if r.g == g) == want
        reasons |= {t[3] for t in want}
    assert len(reasons) == 4
    assert sorted(r.reason for r in got if r.g == 6) == ["nothing new", "nothing new", "seed"]
