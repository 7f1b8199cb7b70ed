"""Alignment of frames to a reference: intensities first, then features, else identity.

All frames of a batch are solved at once: images are (frames, height, width), transforms (frames, 2, 3)
that map places of the reference to places of the frame.
"""

from __future__ import annotations

import numpy as np

from lamina.functions import kernels

#: Least correlation and scales of an accepted transform, the ratio test, the reach of an inlier in pixels, the least matches.
LEAST_CORRELATION, SCALES, RATIO, REACH, LEAST_MATCHES = 0.90, (0.8, 1.25), 0.75, 3.0, 8
STEPS = 30

_pairs = np.random.default_rng(11).normal(0, 3.0, (256, 2, 2)).round().clip(-7, 7).astype(int)


def identity(n: int) -> np.ndarray:
    return np.tile(np.array([[1.0, 0, 0], [0, 1.0, 0]]), (n, 1, 1))


def warp(images: np.ndarray, transforms: np.ndarray) -> np.ndarray:
    """Images at the places that the transforms give, bilinear, with the edge carried on."""
    n, h, w = images.shape
    y, x = np.mgrid[0:h, 0:w].astype(float)
    t = transforms[:, :, :, None, None]
    sx = np.clip(t[:, 0, 0] * x + t[:, 0, 1] * y + t[:, 0, 2], 0, w - 1)
    sy = np.clip(t[:, 1, 0] * x + t[:, 1, 1] * y + t[:, 1, 2], 0, h - 1)
    x0, y0 = np.minimum(sx.astype(int), max(w - 2, 0)), np.minimum(sy.astype(int), max(h - 2, 0))
    u, v, k = sx - x0, sy - y0, np.arange(n)[:, None, None]
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    return (1 - v) * ((1 - u) * images[k, y0, x0] + u * images[k, y0, x1]) + v * ((1 - u) * images[k, y1, x0] + u * images[k, y1, x1])


def valid(shape: tuple[int, int], transform: np.ndarray) -> np.ndarray:
    """Places of the reference that the frame covers, without those next to one that it doesn't."""
    h, w = shape
    y, x = np.mgrid[0:h, 0:w].astype(float)
    sx, sy = transform[0, 0] * x + transform[0, 1] * y + transform[0, 2], transform[1, 0] * x + transform[1, 1] * y + transform[1, 2]
    inside = np.pad((sx >= 0) & (sx <= w - 1) & (sy >= 0) & (sy <= h - 1), 1, constant_values=True)
    return np.logical_and.reduce([inside[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of each pair of images; 0 for a flat one."""
    x, y = a.reshape(len(a), -1), b.reshape(len(b), -1)
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    return np.where(norm > 1e-12, (x * y).sum(axis=1) / np.where(norm > 1e-12, norm, 1), 0.0)


def phase_shifts(fixed: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """(dy, dx, peak) of each frame: the cyclic shift of ``moving`` against ``fixed`` by phase correlation."""
    n, h, w = fixed.shape
    centred = lambda a: a - a.mean(axis=(1, 2), keepdims=True)
    f = np.fft.fft2(centred(fixed)) * np.conj(np.fft.fft2(centred(moving)))
    r = np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)).real.reshape(n, -1)
    at = r.argmax(axis=1)
    y, x = np.divmod(at, w)
    return np.stack([np.where(y > h // 2, y - h, y), np.where(x > w // 2, x - w, x), r[np.arange(n), at]], axis=1).astype(float)


def by_intensity(fixed: np.ndarray, moving: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Affine transforms by Gauss-Newton from the phase shift, and the correlations reached: the best of all steps."""
    n, h, w = fixed.shape
    shift = phase_shifts(fixed, moving)
    now = identity(n)
    now[:, 0, 2], now[:, 1, 2] = -shift[:, 1], -shift[:, 0]
    y, x = np.mgrid[0:h, 0:w].astype(float)
    best, reached, going = now.copy(), correlations(fixed, warp(moving, now)), np.arange(n)
    for _ in range(steps):
        if not len(going):
            break
        seen = warp(moving[going], now[going])
        gy, gx = np.gradient(seen, axis=(1, 2))
        j = np.stack([gx * x, gx * y, gx, gy * x, gy * y, gy], axis=-1).reshape(len(going), -1, 6)
        left = (fixed[going] - seen).reshape(len(going), -1, 1)
        step = np.linalg.solve(j.transpose(0, 2, 1) @ j + 1e-6 * np.eye(6), j.transpose(0, 2, 1) @ left).reshape(-1, 2, 3)
        now[going] += np.clip(step, -max(h, w), max(h, w))
        c = correlations(fixed[going], warp(moving[going], now[going]))
        better = c > reached[going]
        best[going[better]], reached[going[better]] = now[going[better]], c[better]
        going = going[np.abs(step).reshape(len(going), -1).max(axis=1) >= 1e-6]
    return best, reached


def corners(gray: np.ndarray, most: int = 500) -> np.ndarray:
    """(y, x) of the strongest corners: greatest lesser eigenvalue of the structure tensor among their neighbours."""
    gy, gx = np.gradient(gray)
    xx, yy, xy = (kernels.gaussian(v, 1.0) for v in (gx * gx, gy * gy, gx * gy))
    strength = (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2
    wide = np.pad(strength, 1, constant_values=-np.inf)
    h, w = gray.shape
    top = np.max([wide[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], axis=0)
    y, x = np.nonzero((strength >= top) & (strength > 1e-8 + 0.01 * strength.max(initial=0)))
    order = np.lexsort((x, y, -strength[y, x]))[:most]
    return np.stack([y[order], x[order]], axis=1)


def descriptors(gray: np.ndarray, points: np.ndarray) -> np.ndarray:
    """256 comparisons of smoothed places around each point, as four 64-bit words."""
    smooth = np.pad(kernels.gaussian(gray, 1.0), 8, mode="edge")
    p = points[:, None, None, :] + 8 + _pairs[None]
    bits = smooth[p[:, :, 0, 0], p[:, :, 0, 1]] > smooth[p[:, :, 1, 0], p[:, :, 1, 1]]
    return np.packbits(bits, axis=1).view(np.uint64).reshape(len(points), 4)


def matched(a: np.ndarray, b: np.ndarray, ratio: float = RATIO) -> list[tuple[int, int]]:
    """Pairs (i, j) where b[j] is nearest to a[i] by Hamming distance, and nearer than the second by the ratio."""
    if not len(a) or len(b) < 2:
        return []
    d = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2)
    order = np.argsort(d, axis=1, kind="stable")[:, :2]
    first, second = (np.take_along_axis(d, order[:, k : k + 1], axis=1)[:, 0] for k in (0, 1))
    return [(int(i), int(order[i, 0])) for i in np.flatnonzero(first < ratio * second)]


def consensus(source: np.ndarray, target: np.ndarray, reach: float = REACH, tries: int = 300) -> tuple[np.ndarray, np.ndarray] | None:
    """Affine transform (2, 3) of (x, y) source to target points by random sample consensus, and its inliers; None if no three agree."""
    rng, n = np.random.default_rng(17), len(source)
    wide = np.column_stack([source, np.ones(n)])
    best = np.zeros(n, bool)
    for _ in range(tries if n >= 3 else 0):
        three = rng.choice(n, 3, replace=False)
        if abs(np.linalg.det(wide[three])) < 1e-6:
            continue
        m = np.linalg.solve(wide[three], target[three])
        inside = np.linalg.norm(wide @ m - target, axis=1) <= reach
        if inside.sum() > best.sum():
            best = inside
    if best.sum() < 3:
        return None
    m = np.linalg.lstsq(wide[best], target[best], rcond=None)[0]
    return m.T, best


def features(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners and their descriptors; none of either where too few for a match."""
    points = corners(gray)
    points = points if len(points) >= LEAST_MATCHES else points[:0]
    return points, descriptors(gray, points) if len(points) else np.zeros((0, 4), np.uint64)


def by_features(fixed: np.ndarray, moving: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, float] | None:
    """Affine transform of one frame from matched corners, and the share of inliers; None with too few matches.

    ``known`` are the features of ``fixed``. Each of its corners has one match at most.
    """
    a, described = known or features(fixed)
    if not len(a):
        return None
    b = corners(moving)
    pairs = matched(described, descriptors(moving, b)) if len(b) else []
    if len(pairs) < LEAST_MATCHES:
        return None
    i, j = np.array(pairs).T
    found = consensus(a[i][:, ::-1].astype(float), b[j][:, ::-1].astype(float))
    return None if found is None else (found[0], float(found[1].mean()))


def scale_of(transforms: np.ndarray) -> np.ndarray:
    return np.sqrt(np.abs(transforms[:, 0, 0] * transforms[:, 1, 1] - transforms[:, 0, 1] * transforms[:, 1, 0]))


def accepted(transforms: np.ndarray, reached: np.ndarray) -> np.ndarray:
    s = scale_of(transforms)
    return (reached >= LEAST_CORRELATION) & (s >= SCALES[0]) & (s <= SCALES[1])


def register(fixed: np.ndarray, moving: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transforms, correlations and models (``intensity``, ``features`` or ``identity``) of a batch.

    A frame keeps the first model that is accepted and correlates better than the frame as it is.
    """
    plain = correlations(fixed, moving)
    transforms, reached, model = identity(len(fixed)), plain.copy(), np.array(["identity"] * len(fixed), object)
    t, c = by_intensity(fixed, moving)
    good = accepted(t, c) & (c > plain)
    transforms[good], reached[good], model[good] = t[good], c[good], "intensity"
    known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
    for k in np.flatnonzero(~good & ~accepted(identity(len(fixed)), plain)):
        if (image := fixed[k].tobytes()) not in known:
            known[image] = features(fixed[k])
        if (found := by_features(fixed[k], moving[k], known[image])) is not None:
            one = found[0][None]
            c = correlations(fixed[k : k + 1], warp(moving[k : k + 1], one))
            if accepted(one, c)[0] and c[0] > plain[k]:
                transforms[k], reached[k], model[k] = found[0], c[0], "features"
    return transforms, reached, model


def stability(transforms: np.ndarray, reached: np.ndarray, model: np.ndarray) -> np.ndarray:
    """0..1 for each registered frame: how surely it lies still. Fixed values: .55, .45, .95, .05; 80 pixels, 15 degrees.

    The correlation is both the confidence and, for want of inliers, their share; a frame that no model moved and that
    isn't accepted as it is gets a neutral floor.
    """
    c = np.clip(reached, 0.0, 1.0)
    base = 0.55 * c + 0.45 * c
    still = (model == "identity") & ~accepted(transforms, reached)
    base = np.where(still, np.maximum(base, 0.45 + 0.20 * c), base)
    turned = np.abs(np.degrees(np.arctan2(transforms[:, 1, 0], transforms[:, 0, 0]))) / 15
    moved = (np.abs(transforms[:, 0, 2]) + np.abs(transforms[:, 1, 2])) / 80 + np.abs(np.log(np.maximum(scale_of(transforms), 1e-6))) + turned
    return np.clip(0.95 * base + 0.05 * (1 - np.minimum(1.0, moved)), 0.0, 1.0)
