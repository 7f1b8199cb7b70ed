"""Scene boundaries from previews: shape, composition, and the subject on a bright backdrop.

Previews are rows (g source, f place, shape, at seconds, height, width, rgb bytes as one array, issue). Features are
made frame by frame; a boundary needs only a frame and the one before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import kernels

#: Brightness, neutrality and darkness of backdrop and subject (0..255), shares of the image, the change of a subject.
BRIGHT, NEUTRAL, DARK, BACKDROP, LEAST_AREA, MOST_AREA, SUBJECT_CHANGE, SUBJECT_SIGMA = 160, 45, 145, 0.55, 0.001, 0.2, 0.09, 2.0
#: Fixed values of the detector, in seconds and mean differences.
RULE = {"pause": 20.0, "long_pause": 60.0, "change": 0.025, "pause_change": 0.006}
VISIBLE = 0.15


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def subject_bounds(rgb: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x, y, width, height) of the largest isolated dark region on a mostly bright and neutral backdrop; None without one.

    Regions that reach the border belong to the backdrop.
    """
    h, w = rgb.shape[:2]
    gray = luma(rgb.astype(float))
    bright = gray > BRIGHT
    neutral = rgb.max(axis=2).astype(int) - rgb.min(axis=2) < NEUTRAL
    if (bright & neutral).mean() < BACKDROP:
        return None
    labels, n = kernels.components(kernels.gaussian(gray, 1.0) < DARK)
    inner = [s for s in kernels.component_stats(labels, n) if LEAST_AREA * h * w < s[1] < MOST_AREA * h * w and s[2] > 2 and s[3] > 2 and s[4] < w - 3 and s[5] < h - 3]
    if not inner:
        return None
    _, _, x0, y0, x1, y1 = max(inner, key=lambda s: (s[1], -s[0]))
    return x0, y0, x1 - x0 + 1, y1 - y0 + 1


def soft(rgb: np.ndarray, sigma: float) -> np.ndarray:
    return np.stack([kernels.gaussian(rgb[:, :, c].astype(float), sigma) for c in range(3)], axis=2)


def subject_difference(a: np.ndarray, bounds_a: tuple, b: np.ndarray, bounds_b: tuple) -> float:
    """Least mean difference (0..1) of two smoothed images in the box around both subjects, over nine small shifts."""
    h, w = a.shape[:2]
    t = max(1, round(max(h, w) / 320))
    x0, y0 = max(t, min(bounds_a[0], bounds_b[0])), max(t, min(bounds_a[1], bounds_b[1]))
    x1, y1 = min(w - t, max(bounds_a[0] + bounds_a[2], bounds_b[0] + bounds_b[2])), min(h - t, max(bounds_a[1] + bounds_a[3], bounds_b[1] + bounds_b[3]))
    if x0 >= x1 or y0 >= y1:
        return 0.0
    mine = a[y0:y1, x0:x1]
    return float(min(np.abs(mine - b[y0 + dy : y1 + dy, x0 + dx : x1 + dx]).mean() for dy in (-t, 0, t) for dx in (-t, 0, t)) / 255)


def composition_difference(a: np.ndarray, b: np.ndarray) -> float:
    """Mean difference of two previews (0..1) where either is visible, or else everywhere."""
    seen = np.maximum(a.max(axis=2), b.max(axis=2)) > VISIBLE
    d = np.abs(a - b)
    return float(d[seen].mean() if seen.any() else d.mean())


FEATURES = "g int, f bigint, shape string, at double, issue string, preview array<float>, subject array<int>, backdrop array<float>"


def features(previews: DataFrame) -> DataFrame:
    """(g, f, shape, at, issue, preview, subject, backdrop): what boundaries are judged by, one row per frame."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                if r.issue is not None or r.rgb is None:
                    out.append((r.g, r.f, r.shape, r.at, r.issue or "no pixels", None, None, None))
                    continue
                rgb = np.asarray(r.rgb, np.uint8).reshape(r.height, r.width, 3)
                bounds = subject_bounds(rgb)
                smooth = soft(rgb, SUBJECT_SIGMA).astype(np.float32).ravel() if bounds else None
                out.append((r.g, r.f, r.shape, r.at, None, (soft(rgb, 3.0) / 255).astype(np.float32).ravel(), bounds, smooth))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")])

    return previews.select("g", "f", F.col("shape"), "at", "height", "width", "rgb", "issue").mapInPandas(task, FEATURES)


def split(rows: DataFrame) -> DataFrame:
    """(g, f, group_no, excluded_reason, confidence): groups numbered from 0 in each source; an unreadable frame stands alone."""
    w = Window.partitionBy("g").orderBy("f")
    before = F.lag(F.struct("preview", "subject", "backdrop", "at", "shape", "issue")).over(w)
    paired = rows.withColumn("b", before)

    @F.pandas_udf("change double, other boolean")
    def compared(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p, s, k, shape, q, t, m, last in zip(a["preview"], a["subject"], a["backdrop"], a["shape"], b["preview"], b["subject"], b["backdrop"], b["shape"], strict=True):
            if p is None or q is None or shape != last:
                out.append((None, False))
                continue
            h, wide = map(int, shape.split("x"))
            side = lambda v: np.asarray(v, float).reshape(h, wide, 3)
            other = s is not None and t is not None and subject_difference(side(m), tuple(t), side(k), tuple(s)) > SUBJECT_CHANGE
            out.append((composition_difference(side(q), side(p)), other))
        return pd.DataFrame(out, columns=["change", "other"])

    own = F.struct("preview", "subject", "backdrop", "shape")
    other = F.struct("b.preview", "b.subject", "b.backdrop", "b.shape")
    judged = paired.select("g", "f", "shape", "at", "issue", F.col("b.at").alias("before"), F.col("b.shape").alias("last"), F.col("b.issue").alias("failed"), compared(own, other).alias("c"))
    known = lambda c: F.coalesce(c, F.lit(False))
    gap = F.coalesce(F.col("at") - F.col("before"), F.lit(0.0))
    cut = F.col("issue").isNotNull() | F.col("failed").isNotNull() | known(F.col("shape") != F.col("last")) | (gap < 0) | (gap > max(RULE["long_pause"], RULE["pause"]))
    cut = cut | known(F.col("c.change") > RULE["change"]) | F.col("c.other") | ((gap >= RULE["pause"]) & known(F.col("c.change") > RULE["pause_change"]))
    marked = judged.withColumn("cut", (cut & F.col("last").isNotNull()).cast("int"))
    return marked.select("g", "f", F.sum("cut").over(w).alias("group_no"), F.col("issue").alias("excluded_reason"), F.when(F.col("issue").isNull(), 1.0).otherwise(0.0).alias("confidence"))


def fixture(embeddings: DataFrame, height: int = 24, width: int = 32) -> DataFrame:
    """Previews drawn from vectors: a dark bar on a bright backdrop, which moves now and then, pauses, turned and unreadable frames."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for g, f in zip(pdf["g"], pdf["f"], strict=True):
                k = int(f) // 40  # frames of one scene
                h, w = (width, height) if f % 53 == 0 else (height, width)
                rgb = np.full((h, w, 3), 215 + k % 3, np.uint8)
                x = 5 + 5 * (k % 3)
                rgb[6 : h - 8, x : x + 6] = (40, 45, 50)
                if f % 61 == 0:
                    rgb[:] = (90, 30, 200)
                out.append((g, f, f"{h}x{w}", float(f * 2 + 45 * (f // 90)), h, w, rgb.ravel().astype(int), "unreadable" if f % 71 == 0 else None))
            yield pd.DataFrame(out, columns=["g", "f", "shape", "at", "height", "width", "rgb", "issue"])

    schema = "g int, f bigint, shape string, at double, height int, width int, rgb array<int>, issue string"
    return embeddings.select(F.col("label").alias("g"), F.col("vec_id").alias("f")).mapInPandas(task, schema)
