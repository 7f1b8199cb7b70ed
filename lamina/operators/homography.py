"""Transforms as arrays of nine numbers, row by row: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rescaled(h: Column | str, factor: float) -> Column:
    """The transform between images of another size: S H 1/S."""
    by = [1.0, 1.0, factor, 1.0, 1.0, factor, 1 / factor, 1 / factor, 1.0]
    return F.array(*[F.get(h, k) * w for k, w in enumerate(by)])


def scale(h: Column | str) -> Column:
    return F.sqrt(F.abs(F.get(h, 0) * F.get(h, 4) - F.get(h, 1) * F.get(h, 3)))


def rotation(h: Column | str) -> Column:
    """Degrees."""
    return F.degrees(F.atan2(F.get(h, 3), F.get(h, 0)))


def image_of(h: Column | str, x: Column, y: Column) -> Column:
    """Struct (x, y) of a point's image."""
    row = lambda k: F.get(h, k) * x + F.get(h, k + 1) * y + F.get(h, k + 2)
    return F.struct((row(0) / row(6)).alias("x"), (row(3) / row(6)).alias("y"))


def plausible(h: Column | str, width: float, height: float, scales: tuple[float, float] = (0.7, 1.4), degrees: float = 15, shift: float = 0.25, bend: float = 0.0003) -> Column:
    """Whether scale, rotation, shift (as a share of the size) and perspective are what two frames of one scene may have."""
    return (
        scale(h).between(*scales) & (F.abs(rotation(h)) <= degrees) & (F.abs(F.get(h, 2)) <= shift * width) & (F.abs(F.get(h, 5)) <= shift * height) & (F.abs(F.get(h, 6)) + F.abs(F.get(h, 7)) < bend)
    )
