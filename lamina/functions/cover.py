"""Frames that together cover the sharp positions of a stack.

Positions are bits: a frame is a row of 64-bit words, new positions are counted by population count. Both
selectors ask for the frame of greatest gain again and again. As positions are covered, gains only fall, so
an old gain is an upper bound: frames wait in a heap by their last known gain, and only the one on top is
counted anew. It is the best as soon as its count hasn't changed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

#: Shares of the best score, of new positions and of covered ones.
NEAR_BEST, LEAST_SCORE, LEAST_GAIN, ENOUGH = 0.9, 0.002, 0.0005, 0.9995
#: Fixed values of the library's selector.
RELATIVE, SUPPORT, LIBRARY_GAIN, QUALITY_WEIGHT = 0.95, 0.15, 0.002, 0.01


def pack(masks: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of 64-bit words; the last word is filled with zeros."""
    n, p = masks.shape
    wide = np.zeros((n, -(-p // 64) * 64), bool)
    wide[:, :p] = masks
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def ones(words: np.ndarray) -> int:
    return int(np.bitwise_count(words).sum())


@dataclass
class Cover:
    """What is still open, and frames by the greatest gain that they may have.

    ``bonus`` is added to a gain in positions; equals go to the better quality, then to the lower frame.
    """

    bits: np.ndarray
    quality: np.ndarray
    open: np.ndarray
    bonus: np.ndarray
    waiting: list[tuple[float, float, int]] = field(default_factory=list)

    def offer(self, frames: Iterable[int]) -> None:
        for i in frames:
            heapq.heappush(self.waiting, (-np.inf, -float(self.quality[i]), int(i)))

    def best(self) -> tuple[int, int] | None:
        """The frame to take next and its new positions; it stops waiting. None if no frame waits."""
        while self.waiting:
            bound, worse, i = heapq.heappop(self.waiting)
            new = ones(self.bits[i] & self.open)
            now = -(new + float(self.bonus[i]))
            if now == bound:
                return i, new
            heapq.heappush(self.waiting, (now, worse, i))
        return None

    def take(self, i: int) -> None:
        self.open = self.open & ~self.bits[i]


@dataclass(frozen=True)
class Choice:
    """Frames in the order taken, the share of positions that each frame asked for added, and the share covered."""

    taken: list[int]
    gains: dict[int, float]
    covered: float
    refused: int | None = None

    def reason(self, frame: int) -> str:
        if frame in self.taken:
            return "seed" if frame == self.taken[0] else "new positions"
        return "too few new positions" if frame == self.refused else "nothing new"


def choose(sharp: np.ndarray, support: np.ndarray, quality: np.ndarray, frames: Iterable[int], least_gain: float, enough: float, bonus: np.ndarray | None = None) -> Choice:
    """Take frames until ``enough`` of the support is covered or the best adds less than ``least_gain``; the first is always taken.

    The bonus, in positions, counts from the second frame on.
    """
    return choose_packed(pack(sharp & support), max(1, int(support.sum())), quality, frames, least_gain, enough, bonus)


def choose_packed(bits: np.ndarray, total: int, quality: np.ndarray, frames: Iterable[int], least_gain: float, enough: float, bonus: np.ndarray | None = None) -> Choice:
    """``choose`` of frames whose sharp positions, of ``total`` that count, are packed.

    Of frames with equal positions at most one is taken and one refused, so the two best of them by quality stand for all.
    """
    cover = Cover(bits, quality, np.full(bits.shape[1], ~np.uint64(0)), np.zeros(len(bits)))
    cover.offer(frames)
    taken: list[int] = []
    gains: dict[int, float] = {}
    covered = 0
    while (found := cover.best()) is not None:
        i, new = found
        gains[i] = new / total
        if taken and gains[i] < least_gain:
            return Choice(taken, gains, covered / total, refused=i)
        taken.append(i)
        covered += new
        cover.take(i)
        if covered / total >= enough:
            break
        if bonus is not None and len(taken) == 1:
            rest = [i for _, _, i in cover.waiting]
            cover = Cover(bits, quality, cover.open, bonus)
            cover.offer(rest)
    return Choice(taken, gains, covered / total)


def near_best(scores: np.ndarray, quality: np.ndarray, failed: np.ndarray, least_gain: float = LEAST_GAIN, enough: float = ENOUGH) -> Choice:
    """Production rule over ``scores`` (frames x positions): a frame is sharp where it has 0.9 of the best score.

    Positions without detail in any frame don't count; failed frames are passed over.
    """
    best = scores.max(axis=0)
    useful = best > max(LEAST_SCORE * float(best.max(initial=0)), 1e-7)
    return choose(scores >= NEAR_BEST * best, useful, quality, np.flatnonzero(~failed), least_gain, enough)


def library(maps: np.ndarray, quality: np.ndarray, target: float = 0.995, least_gain: float = LIBRARY_GAIN) -> Choice:
    """Library rule: sharp from 0.95 of the best map, where the best reaches 0.15; a slight weight of quality after the seed.

    Without such positions those above zero count, and without these all.
    """
    top = maps.max(axis=0)
    support = supported(top)
    return choose(sharp(maps, top), support, quality, range(len(maps)), least_gain, target, bonus_of(quality, len(maps), max(1, int(support.sum()))))


def supported(top: np.ndarray) -> np.ndarray:
    """The library's positions that count, by the greatest value at each."""
    return next((s for s in (top >= SUPPORT, top > 0) if s.any()), np.ones(top.shape, bool))


def sharp(maps: np.ndarray, top: np.ndarray) -> np.ndarray:
    return maps >= RELATIVE * np.maximum(top, 1e-6)


def bonus_of(quality: np.ndarray, n: int, total: int) -> np.ndarray:
    return QUALITY_WEIGHT * quality / n * total
