"""Single passes over the frames of a stack, a batch at a time: what they must remember doesn't grow with the frames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

from lamina.functions import cover, kernels

#: Similarities nearer to a limit than this are held one by one.
ROUNDING = 1e-9


@dataclass
class Maps:
    """Maps with what ``kernels.similarity`` asks of each: itself centred, its norm, strong support as bits and their number."""

    maps: np.ndarray
    centred: np.ndarray
    norm: np.ndarray
    words: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, maps: np.ndarray) -> Maps:
        centred = maps - maps.mean(axis=1, keepdims=True)
        words = cover.pack(kernels.strong_rows(maps))
        return cls(maps, centred, np.linalg.norm(centred, axis=1), words, np.bitwise_count(words).sum(axis=1, dtype=np.int64))

    def columns(self) -> Iterable[np.ndarray]:
        return self.maps, self.centred, self.norm, self.words, self.count

    def __getitem__(self, rows) -> Maps:
        return Maps(*(c[rows] for c in self.columns()))

    def followed_by(self, other: Maps) -> Maps:
        return Maps(*(np.concatenate(c) for c in zip(self.columns(), other.columns(), strict=True)))

    def similar(self, other: Maps) -> np.ndarray:
        """Similarities of these maps to as many others, or to a single one."""
        norm = self.norm * other.norm
        flat = norm <= 1e-8
        corr = np.where(flat, 1.0, (self.centred * other.centred).sum(axis=-1) / np.where(flat, 1.0, norm))
        both = np.bitwise_count(self.words & other.words).sum(axis=-1, dtype=np.int64)
        either = self.count + other.count - both
        overlap = np.where(either == 0, 1.0, both / np.maximum(either, 1))
        return np.clip(0.225 * (corr + 1) + 0.30 * (1 - np.abs(self.maps - other.maps).mean(axis=-1)) + 0.25 * overlap, 0, 1)


def reaches(s: float, least: float, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether maps whose similarity is about ``s`` have one of at least ``least``."""
    return bool(s > least + ROUNDING or (s >= least - ROUNDING and kernels.similarity(a, b) >= least))


class Scenes:
    """``kernels.anchored_groups`` by similarities of at least ``least``: three maps and an unconfirmed boundary are remembered."""

    AHEAD = 32

    def __init__(self, least: float, confirm: int = 2):
        self.least, self.confirm = least, max(1, confirm)
        self.group, self.waiting = 0, 0
        #: First, most textured and latest frame of the group, then those that wait.
        self.known: Maps | None = None

    def take(self, maps: np.ndarray) -> list[int]:
        """The groups that the next maps decide, in the order of frames; frames of an unconfirmed boundary wait."""
        if not len(maps):
            return []
        new = Maps.of(maps)
        begin = 0 if self.known is None else 3 + self.waiting
        every = new if self.known is None else self.known.followed_by(new)
        first, best = (None, None) if self.known is None else (0, 1)
        texture, n = every.maps.std(axis=1), len(every.maps)
        # The latest frame of the group is before those that wait; others are met by blocks of frames ahead.
        lags: dict[int, np.ndarray] = {}
        blocks: dict[int, tuple[int, np.ndarray]] = {}

        def before(i: int, lag: int) -> float:
            if lag not in lags:
                lags[lag] = np.concatenate((np.zeros(lag), every[lag:].similar(every[: n - lag])))
            return lags[lag][i]

        def ahead(i: int, anchor: int) -> float:
            start, s = blocks.get(anchor, (n, None))
            if s is None or i >= start + len(s):
                start, s = blocks[anchor] = i, every[i : i + self.AHEAD].similar(every[anchor])
            return s[i - start]

        def belongs(i: int) -> bool:
            if first is None:
                return True
            meets = lambda s, a: reaches(s, self.least, every.maps[i], every.maps[a])
            return meets(before(i, 1 + self.waiting), i - 1 - self.waiting) or meets(ahead(i, first), first) or (best != first and meets(ahead(i, best), best))

        out = []
        for i in range(begin, n):
            here = belongs(i)
            if not here and self.waiting + 1 < self.confirm:
                self.waiting += 1
                continue
            if not here:
                self.group, first, best = self.group + 1, None, None
                blocks.clear()
            for k in range(i - self.waiting, i + 1):
                out.append(self.group)
                first = k if first is None else first
                best = k if best is None or texture[k] > texture[best] else best
            self.waiting = 0
        latest = n - 1 - self.waiting
        self.known = every[[first, best, *range(latest, n)]]
        return out

    def end(self) -> list[int]:
        """The groups of the frames that still wait."""
        return [self.group] * self.waiting


class Clusters:
    """``kernels.clusters`` by similarities of at least ``least``: the representatives are remembered, with their names."""

    BLOCK, AT_ONCE = 64, 2048

    def __init__(self, least: float):
        self.least, self.n = least, 0
        self.quality: list[float] = []
        self.names: list = []
        self.heads: Maps | None = None

    def _put(self, k: int, one: Maps) -> None:
        if self.heads is None:
            self.heads = Maps(*(np.zeros((self.BLOCK, *c.shape), c.dtype) for c in one.columns()))
        if k >= len(self.heads.norm):
            self.heads = self.heads.followed_by(Maps(*(np.zeros_like(c) for c in self.heads.columns())))
        for c, v in zip(self.heads.columns(), one.columns(), strict=True):
            c[k] = v

    def _able(self, block: Maps) -> np.ndarray:
        """Maps x representatives: similar enough if there were no distance between them."""
        heads = self.heads[: self.n]
        bits = lambda m: np.unpackbits(m.words.view(np.uint8), axis=1).astype(np.float32)
        norm = np.outer(block.norm, heads.norm)
        flat = norm <= 1e-8
        corr = np.where(flat, 1.0, block.centred @ heads.centred.T / np.where(flat, 1.0, norm))
        both = bits(block) @ bits(heads).T
        either = block.count[:, None] + heads.count - both
        overlap = np.where(either == 0, 1.0, both / np.maximum(either, 1))
        return 0.225 * (corr + 1) + 0.30 + 0.25 * overlap >= self.least - ROUNDING

    def _near(self, block: Maps) -> list[list[tuple[int, float]]]:
        """For each map the representatives that are similar enough or within rounding of it, in order, with their similarity."""
        out: list[list[tuple[int, float]]] = [[] for _ in block.norm]
        rows, slots = np.nonzero(self._able(block)) if self.n else ((), ())
        for k in range(0, len(rows), self.AT_ONCE):
            r, h = rows[k : k + self.AT_ONCE], slots[k : k + self.AT_ONCE]
            s = block[r].similar(self.heads[h])
            for j in np.flatnonzero(s >= self.least - ROUNDING):
                out[r[j]].append((int(h[j]), float(s[j])))
        return out

    def take(self, maps: np.ndarray, quality: np.ndarray, names: list) -> list[tuple]:
        """(name, cluster, False) of the frames that are known not to stay representatives."""
        out = []
        for start in range(0, len(maps), self.BLOCK):
            block = Maps.of(maps[start : start + self.BLOCK])
            near = self._near(block)
            #: Representatives that are new since then.
            fresh: list[int] = []
            for i, (q, name) in enumerate(zip(quality[start : start + self.BLOCK], names[start : start + self.BLOCK])):
                met = near[i]
                if fresh:
                    met = sorted([t for t in met if t[0] not in fresh] + list(zip(fresh, self.heads[fresh].similar(block[i]), strict=True)))
                k = next((k for k, s in met if reaches(s, self.least, block.maps[i], self.heads.maps[k])), None)
                if k is None:
                    k, self.n = self.n, self.n + 1
                    self.quality.append(q)
                    self.names.append(name)
                elif q > self.quality[k]:
                    out.append((self.names[k], k, False))
                    self.quality[k], self.names[k] = q, name
                else:
                    out.append((name, k, False))
                    continue
                self._put(k, block[i])
                if k not in fresh:
                    fresh.append(k)
        return out

    def end(self) -> list[tuple]:
        """(name, cluster, True) of the representatives."""
        return [(name, k, True) for k, name in enumerate(self.names)]
