"""Parts that a caller may put in place of the engine's own: loaders, detectors, analysers, mergers, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: What each kind takes and returns, as DataFrames.
KINDS = {
    "loader": "(path, ...) to frames (g, f, m)",
    "detector": "frames (g, f, m) to (g, f, group_no)",
    "analyser": "frames (g, f, m) to (g, f, selected)",
    "merger": "frames (g, f, m) to (g, p, fused)",
}
_parts: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {}


def register(kind: str, name: str, part: Callable[[DataFrame], DataFrame]) -> None:
    if kind not in KINDS:
        raise ValueError(f"no kind {kind}; there are {sorted(KINDS)}")
    _parts[kind, name] = part


def part(kind: str, name: str) -> Callable[[DataFrame], DataFrame]:
    try:
        return _parts[kind, name]
    except KeyError:
        raise ValueError(f"no {kind} named {name}") from None


def run(files: DataFrame, loader: str, detector: str, analyser: str, merger: str) -> DataFrame:
    """Files to fused maps by registered parts: each detected group is a stack, of which the selected frames are merged."""
    frames = part("loader", loader)(files)
    grouped = part("detector", detector)(frames)
    stacks = frames.join(grouped, ["g", "f"]).selectExpr("cast(xxhash64(g, group_no) % 2147483647 as int) AS g", "f", "m")
    chosen = part("analyser", analyser)(stacks).filter("selected").select("g", "f")
    return part("merger", merger)(stacks.join(chosen, ["g", "f"], "left_semi"))
