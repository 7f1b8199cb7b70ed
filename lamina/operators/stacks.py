"""Operators on whole stacks: what needs one frame runs per frame, what needs all of them is an aggregate.

Maps are rows (g group, f frame, m values of a square map). Registration, measures and weights work on batches
of frames; owners, blends and medians are grouped aggregates over positions; a group's label map, whose size is
that of one frame, is one row. Only the greedy and ordering steps see a whole stack: ``per_stack`` refuses one
that has no place in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import align, cover, kernels, passes, paths
from lamina.operators import maps as dense
from lamina.operators.kept import kept

#: Bytes that a stack may have in one task.
MOST_BYTES = 1 << 30
#: Least partitions over which stacks are dealt.
LEAST_PARTS = 128
#: Parts of a group to which its reference travels.
SALTS = 32


def square(m: np.ndarray) -> np.ndarray:
    n = int(np.sqrt(len(m)))
    return np.asarray(m, float)[: n * n].reshape(n, n)


def images_of(column: pd.Series) -> np.ndarray:
    """Frames with values 0..1 of equally long maps of codes."""
    return np.stack([square(m) for m in column]) / 65535


def framewise(rows: DataFrame, schema: str, work: Callable[[pd.DataFrame], list[list]]) -> DataFrame:
    """``work`` on batches of rows whose maps are of one size; returns columns in the order of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, part in pdf.groupby(pdf["m"].map(len), sort=False):
                columns = work(part.reset_index(drop=True))
                yield pd.DataFrame(dict(zip(names, columns, strict=True)))

    return rows.mapInPandas(task, schema)


def per_stack(rows: DataFrame, schema: str, work: Callable[[int, pd.DataFrame], list[tuple]]) -> DataFrame:
    """``work(group, frames in order)`` for each stack of (g, f, m, ...) rows; a stack beyond ``MOST_BYTES`` is an error."""
    names = [c.split()[0] for c in schema.split(", ")]

    def task(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        if 8 * n * len(pdf["m"].iloc[0]) > MOST_BYTES:
            raise ValueError(f"the stack of group {key[0]} has {n} frames; it may have {MOST_BYTES} bytes: split the group")
        return pd.DataFrame(work(key[0], pdf.sort_values("f", ignore_index=True)), columns=names)

    # Long work on few rows: small partitions aren't put together, and few groups meet in one.
    parts = max(LEAST_PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "g").groupBy("g").applyInPandas(task, schema)


def in_order(rows: DataFrame, schema: str, work: Callable[[int | None, Iterator[pd.DataFrame]], Iterator[list]]) -> DataFrame:
    """``work(group, batches of its frames in order)`` for each stack, which may be of any length; yields columns in the order of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            # A missing group is one as well.
            code = pd.factorize(pdf["g"])[0]
            for part in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(code)) + 1):
                if len(part):
                    g = pdf["g"].iloc[part[0]]
                    yield None if pd.isna(g) else int(g), pdf.iloc[part[0] : part[-1] + 1]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, parts in groupby(pieces(batches), key=lambda t: t[0]):
            for columns in work(g, (part for _, part in parts)):
                out = pd.DataFrame(dict(zip(names[1:], columns, strict=True)))
                out.insert(0, names[0], pd.array([g] * len(out), "Int32"))
                yield out

    parts = max(LEAST_PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "g").sortWithinPartitions("g", F.asc_nulls_last("f")).mapInPandas(task, schema)


def with_reference(maps: DataFrame, order: str = "f") -> DataFrame:
    """``maps`` plus ``ref``, the map of the group's first frame by ``order``, ties to the lowest frame.

    The reference travels to its group's frames by a join. It goes once to each of up to ``SALTS`` parts of the group.
    """
    salt = F.coalesce(F.pmod(F.col("f"), F.lit(SALTS)), F.lit(0)).cast("int")
    refs = maps.groupBy("g").agg(F.min_by("m", F.struct(F.expr(order), "f")).alias("ref"), F.collect_set(salt).alias("_salts"))
    return maps.withColumn("_salt", salt).join(refs.select("g", "ref", F.explode("_salts").alias("_salt")), ["g", "_salt"]).drop("_salt")


REGISTERED = "g int, f bigint, transform array<double>, correlation double, model string, accepted boolean, m array<double>"


def registered(with_ref: DataFrame) -> DataFrame:
    """Each frame against its group's ``ref``: transform, correlation, model, whether it passes the gates, and the warped map."""

    def work(pdf: pd.DataFrame) -> list[list]:
        moving, fixed = images_of(pdf["m"]), images_of(pdf["ref"])
        t, c, model = align.register(fixed, moving)
        warped = np.rint(align.warp(moving, t) * 65535)
        return [pdf["g"], pdf["f"], list(t.reshape(len(t), 6)), c, model, align.accepted(t, c), list(warped.reshape(len(t), -1))]

    return framewise(with_ref, REGISTERED, work)


def registration(maps: DataFrame) -> DataFrame:
    """Each frame against the first of its group: affine terms, correlation, model, whether it passes the gates."""
    return registered(with_reference(maps)).drop("m")


def with_quality(maps: DataFrame) -> DataFrame:
    """``maps`` plus ``quality``, a frame's score by ``kernels.image_quality``."""
    return framewise(
        maps.select("g", "f", "m"), "g int, f bigint, m array<double>, quality double",
        lambda pdf: [pdf["g"], pdf["f"], pdf["m"], kernels.image_qualities(images_of(pdf["m"]))],
    )


def scored(maps: DataFrame) -> DataFrame:
    """(g, f, stability, quality): frames with the evidence of their registration to the group's first."""

    def work(pdf: pd.DataFrame) -> list[list]:
        moving = images_of(pdf["m"])
        still = align.stability(*align.register(images_of(pdf["ref"]), moving))
        return [pdf["g"], pdf["f"], still, kernels.image_qualities(moving, still)]

    return framewise(with_reference(maps), "g int, f bigint, stability double, quality double", work)


def stack_of(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["m"].to_numpy())


def whole_frame_selection(maps: DataFrame) -> DataFrame:
    """Production selector: quality, the best frame as reference, registration to it, coverage of the registered focus maps.

    The reference always stays; a frame without finite values is passed over.
    """
    rated = kept(with_quality(maps))

    def focus(pdf: pd.DataFrame) -> list[list]:
        moving = images_of(pdf["m"])
        t, _, _ = align.register(images_of(pdf["ref"]), moving)
        warped = np.rint(align.warp(moving, t) * 65535) / 65535
        return [pdf["g"], pdf["f"], pdf["quality"], list(kernels.focus_map(warped).reshape(len(pdf), -1))]

    focused = framewise(with_reference(rated, "-quality"), "g int, f bigint, quality double, m array<double>", focus)

    def work(g, pdf):
        x, quality = stack_of(pdf), pdf["quality"].to_numpy()
        reference = int(quality.argmax())
        choice = cover.near_best(np.nan_to_num(x), quality, ~np.isfinite(x).all(axis=1))
        return [(g, int(f), i in choice.taken or i == reference, choice.gains.get(i, 0.0) if i in choice.taken else 0.0, choice.covered) for i, f in enumerate(pdf["f"])]

    return per_stack(focused, "g int, f bigint, selected boolean, gain double, coverage double", work)


def with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` plus the columns of their group's row, which travels to ``SALTS`` parts of the group; a missing group is one as well."""
    one = groups.withColumnRenamed("g", "_g").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.coalesce(F.pmod(F.col("f"), F.lit(SALTS)), F.lit(0)).cast("int"))
    return salted.join(one, F.col("g").eqNullSafe(F.col("_g")) & (F.col("_salt") == F.col("_part"))).drop("_g", "_part", "_salt")


def tops(maps: DataFrame) -> DataFrame:
    """(g, n, top): frames of each group and the greatest value at each position."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(None if pd.isna(g) else g, len(part), stack_of(part).max(axis=0)) for g, part in pdf.groupby("g", dropna=False)], columns=["g", "n", "top"]).astype({"g": "Int32"})

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": pd.array([key[0]], "Int32"), "n": [pdf["n"].sum()], "top": [np.stack(pdf["top"].to_numpy()).max(axis=0)]})

    schema = "g int, n bigint, top array<double>"
    return maps.select("g", "m").mapInPandas(partial, schema).groupBy("g").applyInPandas(whole, schema)


def library_selection(maps: DataFrame, target: float = 0.995) -> DataFrame:
    """Library selector, in the order of least transitions, with reasons.

    A task sees two frames of each set of sharp positions, and the maps of frames that were taken, at most one a position.
    """

    def mark(pdf: pd.DataFrame) -> list[list]:
        x, top = stack_of(pdf) / 65535, np.stack(pdf["top"].to_numpy()) / 65535
        support = np.apply_along_axis(cover.supported, 1, top)
        words = cover.pack(cover.sharp(x, top) & support)
        # A frame without sharp positions is taken only where no other one is: then there is nothing to order.
        m = [v if some else None for v, some in zip(pdf["m"], words.any(axis=1))]
        return [pdf["g"], pdf["f"], x.mean(axis=1), pdf["n"], np.maximum(1, support.sum(axis=1)), list(words.view(np.int64)), m]

    marked = framewise(with_group(maps.select("g", "f", "m"), kept(tops(maps))), "g int, f bigint, quality double, n bigint, total bigint, words array<bigint>, m array<double>", mark)
    rated = kept(marked.withColumn("id", F.monotonically_increasing_id()))

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["f", "id"], ignore_index=True)
        quality, n, total = pdf["quality"].to_numpy(), int(pdf["n"].iloc[0]), int(pdf["total"].iloc[0])
        bits = np.ascontiguousarray(np.stack(pdf["words"].to_numpy()), np.int64).view(np.uint64)
        choice = cover.choose_packed(bits, total, quality, range(len(pdf)), cover.LIBRARY_GAIN, target, cover.bonus_of(quality, n, total))
        asked = choice.taken + ([] if choice.refused is None else [choice.refused])
        turn = [k if k < len(choice.taken) else None for k in range(len(asked))]
        return pd.DataFrame({
            "g": pd.array([key[0]] * len(asked), "Int32"), "id": pdf["id"].to_numpy()[asked], "turn": pd.array(turn, "Int32"),
            "gain": [choice.gains[i] for i in asked], "reason": [choice.reason(i) for i in asked], "coverage": choice.covered,
        })

    best = Window.partitionBy("g", "words").orderBy(F.desc("quality"), "f", "id")
    few = rated.drop("m").withColumn("_k", F.row_number().over(best)).filter("_k <= 2").drop("_k")
    asked = kept(few.groupBy("g").applyInPandas(choose, "g int, id bigint, turn int, gain double, reason string, coverage double"))

    def order(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["f", "id"], ignore_index=True)
        taken = pdf["turn"].to_numpy().argsort().tolist()
        path = kernels.nearest_order(taken, stack_of(pdf) / 65535) if len(taken) > 1 else taken
        return pd.DataFrame({"id": pdf["id"].to_numpy()[path], "place": range(len(path))})

    taken = asked.filter("turn is not null").select("id", "turn").join(rated.select("id", "g", "f", "m"), "id")
    places = taken.groupBy("g").applyInPandas(order, "id bigint, place int")
    said = asked.select("id", "gain", "reason").join(places, "id", "left")
    rows = with_group(rated.select("id", "g", "f"), asked.groupBy("g").agg(F.first("coverage").alias("coverage"))).join(said, "id", "left")
    return rows.select("g", "f", "place", F.coalesce("gain", F.lit(0.0)).alias("gain"), F.coalesce("reason", F.lit("nothing new")).alias("reason"), "coverage")


#: Least similarity of a map to the head of its cluster, for these maps.
CLUSTER = 0.62


def focus_clusters(maps: DataFrame) -> DataFrame:
    """Clusters in one pass over the frames: a stack may have any length, its representatives ``MOST_BYTES``."""

    def work(g, batches):
        clusters = passes.Clusters(CLUSTER)
        for pdf in batches:
            x = stack_of(pdf) / 65535
            found = clusters.take(x, x.mean(axis=1), pdf["f"].tolist())
            if 8 * clusters.n * x.shape[1] > MOST_BYTES:
                raise ValueError(f"group {g} has more than {clusters.n - 1} clusters; their representatives may have {MOST_BYTES} bytes: split the group")
            if found:
                yield list(zip(*found, strict=True))
        yield list(zip(*clusters.end(), strict=True))

    return in_order(maps, "g int, f bigint, cluster int, representative boolean", work)


def alignment_order(maps: DataFrame) -> DataFrame:
    """Order of frames for registration; the order of capture where the path is too doubtful."""

    def work(g, pdf):
        costs = paths.Costs(stack_of(pdf) / 65535)
        path = paths.path_order(costs)
        confidence = float(costs.similar(np.array(path[:-1]), np.array(path[1:])).mean()) if len(path) > 1 else 1.0
        path = path if confidence >= 0.35 else list(range(len(path)))
        return [(g, int(pdf["f"][i]), k, confidence) for k, i in enumerate(path)]

    return per_stack(maps, "g int, f bigint, place int, confidence double", work)


def anchor_split(maps: DataFrame) -> DataFrame:
    """Scenes by three anchors each, in one pass over the frames: a stack may have any length."""

    def work(g, batches):
        scenes, waiting = passes.Scenes(0.55), []
        for pdf in batches:
            found = scenes.take(stack_of(pdf) / 65535)
            waiting += pdf["f"].tolist()
            yield waiting[: len(found)], found
            waiting = waiting[len(found) :]
        yield waiting, scenes.end()

    return in_order(maps, "g int, f bigint, scene int", work)


#: Different descriptors of a group that one task holds against all of it, and how many of these at once.
CHUNK, ROWS = 4096, 32
NONE = 255


def two_nearest(descriptors: DataFrame) -> DataFrame:
    """(g, i, j, distance, second) of (g, i, bits): the two nearest others of each row's group by Hamming distance, ties to the lower id.

    Equal descriptors are one, with their three lowest ids, so copies cost nothing. Different ones are compared all with
    all: each part of a group goes over the whole group, of which a task holds 26 bytes a descriptor.
    """
    low = descriptors.filter("g is not null and i is not null").withColumn("_k", F.row_number().over(Window.partitionBy("g", "bits").orderBy("i"))).filter("_k <= 3")
    named = kept(low.groupBy("g", "bits").agg(F.sort_array(F.collect_list("i")).alias("ids")))
    parted = named.join(named.groupBy("g").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_n")), "g")
    parts = max(LEAST_PARTS, int(descriptors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = parted.select("g", F.pmod(F.xxhash64("bits"), F.col("_n")).cast("int").alias("part"), "bits", "ids").repartition(parts, "g", "part")
    pair = [F.col("ids")[0].alias("a"), F.coalesce(F.get("ids", F.lit(1)), F.col("ids")[0]).alias("b"), (F.size("ids") > 1).alias("two")]
    whole = parted.select(F.col("g").alias("g"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("part"), F.col("bits").alias("bits"), *pair).repartition(parts, "g", "part")

    def task(key: tuple, mine: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        all_ = all_.sort_values("a", ignore_index=True)
        words, a, b, two = all_["bits"].to_numpy().view(np.uint64), all_["a"].to_numpy(), all_["b"].to_numpy(), all_["two"].to_numpy()
        own = mine["bits"].to_numpy().view(np.uint64)
        order = np.argsort(words)
        me = order[np.searchsorted(words[order], own)] if len(own) else np.zeros(0, np.intp)
        out = []
        for k in range(0, len(own), ROWS):
            d = np.bitwise_count(own[k : k + ROWS, None] ^ words)
            r = np.arange(len(d))
            d[r, me[k : k + ROWS]] = NONE
            first = d.argmin(axis=1)
            d1 = d[r, first].copy()
            d[r, first] = NONE
            next_ = d.argmin(axis=1)
            d2 = d[r, next_]
            # The second is the next id of the nearest descriptor, or the first id of the next one.
            same = two[first] & (d1 < NONE) & ((d1 < d2) | (b[first] < a[next_]))
            out.append((d1, a[first], np.where(same, d1, d2), np.where(same, b[first], a[next_])))
        d1, j1, d2, j2 = (np.concatenate(c) for c in zip(*out, strict=True)) if out else ([],) * 4
        return pd.DataFrame({"g": mine["g"], "bits": mine["bits"], "ids": mine["ids"], "d1": d1, "j1": j1, "d2": d2, "j2": j2})

    near = asked.groupBy("g", "part").cogroup(whole.groupBy("g", "part")).applyInPandas(task, "g int, bits bigint, ids array<bigint>, d1 int, j1 bigint, d2 int, j2 bigint")
    pair_of = lambda d, j: F.struct(d.cast("int").alias("d"), j.alias("j"))
    copies = F.transform(F.filter("ids", lambda j: j != F.col("i")), lambda j: pair_of(F.lit(0), j))
    others = F.filter(F.array(pair_of(F.col("d1"), F.col("j1")), pair_of(F.col("d2"), F.col("j2"))), lambda t: t["d"] < NONE)
    met = descriptors.join(near, ["g", "bits"]).select("g", "i", F.sort_array(F.concat(copies, others)).alias("t")).filter(F.size("t") >= 2)
    return met.select("g", "i", F.col("t")[0]["j"].alias("j"), F.col("t")[0]["d"].alias("distance"), F.col("t")[1]["d"].alias("second"))


# Fusion: a strategy takes (g, f, m) and returns (g, p, fused).

Strategy = Callable[[DataFrame], DataFrame]
#: Fusion strategies by name. ``register_strategy`` adds to it.
STRATEGIES: dict[str, Strategy] = {}


def register_strategy(name: str) -> Callable[[Strategy], Strategy]:
    """Give a function from (g, f, m) to (g, p, fused) a name: a new fusion strategy."""

    def keep(f: Strategy) -> Strategy:
        STRATEGIES[name] = f
        return f

    return keep


def sharpness(image: np.ndarray) -> np.ndarray:
    return kernels.gaussian(np.abs(kernels.laplacian(image)), 1.0)


def measured(maps: DataFrame, measure: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(g, f, p, v, s): each frame's values and its measure, by position."""
    rows = framewise(
        maps.select("g", "f", "m"), "g int, f bigint, v array<double>, s array<double>",
        lambda pdf: [pdf["g"], pdf["f"], *zip(*[(x.ravel(), measure(x).ravel()) for x in images_of(pdf["m"])], strict=True)],
    )
    return rows.select("g", "f", F.posexplode(F.arrays_zip("v", "s")).alias("p", "z")).select("g", "f", "p", "z.v", "z.s")


def label_maps(owners: DataFrame, column: str) -> DataFrame:
    """(g, labels): a group's label map as one row; it has as many entries as a frame has positions."""
    return owners.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", column))), lambda x: x[column]).alias("labels"))


def regularised(labels: DataFrame, least: int = 8) -> DataFrame:
    """Label maps whose small regions took the label around them."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"g": pdf["g"], "labels": [kernels.settled(square(x).astype(np.int64), least).ravel() for x in pdf["labels"]]})

    return labels.select("g", "labels").mapInPandas(task, "g int, labels array<bigint>")


def owner_labels(maps: DataFrame, least: int = 8, guarded: bool = False) -> DataFrame:
    """(g, labels): the sharpest frame of each position, small regions settled. Warped frames in, one row per group out.

    With ``guarded``, large flat regions are then locked to the frame of median tone, and edges to their sharpest frame.
    """
    px = measured(maps, sharpness)
    owners = dense.owner(px, ["g", "p"], "f", "s")
    labels = regularised(label_maps(owners, "owner"), least)
    if not guarded:
        return labels
    px, owners = kept(px), kept(owners)
    now = labels.select("g", F.posexplode("labels").alias("p", "owner"))
    now = overridden(overridden(now, background_locks(px, owners)), edge_guards(px, owners))
    return label_maps(now, "owner")


def blended(maps: DataFrame, labels: DataFrame, weigh: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """(g, p, fused): frames weighted by their part of the label map; frames that own no position don't take part."""
    used = labels.select("g", F.explode(F.array_distinct("labels")).alias("f"))
    rows = maps.join(used, ["g", "f"], "left_semi").join(labels, "g")

    def work(pdf: pd.DataFrame) -> list[list]:
        out = [(x.ravel(), weigh(square(own).astype(np.int64), int(f)).ravel()) for x, own, f in zip(images_of(pdf["m"]), pdf["labels"], pdf["f"], strict=True)]
        return [pdf["g"], *zip(*out, strict=True)]

    long = framewise(rows.select("g", "f", "m", "labels"), "g int, v array<double>, w array<double>", work)
    px = long.select("g", F.posexplode(F.arrays_zip("v", "w")).alias("p", "z")).select("g", "p", "z.v", "z.w")
    return px.groupBy("g", "p").agg((F.sum(F.col("w") * F.col("v")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("fused"))


def feathered(labels: np.ndarray, frame: int) -> np.ndarray:
    return kernels.gaussian((labels == frame).astype(float), 1.0)


def narrowed(labels: np.ndarray, frame: int) -> np.ndarray:
    """Hard but next to a change of owner."""
    return kernels.narrow(labels, np.array([frame, *[v for v in np.unique(labels) if v != frame]]))[0]


@register_strategy("quality")
def fuse_quality(maps: DataFrame) -> DataFrame:
    """Frames warped to the first, hard owners by sharpness, regularised and guarded, feathered."""
    moved = kept(registered(with_reference(maps)).select("g", "f", "m"))
    return blended(moved, owner_labels(moved, guarded=True), feathered)


@register_strategy("narrow")
def fuse_narrow(maps: DataFrame) -> DataFrame:
    """Frames warped to the first, hard owners with small regions settled, copied exactly; only seams are feathered."""
    moved = kept(registered(with_reference(maps)).select("g", "f", "m"))
    return blended(moved, owner_labels(moved), narrowed)


#: A model: an image to its response at each position. Weights are the caller's; see ``OnnxModel``.
Model = Callable[[np.ndarray], np.ndarray]
TILE, OVERLAP = 512, 64
SCALES = (1, 2)


def response_model(image: np.ndarray) -> np.ndarray:
    """The stand-in where no network's weights are given: sharpness and texture."""
    return (sharpness(image) + kernels.texture_energy(image)) / 2


def tile_starts(size: int, tile: int = TILE, overlap: int = OVERLAP) -> list[int]:
    """First places of overlapping tiles, the last flush with the edge."""
    stride = max(64, tile - overlap)
    return sorted({min(k, max(0, size - tile)) for k in range(0, max(1, size - tile + stride), stride)})


def tiled(model: Model, image: np.ndarray, tile: int = TILE, overlap: int = OVERLAP) -> np.ndarray:
    """A model's response from tiles, so that its memory is bounded; overlaps are averaged with weights that fall to the tile's edge."""
    h, w = image.shape
    total, mass = np.zeros((h, w)), np.zeros((h, w))
    for y in tile_starts(h, tile, overlap):
        for x in tile_starts(w, tile, overlap):
            part = image[y : y + tile, x : x + tile]
            ramp = lambda n: np.minimum(np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)) / max(1, overlap), 1.0)
            weight = np.outer(ramp(part.shape[0]), ramp(part.shape[1]))
            total[y : y + tile, x : x + tile] += weight * model(part)
            mass[y : y + tile, x : x + tile] += weight
    return total / mass


def at_scales(model: Model, image: np.ndarray, scales: tuple[int, ...] = SCALES) -> np.ndarray:
    """Mean response over sizes: the image at its own size and shrunk by whole factors, brought back."""
    h, w = image.shape
    out = np.zeros((h, w))
    for s in scales:
        small = image if s == 1 else kernels.resize(image, max(1, h // s), max(1, w // s))
        back = tiled(model, small)
        out += back if s == 1 else kernels.resize(back, h, w)
    return out / len(scales)


#: Providers in order of preference.
PROVIDERS = ("CUDAExecutionProvider", "DmlExecutionProvider", "CPUExecutionProvider")
_sessions: dict[str, object] = {}


@dataclass(frozen=True)
class OnnxModel:
    """A network that takes (1, 1, h, w) and returns as many responses; only its path travels, and each worker makes one session."""

    path: str

    def __call__(self, image: np.ndarray) -> np.ndarray:
        if self.path not in _sessions:
            import onnxruntime

            there = set(onnxruntime.get_available_providers())
            _sessions[self.path] = onnxruntime.InferenceSession(self.path, providers=[p for p in PROVIDERS if p in there])
        session = _sessions[self.path]
        wide = kernels.padded(image.astype(np.float32))
        out = session.run(None, {session.get_inputs()[0].name: wide[None, None]})[0]
        return np.asarray(out, float).reshape(wide.shape)[: image.shape[0], : image.shape[1]]


def fuse_by_model(maps: DataFrame, model: Model = response_model) -> DataFrame:
    """Softmax of a model's responses over the frames of each position, tempered by the group's deviation."""
    px = measured(registered(with_reference(maps)).select("g", "f", "m"), lambda x: at_scales(model, x))
    spread = px.groupBy("g").agg(F.greatest(F.stddev_pop("s"), F.lit(1e-6)).alias("scale"))
    top = px.groupBy("g", "p").agg(F.max("s").alias("top"))
    e = F.exp((F.col("s") - F.col("top")) / F.col("scale"))
    return px.join(top, ["g", "p"]).join(spread, "g").groupBy("g", "p").agg((F.sum(e * F.col("v")) / F.sum(e)).alias("fused"))


@register_strategy("ai")
def fuse_soft(maps: DataFrame) -> DataFrame:
    return fuse_by_model(maps)


STRATEGIES["fast"] = STRATEGIES["ai"]


def fuse(maps: DataFrame, strategy: str) -> DataFrame:
    """Fused map of each stack by a registered strategy; an unknown name is an error."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy named {strategy}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](maps)


FEATURES = (
    "g int, f bigint, hash bigint, components int, largest int, angle double, major double, minor double, focus double, texture double, corners int, histogram array<double>, "
    "dy double, dx double, peak double"
)


def frame_features(maps: DataFrame) -> DataFrame:
    """Per frame: perceptual hash, components of strong support, axis, focus, texture, corners, histogram, residual shift to the first frame."""

    def work(pdf: pd.DataFrame) -> list[list]:
        x, out = images_of(pdf["m"]), []
        shifts = align.phase_shifts(images_of(pdf["ref"]), x)
        for a in x:
            labels, n = kernels.components(kernels.strong(a))
            largest = max((s[1] for s in kernels.component_stats(labels, n)), default=0)
            out.append((kernels.perceptual_hash(a), n, largest, *kernels.principal_axis(labels > 0), kernels.focus_map(a).mean(), kernels.texture_energy(a).mean(), len(align.corners(a)), kernels.histogram(a)))
        return [pdf["g"], pdf["f"], *zip(*out, strict=True), *shifts.T]

    return framewise(with_reference(maps), FEATURES, work)


def residual_diagnostics(features: DataFrame, reliable: float = 0.1) -> DataFrame:
    """(g, n, residual): the median length of the shifts whose correlation peak is reliable; null without one."""
    good = F.col("peak") >= reliable
    return features.groupBy("g").agg(F.count_if(good).alias("n"), F.percentile(F.when(good, F.hypot("dy", "dx")), 0.5).alias("residual"))


def background_locks(px: DataFrame, owners: DataFrame, least: int = 6, share: float = 0.4) -> DataFrame:
    """(g, p, owner): positions of large flat regions, locked to the frame of median tone, the lowest of equals.

    Flat are positions whose best sharpness is below the group's ``share`` quantile; regions of ``least`` positions count.
    """
    limit = owners.groupBy("g").agg(F.percentile("best", share).alias("t"))
    flat = owners.join(limit, "g").select("g", "p", (F.col("best") < F.col("t")).cast("int").alias("flat"))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for g, x in zip(pdf["g"], pdf["labels"], strict=True):
                regions, n = kernels.components(square(x) > 0)
                big = [s[0] for s in kernels.component_stats(regions, n) if s[1] >= least]
                out += [(g, int(p), int(r)) for p, r in enumerate(regions.ravel()) if r in big]
            yield pd.DataFrame(out, columns=["g", "p", "region"])

    regions = label_maps(flat, "flat").mapInPandas(task, "g int, p int, region int")
    tones = px.join(regions, ["g", "p"]).groupBy("g", "region", "f").agg(F.avg("v").alias("tone"))
    middle = tones.groupBy("g", "region").agg(F.percentile("tone", 0.5).alias("middle"))
    anchors = tones.join(middle, ["g", "region"]).groupBy("g", "region").agg(F.min_by("f", F.struct(F.abs(F.col("tone") - F.col("middle")), "f")).alias("anchor"))
    return regions.join(anchors, ["g", "region"]).select("g", "p", F.col("anchor").alias("owner"))


def background_owner(maps: DataFrame) -> DataFrame:
    """(g, p, owner): the sharpest frame of each position, large flat regions locked."""
    px = measured(maps, sharpness)
    owners = dense.owner(px, ["g", "p"], "f", "s")
    return overridden(owners.select("g", "p", "owner"), background_locks(px, owners))


def overridden(owners: DataFrame, change: DataFrame) -> DataFrame:
    """Owners (g, p, owner) with those of ``change`` in their place."""
    return owners.join(change.withColumnRenamed("owner", "_now"), ["g", "p"], "left").select("g", "p", F.coalesce("_now", "owner").alias("owner"))


def edge_guards(px: DataFrame, owners: DataFrame, edge: float = 0.35, steps: int = 2, share: float = 0.7) -> DataFrame:
    """(g, p, owner): positions beside subject edges, given to one sharp frame of each outline.

    Outlines are connected positions where the group's best sharpness is above its 1 - ``edge`` quantile. Each takes the
    frame of greatest sharpness summed over it, the lowest of equals; positions within ``steps`` follow unless that frame
    has less than ``share`` of the best there. A later outline, in scan order, goes over an earlier one.
    """
    limit = owners.groupBy("g").agg(F.percentile("best", 1 - edge).alias("t"))
    marked = owners.join(limit, "g").select("g", "p", (F.col("best") > F.col("t")).cast("int").alias("edge"))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for g, x in zip(pdf["g"], pdf["labels"], strict=True):
                regions, n = kernels.components(square(x) > 0)
                for k in range(1, n + 1):
                    near = kernels.dilated(regions == k, steps)
                    out += [(g, k, int(p), bool(regions.ravel()[p] == k)) for p in np.flatnonzero(near.ravel())]
            yield pd.DataFrame(out, columns=["g", "region", "p", "inside"])

    places = label_maps(marked, "edge").mapInPandas(task, "g int, region int, p int, inside boolean")
    sums = px.join(places.filter("inside"), ["g", "p"]).groupBy("g", "region", "f").agg(F.sum("s").alias("s"))
    chosen = dense.owner(sums, ["g", "region"], "f", "s").select("g", "region", F.col("owner").alias("f"))
    able = places.join(chosen, ["g", "region"]).join(px.select("g", "f", "p", "s"), ["g", "f", "p"]).join(owners.select("g", "p", "best"), ["g", "p"])
    return able.filter(F.col("s") >= share * F.col("best")).groupBy("g", "p").agg(F.max_by("f", "region").alias("owner"))


def edge_guarded(maps: DataFrame) -> DataFrame:
    """(g, p, owner): the sharpest frame of each position, guarded beside subject edges."""
    px = measured(maps, sharpness)
    owners = dense.owner(px, ["g", "p"], "f", "s")
    return overridden(owners.select("g", "p", "owner"), edge_guards(px, owners))


def gain_overlap(maps: DataFrame, factor: int = 2) -> DataFrame:
    """(g, f, gain, overlap): the median ratio of the group's first frame to each registered and shrunk one, over places that both cover.

    Places next to one that isn't covered don't count, nor do dark or saturated ones; gains are clamped to 0.9..1.1.
    """

    def work(pdf: pd.DataFrame) -> list[list]:
        moving, fixed = images_of(pdf["m"]), images_of(pdf["ref"])
        t, _, _ = align.register(fixed, moving)
        gains, overlaps = [], []
        for a, b, m in zip(fixed, align.warp(moving, t), t, strict=True):
            h, w = max(1, a.shape[0] // factor), max(1, a.shape[1] // factor)
            use = kernels.shrunk(align.valid(a.shape, m), factor)[:h, :w]
            x, y = kernels.resize(a, h, w), kernels.resize(b, h, w)
            good = use & (x > 0.02) & (y > 0.02) & (x < 0.98) & (y < 0.98)
            gains.append(float(np.clip(np.median(x[good] / y[good]), 0.9, 1.1)) if good.any() else 1.0)
            overlaps.append(float(use.mean()))
        return [pdf["g"], pdf["f"], gains, overlaps]

    return framewise(with_reference(maps), "g int, f bigint, gain double, overlap double", work)


def contours(maps: DataFrame, sigma: float = 2.0) -> DataFrame:
    """(g, f, p, energy): each frame's contour energy, with strong support as seeds."""
    rows = framewise(
        maps.select("g", "f", "m"), "g int, f bigint, e array<double>",
        lambda pdf: [pdf["g"], pdf["f"], [kernels.contour_energy(kernels.gradient(x), np.abs(kernels.laplacian(x)), kernels.strong(x), sigma).ravel() for x in images_of(pdf["m"])]],
    )
    return rows.select("g", "f", F.posexplode("e").alias("p", "energy"))


def centrelines(maps: DataFrame, threshold: float = 0.12, strips: int = 6, least: int = 3, tolerance: float = 2.0) -> DataFrame:
    """(g, f, strips, offset, consistent): each frame's shape against the first of its group, across the main axis.

    Null where the first shape isn't long.
    """

    def work(pdf: pd.DataFrame) -> list[list]:
        found = [kernels.centreline(a > threshold, b > threshold, strips, least) for a, b in zip(images_of(pdf["ref"]), images_of(pdf["m"]), strict=True)]
        good = [None if f is None else f[0] >= strips - 1 and f[1] <= tolerance and 0.97 <= f[2] <= 1.03 and 0.75 <= f[3] <= 1.33 for f in found]
        return [pdf["g"], pdf["f"], [None if f is None else f[0] for f in found], [None if f is None or not np.isfinite(f[1]) else f[1] for f in found], good]

    return framewise(with_reference(maps), "g int, f bigint, strips int, offset double, consistent boolean", work)


TONED = "g int, f bigint, r array<int>, gr array<int>, b array<int>"


def toned(colours: DataFrame, sigma: float = 2.0, least: int = 4) -> DataFrame:
    """Frames (g, f, r, gr, b arrays of 0..255) brought to the tone of their group's first, material by material.

    A material's core are positions of the same material in both frames. Offsets are added, rounded half to even and
    clipped; the reference and positions outside every core's reach stay.
    """
    refs = colours.groupBy("g").agg(F.min_by(F.struct("r", "gr", "b"), "f").alias("ref")).select("g", F.col("ref.r").alias("rr"), F.col("ref.gr").alias("rg"), F.col("ref.b").alias("rb"))

    def material(rgb: np.ndarray) -> np.ndarray:
        """Coarse classes: gray levels, or the strongest colour."""
        spread = rgb.max(axis=2) - rgb.min(axis=2)
        return np.where(spread >= 50, 4 + rgb.argmax(axis=2), np.digitize(rgb.max(axis=2), [64, 160]))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                own, ref = (np.stack([square(c) for c in cs], axis=2) for cs in ((r.r, r.gr, r.b), (r.rr, r.rg, r.rb)))
                classes = material(own)
                offset = kernels.tone_offset(ref, own, classes, classes == material(ref), sigma, least)
                new = np.clip(np.rint(own + offset), 0, 255).astype(int)
                out.append((r.g, r.f, *(new[:, :, c].ravel() for c in range(3))))
            yield pd.DataFrame(out, columns=["g", "f", "r", "gr", "b"])

    return colours.join(refs, "g").mapInPandas(task, TONED)
