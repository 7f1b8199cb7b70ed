"""Operators on dense maps in long form (group, position, frame, value).

Everything per position is a grouped aggregate or a window over (group, position): the frames of a
position are few, positions are many, so the shuffle spreads evenly and partial aggregates combine
before it. Ties always fall to the lowest frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.kept import kept
from lamina.operators.sequence import running_total


def owner(px: DataFrame, keys: list[str], frame: str, value: str) -> DataFrame:
    """Best value and its lowest frame at each position (argmax); null values never win."""
    best = px.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("best"), (-F.col(frame)).alias("f"))).alias("_m"))
    return best.select(*keys, F.col("_m.best").alias("best"), (-F.col("_m.f")).alias("owner"))


def running_owner(px: DataFrame, keys: list[str], frame: str, value: str, valid: Column) -> DataFrame:
    """The owner after each frame; frames that don't cover the position are passed over."""
    w = Window.partitionBy(*keys).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    m = F.max(F.when(valid, F.struct(F.col(value).alias("v"), (-F.col(frame)).alias("f")))).over(w)
    return px.withColumn("_m", m).withColumns({"best": F.col("_m.v"), "owner": -F.col("_m.f")}).drop("_m")


def softmax(px: DataFrame, keys: list[str], value: str, scale: float, valid: Column | None = None) -> DataFrame:
    """``px`` plus ``weight``: stable softmax over frames; where no frame is valid, the mask is not used."""
    w = Window.partitionBy(*keys)
    if valid is None:
        valid = F.lit(True)
    out = px.withColumn("_v", valid).withColumn("_use", F.col("_v") | ~F.max("_v").over(w))
    top = F.max(F.when(F.col("_use"), F.col(value))).over(w)
    out = out.withColumn("_e", F.when(F.col("_use"), F.exp((F.col(value) - top) / scale)).otherwise(0.0))
    return out.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_v", "_use", "_e")


def renormalise(px: DataFrame, keys: list[str], weight: str, valid: Column) -> DataFrame:
    """Weights of invalid frames become 0 and the rest sum to 1; without any mass, valid frames share equally."""
    w = Window.partitionBy(*keys)
    out = px.withColumn("_v", valid).withColumn("_m", F.when(F.col("_v"), F.col(weight)).otherwise(0.0))
    total, n = F.sum("_m").over(w), F.count_if(F.col("_v")).over(w)
    return out.withColumn(weight, F.when(total > 0, F.col("_m") / total).when(n > 0, F.col("_v").cast("int") / n).otherwise(0.0)).drop("_v", "_m")


def top_k(px: DataFrame, keys: list[str], frame: str, value: str, k: int) -> DataFrame:
    """The k greatest values of each position with weights that sum to 1."""
    w = Window.partitionBy(*keys)
    ranked = px.withColumn("rank", F.row_number().over(w.orderBy(F.desc(value), frame))).filter(F.col("rank") <= k)
    return ranked.withColumn("weight", F.col(value) / F.sum(value).over(w))


def blend(px: DataFrame, keys: list[str], value: str, weight: str, least: float = 1e-6) -> DataFrame:
    """Weighted mean over frames, rounded half to even and clipped to a byte."""
    mean = F.sum(F.col(weight) * F.col(value)) / F.greatest(F.sum(weight), F.lit(least))
    return px.groupBy(*keys).agg(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(mean).cast("int"))).alias("blended"))


def summary(values: Column) -> dict[str, Column]:
    """Aggregates of a focus map: mean, population deviation, share of focused positions, quality."""
    mean = F.avg(values)
    return {
        "mean": mean,
        "std": F.stddev_pop(values),
        "focused": F.avg(F.when(values > 0.35, 1.0).otherwise(0.0)),
        "quality": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.65 * mean + 0.35 * F.percentile(values, 0.9))),
    }


def support(px: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``px`` plus ``strong``: values above the frame's 70th percentile; a map too sparse for it uses mean plus a quarter deviation."""
    s = px.groupBy(*keys).agg(F.percentile(value, 0.7).alias("_t"), F.min(value).alias("_min"), (F.avg(value) + 0.25 * F.stddev_pop(value)).alias("_alt"))
    t = F.when(F.col("_t") > F.col("_min") + 1e-7, F.col("_t")).when(F.col("_alt") > F.col("_min") + 1e-7, F.col("_alt"))
    return px.join(s, keys).withColumn("strong", F.coalesce(F.col(value) > t, F.lit(False))).drop("_t", "_min", "_alt")


def pair_similarity(pairs: DataFrame, px: DataFrame, group: str, frame: str, position: str, value: str) -> DataFrame:
    """(group, i, j, similarity, difference, overlap) for listed pairs of frames: an equi-join on frame and position."""
    marked = support(px, [group, frame], value)
    a = marked.select(group, F.col(frame).alias("i"), position, F.col(value).alias("a"), F.col("strong").alias("sa"))
    b = marked.select(group, F.col(frame).alias("j"), position, F.col(value).alias("b"), F.col("strong").alias("sb"))
    m = pairs.join(a, [group, "i"]).join(b, [group, "j", position])
    n, either = F.count("*"), F.count_if(F.col("sa") | F.col("sb"))
    m = m.groupBy(group, "i", "j").agg(
        F.coalesce(F.corr("a", "b"), F.lit(1.0)).alias("corr"),
        (F.sum(F.abs(F.col("a") - F.col("b"))) / n).alias("difference"),
        F.when(either == 0, 1.0).otherwise(F.count_if(F.col("sa") & F.col("sb")) / either).alias("overlap"),
    )
    s = 0.45 * (F.when(F.isnan("corr"), 1.0).otherwise(F.col("corr")) + 1) / 2 + 0.30 * (1 - F.col("difference")) + 0.25 * F.col("overlap")
    return m.select(group, "i", "j", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)).alias("similarity"), "difference", "overlap")


def quantiles(rows: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """(keys, name): the linear quantile of ``value`` for each key, exact however many values a key has.

    Equal values are counted before they are put in order by range, so no task holds the values of a key.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = kept(running_total(counted, [*keys, value], F.col("_n"), "_at"))
    ends = placed.groupBy(*keys).agg(F.min("_at").alias("_from"), F.max(F.col("_at") + F.col("_n")).alias("_to"))
    met = placed.join(ends, keys) if keys else placed.join(F.broadcast(ends))
    rank = F.col("_from") + share * (F.col("_to") - F.col("_from") - 1)
    low, high = F.floor(rank), F.ceil(rank)
    has = lambda r: (F.col("_at") <= r) & (r < F.col("_at") + F.col("_n"))
    picked = met.filter(has(low) | has(high)).groupBy(*keys).agg(
        F.max(F.when(has(low), F.col(value))).alias("_a"), F.max(F.when(has(high), F.col(value))).alias("_b"), F.first(rank - low).alias("_t")
    )
    return picked.select(*keys, (F.col("_a") + F.col("_t") * (F.col("_b") - F.col("_a"))).alias(name))


def flat_noise(flat: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """(key, median, mad) of the values of each key with at least ``least`` rows."""
    enough = flat.groupBy(key).agg(F.count("*").alias("_c")).filter(F.col("_c") >= least).select(key)
    rows = kept(flat.join(enough, key).select(key, value))
    medians = quantiles(rows, [key], value, 0.5, "median")
    apart = rows.join(medians, key).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return quantiles(apart, [key], "_d", 0.5, "mad").join(medians, key)


def noise_ceiling(samples: DataFrame, bin_col: str, value: str, spread: str, least: int = 64, least_flat: int = 32, share: float = 0.35, k: float = 6.0) -> DataFrame:
    """(bin, ceiling): median + k robust deviations of the values in the flattest rows of each bin.

    A bin with too few rows takes the greater ceiling of the bins beside it.
    """
    sizes = samples.groupBy(bin_col).agg(F.count("*").alias("n"))
    limits = quantiles(samples.join(sizes.filter(F.col("n") >= least).select(bin_col), bin_col), [bin_col], spread, share, "limit")
    flat = samples.join(limits, bin_col).filter(F.col(spread) <= F.col("limit"))
    noise = flat_noise(flat, bin_col, value, least_flat)
    own = noise.select(bin_col, F.greatest(F.lit(1e-6), F.col("median") + k * 1.4826 * F.col("mad")).alias("own"))
    bins = sizes.select(bin_col).join(own, bin_col, "left")
    near = own.select((F.col(bin_col) - 1).alias(bin_col), "own").unionByName(own.select((F.col(bin_col) + 1).alias(bin_col), "own")).groupBy(bin_col).agg(F.max("own").alias("near"))
    return bins.join(near, bin_col, "left").select(bin_col, F.coalesce("own", "near").alias("ceiling"), F.col("own").isNull().alias("borrowed"))


def _readers(c: Column, d: Column, size: int) -> Column:
    """Places whose tap at distance d is c: from c itself and from its images beyond either border."""
    seen = F.array_distinct(F.array(c, -c, 2 * (size - 1) - c))
    return F.filter(F.transform(seen, lambda v: v - d), lambda t: (t >= 0) & (t < size))


def stencils(px: DataFrame, group: list[str], x: str, y: str, size: int, kernels: dict[str, tuple[str, dict[tuple[int, int], float]]]) -> DataFrame:
    """Correlations with small kernels, borders reflected without the edge (101): each name is a column and its kernel.

    Each position sends its weighted values to the places that read it, over the border too, and they are summed:
    one shuffle for all kernels, no join, and the fan-out is the number of taps.
    """
    taps = sorted({o for _, k in kernels.values() for o in k})
    weight = lambda name, o: F.lit(float(kernels[name][1].get(o, 0.0))).alias(name)
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), *[weight(n, (dx, dy)) for n in kernels]) for dx, dy in taps])
    sent = px.select(*group, x, y, *sorted({c for c, _ in kernels.values()}), F.explode(offsets).alias("t"))
    sent = sent.select(*group, y, F.col("t.dy").alias("_dy"), *[(F.col(f"t.{n}") * F.col(c)).alias(f"_{n}") for n, (c, _) in kernels.items()], F.explode(_readers(F.col(x), F.col("t.dx"), size)).alias("_x"))
    sent = sent.select(*group, *[f"_{n}" for n in kernels], "_x", F.explode(_readers(F.col(y), F.col("_dy"), size)).alias("_y"))
    return sent.groupBy(*group, F.col("_x").alias(x), F.col("_y").alias(y)).agg(*[F.sum(f"_{n}").alias(n) for n in kernels])


def stencil(px: DataFrame, group: list[str], value: str, x: str, y: str, size: int, kernel: dict[tuple[int, int], float]) -> DataFrame:
    """One correlation, as ``response``."""
    return stencils(px, group, x, y, size, {"response": (value, kernel)})


def sent(px: DataFrame, keys: list[str], columns: list[str], x: str, y: str, size: int, offsets: list[tuple[int, int]]) -> DataFrame:
    """Columns of each position at the places that it reaches: rows (keys, x, y, dx, dy, columns); nothing leaves the map."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    out = px.select(*keys, x, y, *columns, F.explode(steps).alias("s"))
    tx, ty = F.col(x) + F.col("s.dx"), F.col(y) + F.col("s.dy")
    return out.filter(tx.between(0, size - 1) & ty.between(0, size - 1)).select(*keys, tx.alias(x), ty.alias(y), F.col("s.dx").alias("dx"), F.col("s.dy").alias("dy"), *columns)


def disc(rx: float, ry: float) -> list[tuple[int, int]]:
    """Offsets inside an ellipse."""
    return [(dx, dy) for dx in range(-int(rx), int(rx) + 1) for dy in range(-int(ry), int(ry) + 1) if (dx / max(rx, 1e-9)) ** 2 + (dy / max(ry, 1e-9)) ** 2 <= 1]


def window(r: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1)]


def overruled(base: DataFrame, evidence: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, owner, best) after evidence (keys, strong, strength): its owner takes over unless its strength is under ``share`` of the local best."""
    met = base.join(evidence, keys, "left")
    return met.select(*keys, F.when(F.col("strength") >= share * F.col("best"), F.col("strong")).otherwise(F.col("owner")).alias("owner"), "best")


def array_quantile(values: Column, share: float) -> Column:
    """Linear quantile of an array's numbers; null for an empty one."""
    def at(v: Column) -> Column:
        rank = share * (F.size(v) - 1)
        low = F.floor(rank).cast("int")
        a, b = F.get(v, low), F.get(v, F.ceil(rank).cast("int"))
        return a + (rank - low) * (b - a)

    return F.get(F.transform(F.array(F.sort_array(values)), at), 0)
