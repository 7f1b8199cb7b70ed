"""Ordered-sequence operators: splits, numbering, natural order, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.kept import kept


def split_sequence(rows: DataFrame, source: str, order: list[str], boundary: Column) -> DataFrame:
    """``rows`` plus ``group_no``: a running number that grows at rows where ``boundary`` holds.

    ``boundary`` may use ``lag``/``lead`` over the same window; null counts as no boundary.
    """
    w = Window.partitionBy(source).orderBy(*order)
    return rows.withColumn("_b", F.coalesce(boundary, F.lit(False)).cast("int")).withColumn("group_no", F.sum("_b").over(w)).drop("_b")


def capture_boundary(
    source: str, order: list[str], time: str, value: str, bad: Column, *, pause: float, long_pause: float, change: float, pause_change: float, shape: str | None = None, subject_changed: Column | None = None
) -> Column:
    """Where a capture sequence is cut: time runs backwards, a long pause, a great change, another shape or subject, or a
    pause with a small change; unreadable rows stand alone. A missing time is no gap; what isn't known is no change."""
    w = Window.partitionBy(source).orderBy(*order)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    known = lambda c: F.coalesce(c, F.lit(False))
    gap = F.coalesce(seconds(F.col(time)) - F.lag(seconds(F.col(time))).over(w), F.lit(0.0))
    moved = F.abs(F.col(value) - F.lag(value).over(w))
    after_bad = F.coalesce(F.lag(bad).over(w), F.lit(False))
    cut = known(bad) | after_bad | (gap < 0) | (gap > long_pause) | known(moved > change) | ((gap >= pause) & known(moved > pause_change))
    if shape is not None:
        cut = cut | known(F.col(shape) != F.lag(shape).over(w))
    return cut if subject_changed is None else cut | known(subject_changed)


def path_key(path: Column) -> Column:
    """A path's key: one kind of slash, no ``.`` parts, none at the end, lower case."""
    return F.lower(F.regexp_replace(F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/./"), F.lit("/")), "/+$", ""))


def natural_key(text: Column) -> Column:
    """Sort key: lower case, runs of digits as numbers before text; an array of (is text, digits, number, text).

    A number is its digits without leading zeros, compared by their count and then as text, so it may have any length.
    """
    parts = F.split(F.regexp_replace(F.lower(text), "([0-9]+)", "\u0001$1\u0001"), "\u0001")
    digits = lambda c: c.rlike("^[0-9]+$")
    bare = lambda c: F.regexp_replace(c, "^0+", "")
    return F.transform(
        parts, lambda c: F.struct((~digits(c)).alias("t"), F.when(digits(c), F.char_length(bare(c))).alias("k"), F.when(digits(c), bare(c)).alias("n"), F.when(~digits(c), c).alias("s"))
    )


def islands(rows: DataFrame, source: str, order: list[str], mark: Column) -> DataFrame:
    """``rows`` plus ``island``: runs of rows with an equal ``mark``, numbered from 0."""
    w = Window.partitionBy(source).orderBy(*order)
    changed = F.coalesce(mark != F.lag(mark).over(w), F.lit(False)).cast("int")
    return rows.withColumn("_c", changed).withColumn("island", F.sum("_c").over(w)).drop("_c")


def dealt(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` by range of ``order``, with the number of their part as ``_part``; kept, so that all steps see the same parts."""
    return kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def running_total(rows: DataFrame, order: list, weight: Column, name: str) -> DataFrame:
    """``rows`` plus the sum of ``weight`` over all rows before them in the whole order, without one task for all rows.

    Each part of the order is summed alone, and the sums of the parts before it are added. Ties may fall either way:
    end ``order`` with a unique column.
    """
    parts = dealt(rows.withColumn("_w", weight), order)
    total, before = 0, []
    for r in sorted(parts.groupBy("_part").agg(F.sum("_w").alias("w")).collect()):  # a row for each part
        before.append((r["_part"], total))
        total += r["w"]
    starts = rows.sparkSession.createDataFrame(before, "_part int, _before bigint")
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumn("_k", F.coalesce(F.sum("_w").over(w), F.lit(0))).join(F.broadcast(starts), "_part")
    return summed.withColumn(name, F.col("_before") + F.col("_k")).drop("_part", "_before", "_k", "_w")


def global_rank(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` plus their 1-based place in the whole order."""
    return running_total(rows, order, F.lit(1).cast("bigint"), "_r").withColumn(name, F.col("_r") + 1).drop("_r")


def grouped_rank(rows: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """``rows`` plus their 1-based place in their group, however large a group is: the place in the whole order less the group's first."""
    ranked = global_rank(rows, [*group, *order], "_g")
    first = kept(ranked)
    starts = first.groupBy(*group).agg(F.min("_g").alias("_first")).toDF(*[f"_{c}" for c in group], "_first")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    return first.join(starts, same).withColumn(name, F.col("_g") - F.col("_first") + 1).select(*rows.columns, name)


def next_value(rows: DataFrame, group: str, order: list, value: str, name: str) -> DataFrame:
    """``rows`` plus the first non-null ``value`` after them in their group, without one task for a group.

    A part of the order gives each row the next value inside it; rows at its end take the first of a later part.
    """
    parts = dealt(rows, [group, *order])
    w = Window.partitionBy("_part", group).orderBy(*order)
    inside = parts.withColumn("_n", F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    firsts = parts.filter(F.col(value).isNotNull()).groupBy(group, "_part").agg(F.min_by(value, F.struct(*order)).alias("_v"))  # a row for each group and part
    later = parts.select(group, "_part").distinct().alias("a").join(firsts.alias("b"), (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("b._part") > F.col("a._part")))
    carry = later.groupBy(F.col(f"a.{group}").alias("_group"), F.col("a._part").alias("_at")).agg(F.min_by("b._v", "b._part").alias("_carry"))
    out = inside.join(carry, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")), "left")
    return out.select(*rows.columns, F.coalesce("_n", "_carry").alias(name))
