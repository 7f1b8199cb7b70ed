"""Groups that a file declares: an array of arrays of names or relative paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.sequence import path_key


def declared(spark: SparkSession, path: str) -> DataFrame:
    """(group_no, position, name) of a file ``{"groups": [[...], ...]}``, or of the bare array."""
    text = spark.read.text(path, wholetext=True)
    kind = "array<array<string>>"
    groups = F.coalesce(F.from_json("value", f"struct<groups:{kind}>")["groups"], F.from_json("value", kind))
    rows = text.select(F.posexplode(groups).alias("group_no", "names"))
    return rows.select("group_no", F.posexplode("names").alias("position", "name"))


def members(groups: DataFrame, images: DataFrame, root: str) -> DataFrame:
    """(group_no, position, name, path, state): each name's image, by its path below ``root``, or else by a name that only one image has.

    ``state`` is ``found``, ``missing`` or ``ambiguous``. Case and the kind of slash don't matter.
    """
    base = path_key(F.lit(root.rstrip("/") + "/x")).substr(F.lit(1), F.lit(len(root.rstrip("/")) + 1))
    full = path_key(F.col("path"))
    relative = images.select("path", F.when(full.startswith(base), F.substr(full, F.length(base) + 1)).otherwise(full).alias("k"))
    plain = images.select(F.element_at(F.split(path_key(F.col("path")), "/"), -1).alias("k"), "path").groupBy("k").agg(F.count("*").alias("n"), F.min("path").alias("only"))
    wanted = groups.withColumn("k", path_key(F.col("name")))
    met = wanted.join(relative, "k", "left").join(plain, "k", "left")
    path = F.coalesce("path", F.when(F.col("n") == 1, F.col("only")))
    return met.select("group_no", "position", "name", path.alias("path"), F.when(path.isNotNull(), "found").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("state"))
