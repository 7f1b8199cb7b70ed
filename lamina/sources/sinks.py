"""Manifest files, image decoding and user functions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import kernels

BOM = b"\xef\xbb\xbf"


def replace_file(spark: SparkSession, draft, target: str) -> None:
    """Put a finished file in the place of another in one step: readers see the one or the other."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(target)
    store = final.getFileSystem(conf)
    options = jvm.org.apache.hadoop.fs.Options
    how = spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
    how[0] = getattr(options, "Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), conf).rename(store.makeQualified(draft), store.makeQualified(final), how)


def write_manifest(df: DataFrame, path: str, order: list[str], form: str = "csv") -> None:
    """One UTF-8 file, there whole or not at all: CSV with a byte-order mark and a header, or a JSON array of objects.

    Parts are written in order by Spark and joined by the driver as streams of bytes, so the manifest never has to
    fit in one task's memory. The finished file takes the place of the old one in one step.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    draft = f"{path}.{uuid.uuid4().hex}"
    if form == "csv":
        text = df.select(*[F.when(F.col(c).isNull(), "").otherwise(F.col(c).cast("string")).alias(c) for c in df.columns])
        text.orderBy(*order).write.option("header", False).option("quoteAll", True).option("escape", '"').csv(draft)
        head, tail = BOM + (",".join(f'"{c}"' for c in df.columns) + "\n").encode(), b""
    else:
        # A comma stands in front of every object; the first is left out below.
        lines = df.orderBy(*order).select(F.concat(F.lit(","), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("value"))
        lines.write.text(draft)
        head, tail = b"[", b"]\n"
    target, parts = jvm.org.apache.hadoop.fs.Path(f"{draft}.whole"), jvm.org.apache.hadoop.fs.Path(draft)
    fs = target.getFileSystem(conf)
    out = fs.create(target, True)
    out.write(bytearray(head))
    comma = form != "csv"
    for s in sorted(fs.listStatus(parts), key=lambda s: s.getPath().getName()):
        if s.getPath().getName().startswith("part-") and s.getLen():
            part = fs.open(s.getPath())
            if comma:
                part.read()  # the first comma of all
                comma = False
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 65536, False)
            part.close()
    out.write(bytearray(tail)) if tail else None
    out.close()
    fs.delete(parts, True)
    replace_file(spark, target, path)


def decoded(spark: SparkSession, folder: str, edge: int | None = None) -> DataFrame:
    """(path, height, width, channels, pixels) by Spark's image reader; pixels are bytes in BGR order.

    With ``edge``, frames are made smaller until their longer side has that many pixels: first by a whole factor of 2, 4
    or 8, then by area; none is made larger.
    """
    i = spark.read.format("image").option("dropInvalid", True).load(folder)
    full = i.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))
    if edge is None:
        return full

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(r.path, *reduced(r.pixels, r.height, r.width, r.channels, edge)) for r in pdf.itertuples()]
            yield pd.DataFrame(out, columns=["path", "height", "width", "channels", "pixels"])

    return full.mapInPandas(task, "path string, height int, width int, channels int, pixels binary")


def reduced(pixels: bytes, height: int, width: int, channels: int, edge: int) -> tuple[int, int, int, bytes]:
    a = np.frombuffer(pixels, np.uint8).reshape(height, width, channels).astype(float)
    factor = max([f for f in (1, 2, 4, 8) if max(height, width) // f >= edge], default=1)
    if factor > 1:  # whole blocks; a rest at the edge goes
        h, w = height // factor * factor, width // factor * factor
        a = a[:h, :w].reshape(h // factor, factor, w // factor, factor, channels).mean(axis=(1, 3)) if h and w else a
    h, w = kernels.long_edge(a.shape[0], a.shape[1], edge)
    if (h, w) != a.shape[:2]:
        a = np.stack([kernels.resize(a[:, :, c], h, w) for c in range(channels)], axis=2)
    return h, w, channels, np.rint(a).clip(0, 255).astype(np.uint8).tobytes()


def gray(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma 0..1 of decoded pixels."""
    a = np.frombuffer(pixels, np.uint8).reshape(height, width, channels).astype(float) / 255
    return a[:, :, 0] if channels == 1 else 0.114 * a[:, :, 0] + 0.587 * a[:, :, 1] + 0.299 * a[:, :, 2]


def register_functions(spark: SparkSession) -> None:
    """SQL names for the engine's own functions."""
    from pyspark.sql.functions import pandas_udf, udtf

    @pandas_udf("double")
    def map_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kernels.similarity(np.asarray(x, float), np.asarray(y, float)) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")

    @pandas_udf("double")
    def focus_mean(maps: pd.Series) -> float:
        """Mean of all positions of a group's maps: an aggregate."""
        total = sum(float(np.sum(m)) for m in maps if m is not None)
        n = sum(len(m) for m in maps if m is not None)
        return total / n if n else 0.0

    @udtf(returnType="position int, value double")
    class TopPositions:
        """The n greatest positions of a map: a table function."""

        def eval(self, m, n: int):
            if m is not None:
                for p in sorted(range(len(m)), key=lambda p: (-m[p], p))[:n]:
                    yield p, float(m[p])

    spark.udf.register("map_similarity", map_similarity)
    spark.udf.register("focus_mean", focus_mean)
    spark.udtf.register("top_positions", TopPositions)
