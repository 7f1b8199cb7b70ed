"""Shared pieces: shared folder, durable intermediate tables, text columns, worker set-up."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


#: Rows of a table of a few small columns (some 100 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of a table that may be broadcast, where rows have no bound of their own.
BROADCAST_BYTES = 32 * 1024 * 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers and bound the rows of one Arrow batch.

    Batches of Spark's default count would take a worker tens of megabytes more than they need, so they hold
    1,000 rows unless the session has already chosen a smaller number; both settings stay with the session.
    Spark's own bound of a batch in bytes holds besides.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 1000:
        spark.conf.set(key, "1000")
    return spark


_own: dict[str, str] = {}  # application to its folder, where a local session names none


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share.

    The session names it in ``spark.checkpoint.dir``. A cluster without it is refused. Only a local session,
    whose driver is its one executor, may go without: it gets a temporary folder that goes with the process.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or "cluster" in context.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _own:
            folder = tempfile.mkdtemp(prefix="lamina-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own[context.applicationId] = "file://" + folder
        base = _own[context.applicationId]
    # Named in full: what a path without a scheme means differs between Spark's files and Arrow's.
    path = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    full = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    full = full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
    _stored.setdefault(context.applicationId, set()).add(full)
    return full


_stored: dict[str, set[str]] = {}  # application to the folders that it has made and not deleted


#: Rows of a small stored table that one file takes.
ROWS_PER_FILE = 50_000


def materialize(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and an executor may be lost.

    A ``small`` table, which is made from many partitions but has few rows, is counted first and written in as few
    files as its rows need; each file costs its store several calls. It is held in the executors meanwhile.
    ``discard`` deletes a table. What a returned DataFrame still reads can't go with its operator: ``release`` deletes that.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if small:
        held = df.persist()
        held.coalesce(max(1, -(-held.count() // ROWS_PER_FILE))).write.parquet(path)
        held.unpersist()
    else:
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lamina_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing will read it again."""
    for df in tables:
        path = getattr(df, "lamina_path", None)
        if path:
            remove_tree(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every folder that operators of this session have made and left: call it when their results are used up."""
    for path in sorted(_stored.get(spark.sparkContext.applicationId, ())):
        remove_tree(spark, path)


def remove_tree(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
    _stored.get(spark.sparkContext.applicationId, set()).discard(path)


def counted_broadcast(df: DataFrame, rows: int, size: int | None = None) -> DataFrame:
    """``df``, marked for broadcast if its counted rows, and its bytes where given, are within the bounds."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size is None or size <= BROADCAST_BYTES) else df


#: Bits for each key of the filter that keeps rows without a partner out of a shuffle, and its most bits (32 MB).
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28


def parted_by_keys(rows: DataFrame, column: str, keys: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` whose ``column`` may be one of the n distinct ``keys``, and the rest, or None if the rows aren't parted.

    Keys that ``counted_broadcast`` takes need no parting. Of more, a bit each is broadcast: a bitmap of a size that
    the count bounds, in rows of 32,768 bits, keeps most rows without a partner out of the shuffle that follows.
    """
    if n <= BROADCAST_ROWS:
        return rows, None
    bits = min(MOST_FILTER_BITS, 1 << (FILTER_BITS * n - 1).bit_length())
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bitmap = keys.select(spot(key).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("_k_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("_k_bits"))
    at = rows.withColumn("_k_bucket", F.bitmap_bucket_number(spot(column))).withColumn("_k_at", F.bitmap_bit_position(spot(column)))
    byte = F.conv(F.hex(F.substring(F.col("_k_bits"), (F.col("_k_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    met = at.join(F.broadcast(bitmap), "_k_bucket", "left").withColumn("_k_may", F.coalesce(F.getbit(byte, (F.col("_k_at") % 8).cast("int")) == 1, F.lit(False)))
    side = lambda test: met.filter(test).drop("_k_bucket", "_k_at", "_k_bits", "_k_may")
    return side(F.col("_k_may")), side(~F.col("_k_may"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; a null id counts as training data."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


#: ``translate`` arguments that lower-case A-Z and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is faster and the same where all characters are single bytes."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a name for ``value``.

    Catalyst copies an expression into every place that uses its alias, even into lambdas, where it
    would be made anew for each element. A lambda's variable is made once.
    """
    return F.get(F.transform(F.array(value), body), 0)


def with_struct(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` plus the column ``name``, which later filters and projections don't copy: a generator makes it."""
    return df.drop(name).select("*", F.explode(F.array(value)).alias(name))
