"""Logical frame tables over the driver's Parquet tables. Each adapter is a narrow projection, so
filters and column selections above it reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture records: id, source, seq (1-based in the source), capture_time, brightness, status."""
    w = Window.partitionBy("source").orderBy("capture_time", "id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), F.col("ts").alias("capture_time"), F.col("value").alias("brightness"), F.col("event_type").alias("status")).withColumn("seq", F.row_number().over(w))


IMAGES_SQL = """SELECT event_id AS id, user_id AS source, ts AS capture_time, value AS brightness, event_type AS status,
                       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense maps in long form: g group, f frame, p position 0..63, q response 0..65535."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("g"), F.col("vec_id").alias("f"), F.posexplode("embedding").alias("p", "v")).select("g", "f", "p", F.bround(F.abs(F.col("v").cast("double")) * 65535).cast("int").alias("q"))


PX_SQL = """SELECT label AS g, vec_id AS f, i - 1 AS p, round_even(abs(embedding[i]::DOUBLE) * 65535, 0)::INT AS q
            FROM embeddings, generate_series(1, 64) AS s(i)"""


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same maps as arrays: g, f, m array<double>."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("g"), F.col("vec_id").alias("f"), F.transform("embedding", lambda v: F.bround(F.abs(v.cast("double")) * 65535).cast("double")).alias("m"))


def frame_valid(f: str = "f", p: str = "p"):
    """Footprint stand-in: a position that a frame doesn't cover."""
    return (F.col(f) * 7 + F.col(p)) % 11 != 0


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group members: group, position, kind, name."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("group_id"), F.col("turn").alias("position"), F.col("role").alias("kind"), F.col("text").alias("name"))


JOB_STATUS = {"signup": "PENDING", "click": "RUNNING", "view": "RUNNING", "error": "FAILED", "purchase": "DONE"}


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job rows in the order of their ids: id, group_id, status, progress, at."""
    e = table(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for kv in JOB_STATUS.items() for x in kv])
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("group_id"), F.coalesce(F.element_at(status, F.col("event_type")), F.lit("PENDING")).alias("status"), (F.col("value") / 100).alias("progress"), F.col("ts").alias("at"))


JOBS_SQL = """SELECT event_id AS id, user_id AS group_id, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'RUNNING'
              WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'DONE' ELSE 'PENDING' END AS status, value / 100 AS progress, ts AS at FROM events"""


def old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored table and updates for it: even events, and every third one with some nulls."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("user_id").alias("group_id"), F.col("value").alias("size"), F.col("event_type").alias("status"))
    new = e.filter("key % 3 = 0").withColumn("size", F.when(F.col("key") % 5 != 0, F.col("size") + 1)).withColumn("status", F.lit("updated"))
    return e.filter("key % 2 = 0"), new


OLD_NEW_SQL = """old AS (SELECT event_id AS key, user_id AS group_id, value AS size, event_type AS status FROM events WHERE event_id % 2 = 0),
new AS (SELECT event_id AS key, user_id AS group_id, CASE WHEN event_id % 5 <> 0 THEN value + 1 END AS size, 'updated' AS status FROM events WHERE event_id % 3 = 0)"""


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with three channels 0..255: g, f, r, gr, b arrays of 64; neighbouring responses over a common ground."""
    e = table(spark, sf_dir, "embeddings")
    byte = lambda k: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: (F.lit(90) + F.floor(F.abs(F.get("embedding", (p + k) % 64).cast("double")) * 100)).cast("int"))
    return e.select(F.col("label").alias("g"), F.col("vec_id").alias("f"), byte(0).alias("r"), byte(1).alias("gr"), byte(2).alias("b"))
