"""Structured Streaming forms: job states, arriving captures, journal upserts, progress."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamina.operators.state import VersionedTables, latest, upsert

STATE = "status string, progress double, last_id bigint"
CHANGES = "group_id bigint, id bigint, status string, progress double"


def job_states(events: DataFrame) -> DataFrame:
    """State of a group after each of its events (group_id, id, status, progress); DONE absorbs, progress is clamped.

    Within a micro-batch events go by id; one older than what its group has seen is passed over.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, progress, last = state.get if state.exists else ("PENDING", 0.0, -(2**62))
        out = []
        for r in pd.concat(list(frames)).sort_values("id").itertuples():
            if r.id <= last:
                continue
            last = int(r.id)
            if status != "DONE":
                status = r.status
                progress = 1.0 if status == "DONE" else min(1.0, max(0.0, float(r.progress)))
            out.append((key[0], last, status, progress))
        state.update((status, progress, last))
        yield pd.DataFrame(out, columns=["group_id", "id", "status", "progress"])

    return events.select("group_id", "id", "status", "progress").groupBy("group_id").applyInPandasWithState(step, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def captures_per_window(events: DataFrame, time: str = "ts", late: str = "1 day", window: str = "6 hours", slide: str | None = None) -> DataFrame:
    """Counts per window, final once the watermark has passed it; with ``slide``, windows overlap."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


PARTS = 16


def part_of(keys: list[str], parts: int):
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def upsert_sink(stream: DataFrame, tables: VersionedTables, name: str, keys: list[str], order: list[str], checkpoint: str, parts: int = PARTS, keep: int = 3) -> StreamingQuery:
    """Keep a table at the latest row of each key. A batch that is replayed gives the same table, so nothing doubles.

    The table lies in parts by a hash of the key; a batch rewrites the parts that it touches and no other. Versions
    but the last ``keep`` are deleted.
    """

    def write(batch: DataFrame, _: int) -> None:
        new = latest(batch, keys, order).withColumn("_part", part_of(keys, parts)).persist()
        touched = sorted(r["_part"] for r in new.select("_part").distinct().collect())  # at most ``parts`` numbers
        _, held = tables.state()
        known = [k for p in touched if (k := f"{name}/{p:05d}") in held]
        plain = new.drop("_part")
        base = tables.spark.read.parquet(*[held[k] for k in known]) if known else plain.limit(0)
        after = latest(upsert(base, plain, keys).unionByName(base), keys, order)
        folder = f"{tables.root}/{name}-parts/{uuid.uuid4().hex}"
        after.withColumn("_part", part_of(keys, parts)).write.partitionBy("_part").parquet(folder)
        new.unpersist()
        tables.publish({f"{name}/{p:05d}": f"{folder}/_part={p}" for p in touched}, {f"{name}/{p:05d}": held.get(f"{name}/{p:05d}") for p in touched})
        tables.vacuum_parts(name, keep)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bounded_source(spark, path: str, schema, files_per_trigger: int = 3) -> DataFrame:
    """A file stream that takes so many files at once: the queue's bound."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
