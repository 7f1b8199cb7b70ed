"""State tables: upserts, conditional updates, journals. A new version is computed by one full outer
join on the key (sort-merge, so neither side has to fit in memory) and published by a numbered pointer file."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.sequence import global_rank


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; ties fall to the greatest whole row, so a re-run gives the same."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return best.select(*[F.col(k) if k in keys else F.col(f"_r.{k}") for k in df.columns])


def upsert(base: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """Rows of both tables by key, in the columns of ``base``. Where both have a row, the new one's columns win, but
    those of ``keep`` stay, as do those that ``new`` doesn't have, and those of ``fill`` take the new value only if it
    isn't null. A null key equals a null key; each table has a key once."""
    b, n = base.withColumn("_old", F.lit(True)).alias("b"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = b.join(n, [F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")

    def value(c: str) -> Column:
        old = F.col(f"b.{c}")
        if c not in new.columns:
            return old.alias(c)
        now = F.col(f"n.{c}")
        if c in keys or c in fill:
            return F.coalesce(now, old).alias(c)
        if c in keep:
            return F.when(F.col("b._old"), old).otherwise(now).alias(c)
        return F.when(F.col("n._new"), now).otherwise(old).alias(c)

    return joined.select(*[value(c) for c in base.columns])


def update_where(base: DataFrame, new: DataFrame, keys: list[str], columns: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Update rows that have a partner in ``new``: each listed column by a function of (old, new)."""
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_hit"))
    joined = base.join(n, keys, "left")
    return joined.select(*[F.when(F.col("_hit"), columns[c](F.col(c), F.col(f"_n_{c}"))).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Columns of ``schema`` in order; missing ones are null, unknown ones go (additive migration)."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])


def append_with_ids(base: DataFrame, new: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Append rows with dense surrogate ids after the greatest one present, in the order of ``order``, which must be unique."""
    top = base.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    numbered = global_rank(new, order, "_k").join(F.broadcast(top)).withColumn(id_col, F.col("_top") + F.col("_k"))  # one row
    return base.unionByName(numbered.select(*base.columns))


def cascade(children: DataFrame, parents: DataFrame, key: str, parent_key: str, rule: str) -> DataFrame:
    """Children after their parents changed: ``cascade`` drops orphans, ``set_null`` clears their key."""
    p = parents.select(F.col(parent_key).alias("_p")).distinct()
    joined = children.join(p, F.col(key) == F.col("_p"), "left")
    if rule == "cascade":
        return joined.filter(F.col(key).isNull() | F.col("_p").isNotNull()).select(*children.columns)
    return joined.select(*[F.col("_p").cast(children.schema[key].dataType).alias(key) if c == key else F.col(c) for c in children.columns])


class Conflict(Exception):
    """Another commit has changed a table that this one was made from."""


class VersionedTables:
    """Parquet tables with numbered pointers: a commit of several tables shows all of them or none.

    Every version of a table is a folder of its own. ``CURRENT.<n>`` names one for each table; the reader takes the
    greatest that is whole. A commit writes its folders first and then makes the next number, which only one writer
    can: the loser tries the number after, or fails with ``Conflict`` if a table that it has read was changed. A crash
    before the pointer leaves the state before, one while it is written leaves an unfinished pointer that nobody takes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[8:]) for n in names if n.startswith("CURRENT."))

    def _load(self, number: int) -> dict[str, str] | None:
        """What a pointer names; None if it isn't whole."""
        stream = self._fs.open(self._path(f"{self.root}/CURRENT.{number:012d}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            held = json.loads(text)
        except ValueError:
            return None
        return held["tables"] if held.get("whole") else None

    def state(self) -> tuple[int, dict[str, str]]:
        """The number and the tables of the greatest whole pointer; 0 and none at the start."""
        for n in reversed(self._numbers()):
            if (held := self._load(n)) is not None:
                return n, held
        return 0, {}

    def read(self, name: str, state: dict[str, str] | None = None) -> DataFrame:
        """A table, or all parts named ``name/...`` of one that is stored in parts."""
        held = self.state()[1] if state is None else state
        paths = [held[name]] if name in held else [p for k, p in sorted(held.items()) if k.startswith(name + "/")]
        if not paths:
            raise KeyError(name)
        return self.spark.read.parquet(*paths)

    def names(self) -> list[str]:
        return sorted(self.state()[1])

    def publish(self, paths: dict[str, str], based_on: dict[str, str] | None = None) -> int:
        """Show folders that are written already; ``based_on``: tables that must be as they were read."""
        while True:
            number, held = self.state()
            if based_on is not None and any(held.get(k) != v for k, v in based_on.items()):
                raise Conflict(f"changed since they were read: {sorted(k for k, v in based_on.items() if held.get(k) != v)}")
            after = max([number, *self._numbers()]) + 1
            try:
                out = self._fs.create(self._path(f"{self.root}/CURRENT.{after:012d}"), False)  # fails if it is there
            except Py4JJavaError as error:
                if "AlreadyExists" in str(error.java_exception):
                    continue
                raise
            out.write(bytearray(json.dumps({"tables": held | paths, "whole": True}).encode()))
            out.close()
            return after

    def commit(self, tables: dict[str, DataFrame], based_on: dict[str, str] | None = None) -> int:
        """Write the tables and show them together; returns the pointer's number."""
        paths = {}
        for name, df in tables.items():
            paths[name] = f"{self.root}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(paths[name])
        return self.publish(paths, based_on)

    def update(self, change: Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]], tries: int = 5) -> int:
        """Commit what ``change`` makes of the tables that it reads; made anew if one of them was changed meanwhile."""
        for attempt in range(tries):
            _, held = self.state()
            seen: dict[str, str] = {}

            def read(name: str, held=held, seen=seen) -> DataFrame:
                seen.update({k: p for k, p in held.items() if k == name or k.startswith(name + "/")})
                return self.read(name, held)

            made = change(read)
            try:
                return self.commit(made, {**{k: held.get(k) for k in made}, **seen})
            except Conflict:
                if attempt == tries - 1:
                    raise
        raise ValueError("tries must be positive")

    def migrate(self, name: str, schema: dict[str, str]) -> bool:
        """Bring a stored table to ``schema``: missing columns are added as nulls, types are widened, unknown columns go. False if it is so already."""
        changed = []

        def change(read):
            df = read(name)
            changed[:] = [c for c, t in schema.items() if c not in df.columns or df.select(F.col(c).cast(t)).schema != df.select(c).schema] + [c for c in df.columns if c not in schema]
            return {name: conform(df, schema)} if changed else {}

        self.update(change)
        return bool(changed)

    def vacuum(self, keep: int = 3) -> int:
        """Delete pointers but the last ``keep`` whole ones, and folders that none of those name; returns how many folders went.

        Not while a commit is under way: its folders have no pointer yet.
        """
        whole = [(n, held) for n in self._numbers() if (held := self._load(n)) is not None][-keep:]
        used = {p.rsplit("/", 1)[-1] for _, held in whole for p in held.values()}
        gone = 0
        for n in self._numbers():
            if whole and n < whole[0][0]:
                self._fs.delete(self._path(f"{self.root}/CURRENT.{n:012d}"), False)
        for name in {k for _, held in whole for k in held}:
            for s in self._fs.listStatus(self._path(f"{self.root}/{name}")):
                folder = s.getPath().getName()
                if s.isDirectory() and len(folder) == 32 and folder not in used:
                    gone += bool(self._fs.delete(s.getPath(), True))
        return gone

    def vacuum_parts(self, name: str, keep: int = 3) -> int:
        """``vacuum`` for a table in parts: a folder goes when none of the last ``keep`` pointers names a part in it."""
        numbers = [n for n in self._numbers() if self._load(n) is not None]
        last = [self._load(n) for n in numbers[-keep:]]
        used = {p.split("/")[-2] for held in last for k, p in held.items() if k.startswith(name + "/")}
        top, gone = self._path(f"{self.root}/{name}-parts"), 0
        for s in self._fs.listStatus(top) if self._fs.exists(top) else []:
            if s.getPath().getName() not in used:
                gone += bool(self._fs.delete(s.getPath(), True))
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/CURRENT.{n:012d}"), False)
        return gone
