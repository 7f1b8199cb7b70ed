"""Archiving files: names without collisions, moves with a journal, what a crash has left.

A plan is rows (op, source, target, mode, bytes). Carrying it out, a task works off one operation at a time and
writes its end beside the target, so that a repeated attempt finds what the first has done.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A name with a number in brackets before its suffix.
NUMBERED = r"^(.*) \(([0-9]+)\)$"


def split_name(name: str) -> tuple[str, int, str]:
    """(root, number, suffix): ``a (2).jpg`` is ("a", 2, ".jpg"); without a number it is 0."""
    stem, dot, suffix = name.rpartition(".")
    stem, suffix = (stem, dot + suffix) if dot and stem else (name, "")
    m = re.match(NUMBERED, stem)
    return (m[1], int(m[2]), suffix) if m else (stem, 0, suffix)


def joined_name(root: str, number: int, suffix: str) -> str:
    return f"{root} ({number}){suffix}" if number else root + suffix


def free_names(names: list[str], taken: set[str]) -> list[str]:
    """Each name, or with the next free number above its own, in turn; upper and lower case are the same name."""
    out, after = [], {}
    used = {t.lower() for t in taken}
    for name in names:
        root, number, suffix = split_name(name)
        k, key = number, (root.lower(), suffix.lower())
        while joined_name(root, k, suffix).lower() in used:
            k = max(k + 1, after.get((*key, k), 0))
        after[(*key, number)] = k + 1  # the next request of this number begins here
        used.add(joined_name(root, k, suffix).lower())
        out.append(joined_name(root, k, suffix))
    return out


def assigned(requests: DataFrame, existing: DataFrame, mode: str = "rename") -> DataFrame:
    """(id, name, target) of ``requests`` (id, name) against ``existing`` (name), in the order of ids.

    ``rename`` gives the next free number, and a number that a name has is counted up; ``skip`` gives null where the
    name is taken; ``error`` stops. Names that differ by case or number alone share a task.
    """
    if mode not in ("rename", "skip", "error"):
        raise ValueError(f"no mode {mode}")

    def family(c):
        stem, suffix = F.regexp_replace(c, r"\.[^.]*$", ""), F.regexp_extract(c, r"(\.[^.]*)$", 1)
        return F.lower(F.concat(F.regexp_replace(stem, r" \([0-9]+\)$", ""), suffix))

    both = requests.select("id", "name", family(F.col("name")).alias("family")).unionByName(existing.select(F.lit(None).cast(requests.schema["id"].dataType).alias("id"), "name", family(F.col("name")).alias("family")))

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, there = pdf[pdf["id"].notna()].sort_values("id"), set(pdf.loc[pdf["id"].isna(), "name"])
        names = asked["name"].tolist()
        targets = free_names(names, there)
        if mode != "rename":
            clash = [t != n for t, n in zip(targets, names, strict=True)]
            if mode == "error" and any(clash):
                raise FileExistsError(f"{names[clash.index(True)]} is taken")
            targets = [None if c else n for c, n in zip(clash, names, strict=True)]
        return pd.DataFrame({"id": asked["id"].astype("int64"), "name": names, "target": targets})

    return both.groupBy("family").applyInPandas(task, "id bigint, name string, target string")


def reconciled(journal: DataFrame, targets: DataFrame, sources: DataFrame) -> DataFrame:
    """(op, phase, bytes, error) of a ``journal`` (op, expected, phase) after a crash, by ``targets`` (op, size) and ``sources`` (op, there)."""
    done, size = F.col("phase") == "archived", F.col("size")
    met = journal.join(targets, "op", "left").join(sources, "op", "left")
    phase = F.when(done | (size == F.col("expected")), "archived").when(size.isNotNull(), "failed").when(F.col("there"), "pending").otherwise("failed")
    error = F.when(~done & (size != F.col("expected")), "size differs").when(~done & size.isNull() & F.col("there").isNull(), "source and target are missing")
    return met.select("op", phase.alias("phase"), F.when(~done & (size == F.col("expected")), F.col("expected")).alias("bytes"), error.alias("error"))


DONE = "op bigint, phase string, bytes bigint, error string"


def carried_out(plan: DataFrame) -> DataFrame:
    """Do a plan (op, source, target, mode); returns (op, phase, bytes, error): ``archived``, ``skipped`` or ``failed``.

    Modes are ``move``, ``copy``, ``hardlink`` and ``skip``. A file appears under its target whole: copies are written
    under a name of their own and renamed. A target of equal size counts as done, so a plan may be carried out again;
    another file there is an error, and an error of one file doesn't stop the others. Paths are local or mounted ones.
    """

    def one(source: str, target: str, mode: str) -> tuple[str, int | None, str | None]:
        import os
        import shutil
        import uuid

        if mode == "skip":
            return "skipped", None, None
        there, left = os.path.exists(target), os.path.exists(source)
        if there and (not left or os.path.getsize(source) == os.path.getsize(target)):
            if mode == "move" and left and not os.path.samefile(source, target):
                os.remove(source)
            return "archived", os.path.getsize(target), None
        if there:
            return "failed", None, "target is another file"
        if not left:
            return "failed", None, "source is missing"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if mode == "hardlink":
            os.link(source, target)
        else:
            draft = f"{target}.{uuid.uuid4().hex}.part"
            try:
                shutil.copy2(source, draft)
                os.link(draft, target)  # fails if a file has come there meanwhile
            finally:
                if os.path.exists(draft):
                    os.remove(draft)
            if mode == "move":
                os.remove(source)
        return "archived", os.path.getsize(target), None

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                try:
                    out.append((r.op, *one(r.source, r.target, r.mode)))
                except OSError as error:
                    out.append((r.op, "failed", None, str(error)))
            yield pd.DataFrame(out, columns=["op", "phase", "bytes", "error"]).astype({"bytes": "Int64"})

    return plan.select("op", "source", "target", "mode").mapInPandas(task, DONE)
