"""Capture files: listing, JPEG headers and EXIF tags from bytes, never pixels; failures become rows.

Folders are listed by tasks, level by level, and not by Spark's file index, which passes over names that begin
with ``_``. Tasks open files by pyarrow, so a folder's URI must be one that it knows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.kept import kept

HEADER = 64 * 1024
#: JPEG frame headers (all SOF markers but DHT, JPG and DAC) and TIFF type sizes.
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
#: Capture time, maker, model and lens tags in order of preference.
TAGS = {"capture_time": (36867, 36868, 306), "camera": (272, 271), "lens": (42036,)}
MOST_ENTRIES = 4096


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, payload) of a JPEG's segments up to the scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    p = 2
    while p + 4 <= len(data):
        if data[p] != 0xFF:
            raise ValueError("marker expected")
        marker = data[p + 1]
        if marker == 0xFF:
            p += 1
            continue
        if marker in (0xD9, 0xDA):
            return
        if marker == 1 or 0xD0 <= marker <= 0xD7:
            p += 2
            continue
        size = int.from_bytes(data[p + 2 : p + 4], "big")
        if size < 2:
            raise ValueError("bad segment length")
        yield marker, data[p + 4 : p + 2 + size]
        p += 2 + size


def exif(tiff: bytes, issues: list[str] | None = None) -> dict[int, object]:
    """Tags of the first directory and the EXIF one; text, numbers and lists of them.

    Of a directory with more entries than a sound one has, the first ``MOST_ENTRIES`` are read, and ``issues`` says so.
    """
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or struct.unpack(order + "H", tiff[2:4])[0] != 42:
        raise ValueError("not a TIFF header")
    out: dict[int, object] = {}
    todo, seen = [struct.unpack(order + "I", tiff[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        n = struct.unpack_from(order + "H", tiff, at)[0]
        if n > MOST_ENTRIES:
            if issues is not None:
                issues.append(f"directory of {n} entries cut at {MOST_ENTRIES}")
            n = MOST_ENTRIES
        for k in range(n):
            e = at + 2 + 12 * k
            if e + 12 > len(tiff):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", tiff, e)
            size = SIZES.get(kind, 0) * count
            place = e + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, e + 8)[0]
            raw = tiff[place : place + size]
            if not size or len(raw) < size:
                continue
            if kind == 2:
                value: object = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
            elif kind in (5, 10):
                pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
                value = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
            elif kind == 7:
                value = raw
            else:
                value = list(struct.unpack(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 6: 'b', 8: 'h', 9: 'i'}[kind] }", raw))
            out.setdefault(tag, value)
            if tag == 34665 and isinstance(value, list):
                todo.append(int(value[0]))
    return out


def header(data: bytes) -> dict:
    """width, height, capture_time, camera, lens, issue of a file's first bytes."""
    out: dict = dict.fromkeys(("width", "height", "capture_time", "camera", "lens", "issue"))
    try:
        for marker, body in segments(data):
            if marker in FRAMES and out["width"] is None and len(body) >= 5:
                out["height"], out["width"] = struct.unpack(">HH", body[1:5])
            elif marker == 0xE1 and body[:6] == b"Exif\0\0":
                found: list[str] = []
                tags = exif(body[6:], found)
                out["issue"] = out["issue"] or next(iter(found), None)
                for name, wanted in TAGS.items():
                    out[name] = next((str(tags[t]) for t in wanted if tags.get(t)), None)
        if out["width"] is None:
            out["issue"] = "no frame header"
    except (ValueError, struct.error, KeyError) as error:
        out["issue"] = str(error)
    return out


SCHEMA = "width int, height int, capture_time string, camera string, lens string, issue string"


def with_headers(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) plus the header's columns. A task reads the first 64 KB of a file, and all of it where the frame header lies later."""

    @F.pandas_udf(SCHEMA)
    def parsed(paths: pd.Series) -> pd.DataFrame:
        out = []
        for p in paths:
            try:
                with opened(p) as f:
                    head = f.read(HEADER)
                    got = header(head)
                    if got["issue"] == "no frame header" and len(head) == HEADER:
                        got = header(head + f.read())
            except OSError as error:
                got = dict.fromkeys(c.split()[0] for c in SCHEMA.split(", ")) | {"issue": f"unreadable: {error}"}
            out.append(got)
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    out = files.withColumn("_h", parsed("path"))
    iso = F.nullif(F.regexp_replace(F.trim("_h.capture_time"), r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3"), F.lit(""))
    return out.select(*files.columns, "_h.width", "_h.height", iso.alias("capture_time"), "_h.camera", "_h.lens", "_h.issue")


@contextmanager
def opened(uri: str):
    """A file's bytes from its full URI."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        yield f


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder's full URI, as every process understands it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


#: Fixed value: the engine's own cache, never scanned.
CACHE_FOLDER = ".stack_cache"
LISTED = "path string, length bigint, modified timestamp, folder boolean, issue string"


def listed(folders: DataFrame) -> DataFrame:
    """(path, length, modified, folder, issue): what lies directly in ``folders`` (path); one that can't be listed is an issue."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for uri in pdf["path"]:
                try:
                    store, path = fs.FileSystem.from_uri(uri)
                    for e in store.get_file_info(fs.FileSelector(path)):
                        out.append((f"{uri.rstrip('/')}/{e.base_name}", e.size, e.mtime, e.type == fs.FileType.Directory, None))
                except OSError as error:
                    out.append((uri, None, None, False, f"unable to list: {error}"))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in LISTED.split(", ")])
            frame["modified"] = pd.to_datetime(frame["modified"], utc=True).dt.tz_localize(None)
            yield frame

    return folders.select("path").mapInPandas(task, LISTED)


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("jpg", "jpeg"), recursive: bool = True, excluded: tuple[str, ...] = (), hidden: bool = False) -> DataFrame:
    """(path, length, modified, issue) of files with these extensions in any case.

    Names that begin with a dot are passed over unless ``hidden``, and folders of such a name with all that is in them;
    excluded folders and the engine's cache are never entered. A folder that can't be listed is a row with an issue.
    """
    name = F.element_at(F.split("path", "/"), -1)
    away = [qualified(spark, e) for e in excluded]
    seen = F.lit(True) if hidden else ~name.startswith(".")
    enter = seen & (name != CACHE_FOLDER) & (~F.col("path").isin(away) if away else F.lit(True))
    root = qualified(spark, folder)
    level, found = spark.createDataFrame([(root,)] if root not in away else [], "path string"), []
    while True:
        entries = kept(listed(level))
        found.append(entries)
        level = entries.filter(F.col("folder") & enter).select("path")
        if not recursive or level.isEmpty():
            break
        level = level.repartition("path")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    wanted = seen & F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*extensions)
    return every.filter(F.col("issue").isNotNull() | (~F.col("folder") & wanted)).select("path", "length", "modified", "issue")


def records(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images with their headers, and (path, issue) of every issue: of a folder's listing and of a file's header. An image with an issue stays."""
    failed = files.filter("issue is not null").select("path", "issue")
    images = with_headers(files.filter("issue is null").drop("issue"))
    return images, failed.unionByName(images.filter("issue is not null").select("path", "issue"))
