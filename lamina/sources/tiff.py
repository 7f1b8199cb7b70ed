"""TIFF frames: baseline files of gray or RGB in 8 or 16 bits, in strips, plain or deflated.

Writing carries the capture's tags along, with the orientation set back, since pixels are stored upright. A file is
checked by reading it back before it appears under its name, and never takes the place of another.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: TIFF tags and compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, ORIENTATION, PREDICTOR, ICC, EXIF = 256, 257, 258, 259, 262, 273, 277, 278, 279, 274, 317, 34675, 34665
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946
#: Text tags of a capture that are carried along: description, maker, model, software, time, artist, copyright.
CARRIED = (270, 271, 272, 305, 306, 315, 33432)
STRIP_BYTES = 1 << 18


def tags_of(data: bytes) -> tuple[str, dict[int, tuple[int, int, bytes]]]:
    """Byte order and the entries (type, count, value bytes) of the first directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack_from(order + "I", data, 4)[0]
    sizes, out = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 13: 4}, {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        e = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, e)
        size = sizes.get(kind, 0) * count
        place = e + 8 if size <= 4 else struct.unpack_from(order + "I", data, e + 8)[0]
        if size:
            out[tag] = (kind, count, data[place : place + size])
    return order, out


def numbers(order: str, entry: tuple[int, int, bytes]) -> list[int]:
    kind, count, raw = entry
    return list(struct.unpack(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 13: 'I'}[kind] }", raw))


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width) or (height, width, samples) as unsigned integers."""
    order, tags = tags_of(data)
    one = lambda tag, default: numbers(order, tags[tag])[0] if tag in tags else default
    height, width, samples, bits, packing = one(HEIGHT, 0), one(WIDTH, 0), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, PLAIN)
    if bits not in (8, 16) or packing not in (PLAIN, DEFLATE, OLD_DEFLATE) or one(284, 1) != 1:
        raise ValueError(f"TIFF of {bits} bits and compression {packing} isn't read")
    kind, rows = np.dtype(f"{order}u{bits // 8}"), min(one(ROWS, height), height)
    parts = []
    for k, (at, n) in enumerate(zip(numbers(order, tags[OFFSETS]), numbers(order, tags[COUNTS]), strict=True)):
        raw = data[at : at + n]
        raw = raw if packing == PLAIN else zlib.decompress(raw)
        here = min(rows, height - k * rows)
        strip = np.frombuffer(raw, kind, here * width * samples).reshape(here, width, samples)
        if one(PREDICTOR, 1) == 2:
            strip = np.cumsum(strip.astype(np.uint64), axis=1).astype(kind)
        parts.append(strip)
    out = np.concatenate(parts).astype(f"u{bits // 8}")
    return out[:, :, 0] if samples == 1 else out


def encode(pixels: np.ndarray, texts: dict[int, str] | None = None, icc: bytes | None = None, packing: int = DEFLATE) -> bytes:
    """A little-endian TIFF; ``texts`` are carried tags by number, ``icc`` a colour profile. Orientation is always upright."""
    if pixels.dtype not in (np.uint8, np.uint16):
        raise ValueError("pixels are 8 or 16 bits")
    h, w = pixels.shape[:2]
    samples, bits = (1 if pixels.ndim == 2 else pixels.shape[2]), 8 * pixels.dtype.itemsize
    rows = max(1, STRIP_BYTES // max(1, w * samples * bits // 8))
    strips = [np.ascontiguousarray(pixels[y : y + rows]).astype(f"<u{bits // 8}").tobytes() for y in range(0, h, rows)]
    strips = [zlib.compress(s, 6) if packing == DEFLATE else s for s in strips]
    body, places = bytearray(b"II*\0\0\0\0\0"), []
    for s in strips:
        places.append(len(body))
        body += s + b"\0" * (len(s) % 2)
    short, long = (lambda *v: (3, len(v), struct.pack(f"<{len(v)}H", *v))), (lambda *v: (4, len(v), struct.pack(f"<{len(v)}I", *v)))
    entries = {
        WIDTH: long(w), HEIGHT: long(h), BITS: short(*[bits] * samples), COMPRESSION: short(packing), PHOTOMETRIC: short(1 if samples == 1 else 2), OFFSETS: long(*places),
        ORIENTATION: short(1), SAMPLES: short(samples), ROWS: long(rows), COUNTS: long(*map(len, strips)), 284: short(1),
    }
    for tag, text in (texts or {}).items():
        raw = text.encode() + b"\0"
        entries[tag] = (2, len(raw), raw)
    if icc:
        entries[ICC] = (7, len(icc), icc)
    listed = b""
    for tag in sorted(entries):
        kind, count, raw = entries[tag]
        if len(raw) > 4:
            at = len(body)
            body += raw + b"\0" * (len(raw) % 2)
            raw = struct.pack("<I", at)
        listed += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
    struct.pack_into("<I", body, 4, len(body))
    return bytes(body + struct.pack("<H", len(entries)) + listed + b"\0\0\0\0")


def carried(capture: bytes) -> dict[int, str]:
    """The text tags of a capture's EXIF block that a TIFF takes over."""
    from lamina.sources.captures import exif

    found = exif(capture)
    return {t: str(found[t]) for t in CARRIED if isinstance(found.get(t), str) and found[t]}


FRAMES = "path string, height int, width int, channels int, bits int, pixels array<int>, signature string, issue string"


def frames(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Decoded frames of ``files`` (path, length, modified); one that can't be decoded is a row with an issue.

    ``signature`` tells a changed file: path, length and time. It is the key under which ``cache.Cache`` keeps frames.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():  # a frame at a time: frames are large
                try:
                    store, path = fs.FileSystem.from_uri(r.path)
                    with store.open_input_stream(path) as f:
                        a = decode(f.read())
                    row = (r.path, a.shape[0], a.shape[1], 1 if a.ndim == 2 else a.shape[2], 8 * a.dtype.itemsize, a.ravel().astype(np.int32), r.signature, None)
                except (ValueError, KeyError, OSError, struct.error, zlib.error) as error:
                    row = (r.path, None, None, None, None, None, r.signature, str(error) or type(error).__name__)
                out = pd.DataFrame([row], columns=[c.split()[0] for c in FRAMES.split(", ")])
                yield out.astype(dict.fromkeys(("height", "width", "channels", "bits"), "Int32"))

    signature = F.sha2(F.concat_ws("\u0001", "path", F.col("length").cast("string"), F.col("modified").cast("string")), 256)
    return files.select("path", signature.alias("signature")).mapInPandas(task, FRAMES)


WRITTEN = "target string, bytes bigint, issue string"


def write(frames_: DataFrame) -> DataFrame:
    """Encode rows (target, height, width, channels, bits, pixels, texts map<int,string>) to files; returns (target, bytes, issue).

    A finished file is read back and compared, and then appears under its target unless a file is there: that is an issue.
    A repeated attempt that finds an equal file counts as done.
    """

    def one(r) -> tuple[int | None, str | None]:
        shape = (r.height, r.width) if r.channels == 1 else (r.height, r.width, r.channels)
        pixels = np.asarray(r.pixels).astype(f"u{r.bits // 8}").reshape(shape)
        data = encode(pixels, {int(k): v for k, v in (r.texts or {}).items()} if not isinstance(r.texts, list) else {int(k): v for k, v in r.texts})
        if not (decode(data) == pixels).all():
            return None, "the written pixels differ"
        store, path = fs.FileSystem.from_uri(r.target)
        if store.get_file_info(path).type != fs.FileType.NotFound:
            with store.open_input_stream(path) as f:
                return (len(data), None) if f.read() == data else (None, "target is another file")
        draft = f"{path}.{uuid.uuid4().hex}.part"
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(draft) as out:
            out.write(data)
        store.move(draft, path)
        return len(data), None

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    out.append((r.target, *one(r)))
                except (ValueError, OSError) as error:
                    out.append((r.target, None, str(error)))
            yield pd.DataFrame(out, columns=["target", "bytes", "issue"]).astype({"bytes": "Int64"})

    return frames_.select("target", "height", "width", "channels", "bits", "pixels", "texts").mapInPandas(task, WRITTEN)
