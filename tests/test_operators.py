"""Operators against plain versions: kernels, headers, state tables, streams."""

import itertools
import json
import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lamina.functions import kernels
from lamina.operators import maps, sequence, state
from lamina.sources import captures
from lamina.streaming import incremental
from pyspark.sql import functions as F


def test_components_equal_flood_fill():
    rng = np.random.default_rng(1)
    for n in (4, 8):
        for _ in range(20):
            m = rng.random((9, 11)) < 0.45
            labels, count = kernels.components(m, n)
            seen = np.zeros(m.shape, int)
            k = 0
            for y, x in itertools.product(range(9), range(11)):
                if m[y, x] and not seen[y, x]:
                    k += 1
                    todo = [(y, x)]
                    while todo:
                        a, b = todo.pop()
                        if not (0 <= a < 9 and 0 <= b < 11) or not m[a, b] or seen[a, b]:
                            continue
                        seen[a, b] = k
                        todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (n == 8 or not (i and j))]
            assert count == k and (labels == seen).all()


def test_path_order_is_no_longer_than_any_swap():
    rng = np.random.default_rng(2)
    for _ in range(10):
        p = rng.random((7, 2))
        cost = np.linalg.norm(p[:, None] - p[None], axis=2)
        path = kernels.path_order(cost)
        assert sorted(path) == list(range(7))
        length = lambda q: sum(cost[a, b] for a, b in zip(q, q[1:]))
        assert length(path) <= length(list(range(7))) + 1e-9


def test_clusters_keep_the_better_representative():
    a, b = np.zeros(40), np.zeros(40)
    a[:10], b[20:] = 1, 1
    label, heads = kernels.clusters(np.stack([a, a * 0.98, b]), np.array([0.6, 0.95, 0.7]))
    assert label == [0, 0, 1] and heads == {0: 1, 1: 2}


def test_anchored_groups_absorb_single_frames():
    f = np.array([[0.0], [0.0], [9.0], [0.0], [9.0], [9.0], [9.0], [0.0]])
    assert kernels.anchored_groups(f, lambda a, b: abs(a[0] - b[0]) < 1) == [0, 0, 0, 0, 1, 1, 1, 1]


def test_resize_keeps_the_mean_and_hash_is_stable():
    a = np.random.default_rng(4).random((33, 50))
    assert kernels.resize(a, 11, 10).mean() == pytest.approx(a.mean())
    assert kernels.long_edge(3000, 4000, 400) == (300, 400) and kernels.long_edge(30, 40, 400) == (30, 40)
    assert (kernels.perceptual_hash(a) ^ kernels.perceptual_hash(a * 0.9)).bit_count() <= 2


def jpeg(width, height, tags=None, padding=0):
    body = b"\xff\xd8"
    if tags:
        text = b"".join(v.encode() + b"\0" for _, v in tags)
        at, entries = 8 + 2 + 12 * len(tags) + 4, b""
        for tag, v in tags:
            n = len(v) + 1
            entries += struct.pack("<HHI", tag, 2, n) + (struct.pack("<I", at) if n > 4 else (v.encode() + b"\0").ljust(4, b"\0"))
            at += n
        tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + text
        body += b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
    while padding > 0:
        body += b"\xff\xfe" + struct.pack(">H", 60_002) + b"x" * 60_000
        padding -= 60_000
    return body + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\1\x11\0" + b"\xff\xd9"


def names(df):
    return sorted(r.path.rsplit("/", 1)[-1] for r in df.collect())


def test_capture_headers(spark, tmp_path):
    (tmp_path / "a.JPG").write_bytes(jpeg(32, 24, [(306, "2024:01:02 03:04:05"), (271, "Maker"), (272, "Model")]))
    (tmp_path / "_DSC1.JPG").write_bytes(jpeg(5, 6))
    (tmp_path / "b.jpeg").write_bytes(jpeg(640, 480, padding=130_000))
    (tmp_path / "c.jpg").write_bytes(b"nothing")
    (tmp_path / "d.txt").write_bytes(b"no")
    images, issues = captures.records(captures.scan(spark, str(tmp_path)))
    got = {r.path.rsplit("/", 1)[-1]: (r.width, r.height, r.capture_time, r.camera) for r in images.collect()}
    assert got == {"a.JPG": (32, 24, "2024-01-02 03:04:05", "Model"), "_DSC1.JPG": (5, 6, None, None), "b.jpeg": (640, 480, None, None), "c.jpg": (None, None, None, None)}
    assert names(issues) == ["c.jpg"]


def test_scan_of_folders(spark, tmp_path):
    for p in ("x/y/1.jpg", "x/.hidden/2.jpg", "x/_kept/3.JPEG", ".stack_cache/4.jpg", "away/5.jpg", "away/deep/6.jpg", ".7.jpg", "x/8 ö#%20.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(jpeg(4, 3))
    found = captures.scan(spark, str(tmp_path), excluded=(str(tmp_path / "away"),))
    assert names(found) == ["1.jpg", "3.JPEG", "8 ö#%20.jpg"]
    assert names(captures.scan(spark, str(tmp_path), hidden=True)) == [".7.jpg", "1.jpg", "2.jpg", "3.JPEG", "5.jpg", "6.jpg", "8 ö#%20.jpg"]
    assert names(captures.scan(spark, str(tmp_path / "x"), recursive=False)) == ["8 ö#%20.jpg"]
    images, issues = captures.records(captures.scan(spark, str(tmp_path / "nowhere")))
    assert images.count() == 0 and [r.issue[:14] for r in issues.collect()] == ["unable to list"]


def test_cut_directory_is_an_issue():
    many = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 5000) + struct.pack("<HHI", 271, 2, 2) + b"M\0\0\0" + struct.pack("<HHIHH", 5, 3, 1, 7, 0) * 4999 + b"\0\0\0\0"
    issues = []
    assert captures.exif(many, issues)[271] == "M" and issues == ["directory of 5000 entries cut at 4096"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB10 9", max_size=6), min_size=1, max_size=12))
def test_natural_key(spark, names):
    import re

    names = [*names, "a" + "9" * 60, "a" + "0" * 50 + "12", "a1" + "0" * 60]
    key = lambda s: [(0, int(c)) if c.isdigit() else (1, c) for c in re.split("([0-9]+)", s.lower())]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(sequence.natural_key(F.col("n")), "n").collect()]
    assert [key(n) for n in got] == sorted(key(n) for n in names)


def test_upsert_and_versions(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, s string, v double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", None)], "k int, s string, v double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(state.upsert(old, new, ["k"])) == [(1, "a", 1.0), (2, None, 5.0), (3, "c", None)]
    assert rows(state.upsert(old, new, ["k"], keep=["s"], fill=["v"])) == [(1, "a", 1.0), (2, "b", 5.0), (3, "c", None)]
    assert rows(state.upsert(old.limit(0), new, ["k"])) == rows(new)
    part = spark.createDataFrame([(1, "z"), (None, "n")], "k int, s string")
    lost = spark.createDataFrame([(1, "a", 2.0), (None, "old", 7.0)], "k int, s string, v double")
    back = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert back(state.upsert(lost, part, ["k"])) == [(1, "z", 2.0), (None, "n", 7.0)]
    assert back(state.upsert(lost, part, ["k"], keep=["s"])) == [(1, "a", 2.0), (None, "old", 7.0)]
    t = state.VersionedTables(spark, f"file://{tmp_path}/state")
    t.commit({"x": old, "y": new})
    t.commit({"x": state.upsert(t.read("x"), t.read("y"), ["k"])})
    assert t.names() == ["x", "y"] and t.read("x").count() == 3


def test_commits_are_whole_and_none_is_lost(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    t, other = state.VersionedTables(spark, root), state.VersionedTables(spark, root)
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    values = lambda name: sorted(r.v for r in state.VersionedTables(spark, root).read(name).collect())
    t.commit({"x": one(1), "y": one(1)})
    # A crash after the folders, and one in the middle of the pointer: the state before stays.
    publish = t.publish
    t.publish = lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError):
        t.commit({"x": one(2), "y": one(2)})
    t.publish = publish
    (tmp_path / "state" / "CURRENT.000000000002").write_text('{"tables": {"x": "file:///nowhere"')
    assert values("x") == values("y") == [1]
    t.commit({"x": one(3)})
    assert values("x") == [3] and values("y") == [1] and t.state()[0] == 3
    # Two writers of different tables: both are kept; of one table: the one that read the older state is refused.
    seen = other.state()[1]
    t.commit({"y": one(4)})
    other.commit({"z": one(5)}, {"x": seen["x"]})
    assert values("y") == [4] and values("z") == [5]
    with pytest.raises(state.Conflict):
        other.commit({"y": one(6)}, {"y": seen["y"]})
    # Two writers that add to one table by ``update``: no addition is lost.
    first = [True]

    def add(read):
        if first and first.pop():
            t.update(lambda r: {"x": r("x").unionByName(one(10))})
        return {"x": read("x").unionByName(one(20))}

    other.update(add)
    assert values("x") == [3, 10, 20]
    folders = lambda: len(list((tmp_path / "state" / "x").iterdir()))
    before = folders()
    assert t.vacuum(keep=1) > 0 and folders() == 1 < before and values("x") == [3, 10, 20] and values("z") == [5]
    with pytest.raises(KeyError):
        t.read("nothing")


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, i, s, p) for i, (s, p) in enumerate([("RUNNING", 0.2), ("DONE", 0.5), ("FAILED", 0.9)])] + [(2, 9, "RUNNING", 7.0)], "group_id bigint, id bigint, status string, progress double")
    src = f"{tmp_path}/in"
    events.filter("id < 2").write.parquet(src)
    events.filter("id >= 2").write.mode("append").parquet(src)
    stream = incremental.bounded_source(spark, src, events.schema, 1)
    q = incremental.job_states(stream).writeStream.format("memory").queryName("job_states").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    last = {r.group_id: (r.status, r.progress) for r in spark.table("job_states").groupBy("group_id").agg(F.max_by("status", "id").alias("status"), F.max_by("progress", "id").alias("progress")).collect()}
    assert last == {1: ("DONE", 1.0), 2: ("RUNNING", 1.0)}
    tables = state.VersionedTables(spark, f"file://{tmp_path}/state")
    incremental.upsert_sink(incremental.bounded_source(spark, src, events.schema, 1), tables, "jobs", ["group_id"], ["id"], f"{tmp_path}/c2", parts=4, keep=1).awaitTermination()
    assert {(r.group_id, r.status) for r in tables.read("jobs").collect()} == {(1, "FAILED"), (2, "RUNNING")}
    # A later batch rewrites the parts of its keys alone.
    before = tables.state()[1]
    spark.createDataFrame([(1, 50, "DONE", 1.0), (1, 3, "RUNNING", 0.0)], events.schema).write.mode("append").parquet(src)
    incremental.upsert_sink(incremental.bounded_source(spark, src, events.schema, 1), tables, "jobs", ["group_id"], ["id"], f"{tmp_path}/c2", parts=4, keep=1).awaitTermination()
    after = tables.state()[1]
    assert {(r.group_id, r.status, r.id) for r in tables.read("jobs").collect()} == {(1, "DONE", 50), (2, "RUNNING", 9)}
    assert len(before) == len(after) == 2 and sum(before[k] != after[k] for k in before) == 1
    assert len(list((tmp_path / "state" / "jobs-parts").iterdir())) == 2


def test_windows_of_a_stream_drop_what_is_late(spark, tmp_path):
    from datetime import datetime, timedelta

    t0, src = datetime(2024, 1, 1), f"{tmp_path}/in"
    schema = "ts timestamp, event_type string"
    for k, hours in enumerate([[0, 1, 7], [60, 61], [59], [2], [100]]):  # 2 h is more than a day behind 61 h
        spark.createDataFrame([(t0 + timedelta(hours=h), "click") for h in hours], schema).coalesce(1).write.mode("append").parquet(f"{src}/{k}")
    for k in range(5):
        for f in (tmp_path / "in" / str(k)).glob("part-*"):
            f.rename(tmp_path / "in" / f"{k}.parquet")
            os.utime(tmp_path / "in" / f"{k}.parquet", (1000 + k, 1000 + k))
    for slide, want in ((None, {(0, 2), (6, 1), (54, 1), (60, 2)}), ("3 hours", {(-3, 2), (0, 2), (3, 1), (6, 1), (54, 1), (57, 3), (60, 2)})):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*.parquet")
        name = f"windows_{'sliding' if slide else 'tumbling'}"
        q = incremental.captures_per_window(stream, slide=slide).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        got = {((r.start - t0).total_seconds() // 3600, r.n) for r in spark.table(name).collect()}
        assert got == want, (slide, got)


def test_noise_ceiling_borrows_from_neighbours(spark):
    rows = [(0, float(i % 5), 0.1) for i in range(100)] + [(1, 3.0, 0.1)] * 10
    out = {r.bin: (r.ceiling, r.borrowed) for r in maps.noise_ceiling(spark.createDataFrame(rows, "bin int, v double, spread double"), "bin", "v", "spread").collect()}
    assert out[0][0] == pytest.approx(2 + 6 * 1.4826) and out[1] == (out[0][0], True)


def test_manifest_file_and_functions(spark, tmp_path):
    from lamina.sources import sinks

    df = spark.createDataFrame([(2, 'b "x"', None), (1, "ä,é", True)], "k int, s string, b boolean")
    sinks.write_manifest(df.repartition(3), f"file://{tmp_path}/m.csv", ["k"])
    assert (tmp_path / "m.csv").read_bytes().decode("utf-8-sig").splitlines() == ['"k","s","b"', '"1","ä,é","true"', '"2","b ""x""",""']
    sinks.write_manifest(df.filter("k = 1"), f"file://{tmp_path}/m.csv", ["k"])
    assert len((tmp_path / "m.csv").read_text("utf-8-sig").splitlines()) == 2
    sinks.write_manifest(df.repartition(3), f"file://{tmp_path}/m.json", ["k"], "json")
    assert json.loads((tmp_path / "m.json").read_text()) == [{"k": 1, "s": "ä,é", "b": True}, {"k": 2, "s": 'b "x"', "b": None}]
    sinks.write_manifest(df.limit(0), f"file://{tmp_path}/m.json", ["k"], "json")
    assert json.loads((tmp_path / "m.json").read_text()) == []
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["m.csv", "m.json"]
    sinks.register_functions(spark)
    assert spark.sql("SELECT map_similarity(array(0D, 1D, 2D), array(0D, 1D, 2D)) AS s").first().s == pytest.approx(1.0)


def test_similarity_matrix_equals_pairs():
    m = np.random.default_rng(6).random((6, 50))
    m[4], m[5] = 0.5, 0.5
    s = kernels.similarity_matrix(m)
    assert np.allclose(s, [[kernels.similarity(a, b) for b in m] for a in m])
