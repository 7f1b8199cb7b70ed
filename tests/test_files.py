"""Files: frames, configuration, declared groups, archiving, caches, plug-ins, hooks."""

import itertools
import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lamina import catalog
from lamina.operators import archive, cache, plugins, state
from lamina.sources import captures, config, groups, sinks, tiff
from lamina.streaming import observers
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.sampled_from([1, 3]), st.sampled_from([np.uint8, np.uint16]), st.sampled_from([tiff.PLAIN, tiff.DEFLATE]), st.integers(0, 2**32 - 1))
def test_tiff_round_trip(h, w, samples, kind, packing, seed):
    a = np.random.default_rng(seed).integers(0, np.iinfo(kind).max, (h, w) if samples == 1 else (h, w, samples), endpoint=True).astype(kind)
    data = tiff.encode(a, {271: "Maker é", 306: "2024:01:02 03:04:05"}, b"profile", packing)
    assert (tiff.decode(data) == a).all()
    _, tags = tiff.tags_of(data)
    assert tags[271][2] == "Maker é".encode() + b"\0" and tags[34675][2] == b"profile" and struct.unpack("<H", tags[274][2]) == (1,)


def test_tiff_of_many_strips_and_of_others(monkeypatch):
    monkeypatch.setattr(tiff, "STRIP_BYTES", 100)
    a = np.random.default_rng(1).integers(0, 65535, (50, 33)).astype(np.uint16)
    assert (tiff.decode(tiff.encode(a)) == a).all()
    big = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 9)  # big-endian, with horizontal differences
    rows = np.array([[10, 12, 20], [250, 5, 7]], np.uint8)
    diff = np.diff(rows.astype(np.int16), axis=1, prepend=0).astype(np.uint8).tobytes()
    entries = [(256, 3), (257, 2), (258, 8), (259, 8), (273, 200), (277, 1), (278, 2), (279, len(zlib.compress(diff))), (317, 2)]
    for tag, v in entries:
        big += struct.pack(">HHIHH", tag, 3, 1, v, 0)
    assert (tiff.decode((big + b"\0" * 4).ljust(200, b"\0") + zlib.compress(diff)) == rows).all()
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.decode(b"nothing at all")


def test_tiff_files(spark, tmp_path):
    a = np.arange(24, dtype=np.uint8).reshape(4, 6)
    rgb = np.arange(36, dtype=np.uint16).reshape(3, 4, 3) * 1000
    uri = lambda n: f"file://{tmp_path}/out/{n}"
    rows = [(uri("a.tif"), 4, 6, 1, 8, a.ravel().tolist(), {271: "Maker"}), (uri("b.tif"), 3, 4, 3, 16, rgb.ravel().tolist(), None), (uri("c.tif"), 9, 9, 1, 8, [1, 2], None)]
    df = spark.createDataFrame(rows, "target string, height int, width int, channels int, bits int, pixels array<int>, texts map<int,string>")
    got = {r.target[-5:]: (r.bytes, r.issue) for r in tiff.write(df).collect()}
    assert got["a.tif"][0] and got["b.tif"][0] and got["c.tif"][1] and not (tmp_path / "out" / "c.tif").exists()
    assert {r.target[-5:]: r.issue for r in tiff.write(df.limit(2)).collect()} == {"a.tif": None, "b.tif": None}  # again: equal files
    (tmp_path / "out" / "a.tif").write_bytes(b"other")
    assert [r.issue for r in tiff.write(df.limit(1)).collect()] == ["target is another file"] and (tmp_path / "out" / "a.tif").read_bytes() == b"other"
    files = captures.scan(spark, str(tmp_path), ("tif",))
    back = {r.path[-5:]: r for r in tiff.frames(spark, files).collect()}
    assert back["b.tif"].pixels == rgb.ravel().tolist() and (back["b.tif"].channels, back["b.tif"].bits) == (3, 16) and back["a.tif"].issue == "not a TIFF"
    from test_operators import jpeg

    block = next(b for m, b in captures.segments(jpeg(3, 4, [(306, "2024:01:02 03:04:05"), (271, "Maker"), (274, "x")])) if m == 0xE1)
    assert tiff.carried(block[6:]) == {306: "2024:01:02 03:04:05", 271: "Maker"}


def png(a):
    h, w = a.shape[:2]
    raw = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_decoded_and_reduced(spark, tmp_path):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (64, 96, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(a))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = sinks.decoded(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and (rows[0].height, rows[0].width, rows[0].channels) == (64, 96, 3)
    assert (np.frombuffer(rows[0].pixels, np.uint8).reshape(64, 96, 3) == a[:, :, ::-1]).all()
    assert np.allclose(sinks.gray(rows[0].pixels, 64, 96, 3), a @ np.array([0.299, 0.587, 0.114]) / 255)
    small = sinks.decoded(spark, str(tmp_path), 24).first()
    want = a[:, :, ::-1].astype(float).reshape(16, 4, 24, 4, 3).mean(axis=(1, 3))
    assert (small.height, small.width) == (16, 24) and np.abs(np.frombuffer(small.pixels, np.uint8).reshape(16, 24, 3) - want).max() <= 0.5
    odd = sinks.decoded(spark, str(tmp_path), 30).first()
    assert (odd.height, odd.width) == (20, 30) and sinks.decoded(spark, str(tmp_path), 500).first().width == 96


def test_config(spark, tmp_path):
    text = {"detector": {"pause_seconds": 5, "unknown": 1}, "coverage": {"mode": "extreme", "coverage_target": 7}, "output": {"form": "tif", "engine": "quality"}, "scan": {"recursive": "yes"}, "more": {}}
    (tmp_path / "c.json").write_text(json.dumps(text))
    got = config.load(spark, f"file://{tmp_path}/c.json")
    assert got.detector.pause_seconds == 5.0 and got.output == config.Output("quality", "tif") and got.coverage == config.Coverage() and got.scan == config.Scan()
    assert config.load(spark, f"file://{tmp_path}/none.json") == config.parsed("{broken") == config.parsed("[1]") == config.parsed('{"scan": 3}') == config.Config()
    assert config.parsed(config.text(got)) == got
    assert config.parsed('{"detector": {"pause_seconds": Infinity}}').detector == config.Detector()
    assert config.parsed('{"coverage": {"coverage_target": null, "mode": "sparse"}}').coverage.mode == "sparse"


def test_declared_groups(spark, tmp_path):
    for name, text in (("a.json", {"groups": [["one.JPG", "sub\\THREE.jpg"], [], ["two.jpg", "none.jpg", "twin.jpg"]]}), ("b.json", [["x"], ["y", "z"]])):
        (tmp_path / name).write_text(json.dumps(text))
    got = groups.declared(spark, f"file://{tmp_path}/a.json")
    assert sorted(map(tuple, got.collect())) == [(0, 0, "one.JPG"), (0, 1, "sub\\THREE.jpg"), (2, 0, "two.jpg"), (2, 1, "none.jpg"), (2, 2, "twin.jpg")]
    assert sorted(map(tuple, groups.declared(spark, f"file://{tmp_path}/b.json").collect())) == [(0, 0, "x"), (1, 0, "y"), (1, 1, "z")]
    images = spark.createDataFrame([(p,) for p in ("/r/one.jpg", "/r/sub/three.JPG", "/r/deep/two.jpg", "/r/p/twin.jpg", "/r/q/TWIN.jpg")], "path string")
    met = {r.name: (r.path, r.state) for r in groups.members(got, images, "/r").collect()}
    assert met == {"one.JPG": ("/r/one.jpg", "found"), "sub\\THREE.jpg": ("/r/sub/three.JPG", "found"), "two.jpg": ("/r/deep/two.jpg", "found"), "none.jpg": (None, "missing"), "twin.jpg": (None, "ambiguous")}


def plain_names(requests, there):
    used, out = {t.lower() for t in there}, []
    for name in requests:
        root, n, suffix = archive.split_name(name)
        candidate = name
        while candidate.lower() in used:
            n += 1
            candidate = f"{root} ({n}){suffix}"
        used.add(candidate.lower())
        out.append(candidate)
    return out


def test_names_without_collisions(spark):
    assert plain_names(["a.jpg", "A.JPG", "a (1).jpg", "b (7)", "b (7)"], {"a.jpg", "b (8)"}) == ["a (1).jpg", "A (2).JPG", "a (3).jpg", "b (7)", "b (9)"]
    got = {r.id: (r.name, r.target) for r in catalog.queries()["collision_names"](spark, DATA).collect()}
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    name = lambda i: f"{docs[i]} (2).jpg" if i % 5 == 0 else f"{docs[i].upper()}.JPG" if i % 5 == 1 else f"{docs[i]}.jpg"
    ids = sorted(i for i in docs if i >= 40 or i % 2)
    want = plain_names([name(i) for i in ids], {name(i) for i in docs if i < 40 and i % 2 == 0})
    assert got == {i: (name(i), t) for i, t in zip(ids, want, strict=True)}
    assert len({t.lower() for _, t in got.values()}) == len(ids)
    asked = spark.createDataFrame([(1, "x.jpg"), (2, "X.jpg"), (3, "y.jpg")], "id bigint, name string")
    there = spark.createDataFrame([("x.jpg",)], "name string")
    assert {r.id: r.target for r in archive.assigned(asked, there, "skip").collect()} == {1: None, 2: None, 3: "y.jpg"}
    with pytest.raises(Exception, match="taken"):
        archive.assigned(asked, there, "error").collect()
    with pytest.raises(ValueError, match="mode"):
        archive.assigned(asked, there, "other")


def test_archive_is_carried_out_and_again(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    src.mkdir()
    dst.mkdir()
    for i in range(6):
        (src / f"{i}.jpg").write_bytes(bytes([i]) * (10 + i))
    (dst / "4.jpg").write_bytes(b"another file of another size")
    modes = ["move", "copy", "hardlink", "skip", "move", "copy", "move"]
    plan = spark.createDataFrame([(i, f"{src}/{i}.jpg", f"{dst}/{i}.jpg", m) for i, m in enumerate(modes)], "op bigint, source string, target string, mode string")
    want = {0: "archived", 1: "archived", 2: "archived", 3: "skipped", 4: "failed", 5: "archived", 6: "failed"}
    for _ in range(2):  # carried out again, as after a crash
        got = {r.op: (r.phase, r.bytes, r.error) for r in archive.carried_out(plan).collect()}
        assert {k: v[0] for k, v in got.items()} == want and got[4][2] == "target is another file" and got[6][2] == "source is missing" and got[0][1] == 10
    assert not (src / "0.jpg").exists() and (src / "1.jpg").exists() and (src / "4.jpg").exists() and (src / "2.jpg").samefile(dst / "2.jpg")
    assert sorted(p.name for p in dst.iterdir()) == ["0.jpg", "1.jpg", "2.jpg", "4.jpg", "5.jpg"]
    # A move that was cut off between the copy and the removal of its source.
    (src / "0.jpg").write_bytes((dst / "0.jpg").read_bytes())
    assert archive.carried_out(plan.limit(1)).first().phase == "archived" and not (src / "0.jpg").exists()


def test_cache_makes_each_result_once(spark, tmp_path):
    c, made = cache.Cache(spark, f"file://{tmp_path}/cache", "value int"), []

    def make(rows):
        made.append(rows.count())
        return rows.select("key", (F.col("x") * 2).alias("value"))

    rows = lambda *xs: spark.createDataFrame([(f"k{x}", x) for x in xs], "key string, x int")
    assert {r.key: r.value for r in c.through(rows(1, 2), make).collect()} == {"k1": 2, "k2": 4}
    assert {r.key: r.value for r in c.through(rows(2, 3, 3), make).collect()} == {"k2": 4, "k3": 6} and made == [2, 2]
    c.invalidate(rows(2).select("key"))
    assert sorted(r.key for r in c.read().collect()) == ["k1", "k3"]
    assert cache.namespace({"a": 1, "b": 2}) == cache.namespace({"b": 2, "a": 1}) != cache.namespace({"a": 1, "b": 3})


def test_plugins(spark):
    from lamina.sources.adapters import maps

    frames = maps(spark, DATA)
    plugins.register("loader", "all", lambda files: frames)
    plugins.register("detector", "one", lambda m: m.select("g", "f", F.lit(0).alias("group_no")))
    plugins.register("analyser", "even", lambda m: m.select("g", "f", (F.col("f") % 2 == 0).alias("selected")))
    plugins.register("merger", "count", lambda m: m.groupBy("g").agg(F.count("*").alias("fused")).select("g", F.lit(0).alias("p"), "fused"))
    out = plugins.run(spark.range(1), "all", "one", "even", "count")
    assert out.agg(F.sum("fused")).first()[0] == frames.filter("f % 2 = 0").count() and out.count() == frames.select("g").distinct().count()
    with pytest.raises(ValueError):
        plugins.part("merger", "none")
    with pytest.raises(ValueError):
        plugins.register("nothing", "x", lambda m: m)


def test_hooks(spark, tmp_path):
    seen, ended = [], []
    hooks = observers.Callbacks(lambda name, batch, rows: seen.append((name, rows)), lambda name, error: (ended.append((name, error)), 1 / 0))
    spark.streams.addListener(hooks)
    try:
        spark.range(7).write.parquet(f"{tmp_path}/in")
        q = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in").writeStream.format("memory").queryName("hooked").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        import time

        for _ in range(100):
            if ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(hooks)
    assert ("hooked", 7) in seen and ended == [("hooked", None)] and isinstance(hooks.errors[0], ZeroDivisionError)
    df, counts = observers.observed(spark.range(10), "scan", n=F.count("*"), most=F.max("id"))
    assert df.filter("id > 3").count() == 6 and counts.get == {"n": 10, "most": 9}


def test_functions_of_users(spark):
    sinks.register_functions(spark)
    spark.createDataFrame([(1, [0.0, 2.0, 1.0]), (1, [3.0, 3.0, 0.0]), (2, [1.0])], "g int, m array<double>").createOrReplaceTempView("user_maps")
    assert {r.g: r.a for r in spark.sql("SELECT g, focus_mean(m) AS a FROM user_maps GROUP BY g").collect()} == {1: 1.5, 2: 1.0}
    got = spark.sql("SELECT g, t.position, t.value FROM user_maps, LATERAL top_positions(m, 2) t").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 3.0), (1, 1, 2.0), (1, 1, 3.0), (1, 2, 1.0), (2, 0, 1.0)]
    spark.catalog.dropTempView("user_maps")


def test_migration_of_stored_tables(spark, tmp_path):
    t = state.VersionedTables(spark, f"file://{tmp_path}/s")
    t.commit({"x": spark.createDataFrame([(1, "a", 5)], "k int, s string, old int")})
    schema = {"k": "bigint", "s": "string", "error": "string"}
    assert t.migrate("x", schema) and not t.migrate("x", schema)
    assert t.read("x").collect() == [(1, "a", None)] and t.read("x").schema["k"].dataType.typeName() == "long"


def test_pairs_are_all_combinations_of_small_groups(spark):
    got = {}
    for r in catalog.queries()["pairwise_join"](spark, DATA).collect():
        got.setdefault(r.g, set()).add((r.i, r.j))
    sizes = {r.conv_id: r["count"] for r in spark.read.parquet(f"{DATA}/conversations.parquet").groupBy("conv_id").count().collect()}
    assert all(got.get(g, set()) == set(itertools.combinations(range(n), 2)) for g, n in sizes.items() if n <= 40)
