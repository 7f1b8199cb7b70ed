"""WARC bundles and token shards: exact round trips, copies, nulls, repeated rows, empty tables."""

import zlib

import numpy as np
import pytest
import zstandard
from lamina.llm import common, files, sharding, sstable, tokens, warc
from tokenizers import Tokenizer


def pages(spark):
    big = "x" * 200
    rows = [(5, "b", big), (3, "a", big), (3, "a", big), (9, None, None), (None, "n", big), (7, "s", "tiny"), (8, "t", "tiny"), (4, "ü", "é" * 60)]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, path string")


def test_warc_round_trip(spark):
    manifest = warc.write(warc.decide(pages(spark)))
    rows = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(manifest).collect()}
    assert rows == {(3, 200, "response", None), (3, 200, "revisit", 3), (5, 200, "revisit", 3), (None, 200, "response", None), (9, 0, "response", None), (7, 4, "response", None), (8, 4, "response", None), (4, 120, "response", None)}
    assert warc.read(manifest).count() == 8
    for m in manifest.collect():
        with files.opened(m.path) as f:
            bundle = warc.Bundle(f)
            listed = bundle.index()
            assert len(listed) == m.records
            for name in listed:
                assert bundle.record(name)[0]["WARC-Record-ID"] == f"<urn:page:{name}>"
            f.seek(0)
            plain = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()
            assert sum(1 for _ in warc.parse_records(plain)) == m.records


def test_warc_equal_rows_have_one_response(spark, monkeypatch):
    """Rows that are equal throughout, over many tasks, with and without url; small ones and those without id stay whole."""
    big, long = "y" * 300, "z" * 3_000_000
    rows = [(3, "a", big)] * 40 + [(3, None, big)] * 5 + [(9, "a", big)] * 30 + [(4, "a", "tiny")] * 7 + [(None, "a", big)] * 6 + [(5, None, long)] * 9
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(13)
    for limit in (200_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        manifest = warc.write(warc.decide(docs))
        back = warc.read(manifest)
        got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to): r["count"] for r in back.groupBy("page_id", "payload_bytes", "record_type", "refers_to").count().collect()}
        assert got == {(3, 300, "response", None): 1, (3, 300, "revisit", 3): 44, (9, 300, "revisit", 3): 30, (4, 4, "response", None): 7, (None, 300, "response", None): 6,
                       (5, 3_000_000, "response", None): 1, (5, 3_000_000, "revisit", 5): 8}
        listed = warc.index(manifest).persist()
        assert listed.count() == len(rows) == listed.select("record_id").distinct().count()
        names = {r.record_id for r in listed.collect()}
        for name in sorted(names)[::7]:
            head, block = warc.lookup(listed, name)
            assert head["WARC-Record-ID"] == f"<urn:page:{name}>" and head.get("WARC-Refers-To", f"<urn:page:{name}>")[10:-1] in names
            assert (len(block) == int(head["X-Payload-Length"])) == (head["WARC-Type"] == "response")
        assert warc.lookup(listed, "nothing") is None


def test_warc_empty(spark):
    assert warc.read(warc.write(warc.decide(pages(spark).limit(0)))).count() == 0


VOCABULARIES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_chunks_give_the_ids_of_whole_texts(name):
    path = tokens.resolved(name)
    whole, mine = Tokenizer.from_file(path), tokens.Encoder(path)
    rng = np.random.default_rng(3)
    alphabet = [*"abcXYZ 019 \n\t\r\x0b\x0c\x1c\x1d\x85\xa0 　éÉßΣσς'’!?#<>|中̀İﬁﬀ", "'s", "'re", " 's", "<|endoftext|>", "<|startoftext|>", "</w>", "  ", "\n\n", " word", "\nWord", "Ab cd"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 25))) for _ in range(6000)] + ["", None, "word " * 5000, " a", "a ", "a\n b"]
    for t, ids in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == (whole.encode(t, add_special_tokens=False).ids if t else []), ascii(t)


def test_shards_round_trip(spark):
    rows = [(i * 7 - 50, f"Some text {i}, isn't it? " * (i % 5)) for i in range(300)] + [(None, "no id"), (13, "thirteen again"), (13, None), (-(2**63), "least"), (2**63 - 1, "most")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, shard int")
    path = tokens.vocabulary("word_bpe_49k.json")
    manifest = sstable.write(docs, path, shards=4)
    back = sorted(sstable.read(manifest).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(tokens.resolved(path))
    ids = lambda x: [*(t.encode(x, add_special_tokens=False).ids if x else []), 1]
    low = -(2**64)
    assert [r.doc_id if r.doc_id is not None else low for r in back] == sorted(low if r[0] is None else r[0] for r in rows)
    at = 0
    for r in back:
        assert r.start == at
        at += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in {(len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for k, x in rows if k == r.doc_id for v in [ids(x)]}
    for key, text in rows[::17] + rows[-2:] + [(None, "no id")]:
        assert ids(text) in sstable.lookup(manifest, key)
    assert len(sstable.lookup(manifest, 13)) == 3 - 0 if any(r[0] == 13 for r in rows[:300]) else 2
    assert sstable.lookup(manifest, 12345) == []
    assert sstable.read(sstable.write(docs.limit(0), path)).count() == 0


def test_least_capacity_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes, k = rng.integers(1, 20, rng.integers(1, 25)), int(rng.integers(1, 6))
        n = len(sizes)
        best = np.full((k + 1, n + 1), 10**9)
        best[0][0] = 0
        for j in range(1, k + 1):
            for e in range(n + 1):
                best[j][e] = min(max(best[j - 1][b], sizes[b:e].sum()) for b in range(e + 1))
        c = sharding.least_capacity(sizes, k)
        assert c == best[k][n]
        cuts = [0, *sharding.even_cuts(np.cumsum(sizes), c, k), n]
        assert all(sizes[a:b].sum() <= c for a, b in zip(cuts, cuts[1:]))


def test_sharding(spark):
    rows = [(i, f"text {i % 40} " * (i % 13)) for i in range(500)] + [(None, None), (3, None), (3, ""), (3, "")] + [(1000 + i, "hot") for i in range(400)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id bigint, text string, shard int, slot int")
    out = sharding.shard(docs, 5).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(5))
    place = {}
    for r in out:
        place.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for k, s in place.items() if k[1] > 1)
    assert sharding.shard(docs.limit(0), 5).count() == 0
