"""Packing, the registered queries' SQL and the pipeline against a plain version."""

import collections
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from lamina.llm import common, packing, queries, similar, tokens, toxicity
from pyspark.sql import functions as F
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"


def test_plan_fills_sequences():
    rng = np.random.default_rng(1)
    for size in (64, 2048):
        lengths = collections.Counter(rng.integers(1, size + 1, 5000).tolist())
        slots = packing.pack(lengths, size)
        placed, taken = collections.Counter(), collections.defaultdict(list)
        for s in slots:
            placed[s.length] += s.last - s.first + 1
            for k in range(s.first, s.last + 1):
                taken[s.sequence + k - s.first].append((s.offset, s.length))
        assert placed == lengths
        for v in taken.values():
            at = 0
            for offset, n in sorted(v):
                assert offset == at
                at += n
            assert at <= size
        assert sum(k * n for k, n in lengths.items()) / size / len(taken) > 0.95
    assert packing.pack({}) == []


def test_packing(spark):
    rows = [(i, "Some words here. " * (i % 300)) for i in range(200)] + [(None, None), (7, ""), (7, ""), (8, "x y\n\nz " * 3000)] + [(1000 + i, "hot") for i in range(300)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, length int")
    path = tokens.vocabulary("byte_bpe_50k.json")
    got = packing.packed(docs, path).collect()
    t = Tokenizer.from_file(tokens.resolved(path))
    want = collections.Counter()
    for i, x in rows:
        ids = np.array([*(t.encode(x, add_special_tokens=False).ids if x else []), 1], "<u4")
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[(i, at, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.packed(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = spark_rows = queries.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    key = lambda r: tuple("null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    want = c.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(key, spark_rows.select(*cols).collect())) == sorted(map(key, want))


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    assert common.shared_dir(spark, "x").startswith("file:/")


def test_pipeline_stages(spark):
    docs = common.table(spark, DATA, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.materialize(stage(spark, docs, DATA), name)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "toxicity":
            scored = toxicity.score(before, toxicity.fit(before, common.table(spark, DATA, "labels")))
            assert docs.count() == scored.filter("toxicity.predicted = 0").count()
        if name == "near_duplicates":
            groups = similar.near_duplicates(before).groupBy("root").agg(F.min("doc_id").alias("doc_id"))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in groups.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long), (1, long), (1, "other " + "text here " * 30), (2, long), (None, "no id " * 20), (None, "no id " * 20), (None, "different words " * 9)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.one_of_each_group(spark, docs, DATA).collect()
    assert sorted((r.doc_id or 0, r.text[:5]) for r in kept) == [(0, "diffe"), (0, "no id"), (1, "other"), (1, "w0 w1")]
    assert corpus_pipeline.one_of_each_group(spark, docs.limit(0), DATA).count() == 0
