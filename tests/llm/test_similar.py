"""The near-duplicate stage against brute force over all pairs of five-word shingle sets."""

import random
import re

import corpus_pipeline
from lamina.llm import common, similar

DATA = "/root/testdata/sf0.001"


def plain_groups(texts):
    sets = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if 5 * n >= 4 * (len(a) + len(sets[j]) - n):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def planted(rng):
    """Edited copies on both sides of similarity 0.8, chains of them, copies and short texts."""
    pool = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "One two", "one  TWO", "one three"]
    for _ in range(60):
        base = [rng.choice(pool) for _ in range(rng.randrange(6, 400))]
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 30)):
                w[rng.randrange(len(w))] = rng.choice(pool)
            texts.append(" ".join(w))
            base = w if rng.random() < 0.3 else base
    return texts


def test_stage_keeps_one_of_each_group_of_edited_copies(spark):
    texts = planted(random.Random(7))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, DATA).collect()}
    assert kept == set(plain_groups(texts))


def test_groups_of_documents(spark):
    docs = common.table(spark, DATA, "documents")
    rows = docs.select("doc_id", "text").collect()
    want = plain_groups([r.text for r in rows])
    got = {r.doc_id: r.root for r in similar.near_duplicates(docs).collect()}
    parts = lambda label: {frozenset(r.doc_id for r in rows if label[r.doc_id] == x) for x in label.values()}
    assert parts(got) == parts({r.doc_id: w for r, w in zip(rows, want)})


def test_large_group_of_near_copies(spark):
    """Edits of one text, on both sides of the similarity, most of them linked over it alone."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for _ in range(400):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, key string, root int")
    want = plain_groups(texts)
    got = {r.doc_id: r.root for r in similar.near_duplicates(docs).collect()}
    parts = lambda label: {frozenset(i for i in range(len(texts)) if label[i] == x) for x in set(label.values())}
    assert parts(got) == parts(dict(enumerate(want)))
