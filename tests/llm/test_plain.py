"""Operators against plain versions of their decisions, skew, clashing columns and the paths beyond broadcasts."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from lamina.llm import common, decontaminate, langid, licenses, packing, quality_rules, sharding, simhash, toxicity
from pyspark.sql import functions as F
from test_dedup_and_overlap import plain_overlap
from test_similar import plain_groups
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"


def plain_hits(text, model):
    """Every term at every place of the folded text, by comparison alone."""
    folded, terms = toxicity.fold(text or ""), {**{w: (x, True) for w, x in model.words.items()}, **{b: (x, False) for b, x in model.beginnings.items()}}
    found, spared = [], []
    for i in range(len(folded)):
        if i and folded[i - 1].isalnum():
            continue
        for t, (w, whole) in terms.items():
            end = i + len(t)
            if folded[i:end] == t and not (whole and end < len(folded) and folded[end].isalnum()):
                found.append((i, end, w))
        for p in toxicity.EXCEPTIONS:
            if folded[i : i + len(p)] == p and not (i + len(p) < len(folded) and folded[i + len(p)].isalnum()):
                spared.append((i, i + len(p)))
    return sorted(h for h in found if not any(a <= h[0] and h[1] <= b for a, b in spared))


def test_toxicity_equals_a_plain_search(spark):
    rng = random.Random(1)
    model = toxicity.Model({"trash": 1.5, "loser": 2.0, "scum": 4.0, "clown": 1.0, "ab": 0.5}, {"idiot": 3.0, "low": 0.7, "lowl": 1.1}, -2.5, 2.2)
    pool = ["trash", "TRASH", "trash can", "tr4sh", "1d10t", "idiots", "idiot proof", "ѕcum", "scummy", "ｌoser", "loser bracket", "low", "lowlife", "ab", "a", "clown fish", "clowns", "!diot", "$cum!", "plain", "word", "\n", "é", "cl0wn"]
    texts = [None, "", " "] + [rng.choice([" ", "", "-"]).join(rng.choice(pool) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    texts.append("word " * 3000 + "scum")
    m = toxicity.Matcher(model)
    rows = spark.createDataFrame([(i, t, 7.5, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, _s double, score string")
    out = toxicity.score(rows, model)
    assert out.columns == ["doc_id", "text", "_s", "score", "toxicity"] and out.select(F.min("_s"), F.max("_s")).first() == (7.5, 7.5)
    got = {r.doc_id: (r.s, r.p) for r in out.select("doc_id", F.col("toxicity.score").alias("s"), F.col("toxicity.predicted").alias("p")).collect()}
    for i, t in enumerate(texts):
        hits = plain_hits(t, model)
        assert sorted(m.hits(t)) == hits, t
        density = sum(w for _, _, w in hits) / (1 + math.log1p(len((t or "").split()) / 100))
        want = 1 / (1 + math.exp(-(model.intercept + model.slope * math.log1p(density))))
        assert got[i][0] == pytest.approx(want) and got[i][1] == int(want >= 0.7)


def test_words_of_the_list_are_weighed_by_the_samples():
    toxic, other = collections.Counter({"=gruk": 90, "=idiot": 1, "=scum": 30}), collections.Counter({"=idiot": 50})
    words, _ = toxicity.choose(toxic, other, 100, 100)
    assert "idiot" not in words and words["scum"] > 3 and words["loser"] == toxicity.SEED_WEIGHT and "gruk" in words


def plain_language(model, x):
    """The two decisions of one text, by loops over the machines."""
    wide = np.append(x, 1.0)
    margins = [float(wide @ model.family_weights[:, f]) for f in range(len(model.families))] if len(model.families) > 1 else [9.0]
    f = max(range(len(margins)), key=lambda k: (margins[k], -k))
    score, languages = 1 / (1 + math.exp(-4 * margins[f])), model.languages[f]
    if len(languages) == 1:
        return languages[0], score
    votes, sums = [0] * len(languages), [0.0] * len(languages)
    for p, (i, j) in enumerate(itertools.combinations(range(len(languages)), 2)):
        m = float(wide @ model.pair_weights[f][:, p])
        votes[i if m > 0 else j] += 1
        sums[i] += m
        sums[j] -= m
    w = max(range(len(languages)), key=lambda c: (votes[c], sums[c], -c))
    return languages[w], score / (1 + math.exp(-4 * sums[w] / (len(languages) - 1)))


def plain_features(text):
    """Hashed n-grams of the letters, with a blank for what stands behind each word and one at either end, counted one by one."""
    mask = 2**32 - 1
    low, a = text.lower(), [32]
    for m in re.finditer(r"[^\W\d_]+", low):
        a += [*map(ord, m[0]), *([32] if m.end() < len(low) else [])]
    a.append(32)
    counts = np.zeros(langid.DIMENSIONS)
    for n in (1, 2, 3):
        for i in range(len(a) - n + 1):
            h = a[i] * 2654435761 & mask
            for c, k in zip(a[i + 1 : i + n], (2246822519, 3266489917)):
                h = (h * 31 + c * k) & mask
            h = (h ^ h >> 15) * 2246822519 & mask
            counts[h >> 20] += 1
    return np.sqrt(counts) / np.linalg.norm(np.sqrt(counts))


def test_language_equals_plain_decisions(spark):
    rng = np.random.default_rng(2)
    languages = [["de", "en", "nl"], ["es", "fr", "it", "pt"], ["xx"]]
    model = langid.Model(["germanic", "romance", "xx"], languages, rng.normal(0, 1, (4097, 3)).astype(np.float32), [rng.normal(0, 1, (4097, 3)).astype(np.float32), rng.normal(0, 1, (4097, 6)).astype(np.float32), None])
    texts = ["Guten Tag, wie geht's?", "el niño 123 está", "x", "Ünïcode ÉTÉ déjà vu", "a b c " * 300, "hello_world", "ﬁn ß"] + ["".join(rng.choice(list("abcdefghéñ  .,1"), 60)) + "z" for _ in range(40)]
    got = {r.doc_id: (r.l.lang_pred, r.l.score) for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).select("doc_id", F.col("language").alias("l")).collect()}
    for i, t in enumerate(texts):
        x = langid.features(t)
        if re.fullmatch(r"[A-Za-z ,.'?0-9éñ]+", t):  # one lower-case form, no marks
            assert np.allclose(x, plain_features(t), atol=1e-6), t
        name, score = plain_language(model, x.astype(float))
        assert got[i][0] == name and got[i][1] == pytest.approx(score, rel=1e-3)


def test_language_sample_is_bounded(spark):
    base = "the and of that with from this have "
    same = spark.range(30_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(base * 3).alias("text"), F.lit("en").alias("lang"))
    no_id = spark.range(3_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("der die das und nicht "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    taken = []
    train = langid.train

    def counted(x, labels):
        taken.append(collections.Counter(labels))
        return train(x, labels)

    langid.train = counted
    try:
        model = langid.fit(same.unionByName(no_id))
    finally:
        langid.train = train
    assert taken[0]["en"] <= 1 and 500 < taken[0]["de"] <= langid.MOST_PER_LANGUAGE and model.families == ["germanic"] * bool(taken[0]["de"])


def test_shards_are_as_small_as_their_order_allows(spark):
    rng = random.Random(3)
    for seed, shards in ((1, 3), (2, 5), (3, 8)):
        texts = [f"text {i} " * rng.randrange(0, 60) for i in range(60)] + ["hot " * 20] * 40 + [None] * 5 + [""] * 4 + ["no text"] * 3
        rows = [(i if rng.random() < 0.9 else None, t, seed) for i, t in enumerate(texts)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, key int")
        out = sharding.shard(docs, shards).collect()
        sizes = collections.Counter()
        for _, t, _ in rows:
            sizes[sharding.NO_TEXT if t is None else hashlib.md5(t.encode()).hexdigest()] += len((t or "").encode()) + 1
        order = [sizes[k] for k in sorted(sizes)]
        ends = [0, *itertools.accumulate(order)]
        best = [[math.inf] * (len(order) + 1) for _ in range(shards + 1)]
        best[0][0] = 0
        for s in range(1, shards + 1):
            for e in range(len(order) + 1):
                best[s][e] = min(max(best[s - 1][b], ends[e] - ends[b]) for b in range(e + 1))
        total = collections.Counter()
        for r in out:
            total[r.shard] += r.size
        assert max(total.values()) == best[shards][len(order)] and len(out) == len(rows)
        place = collections.defaultdict(set)
        for r in out:
            place[r.text_crc32, r.size].add(r.shard)
        assert all(len(v) == 1 for k, v in place.items() if k[1] > 1)
        by = collections.defaultdict(list)
        for r in out:
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_null_texts_are_no_copies_of_a_text(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None] * 3 + ["no text"] * 3)], "doc_id bigint, text string")
    out = {r.doc_id: r.shard for r in sharding.shard(docs, 2).collect()}
    assert len({out[0], out[1], out[2]}) == 1 and len({out[3], out[4], out[5]}) == 1 and out[0] != out[3]


def crowded():
    """Items of frequent words, shared passages, copies, very long and empty texts."""
    rng = random.Random(4)
    pool = ["the", "of", "and", "to"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(f"i{k}", " ".join(rng.choice(pool[:4]) for _ in range(n))) for k, n in enumerate((13, 20, 30, 4, 1, 16))] + [("z", text(40)), ("y", text(7)), (None, text(18)), ("n", None)]
    hot = text(30) + " " + items[6][1] + " " + text(5)
    docs = [(i, hot) for i in range(150)] + [(200 + i, text(rng.randrange(0, 80)) + " " + (rng.choice(items)[1] or "") + " " + text(5)) for i in range(60)]
    docs += [(None, None), (300, ""), (300, "The the THE"), (301, " ".join(rng.choice(pool[:4]) for _ in range(6000))), (302, text(20_000))]
    return docs, items


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination_with_and_without_broadcasts(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    docs, items = crowded()
    frame = spark.createDataFrame([(*d, "k", ["c"], 3) for d in docs], "doc_id bigint, text string, _key string, candidates array<string>, words int").repartition(7)
    bench = spark.createDataFrame([(*i, "k") for i in items], "item_id string, text string, key string")
    found = decontaminate.find(frame, bench)
    assert found.columns == ["doc_id", "text", "_key", "candidates", "words", "overlap"]
    assert found.filter("_key = 'k' and candidates[0] = 'c' and words = 3").count() == len(docs)
    assert collections.Counter(map(tuple, decontaminate.digest(found).collect())) == plain_overlap(docs, items)
    spans = {tuple(s) for r in found.filter("doc_id = 0").select("overlap.spans").limit(1).collect() for s in r.spans}
    assert any(first == 30 and words == 13 for _, first, words in spans)


def test_licenses_beyond_broadcasts(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 3, "Released under the MIT License." if i % 2 else "nothing") for i in range(40)], "doc_id bigint, text string")
    few = {k: licenses.TEMPLATES[k] for k in ("mit", "isc")}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    got = collections.Counter((r.doc_id, tuple(r.licenses)) for r in licenses.scan(docs, templates=few).collect())
    assert got == collections.Counter((i % 3, ("mit",) if i % 2 else ()) for i in range(40))


RUSSIAN = (
    "Утром мы вышли из дома и пошли по узкой дороге к реке где стояла старая мельница Вода тихо шумела под мостом а над полем летали птицы Сосед рассказывал как раньше здесь жили его родители и "
    "сколько труда они вложили в этот сад Потом мы долго сидели на берегу пили чай и говорили о будущем лете о поездке к морю и о книгах которые каждый из нас прочитал зимой долгими вечерами"
)
POLISH = (
    "Rano wyszliśmy z domu i poszliśmy wąską drogą nad rzekę gdzie stał stary młyn Woda cicho szumiała pod mostem a nad polem latały ptaki Sąsiad opowiadał jak dawniej mieszkali tutaj jego rodzice i "
    "ile pracy włożyli w ten ogród Potem długo siedzieliśmy na brzegu piliśmy herbatę i rozmawialiśmy o przyszłym lecie o podróży nad morze oraz o książkach które każdy przeczytał zimą"
)
ITALIAN = (
    "La mattina siamo usciti di casa e abbiamo preso la strada stretta verso il fiume dove stava il vecchio mulino e non lontano dal ponte che porta alla chiesa Il vicino raccontava come una volta qui "
    "vivevano anche suoi genitori e quanto lavoro avevano messo nel giardino Poi abbiamo parlato a lungo della prossima estate del viaggio al mare e dei libri letti durante inverno"
)


def test_sound_prose_of_other_languages_is_kept(spark):
    junk = " ".join(f"{a}{b}q{i}" for i, (a, b) in enumerate(itertools.product("xzkw", "vjpbtrsnmlfdgh")))
    cyrillic = " ".join(f"щш{c}ъ" + "абвгд"[i % 5] for i, c in enumerate("бвгджзклмнпрстфхцч" * 4))
    rows = [(0, RUSSIAN), (1, POLISH), (2, ITALIAN), (3, junk), (4, cyrillic), (5, junk + " π" * 3)]
    docs = spark.createDataFrame([(*r, 9, "q") for r in rows], "doc_id bigint, text string, _m int, quality string")
    out = quality_rules.apply_rules(docs)
    assert out.columns == ["doc_id", "text", "_m", "quality"] and out.filter("_m = 9").count() == len(rows)
    assert {r.doc_id: (r.kept, r.violations) for r in out.select("doc_id", "quality.*").collect()} == {0: (True, []), 1: (True, []), 2: (True, []), 3: (False, ["stop_words"]), 4: (True, []), 5: (True, [])}


def plain_kept(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    cover = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    if len(words) < 50 or 100 * len(cover) > 50 * len(words):
        return False
    letters = [c for c in t if c.isalpha()]
    latin = re.compile(f"[{quality_rules.ALPHABET}]")
    foreign, stops = sum(not latin.match(c) for c in letters), set(quality_rules.listed_stop_words())
    return (
        sum(c in "#*$%&|<>" for c in t) / len(words) <= 0.25 and 1.5 <= sum(map(len, words)) / len(words) <= 20 and sum(c.isupper() for c in letters) <= 0.6 * len(letters)
        and (200 * foreign > len(letters) or sum(w.lower() in stops for w in words) >= 0.01 * len(words)) and (len(lines) - len(set(lines))) <= 0.6 * len(lines)
    )


def test_pipeline_equals_its_plain_stages(spark):
    """All documents of the smallest table through plain versions, one stage after the other."""
    docs = {r.doc_id: r.text for r in common.table(spark, DATA, "documents").collect()}
    frame = common.table(spark, DATA, "documents")
    model = toxicity.fit(frame, common.table(spark, DATA, "labels"))
    score = lambda t: 1 / (1 + math.exp(-(model.intercept + model.slope * math.log1p(sum(w for _, _, w in plain_hits(t, model)) / (1 + math.log1p(len((t or "").split()) / 100))))))
    kept = {i: t for i, t in docs.items() if score(t) < 0.7}
    kept = {i: t for i, t in kept.items() if plain_kept(t)}
    ids = sorted(kept)
    roots = plain_groups([kept[i] for i in ids])
    kept = {i: kept[i] for k, i in enumerate(ids) if roots[k] == k}
    items = [(r.item_id, r.text) for r in common.table(spark, DATA, "benchmark").collect()]
    kept = {k[0]: kept[k[0]] for k in plain_overlap(kept.items(), items) if not k[5]}
    t = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, x in kept.items():
        all_ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(all_ids), 2048):
            part = all_ids[at : at + 2048]
            want[i, at, len(part), zlib.crc32(part.tobytes()), len(all_ids)] += 1
    got = corpus_pipeline.run(spark, DATA).collect()
    assert 0 < len(kept) < len(docs)
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    filled = collections.Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= packing.SIZE


CASES = [(1, None, 1), (1, None, 1), (2, "", 1), (3, " \n ", 1), (None, "no id " * 30, 1), (None, "no id " * 30, 1), (4, "long word " * 30_000, 1), (5, "The same text of a few words.", 1), (6, "the SAME text of a few words.", 1)]


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, stage):
    """Nulls, empty and very long texts, ties, repeated rows, an empty table, clashing and missing columns."""
    schema = "doc_id bigint, text string, toxicity int, quality int, overlap int, _key int, key int, root int, label int, length int"
    docs = spark.createDataFrame([(*r[:2], *[7] * 8) for r in CASES], schema)
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, DATA)
    rows = collections.Counter((r.doc_id, (r.text or "")[:5] if "text" in out.columns else r.start) for r in out.collect())
    assert run(spark, docs.limit(0), DATA).count() == 0
    if stage != "packing":
        assert out.columns == docs.columns and out.filter(" and ".join(f"`{c}` = 7" for c in docs.columns[2:])).count() == sum(rows.values())
    every = collections.Counter((i, (t or "")[:5]) for i, t, _ in CASES)
    if stage in ("toxicity", "decontamination"):
        assert rows == every
    elif stage == "quality_rules":
        assert not rows
    elif stage == "near_duplicates":
        assert rows == {(1, ""): 1, (None, "no id"): 1, (4, "long "): 1, (5, "The s"): 1}
    else:
        assert sum(v for (i, at), v in rows.items() if at == 0) == len(CASES)


def test_odd_rows_of_fingerprints_and_packing(spark):
    docs = spark.createDataFrame([(*r[:2], 7, 7, 7) for r in CASES], "doc_id bigint, text string, fp int, component_id int, sequence_id int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(CASES) and {r.component_id for r in got if r.fp == 0} == {1}
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    packed = packing.packed(docs, "byte_bpe_50k.json")
    assert packed.filter("start = 0").count() == len(CASES) and packed.agg(F.max("length")).first()[0] <= 2048
