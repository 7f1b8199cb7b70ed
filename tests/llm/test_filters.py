"""Toxicity, quality rules, license scan and language identification."""

import collections
import random
import re
import zlib

import pytest
from lamina.llm import langid, licenses, quality_rules, toxicity
from pyspark.sql import functions as F


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_folding():
    assert toxicity.fold("1D10T ѕсum ｌｏｓｅｒ Wow! $tup1d") == "idiot scum loser wow! stupid"
    m = toxicity.Matcher(toxicity.Model({"scum": 2.0, "trash": 1.0}, {"lowei": 3.0}, -3.0, 2.0))
    words = lambda t: [toxicity.fold(t)[a:b] for a, b, _ in m.hits(t)]
    assert words("Scum! scummy, LOWEIsche trash can; trash.") == ["scum", "lowei", "trash"]
    assert m.hits(None) == [] and m.hits("") == []
    assert m.density("scum") > m.density("scum " + "word " * 5000) > 0


def corpus(rng, n):
    clean = ["river", "stone", "garden", "letter", "window", "paper", "morning", "bridge", "idioms"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randrange(5, 200))]
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randrange(2, 6)):
                w[rng.randrange(len(w))] = rng.choice(["gruk", "Blarf!", "zonko" + rng.choice(["ist", "ent", "a"])])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_learns_from_labels_only_of_its_fold(spark):
    rng = random.Random(1)
    docs, labels = corpus(rng, 600)
    extra = [(-1, None), (-2, ""), (None, "gruk gruk"), (-3, "word " * 50_000 + "gruk blarf gruk"), (0, docs[0][1])]
    wrong = [(i, q, 1 - t if held(i) else t) for i, q, t in labels] + [(1, 1, None), (None, 1, 1)]
    d = spark.createDataFrame([(*r, "x") for r in docs + extra], "doc_id bigint, text string, toxicity string")
    model = toxicity.fit(d, spark.createDataFrame(wrong, "doc_id bigint, quality int, toxic int"))
    assert "zonko" in model.beginnings and {"gruk", "blarf"} <= set(model.words)
    got = toxicity.score(d, model).select("doc_id", "toxicity.*").collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r.score <= 1 for r in got)
    truth = {i: t for i, _, t in labels}
    held_right = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and held(r.doc_id)]
    assert sum(held_right) / len(held_right) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[-1].predicted == by[-2].predicted == 0 and by[-1].score == by[-2].score and by[None].predicted == 1 and by[-3].predicted == 1
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(d, toxicity.fit(d, empty)).count() == len(docs) + len(extra)
    assert toxicity.score(d.limit(0), toxicity.fit(d.limit(0), empty)).count() == 0


def plain_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    cover = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), base


def test_quality_rules(spark):
    rng = random.Random(2)
    pool = ["the", "a", "b", "é#", "x|y", "of", "WORD", "\n", "\n\n", "\t", "same line\n"]
    texts = [None, "", " ", "a b c", "a b c a b c", "a a a a", "the " * 60, "A B " * 70, "x " * 40_000, "line of the\n" * 80, "$$$ " * 60]
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 150))) for _ in range(200)]
    texts += [" ".join(f"w{rng.randrange(500)}" if rng.random() < 0.7 else "the" for _ in range(300)) for _ in range(20)]
    d = spark.createDataFrame([(i, t, "q", 5) for i, t in enumerate(texts)] + [(3, texts[3], "q", 5), (None, "x", "q", 5)], "doc_id bigint, text string, quality string, _m int")
    out = quality_rules.apply_rules(d)
    got = {r.doc_id: r for r in out.select("doc_id", "quality.*").collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(t), i
        assert not (r.kept and r.base_failed) and r.kept == (not r.base_failed and not r.violations)
    assert all(got[i].kept for i in range(len(texts) - 20, len(texts))) and not got[10].kept
    assert out.filter("quality.kept").select("doc_id").count() == sum(r.kept for r in out.select("quality.kept").collect())
    assert out.limit(0).count() == 0


def words_of(t):
    return [x for x in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]


def plain_licenses(t, templates):
    """Every run of words against every template: (license, dice, first, words), best place of each, better ones first where they overlap."""
    w = words_of(t)
    grams, best = list(zip(w, w[1:])), {}
    for name, texts in templates.items():
        for text in texts:
            x = words_of(text)
            want = collections.Counter(zip(x, x[1:]))
            n = len(x) - 1
            for a in range(len(grams)):
                left, k = want.copy(), 0
                for e in range(a, min(len(grams), a + int(1.5 * n + 1e-9))):
                    if left[grams[e]] > 0:
                        left[grams[e]] -= 1
                        k += 1
                    dice = 2 * k / (e - a + 1 + n)
                    if dice >= 0.8:
                        best[name] = min(best.get(name, (0, 0, 0)), (-dice, a, e - a + 2))
    better = lambda x, y: (x[1], x[0]) < (y[1], y[0])
    found = [(name, -d, a, k) for name, (d, a, k) in best.items()]
    return sorted(m for m in found if not any(x[0] != m[0] and x[2] < m[2] + m[3] and m[2] < x[2] + x[3] and (x[1] > m[1] or x[1] == m[1] and x[0] < m[0]) for x in found))


def test_licenses_equal_all_windows(spark):
    rng = random.Random(3)
    templates = {k: [x for x in licenses.TEMPLATES[k] if len(x) < 1200] for k in ("mit", "apache-2.0", "cc-by-4.0", "cc-by-nc-4.0", "isc", "0bsd", "gpl-3.0", "lgpl-3.0", "wtfpl")}
    whole = [x for v in templates.values() for x in v]
    texts = [None, "", "MIT", "Released under the MIT License.\nReleased under the MIT License.", "é " * 30_000, "the mit license " * 40, "A small team made it. Released under the MIT License. See the manual."]
    code = lambda n: " ".join(rng.choice(["int", "x1", "return", "the", "license", "software", "of", "under", "y"]) for _ in range(n))
    for _ in range(60):
        w = rng.choice(whole).split(" ")
        for _ in range(rng.randrange(0, max(2, len(w) // 8))):
            w[rng.randrange(len(w))] = rng.choice(["foo", "bar", "", "two words", "the"])
        texts.append(code(rng.randrange(40)) + rng.choice(["\n", "\n\n", " "]) + " ".join(w).upper() + "\n" + code(rng.randrange(40)) + " " + rng.choice([*whole[:6], ""]))
    d = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)] + [(3, texts[3], 1, "k")] * 3, "doc_id bigint, text string, license int, key string")
    got = licenses.scan(d, templates=templates).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        want = plain_licenses(texts[r.doc_id], templates)
        assert [tuple(m)[0::2] + (m.words,) for m in r.found] == [(m[0], m[2], m[3]) for m in want], r.doc_id
        assert [m.dice for m in r.found] == pytest.approx([m[1] for m in want])
        top = min(want, key=lambda m: (-m[1], m[0]), default=(None, None))
        assert r.licenses == [m[0] for m in want] and r.best_license == top[0] and (r.best_dice == pytest.approx(top[1]) if want else r.best_dice is None)
    assert licenses.scan(d.limit(0)).count() == 0


def test_whole_licenses_among_code(spark):
    """Texts in their paragraphs and comment signs, in front of, inside and behind 500 lines of code."""
    wanted = {k: v[-1] for k, v in licenses.TEMPLATES.items() if len(v[-1]) > 300 or k in ("fair", "fsfap", "wtfpl", "epl-2.0")}
    assert len(wanted) >= 20
    code = [f"    value_{i} = compute(value_{i - 1}, {i}) + offset[{i}];" for i in range(500)]
    rows = []
    for name, text in wanted.items():
        w = text.split(" ")
        lines = [" * " + " ".join(w[a : a + 11]) for a in range(0, len(w), 11)]
        lines[len(lines) // 3 : len(lines) // 3] = ["", "/* */", ""]
        for at in (0, 250, 500):
            rows.append((name, "\n".join([*code[:at], "", *lines, "", *code[at:]])))
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    for r in licenses.scan(d).collect():
        assert r.licenses == [rows[r.doc_id][0]] and r.best_dice > 0.95, (rows[r.doc_id][0], r.licenses, r.best_dice)


SPEECH = {
    "en": "the and of that with from this have which their would other".split(),
    "de": "der und die nicht auf eine werden sich auch schön über größe".split(),
    "fr": "les des que pour dans une pas être où élève garçon très".split(),
    "es": "los las que para una por más está niño también según año".split(),
    "xx": "zzqq qqzz zqzq qzqz wqzx".split(),
}


def test_language(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(SPEECH[k]) for _ in range(rng.randrange(6, 80))), k) for i, k in enumerate(list(SPEECH) * 60)]
    wrong = [(i, t, "xx" if held(i) else k) for i, t, k in rows]
    extra = [(-1, None, "en"), (-2, "", None), (-3, "123 -- !", "de"), (-4, "the " * 60_000, None), (None, "les élèves", None), (5, rows[5][1], None)]
    d = spark.createDataFrame([(*r, "s") for r in wrong + extra], "doc_id bigint, text string, lang string, language string")
    model = langid.fit(d)
    assert model.families == ["germanic", "romance", "xx"] and model.languages == [["de", "en"], ["es", "fr"], ["xx"]]
    got = langid.identify(d, model).select("doc_id", "language.*").collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    right = [by[i] == k for i, _, k in rows if held(i)]
    assert sum(right) / len(right) > 0.97
    assert by[-1] == by[-2] == by[-3] == "und" and by[-4] == "en"
    none = langid.fit(d.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(d, none).select("language.*").collect()} == {"und"}
    assert langid.identify(d.limit(0), model).count() == 0
