"""Toxicity by a weighted lexicon and Aho-Corasick.

Texts are folded first: lower case, homoglyphs to Latin letters, digits and signs inside words to
the letters that they stand for. The automaton finds all terms in one pass over the whole text;
terms are whole words or word beginnings, and hits inside an exception phrase don't count. The
weights of the hits are summed, divided by a slowly growing function of the text's length and put
through a logistic curve.

Terms and weights are learned: of the words and word beginnings in a bounded sample of toxic
documents (``MOST_TOXIC``), those far more frequent there than in a sample of other documents
(``MOST_OTHER``), weighted by their log-odds. A short fixed list stands in where there are no
labels, and for its words that the samples lack. Both bounds choose by a hash of the id; scoring covers every text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import discard, held_out, materialize, prepare

MOST_TOXIC, MOST_OTHER = 3_000, 6_000
#: A term must occur in this many and this share of the toxic sample, and be this much likelier there.
LEAST_DOCS, LEAST_SHARE, LEAST_LOG_ODDS = 5, 0.02, 3.0
BEGINNINGS = range(4, 8)
CUTOFF = 0.7

#: General insults with a weight that holds until labels say otherwise.
SEED = "idiot moron stupid scum loser worthless pathetic disgusting trash clown imbecile dumbass bastard asshole bitch shithead".split()
SEED_WEIGHT = 4.0
#: Harmless phrases around words of the list.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "circus clown", "idiot proof", "idiot light", "loser bracket")
#: Letters of other scripts that look like Latin ones, and digits read as letters.
HOMOGLYPHS = dict(
    zip("аеорсухіјѕԁһӏԛԝкмнтвгпαεορυχικντɑɡıƖ", "aeopcyxijsdhlqwkmhtbrnaeopuxikvtagil", strict=True)
)
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
_FULLWIDTH = {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
_TABLE = str.maketrans(HOMOGLYPHS | DIGITS | _FULLWIDTH)
_NEEDS = re.compile("[" + "".join(map(re.escape, [*HOMOGLYPHS, *DIGITS, *_FULLWIDTH])) + "]")
_SIGN = re.compile(r"[@$!](?=[^\W_])")
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, Latin look-alikes as Latin, digits as letters; a sign is a letter only in front of one."""
    text = text.lower()
    if _NEEDS.search(text):
        text = text.translate(_TABLE)
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text


@dataclass(frozen=True)
class Model:
    """``words`` and ``beginnings`` to weights, and the logistic curve."""

    words: dict[str, float]
    beginnings: dict[str, float]
    intercept: float
    slope: float


class Matcher:
    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.automaton = model, ahocorasick.Automaton()
        for term, w in model.beginnings.items():
            self.automaton.add_word(term, (len(term), w, False))
        for term, w in model.words.items():
            if term not in model.beginnings:
                self.automaton.add_word(term, (len(term), w, True))
        for phrase in EXCEPTIONS:
            self.automaton.add_word(phrase, (len(phrase), None, True))
        self.automaton.make_automaton()

    def hits(self, text: str | None) -> list[tuple[int, int, float]]:
        """(first, after, weight) of each counted hit in the folded text."""
        folded = fold(text or "")
        found, spared = [], []
        for end, (n, w, whole) in self.automaton.iter(folded):
            first = end + 1 - n
            if (first and folded[first - 1].isalnum()) or (whole and end + 1 < len(folded) and folded[end + 1].isalnum()):
                continue
            (spared if w is None else found).append((first, end + 1, w))
        return [h for h in found if not any(a <= h[0] and h[1] <= b for a, b, _ in spared)] if spared else found

    def density(self, text: str | None) -> float:
        """Weights of the hits over 1 + ln(1 + words / 100)."""
        total = sum(w for _, _, w in self.hits(text))
        return total / (1 + math.log1p(len((text or "").split()) / 100)) if total else 0.0

    def score(self, text: str | None) -> float:
        z = self.model.intercept + self.model.slope * math.log1p(self.density(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms_of(text: str | None) -> set[str]:
    """Distinct words (=word) and word beginnings (^part) of a folded text."""
    out = set()
    for w in set(WORD.findall(fold(text or ""))):
        if len(w) >= BEGINNINGS[0]:
            out.add("=" + w)
            out.update("^" + w[:n] for n in BEGINNINGS if len(w) >= n)
    return out


def count_terms(sample: DataFrame, within: set[str] | None) -> DataFrame:
    """(term, n): documents of ``sample`` (text) with each term; sums per task, then over tasks."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Counter()
        for f in frames:
            for t in f["text"]:
                c.update(terms_of(t) if within is None else terms_of(t) & within)
        yield pd.DataFrame({"term": list(c), "n": list(c.values())}).astype({"n": "int64", "term": "object"})

    return sample.select("text").mapInPandas(task, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def choose(toxic: Counter, other: Counter, n_toxic: int, n_other: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings with weights. ``toxic`` and ``other`` count documents with each term, those of the list included.

    A word of the fixed list keeps its weight only where neither sample has it. A beginning gives way to a longer
    one, or to a word, that occurs as often (95 %) or is far more telling.
    """
    least = max(LEAST_DOCS, LEAST_SHARE * n_toxic)

    def weight_of(t: str) -> float:
        return math.log((toxic[t] + 0.5) / (n_toxic + 1)) - math.log((other[t] + 0.5) / (n_other + 1))

    weight = {t: weight_of(t) for t, n in toxic.items() if n >= least}
    good = {t: w for t, w in weight.items() if w >= LEAST_LOG_ODDS}
    words, beginnings = {}, {}
    for t in sorted(good, key=lambda t: (len(t), t)):
        body, n = t[1:], toxic[t]
        if any(body.startswith(b) for b in beginnings):
            continue
        longer = [x for x in good if x[1:].startswith(body) and x != t and (len(x) > len(t) or x[0] == "=") and (toxic[x] >= 0.95 * n or (toxic[x] >= 0.6 * n and good[x] >= good[t] + 1.5))]
        if longer and t[0] == "^":
            continue
        (words if t[0] == "=" else beginnings)[body] = good[t]
    words = {w: x for w, x in words.items() if not any(w.startswith(b) for b in beginnings)}
    for s in SEED:
        if not any(s.startswith(b) for b in beginnings):
            met = toxic["=" + s] + other["=" + s]
            words.setdefault(s, weight_of("=" + s) if met else SEED_WEIGHT)
    return {w: x for w, x in words.items() if x > 0}, beginnings


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a small ridge; both classes weigh half."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    a = np.column_stack([np.ones_like(x), x])
    beta, ridge = np.zeros(2), np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + ridge, a.T @ (w * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


#: The curve of the fixed list: no hit 0.05, one hit in a short text about 0.75.
UNFITTED = (-2.95, 2.5)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from the labelled rows of ``docs`` that aren't held out; labels of one id count as toxic if any is.

    Null ids and null labels teach nothing, a null text counts as empty, equal texts count once, and as toxic if
    any of them is; very long texts are read whole. Without toxic or without other documents, or with empty
    tables, the fixed list stands in. Other columns are ignored, whatever their names.
    """
    spark = prepare(docs.sparkSession)
    marked = labels.filter(~held_out(id_col) & F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("y"))
    there = docs.select(F.col(id_col).alias("_id")).distinct()
    marked = marked.join(there, "_id", "left_semi")
    order = F.xxhash64("_id", F.lit("sample"))
    ids = marked.filter("y = 1").orderBy(order, "_id").limit(MOST_TOXIC).unionByName(marked.filter("y = 0").orderBy(order, "_id").limit(MOST_OTHER))
    ids = spark.createDataFrame(ids.collect(), marked.schema)  # at most MOST_TOXIC + MOST_OTHER rows of two numbers
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id")
    sample = materialize(texts.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("y").alias("y")), "toxicity-sample", small=True)
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n_toxic, n_other = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_other:
        words, beginnings = choose(Counter(), Counter(), n_toxic, n_other)
        discard(sample)
        return Model(words, beginnings, *UNFITTED)
    least = max(LEAST_DOCS, LEAST_SHARE * n_toxic)
    listed = ["=" + s for s in SEED]
    toxic = Counter({r["term"]: r["n"] for r in count_terms(sample.filter("y = 1"), None).filter((F.col("n") >= least) | F.col("term").isin(listed)).collect()})
    other = Counter({r["term"]: r["n"] for r in count_terms(sample.filter("y = 0"), set(toxic) | set(listed)).collect()})
    bare = Model(*choose(toxic, other, n_toxic, n_other), *UNFITTED)

    @F.pandas_udf("double")
    def density(x: pd.Series) -> pd.Series:
        m = Matcher(bare)
        return pd.Series([math.log1p(m.density(t)) for t in x], dtype="float64")

    points = sample.select(density("text").alias("x"), "y").groupBy("x", "y").count().toPandas()  # at most as many rows as the sample
    x, y = points["x"].to_numpy(float).repeat(points["count"]), points["y"].to_numpy(float).repeat(points["count"])
    discard(sample)
    return Model(bare.words, bare.beginnings, *logistic(x, y))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` plus struct ``name`` (score, predicted); a column of that name is replaced, all others stay.

    Null, empty and wordless texts have no hits and get the score of a clean text; very long texts are searched
    whole; repeated rows get equal scores; an empty table gives no rows.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("score double, predicted int")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Matcher(model)
        for t in texts:
            s = np.array([m.score(x) for x in t], dtype="float64")
            yield pd.DataFrame({"score": s, "predicted": (s >= CUTOFF).astype("int32")})

    return docs.withColumn(name, scored(F.col(text_col)))
