"""Hierarchical language identification: the family first, then linear SVMs between its languages.

Features are hashed letter n-grams (1 to 3) of the whole text, square-rooted and of unit length.
The family is decided by one linear SVM per family against the rest; within a family each pair of
languages has a linear SVM of its own and the language with most votes wins, ties by summed margins.
Both are trained on at most ``MOST_PER_LANGUAGE`` distinct documents of each of the ``MOST_LANGUAGES`` commonest
languages, and at most ``MOST_DOCUMENTS`` in all, chosen by a hash of id and text; every text is classified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import held_out, prepare

MOST_PER_LANGUAGE, MOST_DOCUMENTS, MOST_LANGUAGES = 1_000, 8_000, 400
DIMENSIONS = 4096
UNKNOWN = "und"
#: Families of ISO 639-1 codes. Any other label is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "indo-aryan": "hi ur bn pa gu mr ne si".split(),
    "turkic": "tr az kk ky uz tk".split(),
    "uralic": "fi et hu".split(),
    "semitic": "ar he mt am".split(),
    "sinitic": "zh yue".split(),
}


def family_of(language: str) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes), language)


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of a text, or None if it has no letter."""
    if not text:
        return None
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    is_letter = letters()[cp]
    if not is_letter.any():
        return None
    cp = np.where(is_letter, cp, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one blank after a word
    a = np.concatenate([np.array([32], np.uint32), cp[keep], np.array([32], np.uint32)])
    counts = np.zeros(DIMENSIONS)
    with np.errstate(over="ignore"):
        one = a * np.uint32(2654435761)
        two = one[:-1] * np.uint32(31) + a[1:] * np.uint32(2246822519)
        three = two[:-1] * np.uint32(31) + a[2:] * np.uint32(3266489917)
        for h in (one, two, three):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
            counts += np.bincount(h >> np.uint32(20), minlength=DIMENSIONS)
    v = np.sqrt(counts)
    return (v / np.linalg.norm(v)).astype(np.float32)


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    languages: list[list[str]] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    pair_weights: list[np.ndarray | None] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of rows of features. A score is the product of the logistic confidences of both steps."""
        n = len(x)
        ones = np.hstack([x, np.ones((n, 1), np.float32)])
        margins = ones @ self.family_weights if len(self.families) > 1 else np.full((n, 1), 9.0)
        chosen = margins.argmax(axis=1)
        best = 1 / (1 + np.exp(-4 * margins[np.arange(n), chosen]))
        names = np.empty(n, object)
        for f, languages in enumerate(self.languages):
            rows = np.flatnonzero(chosen == f)
            if not len(rows):
                continue
            k = len(languages)
            if k == 1:
                names[rows] = languages[0]
                continue
            m = ones[rows] @ self.pair_weights[f]
            votes, sums = np.zeros((len(rows), k)), np.zeros((len(rows), k))
            for p, (i, j) in enumerate(combinations(range(k), 2)):
                votes[:, i] += m[:, p] > 0
                votes[:, j] += m[:, p] <= 0
                sums[:, i] += m[:, p]
                sums[:, j] -= m[:, p]
            w = np.array([max(range(k), key=lambda c: (votes[r, c], sums[r, c])) for r in range(len(rows))])
            names[rows] = np.array(languages, object)[w]
            best[rows] *= 1 / (1 + np.exp(-4 * sums[np.arange(len(rows)), w] / (k - 1)))
        return list(names), best


def linear_svms(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights of L2-regularised squared-hinge SVMs, a column for each column of ``y`` (-1, 1; 0: not a row of this one).

    Nesterov's method over all rows; the classes of one machine weigh the same.
    """
    a = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros_like(y, dtype=np.float32)
    for c in range(y.shape[1]):
        for s in (-1, 1):
            mine = y[:, c] == s
            w[mine, c] = 0.5 / max(1, mine.sum())
    rate = 1 / (2 * 2 + ridge)
    b = np.zeros((a.shape[1], y.shape[1]), np.float32)
    ahead, t = b, 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (a @ ahead))
        g = -2 * a.T @ (w * y * slack) + ridge * ahead
        new = ahead - rate * g
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, b = new + np.float32((last - 1) / t) * (new - b), new
    return b


def train(x: np.ndarray, labels: list[str]) -> Model:
    known = sorted(set(labels))
    families = sorted({family_of(k) for k in known})
    model = Model(families, [[k for k in known if family_of(k) == f] for f in families])
    label = np.array(labels, object)
    belongs = np.array([families.index(family_of(k)) for k in labels])
    if len(families) > 1:
        y = np.where(belongs[:, None] == np.arange(len(families))[None, :], 1, -1).astype(np.float32)
        model.family_weights = linear_svms(x, y)
    for f, languages in enumerate(model.languages):
        if len(languages) < 2:
            model.pair_weights.append(None)
            continue
        rows = belongs == f
        own = label[rows]
        y = np.stack([np.where(own == i, 1, np.where(own == j, -1, 0)) for i, j in combinations(languages, 2)], axis=1).astype(np.float32)
        model.pair_weights.append(linear_svms(x[rows], y))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with a language that aren't held out.

    Null texts, null languages and texts without a letter teach nothing; a null id counts as training data; rows
    that repeat an id and a text count once, however often; very long texts are read whole; an empty table, or one
    without languages, gives a model that names none. Other columns are ignored, whatever their names.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(~held_out("_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("_id", "text", F.lit("sample")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return Model()
    most = max(1, min(MOST_PER_LANGUAGE, MOST_DOCUMENTS // len(counts)))
    # Some more than wanted pass by their hash; copies meet before the shuffle; then the count is exact.
    rates = spark.createDataFrame([(c["lang"], min(1.0, 1.5 * most / c["n"])) for c in counts], "lang string, rate double")
    drawn = rows.join(F.broadcast(rates), "lang").filter(F.pmod("h", F.lit(1_000_000)) < F.col("rate") * 1_000_000)
    distinct = drawn.groupBy("lang", "h").agg(F.first("text").alias("text"))
    sample = distinct.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= most).select("lang", "text")

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [(k, v.astype(np.float16).tobytes()) for k, t in zip(f["lang"], f["text"], strict=True) if (v := features(t)) is not None]
            yield pd.DataFrame(got, columns=["lang", "x"])

    taken = sorted(sample.mapInPandas(task, "lang string, x binary").collect())  # at most MOST_DOCUMENTS rows of 8 KB
    if not taken:
        return Model()
    x = np.stack([np.frombuffer(r["x"], np.float16).astype(np.float32) for r in taken])
    return train(x, [r["lang"] for r in taken])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus struct ``language`` (lang_pred, score); a column of that name is replaced.

    Null texts and texts without a letter, and all texts if nothing was learned, are ``und`` with score 0. Very long
    texts are read whole; repeated rows get equal names; equal votes go to the greater sum of margins, then to the
    language first in order; an empty table gives no rows; all other columns stay.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(t), "score": np.zeros(len(t))})
            rows, x = [], []

            def settle(out=out, rows=rows, x=x):
                if rows:
                    names, scores = model.predict(np.stack(x))
                    out.loc[rows, "lang_pred"] = names
                    out.loc[rows, "score"] = scores
                    rows.clear()
                    x.clear()

            for i, text in enumerate(t if model.languages else []):
                if (v := features(text)) is not None:
                    rows.append(i)
                    x.append(v)
                if len(rows) == 256:
                    settle()
            settle()
            yield out

    return docs.withColumn("language", predicted(F.col(text_col)))
