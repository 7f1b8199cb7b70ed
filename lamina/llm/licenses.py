"""License scan: runs of words against license templates by the Dice coefficient of their word bigrams.

Texts and templates are words of a-z and 0-9, lower-cased. A window is any run of words of a text. With
n bigrams in the template, a in the window and k in both (each counted as often as both have it), the
coefficient is 2 k / (a + n), and a window matches from the threshold t. So

* a lies between t / (2 - t) and (2 - t) / t times n, and k is at least t / (2 - t) of n (the size bounds);
* a window holds one of any n - k + 1 bigrams of its template: texts without a word of such bigrams are
  dropped inside their row;
* a text that has too few of a template's bigrams altogether is dropped for that template;
* the best window begins and ends at bigrams of the template, so only those are tried.

A bigram at position p adds to the overlap of a window from s on if fewer than c of its kind lie between,
where c is the template's count of it: if the c-th occurrence before p lies before s. One pass from each
start therefore finds all windows' overlaps. All steps are DataFrame expressions; the words of a text meet
the templates in a broadcast join, whose size is that of the templates.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import LOWER, ascii_lower, counted_broadcast, let, materialize
from lamina.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
#: Anything but a-z and 0-9, once A-Z are lower case.
SEPARATOR = "[^a-z0-9]+"
_SEPARATOR = f"[^{''.join(LOWER)}0123456789]+"  # the same, listed: the JVM tests a listed character by one look-up
#: Words too frequent in prose to tell a license by.
FREQUENT = (
    "the of and to in a is for on or this that by with any be it as at are not from an you may no but if all use work under can has have will shall which was "
    "such other its your our their there what so we do more out up one who new copy free name form source without including following time made people great"
).split()
EMPTY_LICENSES = "array<struct<license:string,dice:double,first:int,words:int>>"


def least_overlap(n: int, threshold: float) -> int:
    """Bigrams that a matching window shares with a template of n at least."""
    return math.ceil(threshold / (2 - threshold) * n - 1e-9)


def template_bigrams(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, int, dict[str, int]]]:
    """(license, template number, bigrams with counts) of each template."""
    out = []
    for license_id, texts in templates.items():
        for text in texts:
            w = [x for x in re.split(SEPARATOR, text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
            out.append((license_id, len(out), dict(Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))))
    return out


def guard_words(templates: list[tuple[str, int, dict[str, int]]], threshold: float) -> list[str]:
    """Words of which every matching window holds one: for each template so many that the bigrams without them can't reach the least overlap."""
    chosen: set[str] = set()
    for _, _, grams in sorted(templates, key=lambda t: sum(t[2].values())):
        n = sum(grams.values())
        without = {g: c for g, c in grams.items() if not chosen & set(g.split(" "))}
        while sum(without.values()) >= least_overlap(n, threshold):
            gain: Counter[str] = Counter()
            for g, c in without.items():
                gain.update(dict.fromkeys(g.split(" "), c))
            best = min(gain, key=lambda w: (w in FREQUENT, w.isdigit(), -min(len(w), 9), -gain[w], w))
            chosen.add(best)
            without = {g: c for g, c in without.items() if best not in g.split(" ")}
    return sorted(chosen)


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATOR), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """Bigrams of a word array in order; none for fewer than two words."""
    return let(
        words,
        lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))),
    )


def best_window(spots: Column, n: Column, threshold: float) -> Column:
    """Struct (dice, first, words) of the best window over ``spots``: sorted (p, prev) of one template's bigrams in a text.

    Of equal coefficients the window that begins first, then the shorter one; dice is 0 if no start has enough spots in reach.
    """
    reach = F.floor(n * ((2 - threshold) / threshold) + 1e-9).cast("int")
    need = F.ceil(n * (threshold / (2 - threshold)) - 1e-9).cast("int")
    start = "struct<k:int,dice:double,last:int>"

    def from_start(s: Column, i: Column) -> Column:
        def grow(a: Column, x: Column) -> Column:
            counts = (x["prev"] < s["p"]) & (x["p"] - s["p"] < reach)
            dice = 2 * (a["k"] + 1) / (x["p"] - s["p"] + 1 + n)
            better = counts & (dice > a["dice"])
            return F.struct(
                (a["k"] + counts.cast("int")).alias("k"), F.when(better, dice).otherwise(a["dice"]).alias("dice"), F.when(better, x["p"]).otherwise(a["last"]).alias("last")
            ).cast(start)

        found = F.aggregate(F.slice(spots, i + 1, reach), F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("dice"), s["p"].alias("last")).cast(start), grow)
        tried = let(found, lambda f: F.struct(f["dice"].alias("dice"), (-s["p"]).alias("back"), (s["p"] - f["last"] - 2).alias("fewer")))
        return F.when(F.get(spots, i + need - 1)["p"] - s["p"] < reach, tried)

    best = F.array_max(F.array_compact(F.transform(spots, from_start)))
    return let(best, lambda b: F.struct(F.coalesce(b["dice"], F.lit(0.0)).alias("dice"), (-b["back"]).alias("first"), (-b["fewer"]).alias("words")))


def undominated(found: Column) -> Column:
    """Of overlapping windows of several licenses only the best: higher coefficient, then name."""

    def beaten(m: Column) -> Column:
        return F.exists(
            found,
            lambda x: (x["license"] != m["license"]) & (x["first"] < m["first"] + m["words"]) & (m["first"] < x["first"] + x["words"])
            & ((x["dice"] > m["dice"]) | ((x["dice"] == m["dice"]) & (x["license"] < m["license"]))),
        )

    return F.filter(found, lambda m: ~beaten(m))


def matches(docs: DataFrame, text_col: str, threshold: float, templates: dict[str, list[str]]) -> DataFrame:
    """(key, found) of each distinct text with a match; ``found`` lists (license, dice, first, words) by license."""
    spark = docs.sparkSession
    listed = template_bigrams(templates)
    guards = F.array(*map(F.lit, guard_words(listed, threshold)))
    texts = docs.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), words_of(F.col(text_col)).alias("words"))
    # A text without a guard word has no matching window, so most texts end here. Copies meet before the
    # shuffle and in it; from there on all steps are grouped by the key that the rows are dealt by.
    guarded = texts.filter(F.arrays_overlap("words", guards)).groupBy("key").agg(F.first("words").alias("words"))
    by_gram: dict[str, list[tuple[int, int]]] = {}
    for _, t, grams in listed:
        for g, c in grams.items():
            by_gram.setdefault(g, []).append((t, c))
    known = spark.createDataFrame(list(by_gram.items()), "gram string, uses array<struct<template:int,c:int>>")
    named = spark.createDataFrame([(t, lic, sum(g.values())) for lic, t, g in listed], "template int, license string, n int")
    spots = guarded.select("key", F.posexplode(bigrams_of(F.col("words"))).alias("p", "gram")).join(F.broadcast(known), "gram")
    spots = spots.select("key", "gram", "p", F.explode("uses").alias("u")).select("key", "gram", "p", "u.template", "u.c")
    places = spots.groupBy("key", "template", "gram", "c").agg(F.sort_array(F.collect_list("p")).alias("at"))
    pairs = F.transform("at", lambda p, i: F.struct(p.alias("p"), F.coalesce(F.get("at", i - F.col("c")), F.lit(-1)).alias("prev")))
    whole = places.select("key", "template", F.least(F.size("at"), F.col("c")).alias("most"), pairs.alias("pairs")).groupBy("key", "template").agg(
        F.sum("most").alias("most"), F.sort_array(F.flatten(F.collect_list("pairs"))).alias("spots")
    )
    able = whole.join(F.broadcast(named), "template").filter(F.col("most") >= F.col("n") * (threshold / (2 - threshold)) - 1e-9)
    best = able.select("key", "license", best_window(F.col("spots"), F.col("n"), threshold).alias("b")).filter(F.col("b.dice") >= threshold)
    per_license = best.groupBy("key", "license").agg(F.max(F.struct("b.dice", (-F.col("b.first")).alias("back"), (-F.col("b.words")).alias("fewer"))).alias("m"))
    each = F.struct("license", F.col("m.dice").alias("dice"), (-F.col("m.back")).alias("first"), (-F.col("m.fewer")).alias("words"))
    return per_license.groupBy("key").agg(F.sort_array(F.collect_list(each)).alias("found")).select("key", undominated(F.col("found")).alias("found"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(doc_id, found, licenses, best_license, best_dice), one row per document.

    ``found`` has, for each license, the best window (license, dice, first word, words), unless another
    license's better window overlaps it; ``licenses`` are their names, sorted; the best has the highest
    coefficient, ties by name. A template that occurs several times is one entry, at its best place.

    Null, empty and one-word texts match nothing. Very long texts are scanned whole: the work grows with
    their length. Repeated rows each get their row; rows that share an id but not a text are kept apart;
    null ids are kept; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    found = materialize(matches(docs, text_col, threshold, templates), "licenses", small=True)
    out = rows.join(counted_broadcast(found, found.count()), "key", "left").withColumn("found", F.coalesce("found", F.array().cast(EMPTY_LICENSES)))
    first = F.array_max(F.transform("found", lambda m: m["dice"]))
    best = F.get(F.filter("found", lambda m: m["dice"] == first), 0)
    return out.select("doc_id", "found", F.transform("found", lambda m: m["license"]).alias("licenses"), best["license"].alias("best_license"), best["dice"].alias("best_dice"))
