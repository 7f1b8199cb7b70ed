"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every measure is a Catalyst expression over the row's own text, so the operator is a single
narrow projection: no shuffle, no Python, and a lost executor costs only its own splits.
Trigrams that occur twice are found by sorting (hash, position) pairs inside the row, so the
work per text is n log n however often its words repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import let, with_struct

#: Frequent function words of languages that are written with the letters of ``ALPHABET`` alone.
STOP_WORDS = {
    "en": "the of and to in a is that for on with as by it be at from are this was or an not have but they you all were their which will one there when who",
    "de": "der die das und ist in zu den von mit sich auf für nicht ein eine als auch dem des im es an werden aus er hat dass sie nach bei um am sind noch wie",
    "fr": "le la les de des et un une du en est que qui dans pour pas sur au plus par avec ce il se ne sont ou mais nous vous je son ses aux",
    "es": "el los las y del al lo una con no su para por como más o pero sus si ya todo esta entre cuando muy sin sobre también me hasta hay donde",
    "it": "il che di per non della sono anche alla degli questo",
    "pt": "que não uma os com dos mas ao das foi também",
    "nl": "het een van niet dat zijn voor ook maar naar hebben",
    "sv": "och att det som för inte med av till den",
    "da": "og det ikke jeg til af har med som være",
    "fi": "ja on ei että se hän oli mutta kun myös",
    "hu": "és hogy nem egy az is csak meg volt de",
    "id": "yang dan di dengan untuk tidak ini dari itu dalam",
    "sw": "ya wa na kwa ni katika hii cha za kuwa",
    "tl": "ang ng sa mga ay na hindi ito siya kanyang",
}
#: Latin letters of those languages, as the inside of a character class.
ALPHABET = "A-Za-zªºÀ-ÖØ-öø-ÿŒœŸẞ"
#: The stop-word rule holds for a text if at most one in so many letters lies outside ``ALPHABET``.
FOREIGN_LETTERS = 200

WORD_SEPARATOR = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``low <= measure <= high``; a bound of None is open. A measure that is null breaks no rule."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are 0..1 and are 0 for a text without words or lines. The share of stop words is null,
#: and so neutral, for a text in a script or alphabet whose stop words aren't listed.
RULES = (
    Rule("too_short", "n_words", low=50),
    Rule("repeated_trigrams", "repeat_word_ratio", high=0.5),
    Rule("symbols", "symbol_word_ratio", high=0.25),
    Rule("odd_words", "mean_word_chars", low=1.5, high=20.0),
    Rule("shouting", "upper_letter_ratio", high=0.6),
    Rule("stop_words", "stop_word_ratio", low=0.01),
    Rule("duplicate_lines", "dup_line_ratio", high=0.6),
)


def words_of(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATOR), lambda w: w != "")


def kept_characters(text: Column, removed: str) -> Column:
    """Code points of ``text`` that stay when the pattern ``removed`` goes."""
    return F.char_length(F.regexp_replace(text, removed, "")).cast("long")


def trigrams(words: Column) -> Column:
    """Sorted (hash, position) pairs of the three-word windows of ``words``."""
    return F.when(F.size(words) < 4, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.sort_array(
            F.transform(
                F.sequence(F.lit(1), F.size(words) - 2),
                lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i")),
            )
        )
    )


def repeated_at(pairs: Column, hashes: Column) -> Column:
    """Sorted positions of the windows whose hash occurs at least twice in ``pairs``."""
    found = F.transform(
        pairs,
        lambda p, k: F.when((F.get(hashes, k - 1) == p["h"]) | (F.get(hashes, k + 1) == p["h"]), p["i"]),
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.array().cast("array<int>")).otherwise(F.sort_array(F.array_compact(found)))


def words_covered(starts: Column) -> Column:
    """Words inside the three-word windows that begin at the sorted ``starts``."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n"), i.alias("last")),
        lambda a: a["n"],
    )


def listed_stop_words() -> list[str]:
    return sorted({w for words in STOP_WORDS.values() for w in words.split()})


def measures(text: Column) -> Column:
    """Struct of counts of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    stops = listed_stop_words()
    lines = F.filter(F.split(text, "\n"), lambda s: F.regexp_like(s, F.lit(r"[^\x20\x09-\x0D]")))

    def counts(w: Column, n_repeat_words: Column) -> Column:
        return let(
            lines,
            lambda line: F.struct(
                F.size(w).cast("long").alias("n_words"),
                kept_characters(text, WORD_SEPARATOR).alias("word_chars"),
                kept_characters(text, r"[^#*$%&|<>]+").alias("n_symbols"),
                F.size(line).cast("long").alias("n_lines"),
                (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines"),
                n_repeat_words.alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(*stops))).cast("long").alias("n_stop_words"),
                kept_characters(text, r"\P{Lu}+").alias("n_upper"),
                kept_characters(text, r"\P{L}+").alias("n_letters"),
                kept_characters(text, rf"[\P{{L}}{ALPHABET}]+").alias("n_foreign"),
            ),
        )

    return let(
        words_of(text),
        lambda w: let(trigrams(w), lambda pairs: let(F.transform(pairs, lambda p: p["h"]), lambda hashes: counts(w, words_covered(repeated_at(pairs, hashes))))),
    )


def ratio(m: Column, part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(m[part], m[whole]), F.lit(0.0))


#: What a rule may name, from a text's counts.
MEASURES = {
    "n_words": lambda m: m["n_words"],
    "mean_word_chars": lambda m: ratio(m, "word_chars", "n_words"),
    "symbol_word_ratio": lambda m: ratio(m, "n_symbols", "n_words"),
    "dup_line_ratio": lambda m: ratio(m, "n_dup_lines", "n_lines"),
    "repeat_word_ratio": lambda m: ratio(m, "n_repeat_words", "n_words"),
    "stop_word_ratio": lambda m: F.when(FOREIGN_LETTERS * m["n_foreign"] <= m["n_letters"], ratio(m, "n_stop_words", "n_words")),
    "upper_letter_ratio": lambda m: ratio(m, "n_upper", "n_letters"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_upper", "n_letters", "n_foreign")


def violations(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a text with the counts ``m`` breaks, in table order."""
    broken = []
    for r in rules:
        value = MEASURES[r.measure](m)
        tests = [value < r.low] if r.low is not None else []
        tests += [value > r.high] if r.high is not None else []
        test = tests[0] if len(tests) == 1 else tests[0] | tests[1]
        broken.append(F.when(test, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "quality") -> DataFrame:
    """All columns of ``docs`` plus struct ``name`` (counts, violations, base_failed, kept).

    Null and empty texts have no words and are rejected as too short; very long texts are measured whole, in
    n log n; repeated rows and ties get equal verdicts; an empty table gives no rows; all further columns pass
    through, but one named ``name`` is replaced.
    """

    def verdict(m: Column) -> Column:
        base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return let(
            violations(m, rules),
            lambda v: F.struct(*[m[n].alias(n) for n in COUNTS], v.alias("violations"), base.alias("base_failed"), (~base & (F.size(v) == 0)).alias("kept")),
        )

    return with_struct(docs, name, let(measures(F.col(text_col)), verdict))
