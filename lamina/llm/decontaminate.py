"""Benchmark decontamination by a prefix-filtered set join on word shingles.

An item is cut into windows of 13 consecutive words (one window, if it has fewer), and a window into
shingles of 5 words (one shingle, if the item has fewer). A window occurs in a text only if all its
shingles do, so under containment one of them is the necessary prefix: the rarest, by counts over all
documents. Neighbouring windows share such anchors. The join goes

1. matches: shingles of documents that some item has, with their positions; the one pass that cuts all
   texts into words. Copies of a text fall together before the shuffle;
2. anchors: the rarest shingle of each window, by counts of the matches, as (shingle, item, place);
3. candidates: matches equal to an anchor give an alignment ``shift = position in the text - place in
   the item``; the positional bound drops those that leave no room for a window of the anchor, the
   length bound those whose text is shorter than the window;
4. verification: the distinct candidate texts alone are shuffled, once, to meet their alignments; the
   words below each window are compared.

Verdicts are small and meet the documents at the end. All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import ascii_lower, counted_broadcast, discard, let, materialize, parted_by_keys

WINDOW, SHINGLE = 13, 5
#: ASCII characters but 0-9 and a-z stand between words, once A-Z are lower case; the words themselves, in either case.
#: Listed one by one: the JVM tests a listed character by one look-up, a negated range by many calls.
_BETWEEN = [i for i in range(128) if not (chr(i).isdigit() or chr(i).islower())]
SEPARATOR = "[" + "".join(rf"\x{i:02X}" for i in _BETWEEN) + "]+"
WORD = "[^" + "".join(rf"\x{i:02X}" for i in _BETWEEN if not chr(i).isupper()) + "]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")


def count_words(text: Column) -> Column:
    """As many as ``words_of`` has, without making them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def key_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def shingles_of(words: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words, in order; none for fewer words."""
    return let(
        words,
        lambda w: F.when(F.size(w) < size, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        ),
    )


def items_of(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item, n, size, words, ids), one row per distinct word list; ``size`` is the words of its shingles."""
    named = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words_of(F.col(item_text)).alias("words")).filter(F.size("words") > 0)
    lists = named.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    n = F.size("words")
    return lists.select(F.md5(F.array_join("words", " ")).alias("item"), n.alias("n"), F.least(n, F.lit(SHINGLE)).alias("size"), "words", "ids")


def places_of(items: DataFrame, sizes: list[int]) -> DataFrame:
    """(size, h, item, n, at): each shingle of each item."""
    cut = F.lit(None).cast("array<bigint>")
    for size in sizes:
        cut = F.when(F.col("size") == size, shingles_of(F.col("words"), size)).otherwise(cut)
    return items.select("item", "n", "size", F.posexplode(cut).alias("at", "h"))


def anchors_of(places: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(size, h, item, n, at, starts): ``starts`` are the windows of the item that the anchor stands for.

    Ties between equally rare shingles go to the first of the window, so that neighbouring windows share anchors.
    A shingle that no document has anchors its windows too: they occur nowhere.
    """
    rated = places.join(counted_broadcast(counts, counts.count()), ["size", "h"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    last = F.greatest(F.col("n") - window, F.lit(0))  # the last window's first word
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") + F.col("size") - window), F.least(F.col("at"), last))
    spread = rated.select("size", "h", "item", "n", "at", "freq", F.explode(starts).alias("start"))
    best = spread.groupBy("item", "n", "start").agg(F.min(F.struct("freq", "at", "size", "h")).alias("b"))
    grouped = best.groupBy("item", "n", "b.size", "b.h", "b.at").agg(F.max("b.freq").alias("freq"), F.sort_array(F.collect_set("start")).alias("starts"))
    return grouped.filter("freq > 0").drop("freq")


def matches_of(texts: DataFrame, places: DataFrame, sizes: list[int], rows: int) -> DataFrame:
    """(key, size, h, pos, n_words, copies): shingles of the texts (key, words) that some item has."""
    wanted = places.select("size", "h").distinct()

    def placed(size: int) -> Column:
        return F.transform(shingles_of(F.col("words"), size), lambda h, i: F.struct(F.lit(size).alias("size"), h.alias("h"), i.alias("pos")))

    each = F.concat(*map(placed, sizes))
    spots = texts.select("key", F.size("words").alias("n_words"), F.explode(each).alias("s")).select("key", "n_words", "s.size", "s.h", "s.pos")
    found = spots.join(counted_broadcast(wanted, rows), ["size", "h"])
    return found.groupBy("key", "size", "h", "pos", "n_words").agg(F.count("*").alias("copies"))


def verified(words: Column, candidates: Column, window: int) -> Column:
    """Spans (item, first, words, ids) where a window of a candidate item occurs."""

    def of_item(c: Column) -> Column:
        size = F.least(F.size(c["item_words"]), F.lit(window))

        def of_shift(a: Column) -> Column:
            fits = F.filter(
                a["starts"],
                lambda s: (a["shift"] + s >= 0) & (a["shift"] + s + size <= F.size(words)) & (F.slice(words, F.greatest(a["shift"] + s, F.lit(0)) + 1, size) == F.slice(c["item_words"], s + 1, size)),
            )
            return F.transform(fits, lambda s: F.struct(c["item"].alias("item"), (a["shift"] + s).alias("first"), size.alias("words"), c["ids"].alias("ids")))

        return F.flatten(F.transform(c["at"], of_shift))

    return F.flatten(F.transform(candidates, of_item))


def covered(spans: Column) -> Column:
    """Words of a text inside at least one of the spans."""
    return F.aggregate(
        F.sort_array(F.transform(spans, lambda x: F.struct(x["first"].alias("a"), (x["first"] + x["words"]).alias("b")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda t, x: F.struct((t["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], t["end"]))).cast("long").alias("n"), F.greatest(t["end"], x["b"]).alias("end")),
        lambda t: t["n"],
    )


def verdicts_of(texts: DataFrame, per_text: DataFrame, window: int) -> DataFrame:
    """(key, found): struct (n_hit, item_ids, spans) of each text that holds a window."""
    spans = verified(F.col("words"), F.col("candidates"), window)

    def verdict(s: Column) -> Column:
        return F.struct(
            covered(s).alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.transform(s, lambda x: x["ids"])))).alias("item_ids"),
            F.transform(s, lambda x: F.struct(x["item"].alias("item"), x["first"].alias("first"), x["words"].alias("words"))).alias("spans"),
        )

    met = texts.join(per_text, "key").select("key", F.explode(F.array(let(spans, verdict))).alias("found"))
    return met.filter("found.n_hit > 0")


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, name: str = "overlap") -> DataFrame:
    """All columns of ``docs`` plus struct ``name`` (n_words, n_hit, n_items, item_ids, spans, contaminated).

    ``spans`` lists (item words key, first word, words) of each occurrence. Null or wordless texts have no
    hits; items without words occur nowhere; items with equal word lists, and repeated rows of either table,
    each count once per id; a null item id never counts as an item, but its words are hit. Very long texts
    are cut and compared whole. Empty documents give no rows, an empty benchmark no hits. Columns of ``docs``
    pass through whatever their names, but one named ``name`` is replaced; columns whose names begin with
    ``_d_`` are this operator's own.
    """
    own = [c for c in docs.columns if c != name]
    keyed = docs.select(*[F.col(f"`{c}`") for c in own]).withColumn("_d_key", key_of(F.col(text_col)))
    items = materialize(items_of(benchmark, item_col, item_text), "items", small=True)
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most SHINGLE rows
    none = F.struct(F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"), F.array().cast("array<struct<item:string,first:int,words:int>>").alias("spans"))
    if not sizes:
        return concluded(keyed.withColumn("_d_found", none), own, text_col, name)
    places = materialize(places_of(items, sizes), "places", small=True)
    texts = docs.select(key_of(F.col(text_col)).alias("key"), words_of(F.col(text_col)).alias("words"))
    matches = materialize(matches_of(texts, places, sizes, places.count()), "matches", small=True)
    counts = matches.groupBy("size", "h").agg(F.sum("copies").alias("freq"))
    anchors = materialize(anchors_of(places, counts, window), "anchors", small=True)
    found = matches.join(counted_broadcast(anchors, anchors.count()), ["size", "h"]).withColumn("shift", F.col("pos") - F.col("at"))
    width = F.least(F.col("n"), F.lit(window))
    # Length and positional bounds: the first and the last window of the anchor limit the shift.
    found = found.filter((F.col("n_words") >= width) & (F.col("shift") + F.element_at("starts", -1) >= 0) & (F.col("shift") + F.element_at("starts", 1) + width <= F.col("n_words")))
    shifts = found.groupBy("key", "item").agg(F.collect_set(F.struct("shift", "starts")).alias("at"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json("words")) + F.length(F.to_json("ids"))), F.lit(0)).alias("b")).first()
    listed = items.select("item", "ids", F.col("words").alias("item_words"))
    per_text = shifts.join(counted_broadcast(listed, size["n"], size["b"]), "item").groupBy("key").agg(F.collect_list(F.struct("item", "ids", "item_words", "at")).alias("candidates"))
    candidates = materialize(per_text, "candidates", small=True)
    n_candidates = candidates.count()
    near, _ = parted_by_keys(docs.select(F.col(text_col).alias("text"), key_of(F.col(text_col)).alias("key")), "key", candidates, "key", n_candidates)
    near = near.join(counted_broadcast(candidates.select("key"), n_candidates), "key", "left_semi")
    distinct = near.groupBy("key").agg(F.first("text").alias("text")).select("key", words_of(F.col("text")).alias("words"))
    verdicts = materialize(verdicts_of(distinct, candidates, window), "verdicts", small=True)
    weight = verdicts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json("found"))), F.lit(0)).alias("b")).first()
    discard(items, places, matches, anchors, candidates)

    small = verdicts.select(F.col("key").alias("_d_key"), F.col("found").alias("_d_found"))
    may, not_ = parted_by_keys(keyed, "_d_key", verdicts, "key", weight["n"])
    out = may.join(counted_broadcast(small, weight["n"], weight["b"]), "_d_key", "left")
    if not_ is not None:
        out = out.unionByName(not_.withColumn("_d_found", F.lit(None).cast(out.schema["_d_found"].dataType)))
    return concluded(out.withColumn("_d_found", F.coalesce("_d_found", none)), own, text_col, name)


def concluded(rows: DataFrame, own: list[str], text_col: str, name: str) -> DataFrame:
    """The columns ``own`` and the struct ``name`` of rows with ``_d_found``; words are counted once."""
    counted = rows.withColumn("_d_n", F.explode(F.array(count_words(F.col(text_col)))))
    hit = F.col("_d_found.n_hit")
    overlap = F.struct(
        F.col("_d_n").alias("n_words"), hit.alias("n_hit"), F.size("_d_found.item_ids").cast("bigint").alias("n_items"), F.col("_d_found.item_ids").alias("item_ids"),
        F.col("_d_found.spans").alias("spans"), ((hit > 0) & (20 * hit >= F.col("_d_n"))).alias("contaminated"),
    )
    return counted.select(*[F.col(f"`{c}`") for c in own], overlap.alias(name))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col, "overlap.n_words", "overlap.n_hit", "overlap.n_items",
        F.sha2(F.array_join("overlap.item_ids", ","), 256).alias("items_sha256"),
        "overlap.contaminated",
    )
