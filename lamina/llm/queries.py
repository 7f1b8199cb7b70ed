"""Registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontaminate, langid, licenses, packing, quality_rules, sharding, simhash, sstable, tokens, toxicity, warc
from lamina.llm.common import held_out, prepare, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "toxicity.score", "toxicity.predicted")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "best_license", F.round("best_dice", 9).alias("best_dice"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write(table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))
    return sstable.read(manifest).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "position")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(warc.decide(table(spark, sf_dir, "pages")))).drop("path", "frame")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = langid.identify(docs, langid.fit(docs))
    return named.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"quality.{n}") for n in names])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: ASCII white space and A-Z, as DuckDB's patterns write them.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LICENSE_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '')"
_STOPS = ", ".join(f"'{w}'" for w in quality_rules.listed_stop_words())
_ITEM_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def _template_rows() -> str:
    listed = [(lic, text) for lic, texts in licenses.TEMPLATES.items() for text in texts]
    return ", ".join("('{}', {}, '{}')".format(lic, n, text.replace("'", "''")) for n, (lic, text) in enumerate(listed))


def oracle_sql() -> dict[str, str]:
    return {
        # Every run of words from a template's bigram to another, in reach of the threshold.
        "op3_licenses": rf"""
            WITH t0(license, template, text) AS (VALUES {_template_rows()}),
            tw AS (SELECT license, template, {_LICENSE_WORDS} AS w FROM t0),
            tg AS (SELECT license, template, gram, count(*) AS c FROM (SELECT license, template, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS i FROM tw)) GROUP BY ALL),
            tn AS (SELECT template, sum(c) AS n FROM tg GROUP BY template),
            d AS (SELECT row_number() OVER () AS r, doc_id, {_LICENSE_WORDS} AS w FROM documents),
            dg AS (SELECT r, i - 1 AS p, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT r, w, unnest(generate_series(1, len(w) - 1)) AS i FROM d)),
            m AS (SELECT r, license, template, n, p, gram, c, row_number() OVER (PARTITION BY r, template, gram ORDER BY p) AS k FROM dg JOIN tg USING (gram) JOIN tn USING (template)),
            able AS (SELECT r, template FROM (SELECT r, template, n, least(count(*), any_value(c)) AS u FROM m GROUP BY r, template, n, gram) GROUP BY r, template, n HAVING sum(u) >= n * 0.8 / 1.2 - 1e-9),
            q AS (SELECT m.*, coalesce(lag.p, -1) AS prev FROM m JOIN able USING (r, template) LEFT JOIN m lag ON lag.r = m.r AND lag.template = m.template AND lag.gram = m.gram AND lag.k = m.k - m.c),
            w AS (SELECT a.r, a.license, a.p AS first, b.p - a.p + 2 AS words, 2 * row_number() OVER (PARTITION BY a.r, a.template, a.p ORDER BY b.p) / (b.p - a.p + 1 + a.n) AS dice
                  FROM q a JOIN q b ON a.r = b.r AND a.template = b.template AND b.p >= a.p AND b.p - a.p < 1.5 * a.n AND b.prev < a.p),
            best AS (SELECT * FROM w WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY r, license ORDER BY dice DESC, first, words) = 1),
            kept AS (SELECT * FROM best x WHERE NOT EXISTS (SELECT 1 FROM best y WHERE y.r = x.r AND y.license <> x.license AND y.first < x.first + x.words AND x.first < y.first + y.words
                                                                                AND (y.dice > x.dice OR (y.dice = x.dice AND y.license < x.license)))),
            k AS (SELECT r, string_agg(license, ',' ORDER BY license) AS licenses, first(license ORDER BY dice DESC, license) AS best_license, max(dice) AS best_dice FROM kept GROUP BY r)
            SELECT doc_id, coalesce(licenses, '') AS licenses, best_license, round(best_dice, 9) AS best_dice FROM d LEFT JOIN k USING (r)""",
        "op10_quality_rules": rf"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
                              list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM documents),
            n AS (SELECT *, row_number() OVER () AS r, len(w) AS n_words FROM d),
            g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(generate_series(1, n_words - 2)) AS i FROM n)),
            t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
            c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM t, (VALUES (0), (1), (2)) AS x(k) GROUP BY r),
            m AS (SELECT doc_id, n_words::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
                         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop,
                         length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_upper, length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS n_letters,
                         length(regexp_replace(text, '[\P{{L}}{quality_rules.ALPHABET}]+', '', 'g')) AS n_foreign
                  FROM n LEFT JOIN c USING (r)),
            b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                         coalesce(word_chars / nullif(n_words, 0), 0) AS mean_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols,
                         coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup, coalesce(n_stop / nullif(n_words, 0), 0) AS stop,
                         coalesce(n_upper / nullif(n_letters, 0), 0) AS upper FROM m)
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
                   NOT base_failed AND symbols <= 0.25 AND mean_chars BETWEEN 1.5 AND 20 AND upper <= 0.6 AND (stop >= 0.01 OR {quality_rules.FOREIGN_LETTERS} * n_foreign > n_letters) AND dup <= 0.6 AS kept
            FROM b""",
        "op4_decontamination": rf"""
            WITH i AS (SELECT item_id::VARCHAR AS item_id, {_ITEM_WORDS} AS w FROM benchmark),
            iw AS (SELECT item_id, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g, least(13, len(w)) AS k
                   FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
            d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
            dw AS (SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS g
                   FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
            hit AS (SELECT DISTINCT r, s, dw.k, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
            pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + k - 1)) AS p FROM hit) GROUP BY r),
            ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
                   sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
            FROM d LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)""",
        "op7_warc": """
            WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
            f AS (SELECT h, min(page_id) AS first_id FROM p WHERE n >= 100 AND page_id IS NOT NULL GROUP BY h),
            r AS (SELECT p.*, first_id, row_number() OVER (PARTITION BY page_id, p.h ORDER BY url) AS k FROM p LEFT JOIN f ON p.h = f.h AND n >= 100)
            SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
                   CASE WHEN first_id IS NOT NULL AND page_id IS NOT NULL AND (page_id <> first_id OR k > 1) THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN first_id IS NOT NULL AND page_id IS NOT NULL AND (page_id <> first_id OR k > 1) THEN first_id END AS refers_to
            FROM r""",
    }
