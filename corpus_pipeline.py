"""Corpus pipeline: toxicity, quality rules, SimHash near-duplicates, decontamination, packing.

Every stage takes all documents that its predecessor kept, whatever their columns; ``doc_id`` and ``text``
are the ones it reads. Columns whose names begin with ``_p_`` or ``_d_`` are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontaminate, packing, quality_rules, similar, tokens, toxicity
from lamina.llm.common import counted_broadcast, discard, materialize, prepare, table


def columns_of(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among ``docs``, doesn't reject.

    Null, empty and wordless texts hold no term and stay; very long texts are searched whole; repeated rows get
    equal scores; without labels a fixed list stands in; an empty table gives no rows; a column named ``toxicity`` stays.
    """
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), name="_p_toxicity")
    return scored.filter("_p_toxicity.predicted = 0").select(*columns_of(docs))


def of_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule.

    Null and empty texts are too short and go; very long texts are measured whole; repeated rows get equal
    verdicts; an empty table gives no rows; a column named ``quality`` stays.
    """
    prepare(spark)
    return quality_rules.apply_rules(docs, name="_p_quality").filter("_p_quality.kept").select(*columns_of(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id (null last), then the least text key, of each group of near-duplicates.

    Near-duplicates share 0.8 or more of their five-word shingles, directly or over others. Null, empty and
    wordless texts are one group, so one of them stays; very long texts count with all their shingles. Where an
    id names several rows, only the row with that key stays, and of rows with one id and one text the least
    whole row. An empty table gives no rows.

    The rows that go are named by (id, key) and taken away, so that texts that stay travel only if more go
    than may be broadcast.
    """
    groups = similar.near_duplicates(docs)
    chosen = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("c"))
    counted = groups.groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    marked = counted.join(chosen, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("key") == F.col("c.key")))
    marked = materialize(marked.filter(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias("_p_id"), F.col("key").alias("_p_key"), "stays"), "marked", small=True)
    n = {r["stays"]: r["count"] for r in marked.groupBy("stays").count().collect()}
    keyed = docs.withColumn("_p_own_key", similar.key_of(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_p_id")) & (F.col("_p_own_key") == F.col("_p_key"))
    any_ = counted_broadcast(marked.select("_p_id", "_p_key"), sum(n.values()))
    alone = keyed.join(any_, same, "left_anti").select(*columns_of(docs))
    discard(groups)
    if not n.get(True):
        return alone
    several = counted_broadcast(marked.filter("stays").select("_p_id", "_p_key"), n[True])
    rows = keyed.join(several, same, "left_semi").groupBy("doc_id", "_p_own_key").agg(F.min(F.struct(*columns_of(docs))).alias("_p_row"))
    return alone.unionByName(rows.select("_p_row.*"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in windows of benchmark items.

    Null, empty and wordless texts have no hits and stay; very long texts are compared whole; repeated rows get
    equal verdicts; an empty benchmark keeps all, an empty table gives no rows; a column named ``overlap`` stays.
    """
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), name="_p_overlap")
    return found.filter("not _p_overlap.contaminated").select(*columns_of(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens: see ``packing.packed``, which names the cases.

    Workers give their cache of words back after each task: other stages run in the same workers.
    """
    return packing.packed(docs, tokens.vocabulary("byte_bpe_50k.json"), keep=False)


STAGES = [
    ("toxicity", without_toxic),
    ("quality_rules", of_good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Stages 1, 3 and 5 (a learned model, XXH64 shingles, a tokenizer) can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
