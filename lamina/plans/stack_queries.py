"""Queries over whole stacks. Greedy and iterative steps have no SQL; tests hold them against plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import stacks
from lamina.plans.registry import query
from lamina.sources.adapters import colours, maps, table


@query("whole_frame_selection")
def whole_frame_selection(spark, sf):
    return stacks.whole_frame_selection(maps(spark, sf))


@query("library_coverage")
def library_coverage(spark, sf):
    return stacks.library_selection(maps(spark, sf))


@query("focus_clusters")
def focus_clusters(spark, sf):
    return stacks.focus_clusters(maps(spark, sf))


@query("dedup_keep_best")
def dedup_keep_best(spark, sf):
    """The representative of each cluster, in the order of frames, and why it stays."""
    kept = stacks.focus_clusters(maps(spark, sf)).groupBy("g", "cluster").agg(F.max(F.when(F.col("representative"), F.col("f"))).alias("f"), F.count("*").alias("n"))
    reason = F.when(F.col("n") == 1, "only frame of its cluster").otherwise(F.concat(F.lit("best of "), F.col("n").cast("string"), F.lit(" alike")))
    return kept.select("g", "f", "cluster", reason.alias("reason"))


@query("alignment_order")
def alignment_order(spark, sf):
    return stacks.alignment_order(maps(spark, sf))


@query("anchor_split")
def anchor_split(spark, sf):
    return stacks.anchor_split(maps(spark, sf))


@query("fuse_quality")
def fuse_quality(spark, sf):
    return stacks.fuse(maps(spark, sf), "quality")


@query("fuse_model")
def fuse_model(spark, sf):
    return stacks.fuse(maps(spark, sf), "ai")


@query("registration")
def registration(spark, sf):
    return stacks.registration(maps(spark, sf))


@query("frame_features")
def frame_features(spark, sf):
    return stacks.frame_features(maps(spark, sf))


@query("residual_diagnostics")
def residual_diagnostics(spark, sf):
    return stacks.residual_diagnostics(stacks.frame_features(maps(spark, sf)))


@query("fuse_narrow")
def fuse_narrow(spark, sf):
    return stacks.fuse(maps(spark, sf), "narrow")


@query("settled_owner")
def settled_owner(spark, sf):
    """Owner maps with regions of up to eight positions given to the label around them."""
    return stacks.owner_labels(maps(spark, sf)).select("g", F.posexplode("labels").alias("p", "owner"))


@query("scored_frames")
def scored_frames(spark, sf):
    """Quality with the stability that the registration shows."""
    return stacks.scored(maps(spark, sf)).select("g", "f", F.round("stability", 9).alias("stability"), F.round("quality", 9).alias("quality"))


@query("background_owner")
def background_owner(spark, sf):
    return stacks.background_owner(maps(spark, sf))


@query("edge_guard")
def edge_guard(spark, sf):
    return stacks.edge_guarded(maps(spark, sf))


@query("gain_overlap")
def gain_overlap(spark, sf):
    return stacks.gain_overlap(maps(spark, sf))


@query("contour_energy")
def contour_energy(spark, sf):
    return stacks.contours(maps(spark, sf)).select("g", "f", "p", F.round("energy", 9).alias("energy"))


@query("centreline_check")
def centreline_check(spark, sf):
    return stacks.centrelines(maps(spark, sf))


@query("tone_harmonised")
def tone_harmonised(spark, sf):
    return stacks.toned(colours(spark, sf)).select("g", "f", F.posexplode(F.arrays_zip("r", "gr", "b")).alias("p", "c")).select("g", "f", "p", "c.r", "c.gr", "c.b")


BITS_SQL = "list_sum([CASE WHEN embedding[k + 1] > 0 THEN 1::UBIGINT << k ELSE 0::UBIGINT END FOR k IN range(0, 64)])::UBIGINT"


@query("descriptor_matches", f"""WITH d AS (SELECT label AS g, vec_id AS i, {BITS_SQL} AS bits FROM embeddings),
    m AS (SELECT a.g, a.i, b.i AS j, bit_count(xor(a.bits, b.bits))::INT AS d FROM d a JOIN d b ON a.g = b.g AND a.i <> b.i), r AS (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY d, j) AS k FROM m)
    SELECT a.g, a.i, a.j, a.d AS distance, b.d AS second, a.d < 0.75 * b.d AS good FROM r a JOIN r b ON a.g = b.g AND a.i = b.i AND a.k = 1 AND b.k = 2""")
def descriptor_matches(spark, sf):
    """The two nearest descriptors by Hamming distance in the group, over all 64 bits, and the ratio test at 0.75.

    ``align.consensus`` fits what matches.
    """
    bits = F.expr("coalesce(aggregate(transform(slice(embedding, 1, 64), (v, k) -> if(v > 0, shiftleft(1L, k), 0L)), 0L, (a, b) -> a | b), 0L)")
    d = table(spark, sf, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("i"), bits.alias("bits"))
    return stacks.two_nearest(d).withColumn("good", F.col("distance") < 0.75 * F.col("second"))
