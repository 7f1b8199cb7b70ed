"""Queries over dense maps, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import maps
from lamina.plans.registry import query
from lamina.sources.adapters import PX_SQL, frame_valid, pixels, table

VALID = "(f * 7 + p) % 11 <> 0"


def unit(spark, sf):
    """Maps with values 0..1."""
    return pixels(spark, sf).select("g", "f", "p", (F.col("q") / 65535).alias("v"))


UNIT_SQL = f"SELECT g, f, p, q / 65535 AS v FROM ({PX_SQL})"


@query("owner_map", f"WITH px AS ({PX_SQL}) SELECT g, p, max(q) AS best, arg_max(f, (q, -f)) AS owner FROM px GROUP BY g, p")
def owner_map(spark, sf):
    return maps.owner(pixels(spark, sf), ["g", "p"], "f", "q")


@query("running_owner", f"""WITH px AS ({PX_SQL}) SELECT g, f, p, max(CASE WHEN {VALID} THEN q END) OVER w AS best, arg_max(CASE WHEN {VALID} THEN f END, CASE WHEN {VALID} THEN (q, -f) END) OVER w AS owner FROM px WINDOW w AS (PARTITION BY g, p ORDER BY f ROWS UNBOUNDED PRECEDING)""")
def running_owner(spark, sf):
    return maps.running_owner(pixels(spark, sf), ["g", "p"], "f", "q", frame_valid()).select("g", "f", "p", "best", "owner")


@query("top_k_weights", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY g, p ORDER BY q DESC, f) AS rank FROM ({PX_SQL})) SELECT g, p, f, rank, round(q / sum(q) OVER (PARTITION BY g, p), 9) AS weight FROM r WHERE rank <= 4""")
def top_k_weights(spark, sf):
    return maps.top_k(pixels(spark, sf), ["g", "p"], "f", "q", 4).select("g", "p", "f", F.col("rank").cast("bigint").alias("rank"), F.round("weight", 9).alias("weight"))


@query("softmax_frames", f"""WITH e AS (SELECT g, f, p, CASE WHEN {VALID} THEN exp((q - max(CASE WHEN {VALID} THEN q END) OVER (PARTITION BY g, p)) / 5000.0) ELSE 0 END AS e FROM ({PX_SQL})) SELECT g, f, p, round(e / sum(e) OVER (PARTITION BY g, p), 8) AS weight FROM e""")
def softmax_frames(spark, sf):
    return maps.softmax(pixels(spark, sf), ["g", "p"], "q", 5000.0, frame_valid()).select("g", "f", "p", F.round("weight", 8).alias("weight"))


@query("valid_renormalise", f"""WITH m AS (SELECT g, f, p, {VALID} AS ok, CASE WHEN {VALID} THEN q::DOUBLE ELSE 0 END AS m FROM ({PX_SQL}))
    SELECT g, f, p, round(CASE WHEN sum(m) OVER w > 0 THEN m / sum(m) OVER w WHEN count_if(ok) OVER w > 0 THEN ok::INT / count_if(ok) OVER w ELSE 0 END, 9) AS weight FROM m WINDOW w AS (PARTITION BY g, p)""")
def valid_renormalise(spark, sf):
    px = pixels(spark, sf).withColumn("weight", F.col("q").cast("double"))
    return maps.renormalise(px, ["g", "p"], "weight", frame_valid()).select("g", "f", "p", F.round("weight", 9).alias("weight"))


@query("label_frequencies", f"WITH o AS (SELECT g, p, arg_max(f, (q, -f)) AS owner FROM ({PX_SQL}) GROUP BY g, p) SELECT g, owner, count(*) AS n FROM o GROUP BY g, owner")
def label_frequencies(spark, sf):
    return owner_map(spark, sf).groupBy("g", "owner").agg(F.count("*").alias("n"))


@query("evidence_union", f"SELECT g, p, bool_or(q > 20000 AND {VALID}) AS any_evidence, count_if(q > 20000) AS n FROM ({PX_SQL}) GROUP BY g, p")
def evidence_union(spark, sf):
    strong = F.col("q") > 20000
    return pixels(spark, sf).groupBy("g", "p").agg(F.bool_or(strong & frame_valid()).alias("any_evidence"), F.count_if(strong).alias("n"))


@query("coverage_fraction", f"SELECT g, f, coalesce(count_if(v >= 0.2 AND p % 4 <> 0) / nullif(count_if(p % 4 <> 0), 0), 0) AS coverage FROM ({UNIT_SQL}) GROUP BY g, f")
def coverage_fraction(spark, sf):
    support = F.col("p") % 4 != 0
    return unit(spark, sf).groupBy("g", "f").agg(F.coalesce(F.try_divide(F.count_if((F.col("v") >= 0.2) & support), F.count_if(support)), F.lit(0.0)).alias("coverage"))


#: Coverage targets of the modes and their aliases.
MODES = {
    "sparse": 0.98, "compact": 0.98, "minimal": 0.98, "精简": 0.98, "balanced": 0.995, "balance": 0.995, "平衡": 0.995, "extreme": 0.9995, "maximum": 0.9995, "极致": 0.9995,
}


@query("coverage_mode_target", """SELECT event_id, least(1.0, greatest(0.0, coalesce(CASE WHEN event_id % 5 = 0 THEN value / 100 END, CASE event_type WHEN 'click' THEN 0.98 WHEN 'purchase' THEN 0.9995 WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 0.98 WHEN 1 THEN 0.9995 ELSE 0.995 END ELSE 0.995 END))) AS target FROM events""")
def coverage_mode_target(spark, sf):
    third = F.col("event_id") % 3
    named = F.when(third == 0, "精简").when(third == 1, " 极致 ").otherwise("平衡")
    mode = F.trim(F.when(F.col("event_type") == "click", "Compact").when(F.col("event_type") == "purchase", "EXTREME").when(F.col("event_type") == "signup", named).otherwise(F.col("event_type")))
    table_ = F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv])
    named = F.coalesce(F.try_element_at(table_, F.lower(mode)), F.lit(0.995))
    explicit = F.when(F.col("event_id") % 5 == 0, F.col("value") / 100)
    return table(spark, sf, "events").select("event_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(explicit, named))).alias("target"))


@query("map_summary", f"SELECT g, f, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, avg(CASE WHEN v > 0.35 THEN 1.0 ELSE 0.0 END) AS focused, round(least(1, greatest(0, 0.65 * avg(v) + 0.35 * quantile_cont(v, 0.9))), 9) AS quality FROM ({UNIT_SQL}) GROUP BY g, f")
def map_summary(spark, sf):
    s = maps.summary(F.col("v"))
    return unit(spark, sf).groupBy("g", "f").agg(*[(c if k == "focused" else F.round(c, 9)).alias(k) for k, c in s.items()])


#: Maps of which some are flat but for a few positions, and some throughout.
SPARSE_SQL = f"SELECT g, f, p, CASE WHEN f % 5 = 0 THEN CASE WHEN p = 7 THEN 0.75 ELSE 0.25 END WHEN f % 5 = 1 THEN 0.5 ELSE v END AS v FROM ({UNIT_SQL})"


@query("percentile_normalise", f"""WITH u AS ({SPARSE_SQL}), s AS (SELECT g, f, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi, min(v) AS least, max(v) AS most FROM u GROUP BY g, f)
    SELECT g, f, p, round(CASE WHEN hi > lo THEN least(1, greatest(0, (v - lo) / (hi - lo))) WHEN most > least THEN least(1, greatest(0, (v - least) / (most - least))) ELSE 0 END, 9) AS v FROM u JOIN s USING (g, f)""")
def percentile_normalise(spark, sf):
    """By percentiles; a map that they find flat by its range, a flat one as zeros. The 2nd and 98th, which one position of 64 doesn't move."""
    v = F.when(F.col("f") % 5 == 0, F.when(F.col("p") == 7, 0.75).otherwise(0.25)).when(F.col("f") % 5 == 1, 0.5).otherwise(F.col("v"))
    px = unit(spark, sf).withColumn("v", v)
    s = px.groupBy("g", "f").agg(F.percentile("v", F.array(F.lit(0.02), F.lit(0.98))).alias("b"), F.min("v").alias("least"), F.max("v").alias("most"))
    scaled = lambda lo, hi: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("v") - lo) / (hi - lo)))
    lo, hi = F.get("b", 0), F.get("b", 1)
    out = F.when(hi > lo, scaled(lo, hi)).when(F.col("most") > F.col("least"), scaled(F.col("least"), F.col("most"))).otherwise(0.0)
    return px.join(s, ["g", "f"]).select("g", "f", "p", F.round(out, 9).alias("v"))


@query("quantise", f"SELECT g, f, p, round_even(v * 65535, 0)::INT AS code, round_even(v * 65535, 0) / 65535 AS back FROM ({UNIT_SQL})")
def quantise(spark, sf):
    code = F.bround(F.col("v") * 65535).cast("int")
    return unit(spark, sf).select("g", "f", "p", code.alias("code"), (code / 65535).alias("back"))


@query("histogram", f"SELECT g, f, least(31, floor(v * 32))::INT AS bin, count(*) / 64.0 AS share FROM ({UNIT_SQL}) GROUP BY ALL")
def histogram(spark, sf):
    """Equal bins over 0..1, the last one closed; shares of all positions."""
    b = F.least(F.lit(31), F.floor(F.col("v") * 32)).cast("int")
    return unit(spark, sf).groupBy("g", "f", b.alias("bin")).agg((F.count("*") / 64.0).alias("share"))


CONSECUTIVE = "SELECT g, f AS i, lead(f) OVER (PARTITION BY g ORDER BY f) AS j FROM (SELECT DISTINCT label AS g, vec_id AS f FROM embeddings) QUALIFY j IS NOT NULL"
SIMILAR_SQL = f"""px AS ({UNIT_SQL}), t AS (SELECT g, f, CASE WHEN quantile_cont(v, 0.7) > min(v) + 1e-7 THEN quantile_cont(v, 0.7) WHEN avg(v) + 0.25 * stddev_pop(v) > min(v) + 1e-7 THEN avg(v) + 0.25 * stddev_pop(v) END AS t FROM px GROUP BY g, f),
    m AS (SELECT g, f, p, v, coalesce(v > t, false) AS s FROM px JOIN t USING (g, f)), pairs AS ({CONSECUTIVE}),
    sim AS (SELECT x.g, i, j, coalesce(corr(a.v, b.v), 1) AS c, avg(abs(a.v - b.v)) AS difference, CASE WHEN count_if(a.s OR b.s) = 0 THEN 1 ELSE count_if(a.s AND b.s) / count_if(a.s OR b.s) END AS overlap
        FROM pairs x JOIN m a ON a.g = x.g AND a.f = x.i JOIN m b ON b.g = x.g AND b.f = x.j AND b.p = a.p GROUP BY x.g, i, j),
    similar_maps AS (SELECT g, i, j, least(1, greatest(0, 0.45 * (c + 1) / 2 + 0.30 * (1 - difference) + 0.25 * overlap)) AS similarity, difference, overlap FROM sim)"""


def consecutive(spark, sf):
    w = Window.partitionBy("g").orderBy("i")
    e = table(spark, sf, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("i")).distinct()
    return e.withColumn("j", F.lead("i").over(w)).filter("j is not null")


def similar(spark, sf):
    return maps.pair_similarity(consecutive(spark, sf), unit(spark, sf), "g", "f", "p", "v")


@query("map_similarity", f"WITH {SIMILAR_SQL} SELECT g, i, j, round(similarity, 8) AS similarity, round(difference, 8) AS difference, round(overlap, 8) AS overlap FROM similar_maps")
def map_similarity(spark, sf):
    return similar(spark, sf).select("g", "i", "j", *[F.round(c, 8).alias(c) for c in ("similarity", "difference", "overlap")])


FLAT_SQL = f"d AS (SELECT g, f, stddev_pop(v) AS sd FROM ({UNIT_SQL}) GROUP BY g, f)"


@query("map_distance", f"""WITH {SIMILAR_SQL}, {FLAT_SQL} SELECT m.g, i, j, round(least(1, greatest(0, 0.6 * (1 - similarity) + 0.4 * least(1, difference))), 8) AS distance,
    similarity >= 0.7 AND difference <= 0.16 AND (a.sd + b.sd < 0.17 OR overlap >= 0.1) AS same_focus, a.sd + b.sd < 0.17 AS flat FROM similar_maps m JOIN d a ON a.g = m.g AND a.f = i JOIN d b ON b.g = m.g AND b.f = j""")
def map_distance(spark, sf):
    """Duplicate distance and the same-focus test, with thresholds scaled to these maps: of two flat maps the overlap says nothing."""
    d = 0.6 * (1 - F.col("similarity")) + 0.4 * F.least(F.lit(1.0), F.col("difference"))
    sd = unit(spark, sf).groupBy("g", "f").agg(F.stddev_pop("v").alias("sd"))
    side = lambda c: sd.select("g", F.col("f").alias(c), F.col("sd").alias(f"sd_{c}"))
    flat = F.col("sd_i") + F.col("sd_j") < 0.17
    same = (F.col("similarity") >= 0.7) & (F.col("difference") <= 0.16) & (flat | (F.col("overlap") >= 0.1))
    m = similar(spark, sf).join(side("i"), ["g", "i"]).join(side("j"), ["g", "j"])
    return m.select("g", "i", "j", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), d)), 8).alias("distance"), same.alias("same_focus"), flat.alias("flat"))


@query("exposure_shift_similarity", f"WITH {SIMILAR_SQL} SELECT g, i, j, round(0.65 * (c + 1) / 2 + 0.35 * (1 - difference), 8) AS similarity FROM sim")
def exposure_shift_similarity(spark, sf):
    px = unit(spark, sf)
    a, b = px.select("g", F.col("f").alias("i"), "p", F.col("v").alias("a")), px.select("g", F.col("f").alias("j"), "p", F.col("v").alias("b"))
    m = consecutive(spark, sf).join(a, ["g", "i"]).join(b, ["g", "j", "p"]).groupBy("g", "i", "j").agg(F.coalesce(F.corr("a", "b"), F.lit(1.0)).alias("c"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("d"))
    return m.select("g", "i", "j", F.round(0.65 * (F.col("c") + 1) / 2 + 0.35 * (1 - F.col("d")), 8).alias("similarity"))


@query("scene_similarity", f"""WITH px AS ({UNIT_SQL}), pairs AS ({CONSECUTIVE}), low AS (SELECT x.g, i, j, least(1, greatest(0, 0.7 * (coalesce(corr(a.v, b.v), 1) + 1) / 2 + 0.3 * (1 - avg(abs(a.v - b.v))))) AS low FROM pairs x JOIN px a ON a.g = x.g AND a.f = x.i JOIN px b ON b.g = x.g AND b.f = x.j AND b.p = a.p GROUP BY x.g, i, j),
    h AS (SELECT g, f, least(31, floor(v * 32))::INT AS bin, count(*) / 64.0 AS share FROM px GROUP BY ALL), hist AS (SELECT x.g, i, j, coalesce(sum(least(a.share, coalesce(b.share, 0))), 0) AS hist FROM pairs x LEFT JOIN h a ON a.g = x.g AND a.f = x.i LEFT JOIN h b ON b.g = x.g AND b.f = x.j AND b.bin = a.bin GROUP BY x.g, i, j),
    e AS (SELECT label AS g, vec_id AS f, i - 1 AS p, embedding[i] > 0 AS bit FROM embeddings, generate_series(1, 64) AS s(i)), hash AS (SELECT x.g, i, j, count_if(a.bit = b.bit) / 64.0 AS hash FROM pairs x JOIN e a ON a.g = x.g AND a.f = x.i JOIN e b ON b.g = x.g AND b.f = x.j AND b.p = a.p GROUP BY x.g, i, j),
    n AS (SELECT x.g, i, j, (i * 7 + j) % 41 AS matches, (i * 7 + j) % 41 - (i + j) % 3 AS inliers FROM pairs x), geo AS (SELECT g, i, j, CASE WHEN matches < 8 THEN 0 ELSE least(1, greatest(0, 0.55 * inliers / matches + 0.45 * least(1, inliers / 30.0))) END AS geometry FROM n)
    SELECT g, i, j, round(low, 8) AS low, round(hist, 9) AS hist, hash, round(geometry, 9) AS geometry, round(0.5 * low + 0.15 * hist + 0.10 * hash + 0.25 * geometry, 8) AS evidence FROM low JOIN hist USING (g, i, j) JOIN hash USING (g, i, j) JOIN geo USING (g, i, j)""")
def scene_similarity(spark, sf):
    """All four evidences of consecutive previews: low frequencies, histogram intersection, hash agreement, geometry.

    The counts of matches and inliers, which ``align`` finds in real images, are a fixture here.
    """
    pairs, px = consecutive(spark, sf), unit(spark, sf)
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    side = lambda df, key, name: df.withColumnsRenamed({"f": key, "v": f"v_{name}"})
    m = pairs.join(side(px, "i", "a"), ["g", "i"]).join(side(px, "j", "b"), ["g", "j", "p"]).groupBy("g", "i", "j")
    low = m.agg(F.coalesce(F.corr("v_a", "v_b"), F.lit(1.0)).alias("c"), F.avg(F.abs(F.col("v_a") - F.col("v_b"))).alias("d")).select("g", "i", "j", clip(0.7 * (F.col("c") + 1) / 2 + 0.3 * (1 - F.col("d"))).alias("low"))
    e = table(spark, sf, "embeddings")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    values = F.transform("embedding", lambda v: F.bround(F.abs(v.cast("double")) * 65535) / 65535)
    bins = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.size(F.filter("v", lambda v: F.least(F.lit(31), F.floor(v * 32)) == b)) / 64.0)
    shares = e.select(F.col("label").alias("g"), F.col("vec_id").alias("f"), values.alias("v"), F.transform("embedding", lambda v: v > 0).alias("bits")).select("g", "f", bins.alias("share"), "bits")
    both = pairs.join(shares.withColumnsRenamed({"f": "i", "share": "sa", "bits": "ba"}), ["g", "i"]).join(shares.withColumnsRenamed({"f": "j", "share": "sb", "bits": "bb"}), ["g", "j"])
    hist = total(F.zip_with("sa", "sb", lambda a, b: F.least(a, b)))
    hash_ = total(F.zip_with("ba", "bb", lambda a, b: (a == b).cast("double"))) / 64.0
    matches = (F.col("i") * 7 + F.col("j")) % 41
    inliers = matches - (F.col("i") + F.col("j")) % 3
    geometry = F.when(matches < 8, 0.0).otherwise(clip(0.55 * inliers / F.greatest(matches, F.lit(1)) + 0.45 * F.least(F.lit(1.0), inliers / 30.0)))
    out = both.select("g", "i", "j", hist.alias("hist"), hash_.alias("hash"), geometry.alias("geometry")).join(low, ["g", "i", "j"])
    evidence = 0.5 * F.col("low") + 0.15 * F.col("hist") + 0.10 * F.col("hash") + 0.25 * F.col("geometry")
    return out.select("g", "i", "j", F.round("low", 8).alias("low"), F.round("hist", 9).alias("hist"), "hash", F.round("geometry", 9).alias("geometry"), F.round(evidence, 8).alias("evidence"))


@query("quality_score", f"""WITH s AS (SELECT g, f, var_pop(v) AS var, median(v) AS med, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi, avg(CASE WHEN v <= 0.01 OR v >= 0.99 THEN 1.0 ELSE 0.0 END) AS clipped, stddev_pop(v) AS sd FROM ({UNIT_SQL}) GROUP BY g, f)
    SELECT g, f, round(0.45 * least(1, greatest(0, ln(1 + var * 1200) / ln(1201))) + 0.20 * 0.75 + 0.15 * least(1, greatest(0, 0.65 * least(1, greatest(0, 1 - abs(med - 0.5) * 1.35)) + 0.35 * least(1, greatest(0, (hi - lo) / 0.7)))) + 0.10 * (1 - least(1, clipped / 0.01)) + 0.10 * (1 - least(1, greatest(0, (sd - 0.008) / 0.08))), 8) AS score FROM s""")
def quality_score(spark, sf):
    """Per-frame quality from population variance, percentiles and clipping; without registration the stability is neutral."""
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    v = F.col("v")
    s = unit(spark, sf).groupBy("g", "f").agg(F.var_pop(v).alias("var"), F.percentile(v, F.array(F.lit(0.02), F.lit(0.5), F.lit(0.98))).alias("q"), F.avg(F.when((v <= 0.01) | (v >= 0.99), 1.0).otherwise(0.0)).alias("clipped"), F.stddev_pop(v).alias("sd"))
    sharp = clip(F.log1p(F.col("var") * 1200) / F.log1p(F.lit(1200.0)))
    exposure = clip(0.65 * clip(1 - F.abs(F.get("q", 1) - 0.5) * 1.35) + 0.35 * clip((F.get("q", 2) - F.get("q", 0)) / 0.7))
    score = 0.45 * sharp + 0.20 * 0.75 + 0.15 * exposure + 0.10 * (1 - F.least(F.lit(1.0), F.col("clipped") / 0.01)) + 0.10 * (1 - clip((F.col("sd") - 0.008) / 0.08))
    return s.select("g", "f", F.round(score, 8).alias("score"))


@query("reference_argmax", f"WITH m AS (SELECT g, f, avg(q) AS m FROM ({PX_SQL}) GROUP BY g, f) SELECT g, arg_max(f, (m, -f)) AS reference FROM m GROUP BY g")
def reference_argmax(spark, sf):
    m = pixels(spark, sf).groupBy("g", "f").agg(F.avg("q").alias("m"))
    return m.groupBy("g").agg((-F.max(F.struct("m", (-F.col("f")).alias("f")))["f"]).alias("reference"))


@query("graph_medoid", f"""WITH {SIMILAR_SQL}, e AS (SELECT g, i AS x, similarity AS c, overlap AS o, difference AS d, similarity >= 0.5 AS ok FROM similar_maps UNION ALL SELECT g, j, similarity, overlap, difference, similarity >= 0.5 FROM similar_maps),
    s AS (SELECT g, x, round(0.40 * avg(ok::INT) + 0.30 * avg(c) + 0.20 * avg(o) + 0.10 / (1 + coalesce(avg(CASE WHEN ok THEN d END), 0)), 9) AS score FROM e GROUP BY g, x) SELECT g, arg_max(x, (score, -x)) AS reference, max(score) AS score FROM s GROUP BY g""")
def graph_medoid(spark, sf):
    """The frame best connected by valid, confident, low-residual edges."""
    s = similar(spark, sf)
    e = s.select("g", F.explode(F.array("i", "j")).alias("x"), "similarity", "overlap", "difference", (F.col("similarity") >= 0.5).alias("ok"))
    score = 0.40 * F.avg(F.col("ok").cast("int")) + 0.30 * F.avg("similarity") + 0.20 * F.avg("overlap") + 0.10 / (1 + F.coalesce(F.avg(F.when(F.col("ok"), F.col("difference"))), F.lit(0.0)))
    n = e.groupBy("g", "x").agg(F.round(score, 9).alias("score"))
    return n.groupBy("g").agg(F.max(F.struct("score", (-F.col("x")).alias("x"))).alias("m")).select("g", (-F.col("m.x")).alias("reference"), F.col("m.score").alias("score"))


@query("weighted_blend", f"SELECT g, p, least(255, greatest(0, round_even(sum(w * v) / greatest(sum(w), 1e-6), 0)))::INT AS blended FROM (SELECT g, p, (q // 256)::DOUBLE AS v, ((f % 5) + 1)::DOUBLE AS w FROM ({PX_SQL})) GROUP BY g, p")
def weighted_blend(spark, sf):
    px = pixels(spark, sf).select("g", "p", F.floor(F.col("q") / 256).cast("double").alias("v"), (F.col("f") % 5 + 1).cast("double").alias("w"))
    return maps.blend(px, ["g", "p"], "v", "w")


@query("skip_weak_frames", f"SELECT g, f, max(q) AS strongest FROM ({PX_SQL}) GROUP BY g, f HAVING max(q) >= 25000")
def skip_weak_frames(spark, sf):
    return pixels(spark, sf).groupBy("g", "f").agg(F.max("q").alias("strongest")).filter("strongest >= 25000")


@query("exposure_gain", f"""WITH a AS (SELECT g, f, p, q FROM ({PX_SQL})), r AS (SELECT g, p, q AS ref FROM a QUALIFY f = min(f) OVER (PARTITION BY g)), x AS (SELECT a.g, a.f, ref / q AS ratio, abs(ref - q) AS grad FROM a JOIN r USING (g, p) WHERE q > 0 AND q < 65000 AND ref < 65000),
    t AS (SELECT g, f, quantile_cont(grad, 0.35) AS t FROM x GROUP BY g, f) SELECT g, f, round(least(1.1, greatest(0.9, median(ratio))), 9) AS gain FROM x JOIN t USING (g, f) WHERE grad <= t GROUP BY g, f""")
def exposure_gain(spark, sf):
    """Median ratio to the reference over unsaturated positions of least gradient, clamped."""
    px = pixels(spark, sf)
    first = px.groupBy("g").agg(F.min("f").alias("f"))
    ref = px.join(first, ["g", "f"], "left_semi").select("g", "p", F.col("q").alias("ref"))
    x = px.join(ref, ["g", "p"]).filter("q > 0 and q < 65000 and ref < 65000").select("g", "f", (F.col("ref") / F.col("q")).alias("ratio"), F.abs(F.col("ref") - F.col("q")).alias("grad"))
    t = x.groupBy("g", "f").agg(F.percentile("grad", 0.35).alias("t"))
    return x.join(t, ["g", "f"]).filter("grad <= t").groupBy("g", "f").agg(F.round(F.least(F.lit(1.1), F.greatest(F.lit(0.9), F.percentile("ratio", 0.5))), 9).alias("gain"))


NOISE_SQL = """WITH s AS (SELECT floor(l_extendedprice / 5000)::INT AS bin, l_quantity AS v, l_discount AS spread FROM lineitem), l AS (SELECT bin, count(*) AS n, quantile_cont(spread, 0.35) AS t FROM s GROUP BY bin),
    f AS (SELECT s.* FROM s JOIN l USING (bin) WHERE n >= 64 AND spread <= t), m AS (SELECT bin, median(v) AS med FROM f GROUP BY bin HAVING count(*) >= 32), o AS (SELECT bin, greatest(1e-6, med + 6 * 1.4826 * median(abs(v - med))) AS own FROM f JOIN m USING (bin) GROUP BY bin, med),
    b AS (SELECT l.bin, o.own, (SELECT max(own) FROM o n WHERE n.bin IN (l.bin - 1, l.bin + 1)) AS near FROM l LEFT JOIN o USING (bin)) SELECT bin, round(coalesce(own, near), 6) AS ceiling, own IS NULL AS borrowed FROM b"""


@query("noise_ceiling", NOISE_SQL)
def noise_ceiling(spark, sf):
    s = table(spark, sf, "lineitem").select(F.floor(F.col("l_extendedprice") / 5000).cast("int").alias("bin"), F.col("l_quantity").alias("v"), F.col("l_discount").alias("spread"))
    return maps.noise_ceiling(s, "bin", "v", "spread").select("bin", F.round("ceiling", 6).alias("ceiling"), "borrowed")


@query("local_detail_evidence", """WITH t AS (SELECT quantile_cont(l_discount, 0.35) AS t FROM lineitem), f AS (SELECT l_linenumber AS bin, l_quantity AS v FROM lineitem, t WHERE l_discount <= t), m AS (SELECT bin, median(v) AS med FROM f GROUP BY bin HAVING count(*) >= 32),
    c AS (SELECT bin, med + 0.1 * 1.4826 * median(abs(v - med)) AS ceiling FROM f JOIN m USING (bin) GROUP BY bin, med) SELECT l_linenumber AS bin, count_if(ceiling IS NULL OR l_quantity > 1.5 * ceiling) AS n FROM lineitem LEFT JOIN c ON bin = l_linenumber GROUP BY l_linenumber""")
def local_detail_evidence(spark, sf):
    """Flat support chosen over all rows, ceilings by bin; a bin without ceiling is all evidence."""
    items = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("bin"), F.col("l_quantity").alias("v"), F.col("l_discount").alias("spread"))
    limit = maps.quantiles(items, [], "spread", 0.35, "t")
    flat = items.join(F.broadcast(limit), F.col("spread") <= F.col("t")).select("bin", "v")  # one row
    c = maps.flat_noise(flat, "bin", "v", 32).select("bin", (F.col("median") + 0.1 * 1.4826 * F.col("mad")).alias("ceiling"))
    return items.join(c, "bin", "left").groupBy("bin").agg(F.count_if(F.col("ceiling").isNull() | (F.col("v") > 1.5 * F.col("ceiling"))).alias("n"))


@query("drifting_vote", f"WITH s AS (SELECT g, p % 4 AS material, p, (max(q) - min(q)) / 700 AS span FROM ({PX_SQL}) GROUP BY g, p) SELECT g, material, count_if(span > 3 AND span <= 40) AS votes FROM s GROUP BY g, material HAVING count_if(span > 3 AND span <= 40) >= greatest(4, round_even(0.01 * count(*), 0))")
def drifting_vote(spark, sf):
    s = pixels(spark, sf).groupBy("g", "p").agg(((F.max("q") - F.min("q")) / 700).alias("span")).withColumn("material", F.col("p") % 4)
    vote = (F.col("span") > 3) & (F.col("span") <= 40)
    v = s.groupBy("g", "material").agg(F.count_if(vote).alias("votes"), F.count("*").alias("n"))
    return v.filter(F.col("votes") >= F.greatest(F.lit(4), F.bround(0.01 * F.col("n")))).select("g", "material", "votes")


@query("surface_tone_monitor", f"SELECT g, count_if(abs(q - m) > 3000) / count(*) AS drifting, count_if(abs(q - m) > 3000) >= 0.05 * count(*) AS multiband FROM (SELECT g, q, avg(q) OVER (PARTITION BY g, p) AS m FROM ({PX_SQL})) GROUP BY g")
def surface_tone_monitor(spark, sf):
    px = pixels(spark, sf)
    mean = px.groupBy("g", "p").agg(F.avg("q").alias("m"))
    far = F.abs(F.col("q") - F.col("m")) > 3000
    return px.join(mean, ["g", "p"]).groupBy("g").agg((F.count_if(far) / F.count("*")).alias("drifting"), (F.count_if(far) >= 0.05 * F.count("*")).alias("multiband"))


RGB_SQL = "SELECT vec_id AS f, i - 1 AS p, floor(abs(embedding[i]::DOUBLE) * 600)::INT % 256 AS r, floor(abs(embedding[i % 64 + 1]::DOUBLE) * 600)::INT % 256 AS gr, floor(abs(embedding[(i + 1) % 64 + 1]::DOUBLE) * 600)::INT % 256 AS b FROM embeddings, generate_series(1, 64) AS s(i)"


def rgb(spark, sf):
    """Colour triples from neighbouring responses."""
    byte = lambda k: (F.floor(F.abs(F.get("embedding", (F.col("p") + k) % 64).cast("double")) * 600).cast("int") % 256)
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("f"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    return e.select("f", "p", byte(0).alias("r"), byte(1).alias("gr"), byte(2).alias("b"))


@query("material_probe", f"SELECT p, p % 4 AS material, min(r) AS r_lo, max(r) AS r_hi, min(gr) AS g_lo, max(gr) AS g_hi, min(b) AS b_lo, max(b) AS b_hi, count(*) % 65536 AS n FROM ({RGB_SQL}) WHERE {VALID} GROUP BY p")
def material_probe(spark, sf):
    """Least and greatest colour of each position over the frames that cover it, and their count, which wraps at 16 bits."""
    ends = [f(c).alias(f"{name}_{end}") for c, name in (("r", "r"), ("gr", "g"), ("b", "b")) for f, end in ((F.min, "lo"), (F.max, "hi"))]
    return rgb(spark, sf).filter(frame_valid()).groupBy("p").agg(*ends, (F.count("*") % 65536).alias("n")).withColumn("material", F.col("p") % 4)


@query("chroma", f"SELECT f, p, greatest(r, gr, b) - least(r, gr, b) AS chroma, round(0.299 * r + 0.587 * gr + 0.114 * b, 6) AS luma FROM ({RGB_SQL})")
def chroma(spark, sf):
    return rgb(spark, sf).select("f", "p", (F.greatest("r", "gr", "b") - F.least("r", "gr", "b")).alias("chroma"), F.round(0.299 * F.col("r") + 0.587 * F.col("gr") + 0.114 * F.col("b"), 6).alias("luma"))


GRAY_SQL = f"SELECT f, p, CASE f % 4 WHEN 0 THEN r::DOUBLE WHEN 1 THEN r / 255.0 WHEN 2 THEN CASE WHEN p % 5 = 0 THEN 'NaN'::DOUBLE ELSE r / 255.0 END ELSE r * 257.0 END AS r, CASE f % 4 WHEN 0 THEN gr::DOUBLE WHEN 3 THEN gr * 257.0 ELSE gr / 255.0 END AS gr, CASE f % 4 WHEN 0 THEN b::DOUBLE WHEN 3 THEN b * 257.0 ELSE b / 255.0 END AS b FROM ({RGB_SQL})"


@query("gray_conversion", f"""WITH c AS ({GRAY_SQL}), n AS (SELECT f, p, CASE WHEN isnan(r) THEN 0 ELSE r END AS r, gr, b FROM c), m AS (SELECT f, max(greatest(r, gr, b)) AS top FROM n GROUP BY f)
    SELECT f, p, round((0.299 * r + 0.587 * gr + 0.114 * b) / CASE WHEN top > 255 THEN 65535.0 WHEN top > 1 THEN 255.0 ELSE 1.0 END, 9)::DOUBLE AS gray FROM n JOIN m USING (f)""")
def gray_conversion(spark, sf):
    """Luma 0..1 of frames of 8 or 16 bits or of fractions, told by their greatest value; what is no number counts as 0."""
    kind, p = F.col("f") % 4, F.col("p")
    scaled = lambda c: F.when(kind == 0, F.col(c).cast("double")).when(kind == 3, F.col(c) * 257.0).otherwise(F.col(c) / 255.0)
    c = rgb(spark, sf).select("f", "p", F.when((kind == 2) & (p % 5 == 0), F.lit(float("nan"))).otherwise(scaled("r")).alias("r"), scaled("gr").alias("gr"), scaled("b").alias("b"))
    n = c.select("f", "p", *[F.nanvl(k, F.lit(0.0)).alias(k) for k in ("r", "gr", "b")])
    top = n.groupBy("f").agg(F.max(F.greatest("r", "gr", "b")).alias("top"))
    divisor = F.when(F.col("top") > 255, 65535.0).when(F.col("top") > 1, 255.0).otherwise(1.0)
    return n.join(top, "f").select("f", "p", F.round((0.299 * F.col("r") + 0.587 * F.col("gr") + 0.114 * F.col("b")) / divisor, 9).alias("gray"))


@query("material_class", f"SELECT f, p, CASE WHEN r >= 50 THEN 1 + ((gr % 180 + 15) // 30) % 6 + 6 * (b < 64)::INT ELSE 13 + (b >= 64)::INT + (b >= 160)::INT END AS material FROM ({RGB_SQL})")
def material_class(spark, sf):
    """Hue sector and darkness for saturated colours, else one of three grays; saturation, hue and value stand in for r, g and b."""
    hue = F.floor((F.col("gr") % 180 + 15) / 30).cast("int") % 6
    return rgb(spark, sf).select("f", "p", F.when(F.col("r") >= 50, 1 + hue + 6 * (F.col("b") < 64).cast("int")).otherwise(13 + (F.col("b") >= 64).cast("int") + (F.col("b") >= 160).cast("int")).alias("material"))


@query("apply_tone", f"SELECT f, count_if(new <> r) AS changed, sum(new)::BIGINT AS total FROM (SELECT f, r, CASE WHEN {VALID} THEN round_even(least(255, greatest(0, r + (p - 32) * 0.5)), 0)::INT ELSE r END AS new FROM ({RGB_SQL})) GROUP BY f")
def apply_tone(spark, sf):
    new = F.when(frame_valid(), F.bround(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("r") + (F.col("p") - 32) * 0.5))).cast("int")).otherwise(F.col("r"))
    return rgb(spark, sf).withColumn("new", new).groupBy("f").agg(F.count_if(F.col("new") != F.col("r")).alias("changed"), F.sum("new").alias("total"))


@query("tone_alpha", f"SELECT f, p, round(least(1, greatest(0, (m - 1) / 3)) * least(1, greatest(0, (40 - m) / 20)) * least(1, greatest(0, d / 0.2)), 9) AS alpha FROM (SELECT f, p, r / 5.0 AS m, b / 255.0 AS d FROM ({RGB_SQL}))")
def tone_alpha(spark, sf):
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    m, d = F.col("r") / 5.0, F.col("b") / 255.0
    return rgb(spark, sf).select("f", "p", F.round(clip((m - 1) / 3) * clip((40 - m) / 20) * clip(d / 0.2), 9).alias("alpha"))


@query("normalised_field", f"SELECT f, p, round(CASE WHEN {VALID} THEN r ELSE 0 END / greatest(b, 1e-6), 9) AS field FROM ({RGB_SQL})")
def normalised_field(spark, sf):
    return rgb(spark, sf).select("f", "p", F.round(F.when(frame_valid(), F.col("r")).otherwise(0) / F.greatest(F.col("b").cast("double"), F.lit(1e-6)), 9).alias("field"))


SOBEL_X = {(-1, -1): -1.0, (1, -1): 1.0, (-1, 0): -2.0, (1, 0): 2.0, (-1, 1): -1.0, (1, 1): 1.0}
SOBEL_Y = {(y, x): w for (x, y), w in SOBEL_X.items()}
LAPLACE = {(0, 0): -4.0, (1, 0): 1.0, (-1, 0): 1.0, (0, 1): 1.0, (0, -1): 1.0}
BOX = {o: 1 / 9 for o in maps.window(1)}
#: Each position's 3 x 3 taps, reflected at the border.
TAPS_SQL = """SELECT t.g, t.f, t.p, dx, dy, s.v FROM (SELECT g, f, p, dx, dy, CASE WHEN x < 0 THEN -x WHEN x > 7 THEN 14 - x ELSE x END AS x, CASE WHEN y < 0 THEN -y WHEN y > 7 THEN 14 - y ELSE y END AS y
    FROM (SELECT g, f, p, dx, dy, p % 8 + dx AS x, p // 8 + dy AS y FROM {px}, generate_series(-1, 1) AS a(dx), generate_series(-1, 1) AS b(dy))) t JOIN {px} s ON s.g = t.g AND s.f = t.f AND s.p = x + 8 * y"""
GRADIENT_SQL = f"""px AS ({UNIT_SQL}), taps AS ({TAPS_SQL.format(px='px')}), gr AS (SELECT g, f, p, sum(v * dx * (2 - abs(dy))) AS gx, sum(v * dy * (2 - abs(dx))) AS gy, sum(v * (CASE WHEN dx = 0 AND dy = 0 THEN -4 WHEN dx = 0 OR dy = 0 THEN 1 ELSE 0 END)) AS lap, avg(v) AS mean, avg(v * v) AS square FROM taps GROUP BY g, f, p)"""


def gradients(spark, sf):
    """(g, f, x, y, gx, gy, lap, mean, square) of maps with values 0..1."""
    px = unit(spark, sf).select("g", "f", "v", (F.col("v") * F.col("v")).alias("vv"), (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"))
    return maps.stencils(px, ["g", "f"], "x", "y", 8, {"gx": ("v", SOBEL_X), "gy": ("v", SOBEL_Y), "lap": ("v", LAPLACE), "mean": ("v", BOX), "square": ("vv", BOX)})


@query("stencil_fields", f"WITH {GRADIENT_SQL} SELECT g, f, p, round(sqrt(gx * gx + gy * gy), 7) AS gradient, round(lap, 7) AS laplacian, round(greatest(0, square - mean * mean), 7) AS variance FROM gr")
def stencil_fields(spark, sf):
    """Sobel gradient, Laplacian and 3 x 3 variance in one shuffle."""
    p = (F.col("x") + 8 * F.col("y")).alias("p")
    variance = F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))
    return gradients(spark, sf).select("g", "f", p, F.round(F.hypot("gx", "gy"), 7).alias("gradient"), F.round("lap", 7).alias("laplacian"), F.round(variance, 7).alias("variance"))


@query("focus_fields", f"""WITH {GRADIENT_SQL}, w AS (SELECT g, f, p, gx * gx AS xx, gy * gy AS yy, gx * gy AS xy, sqrt(gx * gx + gy * gy) AS grad, greatest(0, square - mean * mean) AS variance, abs(lap) AS detail FROM gr), t3 AS (SELECT g, f, p, xx AS v FROM w), t4 AS (SELECT g, f, p, yy AS v FROM w), t5 AS (SELECT g, f, p, xy AS v FROM w),
    sx AS (SELECT g, f, p, avg(v) AS xx FROM ({TAPS_SQL.format(px='t3')}) GROUP BY g, f, p), sy AS (SELECT g, f, p, avg(v) AS yy FROM ({TAPS_SQL.format(px='t4')}) GROUP BY g, f, p), sc AS (SELECT g, f, p, avg(v) AS xy FROM ({TAPS_SQL.format(px='t5')}) GROUP BY g, f, p),
    z AS (SELECT g, f, p, sx.xx + sy.yy AS trace, sqrt(greatest(0, (sx.xx - sy.yy) * (sx.xx - sy.yy) + 4 * sc.xy * sc.xy)) AS spread, grad, variance, detail FROM w JOIN sx USING (g, f, p) JOIN sy USING (g, f, p) JOIN sc USING (g, f, p))
    SELECT g, f, p, round(0.65 * grad + 0.35 * trace + 0.10 * variance, 6) AS base, round(CASE WHEN grad > 1e-4 AND detail > 0.05 THEN grad * sqrt(detail) ELSE 0 END, 6) AS sharp, round((trace - spread) / 2 - 0.12 * trace, 7) > 0 AND detail > 0.05 AND trace > 2e-5 AS texture FROM z""")
def focus_fields(spark, sf):
    """Base energy, sharp detail and the texture test from a smoothed structure tensor: real gradients, then their products over 3 x 3."""
    w = gradients(spark, sf).select("g", "f", "x", "y", (F.col("gx") * F.col("gx")).alias("xx"), (F.col("gy") * F.col("gy")).alias("yy"), (F.col("gx") * F.col("gy")).alias("xy"), F.hypot("gx", "gy").alias("grad"), F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean")).alias("variance"), F.abs("lap").alias("detail"))
    own = {(0, 0): 1.0}
    z = maps.stencils(w, ["g", "f"], "x", "y", 8, {"sxx": ("xx", BOX), "syy": ("yy", BOX), "sxy": ("xy", BOX), "sg": ("grad", own), "sv": ("variance", own), "sd": ("detail", own)})
    trace = F.col("sxx") + F.col("syy")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.expr("(sxx - syy) * (sxx - syy) + 4 * sxy * sxy")))
    texture = (F.round((trace - spread) / 2 - 0.12 * trace, 7) > 0) & (F.col("sd") > 0.05) & (trace > 2e-5)
    sharp = F.when((F.col("sg") > 1e-4) & (F.col("sd") > 0.05), F.col("sg") * F.sqrt("sd")).otherwise(0.0)
    return z.select("g", "f", (F.col("x") + 8 * F.col("y")).alias("p"), F.round(0.65 * F.col("sg") + 0.35 * trace + 0.10 * F.col("sv"), 6).alias("base"), F.round(sharp, 6).alias("sharp"), texture.alias("texture"))


@query("independent_detail", f"SELECT f, count_if(r > 20 AND (r > 2 * gr OR r > 16 * b)) AS n FROM ({RGB_SQL}) GROUP BY f")
def independent_detail(spark, sf):
    return rgb(spark, sf).groupBy("f").agg(F.count_if((F.col("r") > 20) & ((F.col("r") > 2 * F.col("gr")) | (F.col("r") > 16 * F.col("b")))).alias("n"))


@query("preserve_detail", f"SELECT f, p, CASE WHEN r < 0.7 * max(r) OVER (PARTITION BY p) THEN arg_max(f, (r, -f)) OVER (PARTITION BY p) ELSE f END AS owner FROM ({RGB_SQL})")
def preserve_detail(spark, sf):
    """A propagated owner gives way where its detail is under 0.7 of the local best."""
    x = rgb(spark, sf).select("f", "p", "r")
    best = maps.owner(x, ["p"], "f", "r").withColumnRenamed("owner", "best_owner")
    return x.join(best, "p").select("f", "p", F.when(F.col("r") < 0.7 * F.col("best"), F.col("best_owner")).otherwise(F.col("f")).alias("owner"))


@query("hard_mask", f"WITH o AS (SELECT g, p, arg_max(f, (q, -f)) AS owner FROM ({PX_SQL}) GROUP BY g, p) SELECT x.g, x.f, x.p, CASE WHEN o.owner = x.f THEN 255 ELSE 0 END AS mask FROM ({PX_SQL}) x JOIN o USING (g, p)")
def hard_mask(spark, sf):
    px = pixels(spark, sf)
    return px.join(maps.owner(px, ["g", "p"], "f", "q"), ["g", "p"]).select("g", "f", "p", F.when(F.col("owner") == F.col("f"), 255).otherwise(0).alias("mask"))


@query("neutral_filter", f"""WITH c AS (SELECT *, greatest(r, gr, b) - least(r, gr, b) AS chroma FROM ({RGB_SQL})), l AS (SELECT p, max(r) AS top, arg_max(f, (r, -f)) AS label FROM c GROUP BY p),
    u AS (SELECT c.p, arg_max(f, (r, -f)) AS owner, max(r) AS best FROM c JOIN l USING (p) WHERE chroma < 65 AND (f + c.p) % 7 <> 0 AND gr > 20 AND r >= 0.7 * top GROUP BY c.p)
    SELECT l.p, CASE WHEN best > 1e-6 AND l.p % 5 <> 0 THEN owner ELSE label END AS owner, coalesce(best > 1e-6 AND l.p % 5 <> 0, false) AS guarded, coalesce(best > 1e-6 AND l.p % 5 <> 0 AND owner <> label, false) AS changed FROM l LEFT JOIN u USING (p)""")
def neutral_filter(spark, sf):
    """Neutral positions go to the strongest neutral detail near the local best: filter, update, apply; protected positions stay.

    The red channel is the detail; foreground, material and protection are masks by place.
    """
    c = rgb(spark, sf).withColumn("chroma", F.greatest("r", "gr", "b") - F.least("r", "gr", "b"))
    labels = maps.owner(c, ["p"], "f", "r").withColumnsRenamed({"best": "top", "owner": "label"})
    able = c.join(labels, "p").filter((F.col("chroma") < 65) & ((F.col("f") + F.col("p")) % 7 != 0) & (F.col("gr") > 20) & (F.col("r") >= 0.7 * F.col("top")))
    update = maps.owner(able, ["p"], "f", "r")
    use = F.coalesce((F.col("best") > 1e-6) & (F.col("p") % 5 != 0), F.lit(False))
    out = labels.join(update, "p", "left")
    return out.select("p", F.when(use, F.col("owner")).otherwise(F.col("label")).alias("owner"), use.alias("guarded"), F.coalesce(use & (F.col("owner") != F.col("label")), F.lit(False)).alias("changed"))


@query("blend_tile", f"""WITH px AS ({PX_SQL}), ref AS (SELECT g, p, arg_min(f, f) AS reference, arg_min(q, f) AS r FROM px GROUP BY g, p), o AS (SELECT g, p, arg_max(f, (q, -f)) AS owner, max(q) AS best FROM px GROUP BY g, p),
    c AS (SELECT g, p, CASE WHEN r >= 0.9 * best THEN reference ELSE owner END AS owner, r >= 0.9 * best AS kept, r, CASE WHEN r >= 0.9 * best THEN r ELSE best END AS source, least(least(p % 8, 7 - p % 8), least(p // 8, 7 - p // 8)) / 3.0 AS d FROM ref JOIN o USING (g, p))
    SELECT g, p, owner, kept, round_even(least(255, greatest(0, (r // 256) * (1 - a) + (source // 256) * a)), 0)::INT AS blended FROM (SELECT *, least(d, 1) * least(d, 1) * (3 - 2 * least(d, 1)) AS a FROM c)""")
def blend_tile(spark, sf):
    """Inside a tile the best frame, but the reference where it has 0.9 of the best; faded in from the tile's edge by a smooth step."""
    px = pixels(spark, sf)
    ref = px.groupBy("g", "p").agg(F.min("f").alias("reference"), F.min_by("q", "f").alias("r"))
    o = maps.owner(px, ["g", "p"], "f", "q")
    x, y = F.col("p") % 8, F.floor(F.col("p") / 8)
    t = F.least(F.least(x, 7 - x, y, 7 - y) / 3.0, F.lit(1.0))
    kept = F.col("r") >= 0.9 * F.col("best")
    byte = lambda c: F.floor(c / 256)
    a = t * t * (3 - 2 * t)
    source = F.when(kept, F.col("r")).otherwise(F.col("best"))
    value = F.bround(F.least(F.lit(255.0), F.greatest(F.lit(0.0), byte(F.col("r")) * (1 - a) + byte(source) * a))).cast("int")
    return ref.join(o, ["g", "p"]).select("g", "p", F.when(kept, F.col("reference")).otherwise(F.col("owner")).alias("owner"), kept.alias("kept"), value.alias("blended"))


@query("masked_neighbour_owner", f"WITH o AS (SELECT g, p, arg_max(f, (q, -f)) AS owner FROM ({PX_SQL}) GROUP BY g, p), n AS (SELECT a.g, a.p, b.owner, count(*) AS c FROM o a JOIN o b ON a.g = b.g AND a.p <> b.p AND abs(a.p % 8 - b.p % 8) <= 1 AND abs(a.p // 8 - b.p // 8) <= 1 GROUP BY ALL) SELECT g, p, arg_max(owner, (c, -owner)) AS dominant FROM n GROUP BY g, p")
def masked_neighbour_owner(spark, sf):
    """Most frequent owner among the eight neighbours, the lowest of equals: owners are sent to their neighbours, not joined by distance."""
    o = owner_map(spark, sf)
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    x, y = F.col("p") % 8 + F.col("s.dx"), F.floor(F.col("p") / 8) + F.col("s.dy")
    sent = o.select("g", "p", "owner", F.explode(steps).alias("s")).filter(x.between(0, 7) & y.between(0, 7)).select("g", (x + 8 * y).cast("int").alias("p"), "owner")
    c = sent.groupBy("g", "p", "owner").agg(F.count("*").alias("c"))
    return c.groupBy("g", "p").agg((-F.max(F.struct("c", (-F.col("owner")).alias("o")))["o"]).alias("dominant"))


@query("box_stencil", f"WITH px AS ({PX_SQL}), k AS (SELECT dx, dy FROM generate_series(-1, 1) AS a(dx), generate_series(-1, 1) AS b(dy)), t AS (SELECT g, f, p, CASE WHEN x < 0 THEN -x WHEN x > 7 THEN 14 - x ELSE x END AS x, CASE WHEN y < 0 THEN -y WHEN y > 7 THEN 14 - y ELSE y END AS y FROM (SELECT g, f, p, p % 8 + dx AS x, p // 8 + dy AS y FROM px, k)) SELECT t.g, t.f, t.p, round(sum(q) / 9.0, 6) AS mean FROM t JOIN px s ON s.g = t.g AND s.f = t.f AND s.p = x + 8 * y GROUP BY t.g, t.f, t.p")
def box_stencil(spark, sf):
    px = pixels(spark, sf).select("g", "f", "q", (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"))
    out = maps.stencil(px, ["g", "f"], "q", "x", "y", 8, {(dx, dy): 1 / 9 for dx in (-1, 0, 1) for dy in (-1, 0, 1)})
    return out.select("g", "f", (F.col("x") + 8 * F.col("y")).alias("p"), F.round("response", 6).alias("mean"))


@query("median_label_filter", f"""WITH i AS (SELECT label AS g, vec_id AS f, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings), o AS (SELECT x.g, x.p, k AS label FROM (SELECT g, p, arg_max(f, (q, -f)) AS owner FROM ({PX_SQL}) GROUP BY g, p) x JOIN i ON i.g = x.g AND i.f = x.owner),
    c AS (SELECT i.g, p, 0.299 * r + 0.587 * gr + 0.114 * b AS gray, greatest(r, gr, b) - least(r, gr, b) AS chroma FROM ({RGB_SQL}) x JOIN i ON i.f = x.f AND k = 0),
    t AS (SELECT o.g, o.p, least(7, greatest(0, p % 8 + dx)) + 8 * least(7, greatest(0, p // 8 + dy)) AS s FROM o, generate_series(-7, 7) AS a(dx), generate_series(-7, 7) AS b(dy)), m AS (SELECT t.g, t.p, quantile_disc(o.label, 0.5) AS middle FROM t JOIN o ON o.g = t.g AND o.p = t.s GROUP BY t.g, t.p),
    w AS (SELECT g, max(label) AS most FROM o GROUP BY g)
    SELECT o.g, o.p, CASE WHEN most <= 255 AND gray < 235 AND chroma < 65 THEN middle ELSE label END AS label FROM o JOIN m USING (g, p) JOIN c USING (g, p) JOIN w USING (g)""")
def median_label_filter(spark, sf):
    """Median label of the 15 x 15 surroundings, the edge carried on, where the reference is neither bright nor coloured.

    Labels are numbers of frames in their group; a group with a label over 255 is left as it is. A group's label map is
    one row of 64, searched in place.
    """
    e = table(spark, sf, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("f"))
    index = e.withColumn("k", (F.row_number().over(Window.partitionBy("g").orderBy("f")) - 1).cast("int"))
    o = owner_map(spark, sf).join(index, (F.col("owner") == index.f), "inner").select(index.g, "p", F.col("k").alias("label"))
    whole = o.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "label"))), lambda x: x["label"]).alias("m"))
    near = lambda c: F.sequence(c - 7, c + 7)
    clamp = lambda c: F.least(F.lit(7), F.greatest(F.lit(0), c))
    x, y = F.col("p") % 8, F.floor(F.col("p") / 8).cast("int")
    taps = F.flatten(F.transform(near(y), lambda j: F.transform(near(x), lambda i: F.get("m", clamp(i) + 8 * clamp(j)))))
    middle = F.get(F.sort_array(taps), 112)
    first = index.filter("k = 0").select("g", "f")
    gate = rgb(spark, sf).join(first, "f").select("g", "p", ((0.299 * F.col("r") + 0.587 * F.col("gr") + 0.114 * F.col("b") < 235) & (F.greatest("r", "gr", "b") - F.least("r", "gr", "b") < 65)).alias("open"))
    rows = whole.select("g", "m", F.posexplode("m").alias("p", "label")).join(gate, ["g", "p"])
    return rows.select("g", "p", F.when(F.col("open") & (F.array_max("m") <= 255), middle).otherwise(F.col("label")).alias("label"))


@query("tile_windows", "WITH s(size, tile, overlap) AS (VALUES (1000, 256, 64), (700, 512, 128), (200, 256, 64)), w AS (SELECT *, greatest(64, tile - overlap) AS stride FROM s), b AS (SELECT *, unnest(generate_series(0, greatest(0, size - tile + stride - 1) // stride)) AS k FROM w) SELECT DISTINCT size, tile, greatest(0, least(k * stride, size - tile))::BIGINT AS start, least(size, greatest(0, least(k * stride, size - tile)) + tile)::BIGINT AS stop FROM b")
def tile_windows(spark, sf):
    """Overlapping tiles; the last is flush with the edge."""
    s = spark.createDataFrame([(1000, 256, 64), (700, 512, 128), (200, 256, 64)], "size bigint, tile bigint, overlap bigint").withColumn("stride", F.greatest(F.lit(64), F.expr("tile - overlap")))
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("greatest(0, size - tile + stride - 1) div stride")))
    start = F.greatest(F.lit(0), F.least(F.expr("k * stride"), F.expr("size - tile")))
    return s.withColumn("k", k).select("size", "tile", start.cast("bigint").alias("start"), F.least(F.col("size"), start + F.col("tile")).cast("bigint").alias("stop")).distinct()


@query("edge_cost", f"WITH r AS (SELECT f, p, (r - 128) / 10.0 AS tx, (gr - 128) / 10.0 AS ty, 0.9 + b / 1000.0 AS scale, (r - gr) / 20.0 AS rot, b / 255.0 AS conf FROM ({RGB_SQL})), o AS (SELECT *, greatest(0, least(1, (1 - least(1, abs(tx) / 120)) * (1 - least(1, abs(ty) / 160)))) AS overlap FROM r) SELECT f, p, round(overlap, 12) AS overlap, round(sqrt(tx / 160 * (tx / 160) + ty / 120 * (ty / 120)) + abs(ln(greatest(1e-6, scale))) + abs(rot) / 45, 12) AS magnitude, round(conf * (0.6 + 0.4 * overlap), 12) AS confidence FROM o")
def edge_cost(spark, sf):
    """Cost terms of a registration: overlap, size of the movement, damped confidence."""
    m = rgb(spark, sf).select("f", "p", ((F.col("r") - 128) / 10.0).alias("tx"), ((F.col("gr") - 128) / 10.0).alias("ty"), (0.9 + F.col("b") / 1000.0).alias("scale"), ((F.col("r") - F.col("gr")) / 20.0).alias("rot"), (F.col("b") / 255.0).alias("conf"))
    part = lambda c, size: 1 - F.least(F.lit(1.0), F.abs(F.col(c)) / size)
    overlap = F.greatest(F.lit(0.0), F.least(F.lit(1.0), part("tx", 120) * part("ty", 160)))
    magnitude = F.hypot(F.col("tx") / 160, F.col("ty") / 120) + F.abs(F.log(F.greatest(F.lit(1e-6), F.col("scale")))) + F.abs("rot") / 45
    return m.select("f", "p", F.round(overlap, 12).alias("overlap"), F.round(magnitude, 12).alias("magnitude"), F.round(F.col("conf") * (0.6 + 0.4 * overlap), 12).alias("confidence"))


@query("footprint_validity", f"SELECT f, count_if(x * 1.02 + 0.5 BETWEEN 0 AND 7 AND y * 0.98 - 0.2 BETWEEN 0 AND 7) AS n_valid FROM (SELECT f, p % 8 AS x, p // 8 AS y FROM ({PX_SQL})) GROUP BY f")
def footprint_validity(spark, sf):
    """Positions whose inverse-mapped place lies in the source."""
    x, y = F.col("p") % 8, F.floor(F.col("p") / 8)
    inside = (x * 1.02 + 0.5).between(0, 7) & (y * 0.98 - 0.2).between(0, 7)
    return pixels(spark, sf).groupBy("f").agg(F.count_if(inside).alias("n_valid"))


@query("refiner_gate", f"WITH {SIMILAR_SQL}, a AS (SELECT g, i, j, c >= 0.0 AND difference <= 0.2 AS ok FROM sim) SELECT g, i, j, CASE WHEN bool_and(ok) OVER (PARTITION BY g) THEN 'refined' ELSE 'identity' END AS transform FROM a")
def refiner_gate(spark, sf):
    """One refused frame sends the whole stack back to identity."""
    px = unit(spark, sf)
    a, b = px.select("g", F.col("f").alias("i"), "p", F.col("v").alias("a")), px.select("g", F.col("f").alias("j"), "p", F.col("v").alias("b"))
    m = consecutive(spark, sf).join(a, ["g", "i"]).join(b, ["g", "j", "p"]).groupBy("g", "i", "j").agg(((F.coalesce(F.corr("a", "b"), F.lit(1.0)) >= 0.0) & (F.avg(F.abs(F.col("a") - F.col("b"))) <= 0.2)).alias("ok"))
    every = m.groupBy("g").agg(F.bool_and("ok").alias("every"))
    return m.join(every, "g").select("g", "i", "j", F.when(F.col("every"), "refined").otherwise("identity").alias("transform"))


@query("alignment_validation", """WITH a AS (SELECT conv_id AS g, count(*) AS n, count(*) - (conv_id % 11 = 0)::INT AS inputs, count(DISTINCT CASE WHEN conv_id % 7 = 0 THEN turn % 2 ELSE 0 END) AS sizes, max(length(text)) / 100.0 AS residual, min(length(text)) > 5 AS subject, sum(length(text)) / 900.0 AS ratio FROM conversations GROUP BY conv_id)
    SELECT g, CASE WHEN n <> inputs THEN 'count' WHEN residual > 4 THEN 'silhouette' WHEN NOT subject THEN 'subject' WHEN sizes > 1 THEN 'size' WHEN ratio < 0.35 OR ratio > 1.75 THEN 'crop' WHEN ratio < 0.65 THEN 'warning' ELSE 'ok' END AS state FROM a""")
def alignment_validation(spark, sf):
    """Gates of an aligned stack in order: count, silhouette, subject, size, crop ratio; a small ratio is a warning.

    Measures of the frames are stand-ins; the silhouette's and the subject's are ``silhouette_residual`` and ``scenes``.
    """
    c, even = table(spark, sf, "conversations"), F.when(F.col("conv_id") % 7 == 0, F.col("turn") % 2).otherwise(0)
    a = c.groupBy(F.col("conv_id").alias("g")).agg(
        F.count("*").alias("n"), F.count_distinct(even).alias("sizes"), (F.max(F.length("text")) / 100.0).alias("residual"), (F.min(F.length("text")) > 5).alias("subject"), (F.sum(F.length("text")) / 900.0).alias("ratio"),
    )
    inputs, r = F.col("n") - (F.col("g") % 11 == 0).cast("int"), F.col("ratio")
    state = F.when(F.col("n") != inputs, "count").when(F.col("residual") > 4, "silhouette").when(~F.col("subject"), "subject").when(F.col("sizes") > 1, "size")
    return a.select("g", state.when((r < 0.35) | (r > 1.75), "crop").when(r < 0.65, "warning").otherwise("ok").alias("state"))


@query("texture_rois", f"WITH t AS (SELECT g, f, p // 8 AS patch, stddev_pop(q) AS texture FROM ({PX_SQL}) GROUP BY ALL) SELECT f, patch, round(texture, 6) AS texture FROM t WHERE texture > 1 QUALIFY row_number() OVER (PARTITION BY f ORDER BY round(texture, 6) DESC, patch) <= 6")
def texture_rois(spark, sf):
    """The six most textured patches of each frame."""
    t = pixels(spark, sf).groupBy("f", F.floor(F.col("p") / 8).cast("int").alias("patch")).agg(F.stddev_pop("q").alias("texture")).filter("texture > 1").withColumn("texture", F.round("texture", 6))
    w = Window.partitionBy("f").orderBy(F.desc("texture"), "patch")
    return t.withColumn("k", F.row_number().over(w)).filter("k <= 6").select("f", "patch", "texture")


RADIUS = 8


@query("nearest_edge", f"""WITH px AS (SELECT g, f, p, p % 8 AS x, p // 8 AS y, q FROM ({PX_SQL})), e AS (SELECT * FROM px WHERE q > 15000),
    s AS (SELECT a.f, a.x, a.y, sum(b.q * exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 8.0)) / sum(exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 8.0)) AS strength FROM e a JOIN e b ON a.f = b.f AND abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6 GROUP BY a.f, a.x, a.y),
    n AS (SELECT px.f, px.p, min((px.x - s.x) * (px.x - s.x) + (px.y - s.y) * (px.y - s.y)) AS d2, arg_min(strength, ((px.x - s.x) * (px.x - s.x) + (px.y - s.y) * (px.y - s.y), s.y, s.x)) AS strength FROM px JOIN s ON px.f = s.f GROUP BY px.f, px.p)
    SELECT f, p, round(strength * least(1, greatest(0, (9 - sqrt(d2)) / 2.0)), 5) AS strength FROM n""")
def nearest_edge(spark, sf):
    """Every position takes the smoothed strength of its nearest edge (sigma 2, over edges alone), which fades towards the radius.

    Edges are sent to the places they reach; the radius spans these maps.
    """
    px = pixels(spark, sf).select("f", (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), "q")
    edges = px.filter("q > 15000")
    w = F.exp(-(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / 8.0)
    smooth = maps.sent(edges, ["f"], ["q"], "x", "y", 8, maps.window(6)).groupBy("f", "x", "y").agg((F.sum(w * F.col("q")) / F.sum(w)).alias("strength"))
    strength = edges.select("f", "x", "y").join(smooth, ["f", "x", "y"]).withColumns({"ex": F.col("x"), "ey": F.col("y")})
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    near = maps.sent(strength, ["f"], ["strength", "ex", "ey"], "x", "y", 8, maps.window(RADIUS - 1)).groupBy("f", "x", "y").agg(F.min(F.struct(d2.alias("d2"), "ey", "ex", "strength")).alias("m"))
    fade = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (RADIUS + 1 - F.sqrt("m.d2")) / max(2.0, RADIUS / 4)))
    return near.select("f", (F.col("x") + 8 * F.col("y")).alias("p"), F.round(F.col("m.strength") * fade, 5).alias("strength"))


@query("owner_propagation", f"""WITH o AS (SELECT g, p, p % 8 AS x, p // 8 AS y, max(q) AS best, arg_max(f, (q, -f)) AS owner FROM ({PX_SQL}) WHERE q < 21000 GROUP BY g, p), l AS (SELECT a.g, a.p, max(b.best) AS top FROM o a JOIN o b ON a.g = b.g AND (a.x - b.x) * (a.x - b.x) / 4.0 + (a.y - b.y) * (a.y - b.y) <= 1 GROUP BY a.g, a.p),
    s AS (SELECT o.* FROM o JOIN l USING (g, p) WHERE best >= 0.98 * top), n AS (SELECT o.g, o.p, arg_min(s.owner, ((o.x - s.x) * (o.x - s.x) + (o.y - s.y) * (o.y - s.y), s.p)) AS near FROM o JOIN s ON o.g = s.g AND (o.x - s.x) * (o.x - s.x) + (o.y - s.y) * (o.y - s.y) <= 9 GROUP BY o.g, o.p)
    SELECT o.g, o.p, CASE WHEN o.p % 9 <> 0 THEN coalesce(near, owner) ELSE owner END AS owner FROM o LEFT JOIN n USING (g, p)""")
def owner_propagation(spark, sf):
    """Seeds hold most of the local best in an ellipse; positions inside take the owner of the nearest seed within the radius.

    The share of the best is 0.98 in place of 0.5, which every position of these maps would hold.
    """
    px = pixels(spark, sf).filter("q < 21000")
    o = maps.owner(px, ["g", "p"], "f", "q").select("g", (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), "best", "owner")
    top = maps.sent(o, ["g"], ["best"], "x", "y", 8, maps.disc(2, 1)).groupBy("g", "x", "y").agg(F.max("best").alias("top"))
    seeds = o.join(top, ["g", "x", "y"]).filter(F.col("best") >= 0.98 * F.col("top")).withColumn("sp", F.col("x") + 8 * F.col("y"))
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    near = maps.sent(seeds, ["g"], ["owner", "sp"], "x", "y", 8, maps.disc(3, 3)).groupBy("g", "x", "y").agg(F.min(F.struct(d2.alias("d2"), "sp", F.col("owner").alias("near"))).alias("n"))
    p = F.col("x") + 8 * F.col("y")
    return o.join(near, ["g", "x", "y"], "left").select("g", p.alias("p"), F.when(p % 9 != 0, F.coalesce("n.near", "owner")).otherwise(F.col("owner")).alias("owner"))


@query("mask_shrink", f"SELECT f, (p // 8) // 2 * 4 + (p % 8) // 2 AS cell, bool_and({VALID}) AS valid FROM ({PX_SQL}) GROUP BY ALL")
def mask_shrink(spark, sf):
    """A mask at half the size: a cell is valid only if all of it is."""
    cell = (F.floor(F.floor(F.col("p") / 8) / 2) * 4 + F.floor(F.col("p") % 8 / 2)).cast("bigint")
    return pixels(spark, sf).groupBy("f", cell.alias("cell")).agg(F.bool_and(frame_valid()).alias("valid"))


@query("flat_gate", f"""WITH px AS ({PX_SQL}), s AS (SELECT g, p, max(q) AS best, arg_max(f, (q, -f)) AS owner, min(f) AS reference, stddev_pop(q) AS spread FROM px GROUP BY g, p), l AS (SELECT g, quantile_cont(spread, 0.35) AS t FROM s GROUP BY g), f AS (SELECT s.g, best FROM s JOIN l USING (g) WHERE spread <= t),
    m AS (SELECT g, median(best) AS med FROM f GROUP BY g), c AS (SELECT g, med + 0.5 * 1.4826 * median(abs(best - med)) AS ceiling FROM f JOIN m USING (g) GROUP BY g, med)
    SELECT g, p, CASE WHEN spread <= t AND best <= ceiling THEN reference ELSE owner END AS owner, spread <= t AND best <= ceiling AS locked FROM s JOIN l USING (g) JOIN c USING (g)""")
def flat_gate(spark, sf):
    """Flat positions whose response stays under the noise ceiling are locked to the reference, the first frame."""
    s = pixels(spark, sf).groupBy("g", "p").agg(F.max(F.struct("q", (-F.col("f")).alias("f"))).alias("m"), F.min("f").alias("reference"), F.stddev_pop("q").alias("spread"))
    s = s.select("g", "p", F.col("m.q").alias("best"), (-F.col("m.f")).alias("owner"), "reference", "spread")
    l = s.groupBy("g").agg(F.percentile("spread", 0.35).alias("t"))
    flat = s.join(l, "g").filter(F.col("spread") <= F.col("t"))
    m = flat.groupBy("g").agg(F.percentile("best", 0.5).alias("med"))
    c = flat.join(m, "g").groupBy("g", "med").agg(F.percentile(F.abs(F.col("best") - F.col("med")), 0.5).alias("mad")).select("g", (F.col("med") + 0.5 * 1.4826 * F.col("mad")).alias("ceiling"))
    locked = (F.col("spread") <= F.col("t")) & (F.col("best") <= F.col("ceiling"))
    return s.join(l, "g").join(c, "g").select("g", "p", F.when(locked, F.col("reference")).otherwise(F.col("owner")).alias("owner"), locked.alias("locked"))
