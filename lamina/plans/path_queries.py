"""Queries over paths, plans, transforms and reports, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import homography, maps, sequence
from lamina.plans.registry import query
from lamina.sources.adapters import PX_SQL, pixels, table


@query("manual_groups_json", "SELECT conv_id AS group_no, turn AS position, role AS name FROM conversations")
def manual_groups_json(spark, sf):
    """Declared groups as one JSON array of arrays per source, read back with their places."""
    c = table(spark, sf, "conversations")
    doc = c.groupBy(F.col("conv_id").alias("group_no")).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("name")))).alias("j"))
    rows = doc.select("group_no", F.posexplode(F.from_json("j", "array<struct<turn:bigint,name:string>>")).alias("pos", "m"))
    return rows.select("group_no", F.col("m.turn").alias("position"), "m.name")


@query("archive_plan", """WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY lower(source) ORDER BY doc_id) - 1 AS k FROM documents), t AS (SELECT doc_id, 'archive/' || source || CASE WHEN k = 0 THEN '' ELSE ' (' || k || ')' END AS target, k FROM d)
    SELECT doc_id, target, CASE WHEN doc_id % 11 = 0 THEN 'skip' WHEN k > 0 THEN 'rename' ELSE 'move' END AS action FROM t""")
def archive_plan(spark, sf):
    """Targets and what to do on a collision; ``operators.archive`` carries a plan out."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.lower("source").alias("folded"))
    d = sequence.grouped_rank(d, ["folded"], ["doc_id"], "k").withColumn("k", F.col("k") - 1)
    suffix = F.when(F.col("k") == 0, "").otherwise(F.concat(F.lit(" ("), F.col("k").cast("string"), F.lit(")")))
    return d.select("doc_id", F.concat(F.lit("archive/"), F.col("source"), suffix).alias("target"), F.when(F.col("doc_id") % 11 == 0, "skip").when(F.col("k") > 0, "rename").otherwise("move").alias("action"))


@query("path_extraction", """WITH c AS (SELECT conv_id, list(role || turn ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
    SELECT conv_id, len(r)::INT AS n, array_to_string(r, ',') AS paths, array_to_string(CASE conv_id % 4 WHEN 1 THEN r[1:1] WHEN 3 THEN [] ELSE CASE conv_id % 4 WHEN 2 THEN r ELSE r[1:2] END END, ',') AS selected, r[1] AS first_path FROM c""")
def path_extraction(spark, sf):
    """All, selected and first paths of payloads that name them in different ways; of several names the first that holds any counts."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], x["turn"].cast("string"))).alias("r"))
    kind = F.col("conv_id") % 4
    none = F.lit(None).cast("array<string>")
    payload = F.to_json(F.struct(
        F.when(kind == 0, F.col("r")).alias("all_images"), F.when(kind == 1, F.col("r")).alias("images"), F.when(kind >= 2, F.col("r")).alias("paths"), F.when(kind == 2, F.array().cast("array<string>")).alias("selected_paths"),
        F.when(kind == 0, F.slice("r", 1, 2)).when(kind == 2, F.col("r")).otherwise(none).alias("selected"), F.when(kind == 1, F.slice("r", 1, 1)).otherwise(none).alias("chosen"),
    ))
    lists = F.from_json(payload, ", ".join(f"{k} array<string>" for k in ("all_images", "images", "paths", "selected_paths", "selected", "chosen")))
    some = lambda x: F.when(F.size(x) > 0, x)
    rows = c.select("conv_id", lists.alias("l"))
    every, chosen = F.coalesce(*[some(F.col(f"l.{k}")) for k in ("all_images", "images", "paths")]), F.coalesce(*[some(F.col(f"l.{k}")) for k in ("selected_paths", "selected", "chosen")], F.array().cast("array<string>"))
    return rows.select("conv_id", F.size(every).alias("n"), F.array_join(every, ",").alias("paths"), F.array_join(chosen, ",").alias("selected"), F.get(every, 0).alias("first_path"))


@query("selected_path_resolution", """WITH w AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN lang || '/' || doc_id WHEN 1 THEN source || '/' || doc_id WHEN 2 THEN 'x' || doc_id // 2 ELSE (doc_id % 60)::VARCHAR END AS wanted FROM documents),
    p AS (SELECT doc_id AS id, source, lang || '/' || doc_id AS cur, source || '/' || doc_id AS orig, 'x' || doc_id // 2 AS base, count(*) OVER (PARTITION BY doc_id // 2) AS same, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)
    SELECT w.doc_id, coalesce(i.id, a.id, b.id, c.id) AS image FROM w LEFT JOIN p i ON i.source = w.source AND i.k::VARCHAR = w.wanted LEFT JOIN p a ON a.cur = w.wanted LEFT JOIN p b ON b.orig = w.wanted LEFT JOIN p c ON c.base = w.wanted AND c.same = 1""")
def selected_path_resolution(spark, sf):
    """A whole number is an index into the group's paths; else by current path, then by original path, then by a base name that only one image has."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    base = F.concat(F.lit("x"), F.floor(F.col("doc_id") / 2).cast("string"))
    current, original = F.concat_ws("/", "lang", F.col("doc_id").cast("string")), F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    kind = F.col("doc_id") % 4
    wanted = d.select("doc_id", "source", F.when(kind == 0, current).when(kind == 1, original).when(kind == 2, base).otherwise((F.col("doc_id") % 60).cast("string")).alias("wanted"))
    by = lambda key, name: d.select(key.alias("wanted"), F.col("doc_id").alias(name))
    unique = by(base, "c").groupBy("wanted").agg(F.count("*").alias("n"), F.first("c").alias("c")).filter("n = 1").drop("n")
    places = sequence.grouped_rank(d, ["source"], ["doc_id"], "k").select("source", (F.col("k") - 1).cast("string").alias("wanted"), F.col("doc_id").alias("i"))
    met = wanted.join(places, ["source", "wanted"], "left").join(by(current, "a"), "wanted", "left").join(by(original, "b"), "wanted", "left").join(unique, "wanted", "left")
    return met.select("doc_id", F.coalesce("i", "a", "b", "c").alias("image"))


@query("recovery_path_resolution", """WITH c AS (SELECT doc_id, 0 AS rank, doc_id * 3 AS path FROM documents UNION ALL SELECT doc_id, 1, doc_id * 2 FROM documents UNION ALL SELECT doc_id, 2, doc_id FROM documents)
    SELECT d.doc_id, (SELECT arg_min(path, rank) FROM c WHERE c.doc_id = d.doc_id AND path IN (SELECT doc_id FROM labels)) AS found FROM documents d""")
def recovery_path_resolution(spark, sf):
    """The first candidate place, in order of preference, that the listing has."""
    d = table(spark, sf, "documents").select("doc_id")
    c = d.select("doc_id", F.posexplode(F.array(F.col("doc_id") * 3, F.col("doc_id") * 2, F.col("doc_id"))).alias("rank", "path"))
    listed = table(spark, sf, "labels").select(F.col("doc_id").alias("path")).distinct()
    first = c.join(listed, "path", "left_semi").groupBy("doc_id").agg(F.min_by("path", "rank").alias("found"))
    return d.join(first, "doc_id", "left")


@query("archive_map", "WITH f AS (SELECT doc_id, sha256(text) AS h, strlen(text) AS n FROM documents) SELECT a.doc_id, min(b.doc_id) AS archived_as FROM f a JOIN f b ON a.h = b.h AND a.n = b.n AND a.doc_id % 2 = 1 AND b.doc_id % 2 = 0 GROUP BY a.doc_id")
def archive_map(spark, sf):
    """Sources whose contents are archived already: the digest's least archived id, aggregated before the join."""
    f = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").alias("n"))
    there = f.filter("doc_id % 2 = 0").groupBy("h", "n").agg(F.min("doc_id").alias("archived_as"))
    return f.filter("doc_id % 2 = 1").join(there, ["h", "n"]).select("doc_id", "archived_as")


@query("cross_volume_check", "SELECT conv_id, count(DISTINCT turn % 3) > 1 AND NOT bool_or(role = 'system') AS refused FROM conversations GROUP BY conv_id")
def cross_volume_check(spark, sf):
    """Hard links need one device, unless a match is there already."""
    return table(spark, sf, "conversations").groupBy("conv_id").agg((F.count_distinct(F.col("turn") % 3) > 1).alias("many"), F.bool_or(F.col("role") == "system").alias("there")).select("conv_id", (F.col("many") & ~F.col("there")).alias("refused"))


@query("stale_directories", "SELECT event_id FROM events WHERE regexp_matches('run-' || event_id, '^run-[0-9]+$') AND event_type <> 'purchase' AND ts <= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def stale_directories(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "ts")
    now = e.agg(F.max("ts").alias("now"))
    name = F.concat(F.lit("run-"), F.col("event_id").cast("string"))
    return e.join(F.broadcast(now), name.rlike("^run-[0-9]+$") & (F.col("event_type") != "purchase") & (F.col("ts") <= F.col("now") - F.expr("INTERVAL 24 HOURS"))).select("event_id")


@query("plan_restore", """WITH p AS (SELECT conv_id, list(turn ORDER BY turn) AS o, CASE WHEN conv_id % 4 = 0 THEN list(turn ORDER BY turn)[1:1] WHEN conv_id % 4 = 1 THEN list(turn + 1 ORDER BY turn) ELSE list(turn ORDER BY turn DESC) END AS stored, count(*) AS n FROM conversations GROUP BY conv_id)
    SELECT conv_id, list_sort(stored) = range(0, n) AND conv_id % 5 < n AND (conv_id % 13) / 10.0 <= 1 AND conv_id % 17 <> 0 AS valid FROM p""")
def plan_restore(spark, sf):
    """A stored plan counts only if its order is a permutation of the group, its reference and its confidence are in range, and its shape is the group's."""
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("o"))
    stored = F.when(F.col("conv_id") % 4 == 0, F.slice("o", 1, 1)).when(F.col("conv_id") % 4 == 1, F.transform("o", lambda t: t + 1)).otherwise(F.reverse("o"))
    n = F.size("o").cast("bigint")
    payload = F.to_json(F.struct(stored.alias("order"), (F.col("conv_id") % 5).alias("reference"), (F.col("conv_id") % 13 / 10.0).alias("confidence"), F.when(F.col("conv_id") % 17 != 0, n).otherwise(-1).alias("frames")))
    plan = F.from_json(payload, "order array<bigint>, reference bigint, confidence double, frames bigint")
    p = g.select("conv_id", n.alias("n"), plan.alias("p"))
    order = F.sort_array("p.order") == F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)
    return p.select("conv_id", (order & F.col("p.reference").between(0, F.col("n") - 1) & F.col("p.confidence").between(0, 1) & (F.col("p.frames") == F.col("n"))).alias("valid"))


HOMOGRAPHY_SQL = "SELECT p_partkey, 0.8 + p_size / 100.0 AS a, (p_partkey % 7) / 50.0 AS b, (p_partkey % 11) * 3.0 AS tx, (p_partkey % 5) / 40.0 AS c, 1.1 - p_size / 150.0 AS d, (p_partkey % 9) * -2.0 AS ty, (p_partkey % 3) / 10000.0 AS e, (p_partkey % 4) / 20000.0 AS h FROM part"


@query("affine_algebra", f"""SELECT p_partkey, round(sqrt(abs(a * d - b * c)), 9)::DOUBLE AS scale, round(degrees(atan2(c, a)), 7)::DOUBLE AS rotation, round(tx * 0.25, 7)::DOUBLE AS small_tx, round(ty * 0.25, 7)::DOUBLE AS small_ty, round(e / 0.25, 9)::DOUBLE AS small_e, round(h / 0.25, 9)::DOUBLE AS small_h,
    round((a * 60 + b * 40 + tx) / (e * 60 + h * 40 + 1), 7)::DOUBLE AS px, round((c * 60 + d * 40 + ty) / (e * 60 + h * 40 + 1), 7)::DOUBLE AS py, sqrt(abs(a * d - b * c)) BETWEEN 0.7 AND 1.4 AND abs(degrees(atan2(c, a))) <= 15 AND abs(tx) <= 0.25 * 120 AND abs(ty) <= 0.25 * 60 AND abs(e) + abs(h) < 0.0003 AS plausible FROM ({HOMOGRAPHY_SQL})""")
def affine_algebra(spark, sf):
    """Transforms as rows of nine numbers: to another size (S H 1/S), scale and rotation, a point's image, and the gates of a plausible one."""
    k = F.col("p_partkey")
    h = F.array(0.8 + F.col("p_size") / 100.0, k % 7 / 50.0, k % 11 * 3.0, k % 5 / 40.0, 1.1 - F.col("p_size") / 150.0, k % 9 * -2.0, k % 3 / 10000.0, k % 4 / 20000.0, F.lit(1.0))
    m = table(spark, sf, "part").select("p_partkey", h.alias("h"), homography.rescaled(h, 0.25).alias("s"))
    m = m.withColumns({"scale": homography.scale("h"), "rotation": homography.rotation("h"), "at": homography.image_of("h", F.lit(60.0), F.lit(40.0))})
    s = lambda i, digits: F.round(F.get("s", i), digits)
    return m.select(
        "p_partkey", F.round("scale", 9).alias("scale"), F.round("rotation", 7).alias("rotation"), s(2, 7).alias("small_tx"), s(5, 7).alias("small_ty"), s(6, 9).alias("small_e"), s(7, 9).alias("small_h"),
        F.round("at.x", 7).alias("px"), F.round("at.y", 7).alias("py"), homography.plausible("h", 120, 60).alias("plausible"),
    )


#: Kinds of evidence in the order in which they take over: the frames and strengths that count, and the share of the local best under which they don't.
OWNERSHIP = {"surface": ("f % 2 = 0 AND q > 12000", 0.8), "printed": ("f % 3 = 0 AND q > 15000", 0.8), "exterior": ("f % 5 = 0 AND p % 8 IN (0, 7)", 0.7), "neutral": ("f % 7 = 0 AND p // 8 < 3", 0.7)}


def _ownership_sql() -> str:
    sql, last = [f"px AS ({PX_SQL}), o0 AS (SELECT g, p, arg_max(f, (q, -f)) AS owner, max(q) AS best FROM px GROUP BY g, p)"], "o0"
    for k, (test, share) in enumerate(OWNERSHIP.values(), 1):
        sql.append(f"e{k} AS (SELECT g, p, arg_max(f, (q, -f)) AS strong, max(q) AS strength FROM px WHERE {test} GROUP BY g, p), o{k} AS (SELECT g, p, CASE WHEN strength >= {share} * best THEN strong ELSE owner END AS owner, best FROM {last} LEFT JOIN e{k} USING (g, p))")
        last = f"o{k}"
    return f"WITH {', '.join(sql)} SELECT g, p, owner FROM {last}"


@query("ownership_veto", _ownership_sql())
def ownership_veto(spark, sf):
    """Four accumulators of evidence, each with the strongest frame of each position, which takes over unless it is under a share of the local best."""
    px = pixels(spark, sf)
    base = maps.owner(px, ["g", "p"], "f", "q")
    for test, share in OWNERSHIP.values():
        strong = maps.owner(px.filter(test.replace("p // 8", "p div 8")), ["g", "p"], "f", "q").select("g", "p", F.col("owner").alias("strong"), F.col("best").alias("strength"))
        base = maps.overruled(base, strong, ["g", "p"], share)
    return base.select("g", "p", "owner")


OUTLINE_SQL = f"px AS (SELECT g, f, p % 8 AS x, p // 8 AS y, q FROM ({PX_SQL})), e AS (SELECT * FROM px WHERE q > 14000), i AS (SELECT DISTINCT g, f FROM px), r AS (SELECT g, min(f) AS f FROM px GROUP BY g), o AS (SELECT e.g, x, y FROM e JOIN r USING (g, f))"


@query("silhouette_residual", f"""WITH {OUTLINE_SQL}, a AS (SELECT e.g, e.f, e.x, e.y, min(sqrt((e.x - o.x) * (e.x - o.x) + (e.y - o.y) * (e.y - o.y))) AS d FROM e JOIN o USING (g) GROUP BY ALL), b AS (SELECT e.g, e.f, o.x, o.y, min(sqrt((e.x - o.x) * (e.x - o.x) + (e.y - o.y) * (e.y - o.y))) AS d FROM e JOIN o USING (g) GROUP BY ALL),
    n AS (SELECT g, f, quantile_cont(d, 0.95) AS there FROM a GROUP BY g, f), m AS (SELECT g, f, quantile_cont(d, 0.95) AS back FROM b GROUP BY g, f), s AS (SELECT i.g, i.f, (SELECT count(*) FROM e WHERE e.g = i.g AND e.f = i.f) AS own, (SELECT count(*) FROM o WHERE o.g = i.g) AS ref FROM i)
    SELECT g, f, round(greatest(there, back), 9) AS residual, CASE WHEN own = 0 AND ref = 0 THEN 'none' WHEN own = 0 OR ref = 0 THEN 'disappeared' WHEN greatest(there, back) > 2 THEN 'moved' ELSE 'same' END AS state FROM s LEFT JOIN n USING (g, f) LEFT JOIN m USING (g, f)""")
def silhouette_residual(spark, sf):
    """95th percentile of the distance from each outline to the group's first, and back: the greater counts, against max(2, edge / 320).

    An outline is an array of at most 64 positions in its row, and the group's reference comes by a join on the group.
    """
    px = pixels(spark, sf).select("g", "f", (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), "q")
    outline = px.groupBy("g", "f").agg(F.collect_list(F.when(F.col("q") > 14000, F.struct("x", "y"))).alias("o"))
    ref = outline.groupBy("g").agg(F.min_by("o", "f").alias("r"))
    far = lambda a, b: F.transform(a, lambda p: F.array_min(F.transform(b, lambda r: F.hypot(p["x"] - r["x"], p["y"] - r["y"]))))
    rows = outline.join(ref, "g").withColumns({"there": maps.array_quantile(far("o", "r"), 0.95), "back": maps.array_quantile(far("r", "o"), 0.95)})
    some = (F.size("o") > 0) & (F.size("r") > 0)
    residual = F.when(some, F.greatest("there", "back"))
    state = F.when((F.size("o") == 0) & (F.size("r") == 0), "none").when(~some, "disappeared").when(residual > max(2.0, 8 / 320), "moved").otherwise("same")
    return rows.select("g", "f", F.round(residual, 9).alias("residual"), state.alias("state"))


@query("covariance_axis", f"WITH s AS (SELECT g, f, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy FROM (SELECT g, f, (p % 8)::DOUBLE AS x, (p // 8)::DOUBLE AS y FROM ({PX_SQL}) WHERE q > 8000) GROUP BY g, f) SELECT g, f, round((xx + yy + sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)) / 2, 7) AS major, round((xx + yy - sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)) / 2, 7) AS minor FROM s")
def covariance_axis(spark, sf):
    """Variances along the axes of each frame's support, in closed form."""
    px = pixels(spark, sf).filter("q > 8000").select("g", "f", (F.col("p") % 8).cast("double").alias("x"), F.floor(F.col("p") / 8).cast("double").alias("y"))
    s = px.groupBy("g", "f").agg(F.covar_pop("x", "x").alias("xx"), F.covar_pop("y", "y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    root = "sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)"
    return s.select("g", "f", F.round(F.expr(f"(xx + yy + {root}) / 2"), 7).alias("major"), F.round(F.expr(f"(xx + yy - {root}) / 2"), 7).alias("minor"))


@query("cube_report", "SELECT source, lang, count(*) AS n, grouping(source) + grouping(lang) AS level FROM documents GROUP BY CUBE (source, lang)")
def cube_report(spark, sf):
    return table(spark, sf, "documents").cube("source", "lang").agg(F.count("*").alias("n"), (F.grouping("source") + F.grouping("lang")).cast("bigint").alias("level"))


@query("rollup_report", "SELECT event_type, user_id % 5 AS shard, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type, user_id % 5)")
def rollup_report(spark, sf):
    e = table(spark, sf, "events").withColumn("shard", F.col("user_id") % 5)
    return e.rollup("event_type", "shard").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("as_of_join", "SELECT e.event_id, c.event_id AS last_click FROM events e ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) c ON e.user_id = c.user_id AND e.ts >= c.ts")
def as_of_join(spark, sf):
    """The last click at or before each event of the user: one sort per user, no join."""
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return e.select("event_id", F.max(F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))).over(w)["event_id"].alias("last_click"))


@query("sql_front_end", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) GROUP BY n_name")
def sql_front_end(spark, sf):
    """User SQL over frames."""
    frames = {name: table(spark, sf, name) for name in ("customer", "nation")}
    # Frames are named as arguments, so the session keeps no view.
    return spark.sql("SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer}) GROUP BY n_name", **frames)
