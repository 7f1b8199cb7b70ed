"""Queries over ordered sequences, names and files, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import archive, cache, scenes, sequence
from lamina.plans.registry import query
from lamina.sources.adapters import IMAGES_SQL, images, members, table

HOUR = 3600.0
RULE = {"pause": 2 * HOUR, "long_pause": 8 * HOUR, "change": 300.0, "pause_change": 20.0}


SPLIT_SQL = f"""i AS (SELECT *, CASE WHEN id % 89 = 0 THEN 'portrait' ELSE 'landscape' END AS shape, CASE WHEN id % 4 = 0 THEN id % 13 END AS subject FROM ({IMAGES_SQL})), b AS (SELECT *, coalesce(epoch_us(capture_time) / 1e6 - lag(epoch_us(capture_time) / 1e6) OVER w, 0) AS gap, abs(brightness - lag(brightness) OVER w) AS moved,
    status = 'error' AS bad, coalesce(lag(status = 'error') OVER w, false) AS after_bad, shape <> lag(shape) OVER w AS turned, abs(subject - lag(subject) OVER w) > 9 AS other FROM i WINDOW w AS (PARTITION BY source ORDER BY seq))"""


@query("sequence_split", f"""WITH {SPLIT_SQL} SELECT source, id, seq, sum(CASE WHEN coalesce(bad, false) OR after_bad OR gap < 0 OR gap > 28800 OR coalesce(moved > 300, false) OR coalesce(turned, false) OR coalesce(other, false) OR coalesce(gap >= 7200 AND moved > 20, false) THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY seq)::BIGINT AS group_no,
    CASE WHEN bad THEN 'unreadable' END AS excluded_reason FROM b""")
def sequence_split(spark, sf):
    """Default group detector over capture records: time, brightness, shape and subject; ``scene_split`` finds the subject in previews."""
    bad = F.col("status") == "error"
    w = Window.partitionBy("source").orderBy("seq")
    rows = images(spark, sf).withColumns({"shape": F.when(F.col("id") % 89 == 0, "portrait").otherwise("landscape"), "subject": F.when(F.col("id") % 4 == 0, F.col("id") % 13)})
    other = F.abs(F.col("subject") - F.lag("subject").over(w)) > 9
    rule = sequence.capture_boundary("source", ["seq"], "capture_time", "brightness", bad, shape="shape", subject_changed=other, **RULE)
    out = sequence.split_sequence(rows, "source", ["seq"], rule)
    return out.select("source", "id", "seq", "group_no", F.when(bad, "unreadable").alias("excluded_reason"))


@query("scene_split")
def scene_split(spark, sf):
    """The same rule over previews, whose subjects are found: see ``operators.scenes``."""
    return scenes.split(scenes.features(scenes.fixture(table(spark, sf, "embeddings"))))


@query("out_of_order_time", "SELECT event_id, coalesce(ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), false) AS backwards FROM events")
def out_of_order_time(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("event_id", F.coalesce(F.col("ts") < F.lag("ts").over(w), F.lit(False)).alias("backwards"))


@query("gap_seconds", f"WITH i AS ({IMAGES_SQL}) SELECT id, coalesce((epoch_us(capture_time) - lag(epoch_us(capture_time)) OVER (PARTITION BY source ORDER BY seq)) / 1e6, 0) AS gap FROM i")
def gap_seconds(spark, sf):
    """Times as ISO text, parsed; what can't be parsed gives no gap."""
    w = Window.partitionBy("source").orderBy("seq")
    t = F.unix_micros(F.try_to_timestamp(F.date_format("capture_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    return images(spark, sf).withColumn("t", t).select("id", F.coalesce((F.col("t") - F.lag("t").over(w)) / 1e6, F.lit(0.0)).alias("gap"))


@query("capture_time_normalise", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 10 = 0")
def capture_time_normalise(spark, sf):
    raw = F.when(F.col("event_id") % 10 == 0, "  ").otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", F.nullif(F.regexp_replace(F.trim(raw), r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3"), F.lit("")).alias("iso"))


@query("composition_change", """WITH e AS (SELECT label AS g, vec_id AS f, i - 1 AS p, abs(embedding[i]::DOUBLE) AS r, abs(embedding[i % 64 + 1]::DOUBLE) AS gr, abs(embedding[(i + 1) % 64 + 1]::DOUBLE) AS b FROM embeddings, generate_series(1, 64) AS s(i)), n AS (SELECT g, f, lag(f) OVER (PARTITION BY g ORDER BY f) AS prev FROM (SELECT DISTINCT g, f FROM e)),
    d AS (SELECT n.g, n.f, (abs(x.r - y.r) + abs(x.gr - y.gr) + abs(x.b - y.b)) / 3 AS d, greatest(x.r, x.gr, x.b, y.r, y.gr, y.b) > 0.15 AS seen FROM n JOIN e x ON x.g = n.g AND x.f = n.f JOIN e y ON y.g = n.g AND y.f = n.prev AND y.p = x.p WHERE prev IS NOT NULL)
    SELECT g, f, round(coalesce(avg(CASE WHEN seen THEN d END), avg(d)), 9) AS change FROM d GROUP BY g, f""")
def composition_change(spark, sf):
    """Mean absolute difference of the colours of consecutive previews, where either is brighter than 0.15, or else everywhere."""
    w = Window.partitionBy("g").orderBy("f")
    e = table(spark, sf, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("f"), F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("m"))
    e = e.withColumn("prev", F.lag("m").over(w)).filter("prev is not null")
    colours = lambda c, p: [F.get(c, (p + k) % 64) for k in range(3)]

    def at(p):
        now, then = colours("m", p), colours("prev", p)
        return F.struct((sum((F.abs(a - b) for a, b in zip(now[1:], then[1:])), F.abs(now[0] - then[0])) / 3).alias("d"), (F.greatest(*now, *then) > 0.15).alias("seen"))

    every = F.transform(F.sequence(F.lit(0), F.lit(63)), at)
    mean = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda t, x: t + x["d"]) / F.size(xs))
    rows = e.select("g", "f", every.alias("d"))
    return rows.select("g", "f", F.round(F.coalesce(mean(F.filter("d", lambda x: x["seen"])), mean(F.col("d"))), 9).alias("change"))


@query("manual_override", """WITH m AS (SELECT conv_id, turn, role = 'assistant' AS manual FROM conversations), c AS (SELECT *, CASE WHEN manual <> lag(manual) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS c FROM m),
    i AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c)
    SELECT conv_id AS group_id, island::BIGINT AS run, bool_or(manual) AS manual, min(turn) AS first_position, max(turn) AS last_position, dense_rank() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS number FROM i GROUP BY conv_id, island""")
def manual_override(spark, sf):
    """Declared records first, the others in contiguous automatic runs, numbered by first position."""
    m = members(spark, sf).withColumn("manual", F.col("kind") == "assistant")
    runs = sequence.islands(m, "group_id", ["position"], F.col("manual"))
    g = runs.groupBy("group_id", F.col("island").alias("run")).agg(F.bool_or("manual").alias("manual"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))
    return g.withColumn("number", F.dense_rank().over(Window.partitionBy("group_id").orderBy("first_position")))


@query("sequence_numbering", """WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS good FROM documents)
    SELECT doc_id, position, first_value(good IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS anchor FROM n""")
def sequence_numbering(spark, sf):
    """0-based numbers; each row's anchor is the next readable one in its folder. A folder may be larger than a task."""
    d = table(spark, sf, "documents").select("doc_id", "source").withColumn("good", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")))
    anchored = sequence.next_value(d, "source", ["doc_id"], "good", "anchor")
    return sequence.grouped_rank(anchored, ["source"], ["doc_id"], "k").select("doc_id", (F.col("k") - 1).alias("position"), "anchor")


@query("natural_sort", """SELECT p_partkey, row_number() OVER (ORDER BY regexp_extract(lower(p_brand), '^[^0-9]*'), CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT), p_partkey) AS k FROM part""")
def natural_sort(spark, sf):
    """Ranks of brand names in natural order."""
    p = table(spark, sf, "part").select("p_partkey", sequence.natural_key(F.col("p_brand")).alias("key"))
    return sequence.global_rank(p, ["key", "p_partkey"], "k").select("p_partkey", "k")


@query("scan_order", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY (CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END) IS NULL, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END, CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), doc_id) AS k FROM documents")
def scan_order(spark, sf):
    """Records with a time first, in its order, then by natural name."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")).alias("time"), sequence.natural_key(F.col("source")).alias("name"))
    d = d.withColumn("late", F.col("time").isNull())
    return sequence.grouped_rank(d, ["lang"], ["late", "time", "name", "doc_id"], "k").select("doc_id", "k")


@query("capture_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END NULLS LAST, event_id) AS k FROM events")
def capture_order(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.when(F.col("event_id") % 4 != 0, F.col("value")).asc_nulls_last(), "event_id")
    return table(spark, sf, "events").select("event_id", F.row_number().over(w).cast("bigint").alias("k"))


@query("scan_totals", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source")
def scan_totals(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))


@query("file_filter", "SELECT page_id, url FROM pages WHERE lower(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '(/[^/]*)$', 1)) NOT LIKE '/.%' AND NOT starts_with(url, 'http://') ")
def file_filter(spark, sf):
    """Hidden names and excluded roots."""
    path = F.split_part(F.split_part(F.col("url"), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    name = F.lower(F.regexp_extract(path, "(/[^/]*)$", 1))
    return table(spark, sf, "pages").filter(~name.startswith("/.") & ~F.col("url").startswith("http://")).select("page_id", "url")


@query("path_parts", "SELECT page_id, list_extract(string_split(url, '/'), -1) AS name, regexp_extract(list_extract(string_split(url, '/'), -1), '^([^#?.]*)', 1) AS stem, lower(regexp_extract(url, '(\\.[^./]*)$', 1)) AS suffix FROM pages")
def path_parts(spark, sf):
    name = F.element_at(F.split("url", "/"), -1)
    return table(spark, sf, "pages").select("page_id", name.alias("name"), F.regexp_extract(name, "^([^#?.]*)", 1).alias("stem"), F.lower(F.regexp_extract("url", r"(\.[^./]*)$", 1)).alias("suffix"))


@query("output_naming", "SELECT doc_id, 'out/' || source || CASE WHEN doc_id % 2 = 0 THEN '_stack.jpg' ELSE '.tif' END AS path FROM documents")
def output_naming(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("out/"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, "_stack.jpg").otherwise(".tif")).alias("path"))


@query("collision_rename", "SELECT doc_id, CASE WHEN k = 0 THEN source ELSE source || ' (' || k || ')' END AS name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lower(source) ORDER BY doc_id) - 1 AS k FROM documents)")
def collision_rename(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.lower("source").alias("folded"))
    k = F.col("k") - 1
    return sequence.grouped_rank(d, ["folded"], ["doc_id"], "k").select("doc_id", F.when(k == 0, F.col("source")).otherwise(F.concat("source", F.lit(" ("), k.cast("string"), F.lit(")"))).alias("name"))


@query("file_equality", "WITH f AS (SELECT doc_id, strlen(text) AS size, sha256(text) AS digest FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY size, digest) AS first_id, count(*) OVER (PARTITION BY size, digest) AS copies FROM f")
def file_equality(spark, sf):
    f = table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("digest"))
    g = f.groupBy("size", "digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return f.join(g, ["size", "digest"]).select("doc_id", "first_id", "copies")


@query("fingerprint", "SELECT page_id, sha256(url || chr(1) || strlen(html) || chr(1) || page_id) AS digest FROM pages")
def fingerprint(spark, sf):
    """Digest of path, size and time, parted by a control character (DuckDB has no NUL in text)."""
    return table(spark, sf, "pages").select("page_id", F.sha2(F.concat_ws("\u0001", "url", F.octet_length("html").cast("string"), F.col("page_id").cast("string")), 256).alias("digest"))


@query("plan_key", "SELECT source, sha256('[' || string_agg('{\"doc_id\":' || doc_id || ',\"size\":' || n_chars || '}', ',' ORDER BY doc_id) || ']') AS digest FROM documents GROUP BY source")
def plan_key(spark, sf):
    """Digest of canonical JSON with sorted members."""
    d = table(spark, sf, "documents").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.col("n_chars").alias("size")))).alias("m"))
    return d.select("source", F.sha2(F.to_json("m"), 256).alias("digest"))


@query("focus_cache_key", "SELECT doc_id, sha256('{\"edge\":600,\"sigmas\":[0.8,1.6,3.2]}') AS namespace, substr(sha256('{\"edge\":600,\"sigmas\":[0.8,1.6,3.2]}'), 1, 16) || '/' || sha256(source || doc_id || chr(1) || n_chars || chr(1) || lang) AS key FROM documents")
def focus_cache_key(spark, sf):
    """A stored map's key: the digest of what its configuration says, and the file's fingerprint."""
    d = table(spark, sf, "documents")
    namespace = cache.namespace({"sigmas": [0.8, 1.6, 3.2], "edge": 600})
    path = F.concat("source", F.col("doc_id").cast("string"))
    return d.select("doc_id", F.lit(namespace).alias("namespace"), cache.key(namespace, path, F.col("n_chars").cast("string"), F.col("lang")).alias("key"))


@query("duration_format", """WITH s AS (SELECT event_id, round(value * 50)::BIGINT AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN s || ' 秒' WHEN s < 3600 THEN (s // 60) || ' 分 ' || lpad((s % 60)::VARCHAR, 2, '0') || ' 秒' ELSE (s // 3600) || ' 时 ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ' 分' END AS text FROM s""")
def duration_format(spark, sf):
    s = F.col("s")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    div = lambda a, b: F.floor(a / b).cast("string")
    text = F.when(s < 60, F.concat(s.cast("string"), F.lit(" 秒"))).when(s < 3600, F.concat(div(s, 60), F.lit(" 分 "), two(s % 60), F.lit(" 秒"))).otherwise(F.concat(div(s, 3600), F.lit(" 时 "), two(F.floor(s % 3600 / 60)), F.lit(" 分")))
    return table(spark, sf, "events").withColumn("s", F.round(F.col("value") * 50).cast("bigint")).select("event_id", text.alias("text"))


@query("backend_alias", "SELECT event_id, CASE event_type WHEN 'view' THEN 'ai' WHEN 'click' THEN 'ai' WHEN 'purchase' THEN 'quality' ELSE 'hugin_enfuse' END AS engine FROM events")
def backend_alias(spark, sf):
    alias = F.create_map(*[F.lit(x) for x in ("view", "ai", "click", "ai", "purchase", "quality", "error", "hugin_enfuse", "signup", "hugin_enfuse")])
    name = F.upper(F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.element_at(alias, F.lower(F.trim(name))), F.raise_error(F.lit("unknown engine"))).alias("engine"))


@query("list_filter", "SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END NULLS LAST, event_id) AS k FROM events WHERE event_type = 'click'")
def list_filter(spark, sf):
    """Optional equality predicates, ANDed; order with nulls last."""
    e = table(spark, sf, "events").filter(F.col("event_type") == "click")
    order = [F.when(F.col("event_id") % 3 != 0, F.col("value")).asc_nulls_last(), F.col("event_id")]
    return sequence.global_rank(e, order, "k").select("event_id", "k")


@query("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_lookup(spark, sf):
    return table(spark, sf, "orders").filter("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_totalprice")


@query("or_lookup", """WITH w(p) AS (VALUES ('src1'), ('src3'), ('fr')), c AS (SELECT w.p, d.doc_id, CASE WHEN d.source = w.p THEN 0 ELSE 1 END AS rank FROM w JOIN documents d ON d.source = w.p OR d.lang = w.p)
    SELECT p, arg_min(doc_id, (rank, doc_id)) AS doc_id FROM c GROUP BY p""")
def or_lookup(spark, sf):
    """Match by either of two keys, the first key preferred: two equi-joins, not one disjunctive join."""
    wanted = spark.createDataFrame([("src1",), ("src3",), ("fr",)], "p string")
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    by = lambda c, rank: d.select(F.col(c).alias("p"), "doc_id", F.lit(rank).alias("rank")).join(F.broadcast(wanted), "p")
    both = by("source", 0).unionByName(by("lang", 1))
    return both.groupBy("p").agg(F.min(F.struct("rank", "doc_id")).alias("m")).select("p", "m.doc_id")


@query("result_search", "SELECT conv_id, status, count_if(true) OVER (PARTITION BY status) AS per_class FROM (SELECT conv_id, CASE WHEN max(turn) >= 6 THEN 'done' WHEN max(turn) >= 3 THEN 'failed' ELSE 'skipped' END AS status, bool_or(contains(lower(text), 'the')) AS hit FROM conversations GROUP BY conv_id) WHERE hit")
def result_search(spark, sf):
    has = F.contains(F.lower("name"), F.lit("the"))
    g = members(spark, sf).groupBy(F.col("group_id").alias("conv_id")).agg(F.bool_or(has).alias("hit"), F.max("position").alias("last")).filter("hit")
    g = g.select("conv_id", F.when(F.col("last") >= 6, "done").when(F.col("last") >= 3, "failed").otherwise("skipped").alias("status"))
    counts = g.groupBy("status").agg(F.count("*").alias("per_class"))
    return g.join(counts, "status").select("conv_id", "status", "per_class")


@query("existence_filter", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT page_id FROM pages)")
def existence_filter(spark, sf):
    """Rows of which neither place is listed."""
    d = table(spark, sf, "documents").select("doc_id")
    return d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").join(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id")), "doc_id", "left_anti")


@query("status_classifier", "SELECT user_id, CASE WHEN count(*) = 1 THEN 'NO_MERGE_SINGLE' WHEN count(DISTINCT event_type) = 1 THEN 'NO_MERGE_REPEATED' WHEN count(*) < 4 THEN 'NO_MERGE_TOO_SMALL' ELSE 'READY_FOR_MERGE' END AS status FROM events GROUP BY user_id")
def status_classifier(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))
    return g.select("user_id", F.when(F.col("n") == 1, "NO_MERGE_SINGLE").when(F.col("kinds") == 1, "NO_MERGE_REPEATED").when(F.col("n") < 4, "NO_MERGE_TOO_SMALL").otherwise("READY_FOR_MERGE").alias("status"))


@query("pre_decode_classifier", "SELECT user_id, min(value) AS least, CASE WHEN count(*) < 4 THEN 'NO_MERGE_TOO_SMALL' WHEN min(value) < 1 THEN 'NO_MERGE_UNSTABLE' ELSE 'ANALYSE' END AS status FROM events GROUP BY user_id")
def pre_decode_classifier(spark, sf):
    """Decided before any heavy step; the least similarity is null for a group without comparisons."""
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("value").alias("least"))
    return g.select("user_id", "least", F.when(F.col("n") < 4, "NO_MERGE_TOO_SMALL").when(F.col("least") < 1, "NO_MERGE_UNSTABLE").otherwise("ANALYSE").alias("status"))


@query("minimum_scene_similarity", "SELECT user_id, min(CAST(props ->> '$.k' AS DOUBLE)) AS least FROM events GROUP BY user_id")
def minimum_scene_similarity(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min(F.from_json("props", "k double")["k"]).alias("least"))


@query("equi_join", "SELECT d.doc_id, n_chars, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE source = 'src3' AND quality = 1")
def equi_join(spark, sf):
    d, labels = table(spark, sf, "documents").select("doc_id", "n_chars", "source"), table(spark, sf, "labels")
    return d.filter("source = 'src3'").join(labels.filter("quality = 1"), "doc_id").select("doc_id", "n_chars", "quality")


@query("membership_join", """WITH w(name) AS (VALUES ('SRC1'), ('src2'), ('none')) SELECT w.name, count(d.doc_id) AS n, CASE WHEN count(d.doc_id) = 0 THEN 'missing' WHEN count(d.doc_id) > 1 THEN 'ambiguous' ELSE 'found' END AS state FROM w LEFT JOIN documents d ON lower(d.source) = lower(w.name) GROUP BY w.name""")
def membership_join(spark, sf):
    wanted = spark.createDataFrame([("SRC1",), ("src2",), ("none",)], "name string").withColumn("k", F.lower("name"))
    counts = table(spark, sf, "documents").groupBy(F.lower("source").alias("k")).agg(F.count("doc_id").alias("n"))
    out = wanted.join(counts, "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("name", "n", F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("found").alias("state"))


@query("anti_append", "SELECT doc_id, 'group' AS origin FROM labels UNION ALL SELECT doc_id, 'archive' FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_append(spark, sf):
    own = table(spark, sf, "labels").select("doc_id")
    extra = table(spark, sf, "documents").filter("doc_id % 3 = 0").select("doc_id").join(own, "doc_id", "left_anti")
    return own.withColumn("origin", F.lit("group")).unionByName(extra.withColumn("origin", F.lit("archive")))


@query("path_join", """WITH k AS (SELECT page_id, url, lower(regexp_replace(replace(replace(url, chr(92), '/'), '/./', '/'), '/+$', '')) AS k FROM pages), w AS (SELECT page_id AS wanted_id, upper(replace(url, '/', chr(92))) || chr(92) AS wanted FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT -1, 'none')
    SELECT wanted_id, page_id FROM w LEFT JOIN k ON k = lower(regexp_replace(replace(replace(wanted, chr(92), '/'), '/./', '/'), '/+$', ''))""")
def path_join(spark, sf):
    """Paths meet by a normalised key: one kind of slash, none at the end, no ``.`` parts, any case."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    slash = F.lit("\\")
    wanted = pages.filter("page_id % 3 = 0").select(F.col("page_id").alias("wanted_id"), F.concat(F.upper(F.replace("url", F.lit("/"), slash)), slash).alias("wanted"))
    wanted = wanted.unionByName(spark.createDataFrame([(-1, "none")], "wanted_id bigint, wanted string"))
    known = pages.select("page_id", sequence.path_key(F.col("url")).alias("k"))
    return wanted.withColumn("k", sequence.path_key(F.col("wanted"))).join(known, "k", "left").select("wanted_id", "page_id")


@query("collision_names")
def collision_names(spark, sf):
    """Names against those that are there, numbers counted up: see ``operators.archive``."""
    d = table(spark, sf, "documents")
    name = F.when(F.col("doc_id") % 5 == 0, F.concat("source", F.lit(" (2).jpg"))).when(F.col("doc_id") % 5 == 1, F.concat(F.upper("source"), F.lit(".JPG"))).otherwise(F.concat("source", F.lit(".jpg")))
    there = d.filter("doc_id < 40 and doc_id % 2 = 0").select(name.alias("name")).distinct()
    return archive.assigned(d.filter("doc_id >= 40 or doc_id % 2 = 1").select(F.col("doc_id").alias("id"), name.alias("name")), there)


PAIRS = "SELECT conv_id AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations"


def indexed(spark, sf):
    w = Window.partitionBy("group_id")
    return members(spark, sf).select(F.col("group_id").alias("g"), (F.row_number().over(w.orderBy("position")) - 1).cast("bigint").alias("i"), F.count("*").over(w).alias("n"))


def later(first, last):
    """Numbers first..last as an array; none if last is smaller."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def index_pairs(m, partners):
    """Pairs i < j of one group: each index lists its partners, so nothing is joined and no other pair is made."""
    return m.select("g", "i", F.explode(F.array_distinct(partners)).alias("j"))


def hubs_of(*parts):
    """The indexes n * a / b, rounded down, and the last."""
    return F.array(F.lit(0).cast("bigint"), *[F.floor(F.col("n") * a / b) for a, b in parts], F.col("n") - 1)


@query("pairwise_join", f"WITH m AS ({PAIRS}) SELECT a.g, a.i, b.i AS j FROM m a JOIN m b ON a.g = b.g AND a.i < b.i AND (a.n <= 40 OR b.i - a.i <= 4 OR a.i IN (0, a.n // 4, a.n // 2, 3 * a.n // 4, a.n - 1) OR b.i IN (0, a.n // 4, a.n // 2, 3 * a.n // 4, a.n - 1))")
def pairwise_join(spark, sf):
    """All pairs of small groups; in larger ones near neighbours and five hubs."""
    i, n, hubs = F.col("i"), F.col("n"), hubs_of((1, 4), (1, 2), (3, 4))
    some = F.concat(later(i + 1, F.least(i + 4, n - 1)), F.filter(hubs, lambda h: h > i))
    return index_pairs(indexed(spark, sf), F.when((n <= 40) | F.array_contains(hubs, i), later(i + 1, n - 1)).otherwise(some))


@query("pair_sampling", f"WITH m AS ({PAIRS}) SELECT a.g, a.i, b.i AS j FROM m a JOIN m b ON a.g = b.g AND a.i < b.i AND (a.n <= 24 OR b.i - a.i <= 3 OR (a.i IN (0, a.n // 2, a.n - 1) AND b.i % 2 = 0) OR (b.i IN (0, a.n // 2, a.n - 1) AND a.i % 2 = 0) OR (a.i IN (0, a.n // 2, a.n - 1) AND b.i IN (0, a.n // 2, a.n - 1)))")
def pair_sampling(spark, sf):
    """All pairs of small groups; in larger ones near neighbours, and even indexes and hubs with each of three hubs."""
    i, n, hubs = F.col("i"), F.col("n"), hubs_of((1, 2))
    near = later(i + 1, F.least(i + 3, n - 1))
    from_hub = F.when(F.array_contains(hubs, i), F.filter(later(i + 1, n - 1), lambda j: (j % 2 == 0) | F.array_contains(hubs, j))).otherwise(F.array().cast("array<bigint>"))
    to_hub = F.when(i % 2 == 0, F.filter(hubs, lambda h: h > i)).otherwise(F.array().cast("array<bigint>"))
    return index_pairs(indexed(spark, sf), F.when(n <= 24, later(i + 1, n - 1)).otherwise(F.concat(near, from_hub, to_hub)))


@query("set_equality", """WITH a AS (SELECT source, list_sort(list(doc_id)) AS x FROM documents GROUP BY source), b AS (SELECT source, list_sort(list(doc_id)) AS y FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id) GROUP BY source)
    SELECT source, x = y AS same, (len(x) - len(y))::INT AS missing FROM a JOIN b USING (source)""")
def set_equality(spark, sf):
    """Sets by counts of their distinct members: a member of only one side is seen without gathering either."""
    d = table(spark, sf, "documents").select("source", "doc_id").distinct()
    listed = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("there")).distinct()
    n = d.join(listed, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("there").alias("m"))
    return n.filter("m > 0").select("source", (F.col("n") == F.col("m")).alias("same"), (F.col("n") - F.col("m")).cast("int").alias("missing"))


@query("exact_cover", "SELECT conv_id, list_sort(list(turn)) = range(0, count(*)) AS ok FROM conversations GROUP BY conv_id")
def exact_cover(spark, sf):
    """Positions must be 0..n-1, once each."""
    g = members(spark, sf).groupBy(F.col("group_id").alias("conv_id")).agg(F.array_sort(F.collect_list("position")).alias("p"))
    return g.select("conv_id", (F.col("p") == F.sequence(F.lit(0).cast("bigint"), F.size("p").cast("bigint") - 1)).alias("ok"))


@query("ordered_dedup", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def ordered_dedup(spark, sf):
    g = members(spark, sf).groupBy(F.col("group_id").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct("position", "kind"))).alias("r"))
    return g.select("conv_id", F.array_join(F.array_distinct(F.transform("r", lambda x: x["kind"])), ",").alias("roles"))


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("set_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


@query("set_except_all", "SELECT l_partkey FROM lineitem WHERE l_quantity > 25 EXCEPT ALL SELECT p_partkey FROM part")
def set_except_all(spark, sf):
    return table(spark, sf, "lineitem").filter("l_quantity > 25").select("l_partkey").exceptAll(table(spark, sf, "part").select("p_partkey"))


@query("map_columns", "SELECT source, max(CASE WHEN lang = 'en' THEN n END) AS en, max(CASE WHEN lang = 'de' THEN n END) AS de FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def map_columns(spark, sf):
    n = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    m = n.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))
    return m.select("source", F.try_element_at("m", F.lit("en")).alias("en"), F.try_element_at("m", F.lit("de")).alias("de"))


@query("json_columns", "SELECT event_id, '{\"user\":' || user_id || ',\"kind\":\"' || event_type || '\"}' AS packed, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_columns(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind"))).alias("packed"), F.from_json("props", "k bigint")["k"].alias("k"))


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("sliding_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events, generate_series(0, 2) AS s(k) GROUP BY ALL")
def sliding_windows(spark, sf):
    w = F.window("ts", "3 hours", "1 hour")
    return table(spark, sf, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "event_type", "n", "users")


@query("approximate_users", "SELECT event_type, true AS near FROM events GROUP BY event_type")
def approximate_users(spark, sf):
    """Distinct users by a sketch, within five standard errors of the true count."""
    e = table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("n"))
    return e.select("event_type", (F.abs(F.col("a") - F.col("n")) <= F.greatest(F.lit(2.0), 0.1 * F.col("n"))).alias("near"))


@query("interval_join", "SELECT a.event_id, count(b.event_id) AS clicks FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'click' AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts GROUP BY a.event_id")
def interval_join(spark, sf):
    """Clicks of the user in the six hours up to each event: a range join by buckets of six hours, two for each event."""
    e = table(spark, sf, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    span = 6 * 3600 * 1_000_000
    bucket = lambda c: F.floor(c / span)
    clicks = e.filter("event_type = 'click'").select("user_id", bucket(F.col("s")).alias("k"), F.col("s").alias("at"), F.col("event_id").alias("click"))
    wanted = e.select("event_id", "user_id", "s", F.explode(F.array(bucket(F.col("s")), bucket(F.col("s")) - 1)).alias("k"))
    met = wanted.join(clicks, ["user_id", "k"], "left").withColumn("hit", F.col("at").between(F.col("s") - span, F.col("s")))
    return met.groupBy("event_id").agg(F.count_if(F.coalesce("hit", F.lit(False))).alias("clicks"))


@query("session_windows", """WITH g AS (SELECT user_id, ts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 8 HOUR, false) AS gap FROM events))
    SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def session_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "8 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
