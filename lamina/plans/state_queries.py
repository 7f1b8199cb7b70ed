"""Queries over state tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import archive, sequence, state
from lamina.plans.registry import query
from lamina.sources.adapters import IMAGES_SQL, JOBS_SQL, OLD_NEW_SQL, images, jobs, members, old_and_new, table


@query("image_upsert", f"""WITH {OLD_NEW_SQL} SELECT coalesce(n.key, o.key) AS key, CASE WHEN o.key IS NULL THEN n.group_id ELSE o.group_id END AS group_id,
    CASE WHEN n.key IS NULL THEN o.size ELSE n.size END AS size, CASE WHEN o.key IS NULL THEN n.status ELSE o.status END AS status FROM old o FULL JOIN new n ON o.key = n.key""")
def image_upsert(spark, sf):
    """Refreshes measured columns, keeps what the pipeline has set."""
    old, new = old_and_new(spark, sf)
    return state.upsert(old, new, ["key"], keep=["group_id", "status"])


@query("analysis_upsert", f"""WITH {OLD_NEW_SQL} SELECT coalesce(n.key, o.key) AS key, CASE WHEN n.key IS NULL THEN o.group_id ELSE n.group_id END AS group_id,
    CASE WHEN n.key IS NULL THEN o.size ELSE n.size END AS size, CASE WHEN n.key IS NULL THEN o.status ELSE n.status END AS status FROM old o FULL JOIN new n ON o.key = n.key""")
def analysis_upsert(spark, sf):
    old, new = old_and_new(spark, sf)
    return state.upsert(old, new, ["key"])


@query("archive_upsert", f"""WITH {OLD_NEW_SQL} SELECT coalesce(n.key, o.key) AS key, coalesce(n.group_id, o.group_id) AS group_id, coalesce(n.size, o.size) AS size,
    CASE WHEN n.key IS NULL THEN o.status ELSE n.status END AS status FROM old o FULL JOIN new n ON o.key = n.key""")
def archive_upsert(spark, sf):
    """Journal rows: the new phase wins, sizes and links only where they are known."""
    old, new = old_and_new(spark, sf)
    return state.upsert(old, new, ["key"], fill=["group_id", "size"])


@query("archive_phase_images", f"""WITH {OLD_NEW_SQL} SELECT o.key, o.size, CASE WHEN n.key IS NULL THEN o.status WHEN o.key % 7 = 0 THEN 'failed' WHEN o.key % 2 = 0 AND o.key % 4 = 0 THEN 'archived' ELSE 'archiving' END AS status
    FROM old o LEFT JOIN new n ON o.key = n.key""")
def archive_phase_images(spark, sf):
    """The second step of the journal: images take the state of their operation's phase."""
    old, new = old_and_new(spark, sf)
    phase = F.when(F.col("key") % 7 == 0, "failed").when(F.col("key") % 4 == 0, "archived").otherwise("archiving")
    return state.update_where(old.select("key", "size", "status"), new.select("key", phase.alias("status")), ["key"], {"status": lambda a, b: b})


@query("archive_state_update", f"""WITH {OLD_NEW_SQL} SELECT o.key, coalesce(n.size, o.size) AS size, CASE WHEN n.key IS NULL THEN o.status ELSE n.status END AS status FROM old o LEFT JOIN new n ON o.key = n.key""")
def archive_state_update(spark, sf):
    old, new = old_and_new(spark, sf)
    return state.update_where(old.select("key", "size", "status"), new.select("key", "size", "status"), ["key"], {"size": lambda a, b: F.coalesce(b, a), "status": lambda a, b: b})


@query("conditional_update", f"""WITH {OLD_NEW_SQL} SELECT o.key, CASE WHEN n.key IS NOT NULL AND o.status IN ('purchase', 'click') THEN NULL ELSE o.size END AS size, o.status FROM old o LEFT JOIN new n ON o.key = n.key""")
def conditional_update(spark, sf):
    """Clears the pending value of rows whose state says that it is done with."""
    old, new = old_and_new(spark, sf)
    return state.update_where(old.select("key", "size", "status"), new.select("key", "size"), ["key"], {"size": lambda a, b: F.when(~F.col("status").isin("purchase", "click"), a)})


@query("full_row_update", f"""WITH {OLD_NEW_SQL} SELECT o.key, CASE WHEN n.key IS NULL THEN o.group_id ELSE n.group_id END AS group_id, CASE WHEN n.key IS NULL THEN o.size ELSE n.size END AS size,
    CASE WHEN n.key IS NULL THEN o.status ELSE n.status END AS status FROM old o LEFT JOIN new n ON o.key = n.key""")
def full_row_update(spark, sf):
    old, new = old_and_new(spark, sf)
    take = lambda a, b: b
    return state.update_where(old, new, ["key"], {"group_id": take, "size": take, "status": take})


@query("membership_update", f"""WITH {OLD_NEW_SQL} SELECT o.key, CASE WHEN n.key IS NULL THEN o.group_id ELSE n.group_id + 1000 END AS group_id, CASE WHEN n.key IS NULL THEN o.status ELSE 'grouped' END AS status FROM old o LEFT JOIN new n ON o.key = n.key""")
def membership_update(spark, sf):
    old, new = old_and_new(spark, sf)
    return state.update_where(old.select("key", "group_id", "status"), new.select("key", (F.col("group_id") + 1000).alias("group_id"), F.lit("grouped").alias("status")), ["key"], {"group_id": lambda a, b: b, "status": lambda a, b: b})


ALLOWED = {"size": "double", "status": "string"}


@query("whitelisted_update", f"""WITH {OLD_NEW_SQL} SELECT key, size * 2 AS size, 'checked' AS status, group_id FROM old""")
def whitelisted_update(spark, sf):
    """Only listed columns are set; others in the request are ignored."""
    old, _ = old_and_new(spark, sf)
    wanted = {"size": F.col("size") * 2, "status": F.lit("checked"), "group_id": F.lit(-1), "nothing": F.lit(0)}
    return old.withColumns({k: v.cast(ALLOWED[k]) for k, v in wanted.items() if k in ALLOWED})


@query("schema_migration", f"""WITH {OLD_NEW_SQL} SELECT key, size, status, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS BIGINT) AS attempt FROM old""")
def schema_migration(spark, sf):
    """Additive migration: missing columns as typed nulls, unknown ones dropped."""
    old, _ = old_and_new(spark, sf)
    return state.conform(old, {"key": "bigint", "size": "double", "status": "string", "error": "string", "attempt": "bigint"})


@query("insert_group", """SELECT c_custkey, c_name, NULL AS progress, NULL AS members FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_name), s_name, least(1.0, greatest(0.0, s_acctbal / 5000))::DOUBLE, '[' || s_suppkey || ',' || s_nationkey || ']' FROM supplier""")
def insert_group(spark, sf):
    """Appended rows get dense ids after the greatest present, a clamped progress and their order as JSON."""
    base = table(spark, sf, "customer").select("c_custkey", "c_name", F.lit(None).cast("double").alias("progress"), F.lit(None).cast("string").alias("members"))
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s_acctbal") / 5000))
    new = table(spark, sf, "supplier").select(F.col("s_name").alias("c_name"), progress.alias("progress"), F.to_json(F.array(F.col("s_suppkey"), F.col("s_nationkey").cast("bigint"))).alias("members"))
    return state.append_with_ids(base, new, "c_custkey", ["c_name"])


@query("foreign_key_set_null", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN NULL ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def foreign_key_set_null(spark, sf):
    return state.cascade(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").filter("c_custkey % 3 <> 0"), "o_custkey", "c_custkey", "set_null")


@query("foreign_key_cascade", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def foreign_key_cascade(spark, sf):
    return state.cascade(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").filter("c_custkey % 3 <> 0"), "o_custkey", "c_custkey", "cascade")


@query("integrity_orphans", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) GROUP BY l_orderkey")
def integrity_orphans(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey").join(o, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("cached_plans", """WITH p AS (SELECT event_id AS key, CASE WHEN event_id % 11 = 0 THEN '{broken' ELSE props END AS payload, event_id % 3 AS version FROM events)
    SELECT key, CASE WHEN version = 1 AND json_valid(payload) THEN CAST(payload ->> '$.k' AS BIGINT) END AS k, version = 1 AND json_valid(payload) AS hit FROM p WHERE json_valid(payload)""")
def cached_plans(spark, sf):
    """A payload of another version, or one that can't be parsed, is a miss; broken rows are dropped."""
    p = table(spark, sf, "events").select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 11 == 0, "{broken").otherwise(F.col("props")).alias("payload"), (F.col("event_id") % 3).alias("version"))
    parsed = p.withColumn("v", F.try_parse_json("payload")).filter("v is not null")
    hit = F.col("version") == 1
    return parsed.select("key", F.when(hit, F.try_variant_get("v", "$.k", "bigint")).alias("k"), hit.alias("hit"))


#: Version of the payloads that this engine writes.
PLAN_VERSION = 1
PLANS_SQL = "SELECT event_id % 2 AS kind, event_id // 3 AS cache_key, CASE WHEN event_id % 11 = 0 THEN '{broken' ELSE props END AS payload, event_id % 3 AS version, event_id AS written FROM events"


def plans(spark, sf):
    e = table(spark, sf, "events")
    payload = F.when(F.col("event_id") % 11 == 0, "{broken").otherwise(F.col("props"))
    return e.select((F.col("event_id") % 2).alias("kind"), F.floor(F.col("event_id") / 3).alias("cache_key"), payload.alias("payload"), (F.col("event_id") % 3).alias("version"), F.col("event_id").alias("written"))


@query("plan_cache_upsert", f"WITH p AS ({PLANS_SQL}) SELECT kind, cache_key, arg_max(payload, written) AS payload, arg_max(version, written) AS version, max(written) AS written FROM p GROUP BY kind, cache_key")
def plan_cache_upsert(spark, sf):
    """The cache after all writes: the even half stored, the odd half put on top by (kind, key), the later write winning."""
    p = plans(spark, sf)
    stored, new = (state.latest(p.filter(F.col("written") % 4 < 2 if old else F.col("written") % 4 >= 2), ["kind", "cache_key"], ["written"]) for old in (True, False))
    return state.latest(state.upsert(stored, new, ["kind", "cache_key"]).unionByName(stored), ["kind", "cache_key"], ["written"])


@query("plan_cache_invalidate", f"WITH p AS ({PLANS_SQL}), c AS (SELECT kind, cache_key, arg_max(payload, written) AS payload, arg_max(version, written) AS version FROM p GROUP BY kind, cache_key) SELECT kind, cache_key, version FROM c WHERE json_valid(payload) AND cache_key NOT IN (SELECT doc_id FROM labels)")
def plan_cache_invalidate(spark, sf):
    """Rows whose payload can't be parsed, and those whose key is listed as changed, are deleted."""
    cache = state.latest(plans(spark, sf), ["kind", "cache_key"], ["written"])
    changed = table(spark, sf, "labels").select(F.col("doc_id").alias("cache_key")).distinct()
    return cache.filter(F.try_parse_json("payload").isNotNull()).join(changed, "cache_key", "left_anti").select("kind", "cache_key", "version")


@query("manifest_journal", """SELECT conv_id AS group_id, turn AS position, role AS kind, length(text) AS n FROM conversations WHERE role IS NOT NULL""")
def manifest_journal(spark, sf):
    """Rows stored as a JSON array per group, replayed in order."""
    m = members(spark, sf).filter("kind is not null")
    stored = m.groupBy("group_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("position", "kind", "name")))).alias("rows_json"))
    rows = stored.select("group_id", F.explode(F.from_json("rows_json", "array<struct<position:bigint,kind:string,name:string>>")).alias("r"))
    return rows.select("group_id", "r.position", "r.kind", F.length("r.name").cast("bigint").alias("n"))


#: The fields of a manifest row, in order, and names that other parts use for them.
MANIFEST_FIELDS = (
    "group_id first_image image selected selection_reason quality_score coverage_gain group_coverage merge_output status capture_order alignment_order actual_hugin_input_order "
    "alignment_order_confidence preview_reference fusion_backend requested_backend actual_backend alignment_level alignment_status crop_ratio fallback_used diagnostics"
).split()
MANIFEST_ALIASES = {"first_original": "first_image", "first_original_image": "first_image", "filename": "image", "output_path": "merge_output", "coverage": "group_coverage", "reason": "selection_reason"}


@query("manifest_rows", """WITH d AS (SELECT doc_id, source, n_chars, source || doc_id AS image, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS a FROM documents), l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
    g AS (SELECT source, arg_min(image, doc_id) AS first_image FROM d GROUP BY source UNION ALL SELECT 'empty-group', ''), s AS (SELECT source, count_if(quality = 1) / count(*) AS share, count_if(quality = 1) AS n FROM d LEFT JOIN l USING (doc_id) GROUP BY source), a AS (SELECT 'archive-' || item_id AS path FROM benchmark)
    SELECT g.source AS group_id, first_image, coalesce(image, '') AS image, CASE WHEN quality = 1 AND toxic <> 1 THEN 'true' ELSE 'false' END AS selected, CASE WHEN image IS NULL THEN '' WHEN toxic = 1 THEN 'excluded' WHEN quality = 1 THEN 'selected' ELSE 'not selected' END AS selection_reason,
    (quality * 0.75)::DOUBLE AS quality_score, CASE WHEN quality = 1 THEN n_chars / 1000.0 END AS coverage_gain, share AS group_coverage, CASE WHEN n > 1 THEN 'out/' || g.source || '.tif' ELSE '' END AS merge_output, CASE WHEN n > 1 THEN 'DONE' ELSE 'NO_MERGE' END AS status, coalesce(k::VARCHAR, '') AS capture_order, coalesce(a::VARCHAR, '') AS alignment_order,
    '' AS actual_hugin_input_order, CASE WHEN k IS NOT NULL THEN 1.0::DOUBLE END AS alignment_order_confidence, first_image AS preview_reference, 'ai' AS fusion_backend, 'ai' AS requested_backend, CASE WHEN n_chars % 5 = 0 THEN 'quality' ELSE 'ai' END AS actual_backend, (d.doc_id % 4)::INT AS alignment_level, CASE WHEN image IS NULL THEN '' WHEN d.doc_id % 4 = 3 THEN 'failed' ELSE 'ok' END AS alignment_status,
    n_chars / 2000.0 AS crop_ratio, CASE WHEN n_chars % 5 = 0 THEN 'true' ELSE 'false' END AS fallback_used, CASE WHEN image IS NULL THEN 'group has no images' WHEN d.doc_id % 4 = 3 THEN 'level 3; alignment failed' ELSE 'level ' || d.doc_id % 4 END AS diagnostics
    FROM g LEFT JOIN d ON d.source = g.source LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN s ON s.source = g.source
    UNION ALL SELECT 'archive', '', path, 'false', '', NULL, NULL, NULL, '', 'archive only', '', '', '', NULL, '', '', '', '', NULL, '', NULL, 'false', 'archive only' FROM a""")
def manifest_rows(spark, sf):
    """One row of 23 fields per image of each group; an empty group keeps one row; sources known only to the archive are added.

    An error is appended to a row's diagnostics.
    """
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", F.concat("source", F.col("doc_id").cast("string")).alias("image"))
    d = sequence.grouped_rank(sequence.grouped_rank(d, ["source"], ["doc_id"], "k"), ["source"], ["n_chars", "doc_id"], "a")
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    images = d.join(labels, "doc_id", "left")
    groups = images.groupBy("source").agg(F.min_by("image", "doc_id").alias("first_image"), (F.count_if(F.col("quality") == 1) / F.count("*")).alias("share"), F.count_if(F.col("quality") == 1).alias("n"))
    groups = groups.unionByName(spark.createDataFrame([("empty-group", "")], "source string, first_image string"), allowMissingColumns=True)
    none, chosen, level = F.col("image").isNull(), F.col("quality") == 1, (F.col("doc_id") % 4).cast("int")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    flag = lambda c: F.when(c, "true").otherwise("false")
    note = F.concat(F.lit("level "), level.cast("string"))
    fallback = F.col("n_chars") % 5 == 0
    values = {
        "group_id": F.col("source"), "first_image": F.col("first_image"), "image": text(F.col("image")), "selected": flag(chosen & (F.col("toxic") != 1)),
        "selection_reason": F.when(none, "").when(F.col("toxic") == 1, "excluded").when(chosen, "selected").otherwise("not selected"),
        "quality_score": F.col("quality") * 0.75, "coverage_gain": F.when(chosen, F.col("n_chars") / 1000.0), "group_coverage": F.col("share"),
        "merge_output": F.when(F.col("n") > 1, F.concat(F.lit("out/"), "source", F.lit(".tif"))).otherwise(""), "status": F.when(F.col("n") > 1, "DONE").otherwise("NO_MERGE"),
        "capture_order": text(F.col("k") - 1), "alignment_order": text(F.col("a") - 1), "actual_hugin_input_order": F.lit(""), "alignment_order_confidence": F.when(F.col("k").isNotNull(), 1.0),
        "preview_reference": F.col("first_image"), "fusion_backend": F.lit("ai"), "requested_backend": F.lit("ai"), "actual_backend": F.when(fallback, "quality").otherwise("ai"),
        "alignment_level": level, "alignment_status": F.when(none, "").when(level == 3, "failed").otherwise("ok"), "crop_ratio": F.col("n_chars") / 2000.0, "fallback_used": flag(fallback),
        "diagnostics": F.when(none, "group has no images").when(level == 3, F.concat(note, F.lit("; alignment failed"))).otherwise(note),
    }
    rows = groups.join(images, "source", "left").select(*[values[f].alias(f) for f in MANIFEST_FIELDS])
    archive = table(spark, sf, "benchmark").select(F.concat(F.lit("archive-"), F.col("item_id").cast("string")).alias("image")).join(rows.select("image"), "image", "left_anti")
    fixed = {"group_id": "archive", "selected": "false", "status": "archive only", "fallback_used": "false", "diagnostics": "archive only"}
    numbers = {f.name: f.dataType for f in rows.schema if f.dataType.typeName() != "string"}
    return rows.unionByName(archive.select(*[F.col(f) if f == "image" else F.lit(None).cast(numbers[f]).alias(f) if f in numbers else F.lit(fixed.get(f, "")).alias(f) for f in MANIFEST_FIELDS]))


@query("manifest_normalise", """SELECT doc_id::VARCHAR AS image, CASE WHEN doc_id % 3 = 0 THEN 'first' || source ELSE 'orig' || source END AS first_image, 'out/' || doc_id AS merge_output, n_chars / 1000.0 AS group_coverage, lang AS selection_reason,
    CASE WHEN n_chars > 1000 THEN 'true' ELSE 'false' END AS selected, CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END AS fallback_used, '[' || doc_id || ',' || n_chars || ']' AS capture_order, '{"lang":"' || lang || '","size":' || n_chars || '}' AS diagnostics FROM documents""")
def manifest_normalise(spark, sf):
    """All aliases renamed, where the field itself isn't there; booleans as text, a missing selection as false; lists and structs as compact JSON."""
    d = table(spark, sf, "documents")
    raw = d.select(
        F.col("doc_id").cast("string").alias("filename"), F.concat(F.lit("orig"), "source").alias("first_original"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("first"), "source")).alias("first_original_image"),
        F.concat(F.lit("out/"), F.col("doc_id").cast("string")).alias("output_path"), (F.col("n_chars") / 1000.0).alias("coverage"), F.col("lang").alias("reason"), F.when(F.col("n_chars") > 1000, True).alias("selected"),
        (F.col("doc_id") % 2 == 0).alias("fallback_used"), F.array("doc_id", "n_chars").alias("capture_order"), F.struct("lang", F.col("n_chars").alias("size")).alias("diagnostics"),
    )
    return normalised_manifest(raw)


def normalised_manifest(raw):
    """Columns named as fields or by their aliases, as manifest text and numbers."""
    given = [f for f in MANIFEST_FIELDS if f in raw.columns or any(a in raw.columns for a, g in MANIFEST_ALIASES.items() if g == f)]
    out = []
    for field in given:
        names = [field] if field in raw.columns else [a for a, g in reversed(MANIFEST_ALIASES.items()) if g == field and a in raw.columns]
        c, kind = F.coalesce(*map(F.col, names)), raw.schema[names[0]].dataType.typeName()
        if field in ("selected", "fallback_used") and kind == "boolean":
            c = F.when(c, "true").otherwise("false")
        elif kind in ("array", "struct", "map"):
            c = F.to_json(c)
        out.append(c.alias(field))
    return raw.select(*out)


@query("manifest_upsert", "SELECT user_id AS group_id, event_type AS image, max_by(value, event_id) AS size, min(event_id) AS first_seen FROM events GROUP BY ALL")
def manifest_upsert(spark, sf):
    """The last write of each (group, image) at the place of the first."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("group_id"), F.col("event_type").alias("image")).agg(F.max_by("value", "event_id").alias("size"), F.min("event_id").alias("first_seen"))


@query("selection_update", """SELECT d.doc_id, coalesce(quality = 1, false) AS selected, CASE WHEN toxic = 1 THEN 'manual' WHEN quality = 1 THEN 'coverage' ELSE 'not selected' END AS reason,
    count_if(coalesce(quality = 1, false)) OVER (PARTITION BY source) AS selected_count FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)""")
def selection_update(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    chosen = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = d.join(chosen, "doc_id", "left").withColumn("selected", F.coalesce(F.col("quality") == 1, F.lit(False)))
    counts = rows.groupBy("source").agg(F.count_if("selected").alias("selected_count"))
    known = F.when(F.col("toxic") == 1, "manual")
    return rows.join(counts, "source").select("doc_id", "selected", F.coalesce(known, F.when(F.col("selected"), "coverage").otherwise("not selected")).alias("reason"), "selected_count")


@query("job_latest", f"WITH j AS ({JOBS_SQL}) SELECT group_id, arg_max(id, id) AS id, arg_max(status, id) AS status FROM j GROUP BY group_id HAVING arg_max(status, id) IN ('PENDING', 'RUNNING', 'FAILED')")
def job_latest(spark, sf):
    """Unfinished groups: the last job of each, if it isn't done."""
    last = state.latest(jobs(spark, sf).select("group_id", "id", "status"), ["group_id"], ["id"])
    return last.filter(F.col("status").isin("PENDING", "RUNNING", "FAILED"))


@query("crash_recovery", f"WITH j AS ({JOBS_SQL}) SELECT id, CASE WHEN status = 'RUNNING' THEN 'PENDING' ELSE status END AS status, CASE WHEN status = 'RUNNING' THEN 1 ELSE 0 END AS attempt, CASE WHEN status = 'RUNNING' THEN 'interrupted' END AS error FROM j")
def crash_recovery(spark, sf):
    running = F.col("status") == "RUNNING"
    return jobs(spark, sf).select("id", F.when(running, "PENDING").otherwise(F.col("status")).alias("status"), running.cast("int").alias("attempt"), F.when(running, "interrupted").alias("error"))


@query("job_state_machine", f"""WITH j AS ({JOBS_SQL}), d AS (SELECT *, min(CASE WHEN status = 'DONE' THEN id END) OVER (PARTITION BY group_id) AS done_id FROM j)
    SELECT id, group_id, CASE WHEN done_id <= id THEN 'DONE' ELSE status END AS status, CASE WHEN done_id <= id THEN 1.0 ELSE least(1.0, greatest(0.0, progress)) END AS progress FROM d""")
def job_state_machine(spark, sf):
    """State after every event in the order of ids; DONE absorbs, progress is clamped. The batch form of the stream in ``streaming``."""
    j = jobs(spark, sf)
    first_done = j.filter("status = 'DONE'").groupBy("group_id").agg(F.min("id").alias("done_id"))
    done = F.coalesce(F.col("done_id") <= F.col("id"), F.lit(False))
    return j.join(first_done, "group_id", "left").select("id", "group_id", F.when(done, "DONE").otherwise(F.col("status")).alias("status"), F.when(done, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("progress")))).alias("progress"))


@query("recovery_join", f"""WITH j AS ({JOBS_SQL}), u AS (SELECT group_id FROM j GROUP BY group_id HAVING arg_max(status, id) IN ('PENDING', 'RUNNING', 'FAILED')), i AS ({IMAGES_SQL}),
    s AS (SELECT source, list_sort(list(id)) AS all_ids, list_sort(list(id) FILTER (status = 'click')) AS chosen FROM i GROUP BY source)
    SELECT group_id, len(CASE WHEN chosen IS NULL OR len(chosen) = 0 THEN all_ids ELSE chosen END)::INT AS n, coalesce(chosen = all_ids, false) AS same FROM u JOIN s ON s.source = u.group_id""")
def recovery_join(spark, sf):
    """Unfinished groups with how many images go on: the selected ones, or all if none are; by counts, no group is gathered."""
    unfinished = job_latest(spark, sf).select("group_id")
    n = images(spark, sf).groupBy(F.col("source").alias("group_id")).agg(F.count("*").alias("all"), F.count_if(F.col("status") == "click").alias("chosen"))
    return unfinished.join(n, "group_id").select("group_id", F.when(F.col("chosen") == 0, F.col("all")).otherwise(F.col("chosen")).cast("int").alias("n"), (F.col("chosen") == F.col("all")).alias("same"))


@query("archive_reconciliation", """WITH j AS (SELECT doc_id AS op, n_chars AS expected, CASE doc_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'archiving' ELSE 'archived' END AS phase FROM documents), t AS (SELECT page_id * 2 AS op, CASE WHEN page_id % 3 = 0 THEN (SELECT n_chars FROM documents WHERE doc_id = page_id * 2) ELSE 7 END AS size FROM pages), s AS (SELECT doc_id AS op FROM labels GROUP BY doc_id)
    SELECT j.op, CASE WHEN phase = 'archived' THEN 'archived' WHEN t.size = expected THEN 'archived' WHEN t.size IS NOT NULL THEN 'failed' WHEN s.op IS NOT NULL THEN 'pending' ELSE 'failed' END AS phase, CASE WHEN phase <> 'archived' AND t.size = expected THEN expected END AS bytes,
    CASE WHEN phase <> 'archived' AND t.size <> expected THEN 'size differs' WHEN phase <> 'archived' AND t.size IS NULL AND s.op IS NULL THEN 'source and target are missing' END AS error FROM j LEFT JOIN t USING (op) LEFT JOIN s USING (op)""")
def archive_reconciliation(spark, sf):
    """After a crash: an unfinished operation is archived if its target has the expected size, failed if another, pending if only its source is there."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("op"), F.col("n_chars").alias("expected"))
    phase = F.when(F.col("op") % 3 == 0, "pending").when(F.col("op") % 3 == 1, "archiving").otherwise("archived")
    sizes = d.withColumnRenamed("expected", "whole")
    targets = table(spark, sf, "pages").select((F.col("page_id") * 2).alias("op"), (F.col("page_id") % 3 == 0).alias("complete")).join(sizes, "op", "left").select("op", F.when(F.col("complete"), F.col("whole")).otherwise(7).alias("size"))
    sources = table(spark, sf, "labels").select(F.col("doc_id").alias("op")).distinct().withColumn("there", F.lit(True))
    return archive.reconciled(d.withColumn("phase", phase), targets, sources)


@query("run_summary", f"WITH j AS ({JOBS_SQL}) SELECT status, count(*) AS n, count(DISTINCT group_id) AS n_groups, min(id) AS first_id, max(id) AS last_id FROM j GROUP BY status")
def run_summary(spark, sf):
    return jobs(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("n_groups"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("stage_timing", "SELECT event_type AS stage, round(sum(value), 6) AS seconds, max(value) AS peak, round(max(value) - min(value), 6) AS delta FROM events GROUP BY event_type")
def stage_timing(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 6).alias("seconds"), F.max("value").alias("peak"), F.round(F.max("value") - F.min("value"), 6).alias("delta"))


@query("progress_rollup", f"WITH j AS ({JOBS_SQL}) SELECT group_id, arg_max(status, id) AS stage, arg_max(progress, id) AS progress FROM j GROUP BY group_id")
def progress_rollup(spark, sf):
    return jobs(spark, sf).groupBy("group_id").agg(F.max_by("status", "id").alias("stage"), F.max_by("progress", "id").alias("progress"))


@query("row_mapping", "SELECT event_id, CAST(props ->> '$.k' AS INT) AS k, value > 50 AS bright FROM events")
def row_mapping(spark, sf):
    """Stored text to typed columns."""
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), (F.col("value") > 50).alias("bright"))


@query("failure_classes", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'CANCELLED' WHEN 1 THEN 'FAILED_ALIGNMENT' WHEN 2 THEN 'FAILED_HUGIN' WHEN 3 THEN 'FAILED_ARCHIVE' ELSE 'FAILED_FUSION' END AS status, CASE WHEN event_id % 6 = 3 THEN 'ARCHIVE' ELSE 'FUSION' END AS stage FROM events WHERE event_type = 'error'")
def failure_classes(spark, sf):
    kinds = {0: "CANCELLED", 1: "FAILED_ALIGNMENT", 2: "FAILED_HUGIN", 3: "FAILED_ARCHIVE"}
    kind = F.col("event_id") % 6
    status = F.lit("FAILED_FUSION")
    for k, v in reversed(kinds.items()):
        status = F.when(kind == k, v).otherwise(status)
    return table(spark, sf, "events").filter("event_type = 'error'").select("event_id", status.alias("status"), F.when(kind == 3, "ARCHIVE").otherwise("FUSION").alias("stage"))


@query("merge_routing", """SELECT group_id, CASE WHEN published THEN 'DONE' WHEN archive_only AND failed THEN 'FAILED_CLASSIFICATION' WHEN archive_only OR n < 4 OR selected <= 1 THEN 'NO_MERGE' WHEN cancelled THEN 'CANCELLED' ELSE 'FUSE' END AS route
    FROM (SELECT user_id AS group_id, count(*) AS n, count_if(event_type = 'click') AS selected, bool_or(event_type = 'purchase') AS published, user_id % 5 = 0 AS archive_only, bool_or(event_type = 'error') AS failed, user_id % 7 = 0 AS cancelled FROM events GROUP BY user_id)""")
def merge_routing(spark, sf):
    g = table(spark, sf, "events").groupBy(F.col("user_id").alias("group_id")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("selected"), F.bool_or(F.col("event_type") == "purchase").alias("published"), F.bool_or(F.col("event_type") == "error").alias("failed"))
    only = F.col("group_id") % 5 == 0
    route = F.when(F.col("published"), "DONE").when(only & F.col("failed"), "FAILED_CLASSIFICATION").when(only | (F.col("n") < 4) | (F.col("selected") <= 1), "NO_MERGE").when(F.col("group_id") % 7 == 0, "CANCELLED").otherwise("FUSE")
    return g.select("group_id", route.alias("route"))


@query("needs_merge", """SELECT event_id, CASE WHEN flag IS NOT NULL THEN flag WHEN regexp_matches(status, '^(single_|no_merge_|repeated_)') THEN false ELSE event_id % 4 > 1 END AS needs_merge
    FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN true END AS flag, CASE event_type WHEN 'view' THEN 'no_merge_small' WHEN 'click' THEN 'single_frame' ELSE event_type END AS status FROM events)""")
def needs_merge(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, True).alias("flag"), F.when(F.col("event_type") == "view", "no_merge_small").when(F.col("event_type") == "click", "single_frame").otherwise(F.col("event_type")).alias("status"))
    return e.select("event_id", F.coalesce("flag", F.when(F.col("status").rlike("^(single_|no_merge_|repeated_)"), False), F.col("event_id") % 4 > 1).alias("needs_merge"))


@query("disk_estimate", """WITH d AS (SELECT source, doc_id, greatest(3 * n_chars, 2 * strlen(text)) + 65536 AS bytes, row_number() OVER (PARTITION BY source ORDER BY strlen(text) DESC, doc_id) AS k, strlen(text) AS size FROM documents)
    SELECT source AS volume, sum(bytes)::BIGINT AS encoded, sum(CASE WHEN k <= 3 THEN size ELSE 0 END)::BIGINT AS copies FROM d GROUP BY source""")
def disk_estimate(spark, sf):
    """Bytes wanted per volume: all encodings and the largest copies that workers hold at once."""
    d = table(spark, sf, "documents").select(F.col("source").alias("volume"), "doc_id", "n_chars", F.octet_length("text").alias("size"))
    encoded = d.groupBy("volume").agg(F.sum(F.greatest(3 * F.col("n_chars"), 2 * F.col("size")) + 65536).alias("encoded"))
    # The largest of each salt, and then of those: a volume with very many files doesn't meet in one task.
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("size"), "doc_id"))
    salted = d.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    few = salted.withColumn("k", rank("volume", "salt")).filter("k <= 3").withColumn("k", rank("volume")).filter("k <= 3")
    top = few.groupBy("volume").agg(F.sum("size").cast("bigint").alias("copies"))
    return encoded.join(top, "volume")
