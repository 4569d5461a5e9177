"""Lookups, filters, projections, paging: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS
from sparkloom.functions import quality
from sparkloom.operators import aggregates as A
from sparkloom.operators import lookup as L
from sparkloom.plans.registry import query
from sparkloom.sources import fixtures as X
from sparkloom.sources.fixtures import ctes

_MEM = "id, memory_type, tier, hit_count, status"
_MEMC = ["id", "memory_type", "tier", "hit_count", "status"]


@query(ctes("memories") + f"SELECT {_MEM} FROM memories WHERE id = 42")
def flt01_memory_by_id(spark, sf):
    return L.where_equal(X.memories(spark, sf), id=42).select(*_MEMC)


@query(ctes("vectors") + "SELECT id, tier, len(embedding) AS dims FROM vectors WHERE embedding IS NOT NULL AND status <> 'archived' AND memory_type = 'error' AND tier = 'hot'")
def flt02_memories_with_vectors(spark, sf):
    live = X.vectors(spark, sf).where("embedding IS NOT NULL AND status <> 'archived'")
    return L.where_equal(live, memory_type="error", tier="hot").select("id", "tier", F.size("embedding").cast("long").alias("dims"))


_TEXT = "status = 'active' AND (contains(lower(content), 'thor') OR contains(lower(context), 'thor') OR contains(lower(resolution), 'thor'))"


@query(ctes("memories") + f"SELECT id, hit_count, (SELECT count(*) FROM memories WHERE {_TEXT}) AS total FROM memories WHERE {_TEXT} ORDER BY hit_count DESC, id LIMIT 20 OFFSET 5")
def flt03_memory_text_search(spark, sf):
    found = L.searchable(X.memories(spark, sf).where("status = 'active'"), "Thor", ["content", "context", "resolution"]).select("id", "hit_count")
    return L.with_total(found).orderBy(F.col("hit_count").desc(), "id").offset(5).limit(20)


@query(
    ctes("skills", "catalog")
    + """, u AS (SELECT 0 AS src_rank, 'p' || key AS id, name AS title, key, published_at AS ts FROM skills WHERE contains(lower(name), '1') AND list_contains(categories, 'STEEL')
        UNION ALL SELECT 1, 'd' || key, CASE WHEN display_name = '' THEN name ELSE display_name END, key, key FROM catalog WHERE contains(lower(name), '1') AND category_name = 'src1')
    SELECT src_rank, id, title FROM u ORDER BY src_rank, ts DESC, key LIMIT 30 OFFSET 10"""
)
def flt04_skill_text_search(spark, sf):
    own = L.searchable(X.skills(spark, sf), "1", ["name"]).where(F.array_contains("categories", "STEEL"))
    own = own.select(F.lit(0).alias("src_rank"), F.concat(F.lit("p"), "key").alias("id"), F.col("name").alias("title"), "key", F.col("published_at").alias("at"))
    other = L.searchable(X.catalog(spark, sf), "1", ["name"]).where("category_name = 'src1'")
    other = other.select(F.lit(1).alias("src_rank"), F.concat(F.lit("d"), "key").alias("id"), F.coalesce(F.nullif("display_name", F.lit("")), "name").alias("title"), "key", F.col("key").alias("at"))
    return own.unionByName(other).orderBy("src_rank", F.col("at").desc(), "key").offset(10).limit(30).select("src_rank", "id", "title")


@query(ctes("skills") + "SELECT slug, version, key FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY published_at DESC, key) AS r FROM skills) WHERE r = 1")
def flt05_newest_skill(spark, sf):
    return L.newest_of_each(X.skills(spark, sf), ["slug"], "published_at", "key").select("slug", "version", "key")


@query(ctes("skills") + "SELECT key, slug FROM (SELECT * FROM skills ORDER BY published_at DESC, key LIMIT 200) WHERE list_has_any(categories, ['TIN', 'BRASS', 'ECONOMY'])")
def flt06_recent_skills_of_categories(spark, sf):
    top = L.newest(X.skills(spark, sf), "published_at", "key", 200)
    return top.where(F.arrays_overlap("categories", F.array(F.lit("TIN"), F.lit("BRASS"), F.lit("ECONOMY")))).select("key", "slug")


@query(ctes("vectors") + "SELECT id, label FROM vectors WHERE embedding IS NOT NULL")
def flt07_skills_with_vectors(spark, sf):
    return X.vectors(spark, sf).where("embedding IS NOT NULL").select("id", "label")


@query(ctes("vectors") + "SELECT id, tier FROM vectors WHERE embedding IS NOT NULL AND label >= 5")
def flt08_catalog_with_vectors(spark, sf):
    return X.vectors(spark, sf).where("embedding IS NOT NULL AND label >= 5").select("id", "tier")


@query(ctes("catalog") + "SELECT full_name, name, category_name FROM catalog WHERE full_name = '77'")
def flt09_catalog_skill(spark, sf):
    return L.where_equal(X.catalog(spark, sf), full_name="77").select("full_name", "name", "category_name")


@query("SELECT DISTINCT source AS name FROM documents ORDER BY name")
def flt10_categories(spark, sf):
    return X.table(spark, sf, "documents").select(F.col("source").alias("name")).distinct().orderBy("name")


@query(ctes("segments") + "SELECT id, round(score, 4) AS quality_score FROM segments WHERE labeled AND score >= 0.6 AND task_type = 'click' ORDER BY created_at DESC, id LIMIT 25 OFFSET 5")
def flt11_query_trajectories(spark, sf):
    s = quality.enriched(X.segments(spark, sf)).where("labeled AND quality_score >= 0.6 AND task_type = 'click'")
    return L.newest(s, "created_at", "id", 25, 5).select("id", F.round("quality_score", 4).alias("quality_score"))


@query(ctes("segments") + "SELECT id, session_file FROM segments WHERE NOT segmented ORDER BY created_at, id LIMIT 50")
def flt12_unsegmented_sessions(spark, sf):
    return L.newest(X.segments(spark, sf).where("NOT segmented"), "created_at", "id", 50, oldest=True).select("id", "session_file")


@query(ctes("segments") + "SELECT id FROM segments WHERE NOT labeled ORDER BY created_at, id LIMIT 50")
def flt13_unlabeled_segments(spark, sf):
    return L.newest(X.segments(spark, sf).where("NOT labeled"), "created_at", "id", 50, oldest=True).select("id")


@query(ctes("segments") + "SELECT id, round(score, 4) AS score FROM segments WHERE labeled AND NOT memory_extracted AND score >= 0.7 ORDER BY created_at, id LIMIT 50")
def flt14_memory_eligible(spark, sf):
    s = A.eligible(X.segments(spark, sf), DEFAULTS.memory_score).where("NOT memory_extracted").withColumn("score", F.round(quality.score(F.col("quality_metrics")), 4))
    return L.newest(s, "created_at", "id", 50, oldest=True).select("id", "score")


@query(ctes("segments") + "SELECT id, task_type FROM segments WHERE labeled AND score >= 0.8 AND task_type = 'purchase' ORDER BY created_at, id LIMIT 100")
def flt15_sft_segments(spark, sf):
    s = quality.enriched(A.eligible(X.segments(spark, sf), DEFAULTS.sft_score)).where("task_type = 'purchase'")
    return L.newest(s, "created_at", "id", 100, oldest=True).select("id", "task_type")


@query(ctes("segments") + "SELECT id FROM segments WHERE labeled AND score >= 0.8 AND created_at > TIMESTAMP '2024-01-15' ORDER BY created_at, id LIMIT 100")
def flt16_sft_segments_since(spark, sf):
    s = A.eligible(X.segments(spark, sf), DEFAULTS.sft_score, since=F.lit("2024-01-15").cast("timestamp_ntz"))
    return L.newest(s, "created_at", "id", 100, oldest=True).select("id")


@query(ctes("segments") + "SELECT id, segment_index FROM segments WHERE agent_id = 7 AND session_file = 's2' ORDER BY segment_index")
def flt17_segments_of_session(spark, sf):
    return L.where_equal(X.segments(spark, sf), agent_id=7, session_file="s2").orderBy("segment_index").select("id", "segment_index")


@query(ctes("segments") + "SELECT agent_id, session_file, min(id) AS id FROM segments GROUP BY agent_id, session_file")
def flt18_session_row(spark, sf):
    return X.segments(spark, sf).groupBy("agent_id", "session_file").agg(F.min("id").alias("id"))


@query(ctes("segments") + "SELECT count(*) > 0 AS has FROM segments WHERE agent_id = 7 AND session_file = 's2'")
def flt19_has_segments(spark, sf):
    return L.where_equal(X.segments(spark, sf), agent_id=7, session_file="s2").limit(1).agg((F.count(F.lit(1)) > 0).alias("has"))


@query(ctes("uploads") + "SELECT id, source, size FROM uploads WHERE starts_with(source, 'blog.') ORDER BY created_at DESC, id LIMIT 20 OFFSET 3")
def flt20_raw_uploads(spark, sf):
    return L.newest(X.uploads(spark, sf).where(F.startswith("source", F.lit("blog."))), "created_at", "id", 20, 3).select("id", "source", "size")


@query("SELECT page_id AS id, html AS text, to_base64(encode(html)) AS b64 FROM pages WHERE page_id = 5")
def flt21_raw_upload(spark, sf):
    one = L.where_equal(X.uploads(spark, sf), id=5)
    return one.select("id", F.try_validate_utf8(F.col("payload").cast("string")).alias("text"), F.regexp_replace(F.base64("payload"), "[\\r\\n]", "").alias("b64"))


@query(ctes("evolutions") + "SELECT id, status FROM evolutions WHERE skill_slug = 'skill-3' ORDER BY timestamp DESC, id LIMIT 20")
def flt22_evolution_history(spark, sf):
    return L.newest(L.where_equal(X.evolutions(spark, sf), skill_slug="skill-3"), "timestamp", "id", 20).select("id", "status")


@query("SELECT event_id AS id, ts FROM events WHERE user_id = 11 ORDER BY ts, event_id")
def flt23_contributions(spark, sf):
    return X.table(spark, sf, "events").where("user_id = 11").orderBy("ts", "event_id").select(F.col("event_id").alias("id"), "ts")


@query(ctes("agents") + "SELECT agent_id, product, revision FROM agents WHERE user_id = 9 ORDER BY created_at DESC, agent_id")
def flt24_profiles_of_user(spark, sf):
    return L.newest(L.where_equal(X.agents(spark, sf), user_id=9), "created_at", "agent_id").select("agent_id", "product", "revision")


@query(ctes("agents") + "SELECT agent_id, display_name FROM agents WHERE user_id = 9 ORDER BY created_at, agent_id")
def flt25_agents_of_user(spark, sf):
    return L.newest(L.where_equal(X.agents(spark, sf), user_id=9), "created_at", "agent_id", oldest=True).select("agent_id", "display_name")


@query("SELECT s_suppkey AS token, s_name AS short_code FROM suppliers_of_user ORDER BY s_suppkey DESC".replace("suppliers_of_user", "(SELECT * FROM supplier WHERE s_nationkey = 3)"))
def flt26_shares_of_user(spark, sf):
    return X.table(spark, sf, "supplier").where("s_nationkey = 3").orderBy(F.col("s_suppkey").desc()).select(F.col("s_suppkey").alias("token"), F.col("s_name").alias("short_code"))


@query("SELECT s_suppkey AS token, s_nationkey AS user_id FROM supplier WHERE s_name = (SELECT s_name FROM supplier WHERE s_suppkey = 4)")
def flt27_share_by_code(spark, sf):
    s = X.table(spark, sf, "supplier")
    code = s.where("s_suppkey = 4").select("s_name")
    return s.join(code, "s_name", "left_semi").select(F.col("s_suppkey").alias("token"), F.col("s_nationkey").alias("user_id"))


@query(ctes("evolutions") + "SELECT id AS checkpoint FROM evolutions WHERE status = 'crystallized' ORDER BY timestamp DESC, id LIMIT 1")
def flt28_latest_checkpoint(spark, sf):
    done = X.evolutions(spark, sf).where("status = 'crystallized'")
    return done.agg(F.max_by("id", F.struct("timestamp", -F.col("id"))).alias("checkpoint"))


@query(ctes("evolutions") + "SELECT max(timestamp) AS finished_at FROM evolutions WHERE status = 'crystallized'")
def flt29_last_finished(spark, sf):
    return X.evolutions(spark, sf).where("status = 'crystallized'").agg(F.max("timestamp").alias("finished_at"))


@query(ctes("clusters", "members") + "SELECT cluster_id, topic, list(memory_id ORDER BY added_at, memory_id) AS member_ids FROM clusters JOIN members USING (cluster_id) GROUP BY cluster_id, topic")
def flt30_clusters_with_members(spark, sf):
    lists = X.members(spark, sf).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("added_at", "memory_id"))), lambda e: e["memory_id"]).alias("member_ids"))
    return X.clusters(spark, sf).join(lists, "cluster_id").select("cluster_id", "topic", "member_ids")


@query(ctes("clusters", "members") + "SELECT c.cluster_id, c.topic, m.memory_id FROM clusters c JOIN members m USING (cluster_id) WHERE cluster_id = 3 ORDER BY added_at, memory_id")
def flt31_cluster(spark, sf):
    return L.where_equal(X.clusters(spark, sf), cluster_id=3).join(X.members(spark, sf), "cluster_id").orderBy("added_at", "memory_id").select("cluster_id", "topic", "memory_id")


@query(ctes("members") + "SELECT min(cluster_id) AS cluster_id FROM members WHERE memory_id = 123")
def flt32_cluster_of_memory(spark, sf):
    return L.where_equal(X.members(spark, sf), memory_id=123).agg(F.min("cluster_id").alias("cluster_id"))


@query(ctes("members") + "SELECT memory_id FROM members WHERE cluster_id = 2 ORDER BY added_at, memory_id")
def flt33_member_ids(spark, sf):
    return L.newest(L.where_equal(X.members(spark, sf), cluster_id=2), "added_at", "memory_id", oldest=True).select("memory_id")


@query(ctes("agents") + "SELECT user_id, agent_id, product, revision FROM agents WHERE user_id = 5 AND agent_id = 105")
def flt34_profile(spark, sf):
    return L.where_equal(X.agents(spark, sf), user_id=5, agent_id=105).select("user_id", "agent_id", "product", "revision")


@query("SELECT s_suppkey AS token, s_name AS short_code FROM supplier WHERE s_suppkey = 7")
def flt35_share(spark, sf):
    return X.table(spark, sf, "supplier").where("s_suppkey = 7").select(F.col("s_suppkey").alias("token"), F.col("s_name").alias("short_code"))


@query("SELECT s_nationkey AS user_id, min(s_suppkey) AS token FROM supplier GROUP BY s_nationkey")
def flt36_share_of_agent(spark, sf):
    return X.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("user_id")).agg(F.min("s_suppkey").alias("token"))


@query("SELECT conv_id AS session, coalesce(max(turn) FILTER (WHERE role = 'assistant'), 0) AS lines FROM conversations GROUP BY conv_id")
def flt37_extract_progress(spark, sf):
    c = X.table(spark, sf, "conversations")
    done = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("n"))
    return c.select("conv_id").distinct().join(done, "conv_id", "left").select(F.col("conv_id").alias("session"), F.coalesce("n", F.lit(0)).alias("lines"))


@query("SELECT DISTINCT source AS slug FROM documents WHERE source NOT IN ('src3', 'src5') ORDER BY slug")
def flt38_classifiable_slugs(spark, sf):
    apart = spark.createDataFrame([("src3",), ("src5",)], "slug string")
    return X.table(spark, sf, "documents").select(F.col("source").alias("slug")).distinct().join(F.broadcast(apart), "slug", "left_anti").orderBy("slug")


@query(ctes("skills") + "SELECT slug, max(version) AS version FROM skills GROUP BY slug")
def flt42_latest_version(spark, sf):
    return X.skills(spark, sf).groupBy("slug").agg(F.max("version").alias("version"))


@query("SELECT source AS slug, coalesce(min(text) FILTER (WHERE lang = 'de'), min(text) FILTER (WHERE lang = 'fr'), min(text)) AS text FROM documents GROUP BY source")
def flt41_skill_text_with_fallbacks(spark, sf):
    d = X.table(spark, sf, "documents")
    first = lambda lang: F.min(F.when(F.col("lang") == lang, F.col("text")))
    return d.groupBy(F.col("source").alias("slug")).agg(F.coalesce(first("de"), first("fr"), F.min("text")).alias("text"))


@query(ctes("memories") + "SELECT id, memory_type, tier, hit_count, status, '' AS content, context, '' AS resolution FROM memories")
def prj01_detail_level(spark, sf):
    m = X.memories(spark, sf).select("id", "memory_type", "tier", "hit_count", "status", "content", "context", "resolution")
    return L.detail_level(m, "l1")


@query(ctes("segments") + "SELECT id, round(score, 4) AS quality_score, task_type FROM segments")
def prj02_enriched_segments(spark, sf):
    return quality.enriched(X.segments(spark, sf)).select("id", F.round("quality_score", 4).alias("quality_score"), "task_type")


@query(ctes("catalog") + "SELECT full_name AS slug, '1.0.0' AS version, CASE WHEN description_en <> '' THEN description_en ELSE description END AS description, CASE WHEN category_name = '' THEN 'general' ELSE category_name END AS category FROM catalog")
def prj04_catalog_as_skill(spark, sf):
    return X.catalog(spark, sf).select(
        F.col("full_name").alias("slug"), F.lit("1.0.0").alias("version"), F.coalesce(F.nullif("description_en", F.lit("")), "description").alias("description"), F.coalesce(F.nullif("category_name", F.lit("")), F.lit("general")).alias("category")
    )


@query(ctes("memories") + "SELECT id, hit_count FROM memories WHERE tier = 'hot' ORDER BY hit_count DESC, last_hit_at DESC, id LIMIT 50")
def top01_memories_of_tier(spark, sf):
    return X.memories(spark, sf).where("tier = 'hot'").orderBy(F.col("hit_count").desc(), F.col("last_hit_at").desc(), "id").limit(50).select("id", "hit_count")


@query(ctes("memories") + "SELECT id, hit_count FROM memories WHERE status = 'active' ORDER BY hit_count DESC, id LIMIT 20 OFFSET 40")
def top02_memory_page(spark, sf):
    m = X.memories(spark, sf).where("status = 'active'").select("id", "hit_count")
    return L.page(m, [F.col("hit_count").desc(), F.col("id")], 3, 20)


@query(ctes("skills") + "SELECT key, slug FROM skills ORDER BY published_at DESC, key LIMIT 100 OFFSET 100")
def top03_skill_page(spark, sf):
    return L.page(X.skills(spark, sf).select("key", "slug", "published_at"), [F.col("published_at").desc(), F.col("key")], 2, 500).select("key", "slug")


@query(ctes("clusters", "members") + "SELECT cluster_id, count(memory_id) AS n FROM clusters LEFT JOIN members USING (cluster_id) GROUP BY cluster_id, created_at ORDER BY created_at DESC, cluster_id")
def top05_all_clusters(spark, sf):
    n = X.members(spark, sf).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return X.clusters(spark, sf).join(n, "cluster_id", "left").orderBy(F.col("created_at").desc(), "cluster_id").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "SELECT slug, coalesce(max(title) FILTER (WHERE lang = 'fr'), max(title) FILTER (WHERE lang = 'en')) AS title FROM (SELECT source AS slug, lang, text AS title FROM documents) GROUP BY slug HAVING coalesce(max(title) FILTER (WHERE lang = 'fr'), max(title) FILTER (WHERE lang = 'en')) IS NOT NULL"
)
def api06_showcases_with_fallback(spark, sf):
    d = X.table(spark, sf, "documents").select(F.col("source").alias("slug"), "lang", "text")
    title = lambda lang: F.max(F.when(F.col("lang") == lang, F.col("text")))
    return d.groupBy("slug").agg(F.coalesce(title("fr"), title("en")).alias("title")).where("title IS NOT NULL")


@query("SELECT source AS slug, max(text) AS body FROM documents WHERE source = 'src2' AND lang = 'es' GROUP BY source")
def api09_showcase(spark, sf):
    return X.table(spark, sf, "documents").where("source = 'src2' AND lang = 'es'").groupBy(F.col("source").alias("slug")).agg(F.max("text").alias("body"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey = 17")
def api11_preset(spark, sf):
    return X.table(spark, sf, "part").where("p_partkey = 17").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
