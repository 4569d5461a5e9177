"""State changes (inserts, upserts, updates, deletes) as table-to-table queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS
from sparkloom.operators import writes as W
from sparkloom.operators.similarity import hit_events
from sparkloom.plans.registry import query
from sparkloom.sources import fixtures as X
from sparkloom.sources.fixtures import AS_OF, ctes

_M = ["id", "tier", "status", "hit_count"]


def _mem(spark, sf):
    return X.memories(spark, sf).select(*_M)


_OLD = ctes("memories") + ", m AS (SELECT id, tier, status, hit_count FROM memories)"


@query(_OLD + " SELECT * FROM m WHERE id % 10 <> 3 UNION ALL SELECT id, 'warm', 'active', 1 FROM m WHERE id % 10 = 3 UNION ALL SELECT id + 1000000, 'warm', 'active', 1 FROM m WHERE id % 10 = 3")
def dml01_upsert_memories(spark, sf):
    m = _mem(spark, sf)
    some = m.where("id % 10 = 3")
    new = some.unionByName(some.withColumn("id", F.col("id") + 1000000)).withColumns({"tier": F.lit("warm"), "status": F.lit("active"), "hit_count": F.lit(1).cast("long")})
    return W.upsert(m, new, ["id"])


@query(ctes("memories", "hits") + ", h AS (SELECT id, sum(weight) AS w, max(ts) AS t FROM hits GROUP BY id) SELECT m.id, CAST(m.hit_count + coalesce(w, 0) AS BIGINT) AS hit_count, greatest(last_hit_at, coalesce(t, last_hit_at)) AS last_hit_at FROM memories m LEFT JOIN h ON m.id = h.id")
def dml02_apply_hits(spark, sf):
    return W.apply_hits(X.memories(spark, sf), X.hits(spark, sf)).select("id", "hit_count", "last_hit_at")


@query(ctes("memories") + "SELECT id, hit_count + CASE WHEN id IN (4, 9) THEN 2 ELSE 0 END AS hit_count FROM memories")
def dml03_light_hits(spark, sf):
    h = hit_events(X.memories(spark, sf).where("id IN (4, 9)"), "2023-01-01", 2)
    return W.apply_hits(X.memories(spark, sf), h).select("id", "hit_count")


@query(ctes("memories") + "SELECT id, CASE WHEN id % 4 = 0 THEN 'new ' || id ELSE context END AS context, CASE WHEN id % 8 = 0 THEN 'r' ELSE resolution END AS resolution FROM memories")
def dml04_merged_body(spark, sf):
    m = X.memories(spark, sf).select("id", "context", "resolution")
    c = m.where("id % 4 = 0").select("id", F.concat(F.lit("new "), "id").alias("context"), F.when(F.col("id") % 8 == 0, "r").alias("resolution"))
    return W.update(m, c, ["id"], ["context", "resolution"])


@query(_OLD + " SELECT id, CASE WHEN id % 5 = 0 THEN 'hot' ELSE tier END AS tier, status, hit_count FROM m")
def dml05_batch_tiers(spark, sf):
    m = _mem(spark, sf)
    return W.update(m, m.where("id % 5 = 0").select("id", F.lit("hot").alias("tier")), ["id"], ["tier"])


@query(ctes("memories") + f"SELECT id, CASE WHEN tier = 'cold' AND status <> 'archived' AND (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_hit_at)) / 86400e6 > 30 THEN 'archived' ELSE status END AS status FROM memories")
def dml06_archive_stale(spark, sf):
    return W.archive_stale(X.memories(spark, sf), AS_OF, DEFAULTS.cold_ttl_days).select("id", "status")


@query(ctes("skills") + "SELECT slug, version, max(key) AS key FROM skills GROUP BY slug, version")
def dml07_upsert_skills(spark, sf):
    s = X.skills(spark, sf).select("slug", "version", "key")
    return W.upsert(s.limit(0), s.withColumn("__seq", F.col("key")), ["slug", "version"])


@query("SELECT DISTINCT source AS name, CASE WHEN source IN ('src1', 'src2') THEN 'old' ELSE 'new' END AS description FROM documents")
def dml08_new_categories(spark, sf):
    old = spark.createDataFrame([("src1", "old"), ("src2", "old")], "name string, description string")
    return W.insert_or_ignore(old, X.table(spark, sf, "documents").select(F.col("source").alias("name"), F.lit("new").alias("description")), ["name"])


@query(ctes("catalog") + "SELECT full_name, CASE WHEN key % 3 = 0 THEN 'renamed' ELSE name END AS name FROM catalog")
def dml09_upsert_catalog(spark, sf):
    c = X.catalog(spark, sf).select("full_name", "name")
    new = X.catalog(spark, sf).where("key % 3 = 0").select("full_name", F.lit("renamed").alias("name"))
    return W.upsert(c, new, ["full_name"])


@query(ctes("clusters") + "SELECT cluster_id, CASE WHEN cluster_id < 5 THEN 'changed' ELSE topic END AS topic, created_at FROM clusters UNION ALL SELECT 100, 'changed', TIMESTAMP '2024-03-01'")
def dml10_upsert_clusters(spark, sf):
    c = X.clusters(spark, sf).select("cluster_id", "topic", "created_at")
    ids = c.where("cluster_id < 5").select("cluster_id").unionByName(spark.createDataFrame([(100,)], "cluster_id long"))
    return W.upsert(c, ids.select("cluster_id", F.lit("changed").alias("topic"), F.lit("2024-03-01").cast("timestamp_ntz").alias("created_at")), ["cluster_id"], keep=["created_at"])


@query(ctes("members") + "SELECT cluster_id, memory_id FROM members UNION ALL SELECT cluster_id + 50, memory_id FROM members WHERE memory_id % 20 = 0")
def dml11_add_members(spark, sf):
    m = X.members(spark, sf).select("cluster_id", "memory_id")
    new = m.where("memory_id % 20 = 0")
    return W.insert_or_ignore(m, new.unionByName(new.withColumn("cluster_id", F.col("cluster_id") + 50)).unionByName(new), ["cluster_id", "memory_id"])


@query(ctes("segments") + "SELECT agent_id, session_file FROM segments GROUP BY agent_id, session_file")
def dml13_new_sessions(spark, sf):
    s = X.segments(spark, sf).select("agent_id", "session_file")
    return W.insert_or_ignore(s.where("agent_id < 50").distinct(), s, ["agent_id", "session_file"])


@query(ctes("segments") + "SELECT agent_id, session_file, task_type AS fingerprint FROM segments GROUP BY ALL")
def dml14_unique_segments(spark, sf):
    s = X.segments(spark, sf).select("agent_id", "session_file", F.get_json_object("quality_metrics", "$.summary.task_type").alias("fingerprint"))
    return W.insert_or_ignore(s.limit(0), s, ["agent_id", "session_file", "fingerprint"])


def _flag(spark, sf, condition, **values):
    return W.set_where(X.segments(spark, sf), condition, **values).select("id", "labeled", "memory_extracted", "segmented")


_FLAGS = "SELECT id, {} FROM segments"


@query(ctes("segments") + _FLAGS.format("labeled OR id % 50 = 0 AS labeled, memory_extracted, segmented"))
def dml15_segment_metrics(spark, sf):
    return _flag(spark, sf, F.col("id") % 50 == 0, labeled=True)


@query(ctes("segments") + _FLAGS.format("labeled, memory_extracted OR id % 40 = 1 AS memory_extracted, segmented"))
def dml16_mark_extracted(spark, sf):
    return _flag(spark, sf, F.col("id") % 40 == 1, memory_extracted=True)


@query(ctes("segments") + _FLAGS.format("labeled, CASE WHEN contains(session_file, '3') AND agent_id = 12 THEN false ELSE memory_extracted END AS memory_extracted, segmented"))
def dml17_reset_extracted(spark, sf):
    return W.reset_extracted(X.segments(spark, sf), "3", 12).select("id", "labeled", "memory_extracted", "segmented")


@query(ctes("segments") + "SELECT id FROM segments WHERE id % 9 <> 0")
def dml18_delete_segments(spark, sf):
    s = X.segments(spark, sf).select("id")
    return W.delete(s, s.where("id % 9 = 0"), ["id"])


@query(ctes("agents") + "SELECT user_id, agent_id, product, CASE WHEN agent_id % 6 = 0 THEN revision + 1 ELSE revision END AS revision FROM agents UNION ALL SELECT 0, 999999, 'p', 1")
def dml19_upsert_profiles(spark, sf):
    a = X.agents(spark, sf).select("user_id", "agent_id", "product", "revision")
    new = a.where("agent_id % 6 = 0").select("user_id", "agent_id", "product").unionByName(spark.createDataFrame([(0, 999999, "p")], "user_id long, agent_id long, product string"))
    return W.next_revision(a, new, ["user_id", "agent_id"], ["product"])


@query(ctes("agents") + "SELECT user_id, agent_id, CASE WHEN agent_id % 7 = 0 THEN 'renamed' ELSE display_name END AS display_name, created_at FROM agents")
def dml20_register_agents(spark, sf):
    a = X.agents(spark, sf).select("user_id", "agent_id", "display_name", "created_at")
    new = a.where("agent_id % 7 = 0").withColumns({"display_name": F.lit("renamed"), "created_at": F.lit(AS_OF).cast("timestamp_ntz")})
    return W.upsert(a, new, ["user_id", "agent_id"], keep=["created_at"])


@query(ctes("agents") + "SELECT 'agents' AS name, user_id, agent_id FROM agents WHERE NOT (user_id = 9) UNION ALL SELECT 'profiles', user_id, agent_id FROM agents WHERE revision > 3 AND NOT (user_id = 9)")
def dml21_delete_agents(spark, sf):
    a = X.agents(spark, sf).select("user_id", "agent_id", "revision")
    gone = a.where("user_id = 9")
    left = lambda d, name: W.delete(d, gone, ["user_id", "agent_id"]).select(F.lit(name).alias("name"), "user_id", "agent_id")
    return left(a, "agents").unionByName(left(a.where("revision > 3"), "profiles"))


def _shares(spark, sf):
    return X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("token"), F.col("s_nationkey").alias("user_id"), F.col("s_name").alias("snapshot"))


@query("SELECT s_suppkey AS token, s_nationkey AS user_id, s_name AS snapshot FROM supplier UNION ALL SELECT 100000, 1, 'new'")
def dml22_create_share(spark, sf):
    s = _shares(spark, sf)
    return W.insert_or_ignore(s, spark.createDataFrame([(100000, 1, "new"), (1, 1, "there already")], "token long, user_id int, snapshot string"), ["token"])


@query(ctes("segments") + "SELECT agent_id, session_file, max(segment_index) AS lines FROM segments GROUP BY agent_id, session_file")
def dml24_extract_cursor(spark, sf):
    s = X.segments(spark, sf).select("agent_id", "session_file", F.col("segment_index").alias("lines"))
    return W.upsert(s.limit(0), s.withColumn("__seq", F.col("lines")), ["agent_id", "session_file"])


@query(_OLD + " SELECT id, CASE WHEN id = 11 THEN 'cold' ELSE tier END AS tier, status, hit_count FROM m")
def dml28_one_tier(spark, sf):
    return W.set_where(_mem(spark, sf), F.col("id") == 11, tier="cold")


@query(_OLD + " SELECT id, tier, CASE WHEN id = 12 THEN 'archived' ELSE status END AS status, hit_count FROM m")
def dml29_one_status(spark, sf):
    return W.set_where(_mem(spark, sf), F.col("id") == 12, status="archived")


@query(ctes("clusters") + "SELECT cluster_id, CASE WHEN cluster_id = 1 THEN 'new-skill' ELSE skill_slug END AS skill_slug, topic FROM clusters")
def dml30_cluster_skill(spark, sf):
    return W.set_where(X.clusters(spark, sf), F.col("cluster_id") == 1, skill_slug="new-skill").select("cluster_id", "skill_slug", "topic")


@query(ctes("members", "vectors") + ", e AS (SELECT cluster_id, embedding[1] AS x FROM members JOIN vectors ON memory_id = id) SELECT cluster_id, round(avg(x), 4) AS first FROM e GROUP BY cluster_id")
def dml31_cluster_centroid(spark, sf):
    from sparkloom.operators.similarity import centroids

    c = X.clusters(spark, sf).select("cluster_id", F.lit(None).cast("array<double>").alias("centroid"))
    new = W.update(c, centroids(X.members(spark, sf), X.vectors(spark, sf)), ["cluster_id"], ["centroid"])
    return new.select("cluster_id", F.round(F.element_at("centroid", 1), 4).alias("first"))


@query(ctes("clusters") + "SELECT cluster_id, skill_slug, CASE WHEN cluster_id = 2 THEN 'renamed' ELSE topic END AS topic FROM clusters")
def dml32_cluster_topic(spark, sf):
    return W.set_where(X.clusters(spark, sf), F.col("cluster_id") == 2, topic="renamed").select("cluster_id", "skill_slug", "topic")


@query(ctes("segments") + "SELECT id, CASE WHEN id % 100 = 0 THEN 0.5 ELSE round(score, 4) END AS score, labeled OR id % 100 = 0 AS labeled FROM segments")
def dml33_trajectory_metrics(spark, sf):
    from sparkloom.functions.quality import score

    s = W.set_where(X.segments(spark, sf), F.col("id") % 100 == 0, quality_metrics='{"summary":{"overall_score":0.5}}', labeled=True)
    return s.select("id", F.round(score(F.col("quality_metrics")), 4).alias("score"), "labeled")


@query(ctes("segments") + _FLAGS.format("labeled, memory_extracted OR id = 77 AS memory_extracted, segmented"))
def dml34_mark_session_extracted(spark, sf):
    return _flag(spark, sf, F.col("id") == 77, memory_extracted=True)


@query(ctes("segments") + _FLAGS.format("labeled, memory_extracted, segmented OR (agent_id = 5 AND session_file = 's1') AS segmented"))
def dml35_mark_segmented(spark, sf):
    return _flag(spark, sf, (F.col("agent_id") == 5) & (F.col("session_file") == "s1"), segmented=True)


@query("SELECT s_suppkey AS token, s_nationkey AS user_id, CASE WHEN s_suppkey = 3 THEN 'fresh' ELSE s_name END AS snapshot FROM supplier")
def dml36_share_snapshot(spark, sf):
    return W.set_where(_shares(spark, sf), F.col("token") == 3, snapshot="fresh")


@query("SELECT s_suppkey AS token, s_nationkey AS user_id, s_name AS snapshot FROM supplier WHERE s_suppkey <> 3")
def dml37_delete_share(spark, sf):
    s = _shares(spark, sf)
    return W.delete(s, s.where("token = 3"), ["token"])


@query(ctes("agents") + f"SELECT agent_id, CASE WHEN agent_id = 8 THEN TIMESTAMP '{AS_OF}' ELSE created_at END AS last_sync_at FROM agents")
def dml38_agent_sync(spark, sf):
    a = X.agents(spark, sf).select("agent_id", F.col("created_at").alias("last_sync_at"))
    return W.set_where(a, F.col("agent_id") == 8, last_sync_at=F.lit(AS_OF).cast("timestamp_ntz"))


@query(ctes("evolutions") + "SELECT id, CASE WHEN id = 7 THEN 'completed' ELSE status END AS status FROM evolutions")
def dml39_run_status(spark, sf):
    return W.set_where(X.evolutions(spark, sf), F.col("id") == 7, status="completed").select("id", "status")


@query(ctes("segments") + "SELECT agent_id, session_file, count(*) AS rows FROM segments GROUP BY agent_id, session_file")
def dml41_get_or_create_session(spark, sf):
    s = X.segments(spark, sf).select("agent_id", "session_file")
    have = W.insert_or_ignore(s.where("agent_id % 2 = 0").distinct(), s, ["agent_id", "session_file"])
    return have.join(s, ["agent_id", "session_file"]).groupBy("agent_id", "session_file").agg(F.count(F.lit(1)).alias("rows"))


@query(ctes("skills") + "SELECT key, CASE WHEN r > 1 THEN slug || '-' || r ELSE slug END AS unique_slug FROM (SELECT key, slug, row_number() OVER (PARTITION BY slug, version ORDER BY key) AS r FROM skills)")
def dml43_unique_slugs(spark, sf):
    return W.unique_slugs(X.skills(spark, sf), ["slug", "version"], "key").select("key", "unique_slug")
