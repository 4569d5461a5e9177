"""Joins, similarity, aggregates, windows and set operations: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS
from sparkloom.functions import text as T
from sparkloom.operators import aggregates as A
from sparkloom.operators import ranking as R
from sparkloom.operators import similarity as S
from sparkloom.operators import writes as W
from sparkloom.plans.registry import query
from sparkloom.sources import fixtures as X
from sparkloom.sources.fixtures import AS_OF, ctes

# Phrase vectors of the search queries: unit vectors with a few terms, written as values in both engines.
PHRASES = [[1.0 if i % 8 == 0 else 0.0 for i in range(64)], [1.0 if i % 5 == 1 else -0.5 if i % 7 == 0 else 0.0 for i in range(64)]]
_P = ["[" + ",".join(map(str, p)) + "]::DOUBLE[]" for p in PHRASES]
_COS = "coalesce(list_cosine_similarity(embedding, {p}), 0)"
_BEST = "greatest(" + ", ".join(_COS.format(p=p) for p in _P) + ")"
_HOT = f"exp(-0.05 * greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_hit_at), 0) / 86400e6)"
_BOOST = "CASE tier WHEN 'hot' THEN 1.2 WHEN 'warm' THEN 1.0 WHEN 'cold' THEN 0.8 ELSE 1.0 END"
#: Vectors of the test tables are far apart, so thresholds are low here.
LOW = 0.3


@query(ctes("clusters", "members") + "SELECT cluster_id, count(*) AS n FROM clusters JOIN members USING (cluster_id) WHERE skill_slug = '' GROUP BY cluster_id, created_at HAVING count(*) >= 5 ORDER BY created_at DESC, cluster_id")
def jon01_ready_to_crystallize(spark, sf):
    n = X.members(spark, sf).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= DEFAULTS.crystallize_members)
    return X.clusters(spark, sf).where("coalesce(skill_slug, '') = ''").join(n, "cluster_id").orderBy(F.col("created_at").desc(), "cluster_id").select("cluster_id", "n")


@query(ctes("clusters", "members") + "SELECT cluster_id, count(*) AS n FROM clusters JOIN members USING (cluster_id) WHERE skill_slug = '' GROUP BY cluster_id HAVING count(*) >= 5")
def flt39_clusters_ready(spark, sf):
    return jon01_ready_to_crystallize(spark, sf)


@query(ctes("members") + "SELECT cluster_id, list(memory_id ORDER BY added_at, memory_id) AS ids FROM members GROUP BY cluster_id")
def jon02_members_by_cluster(spark, sf):
    return X.members(spark, sf).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("added_at", "memory_id"))), lambda e: e["memory_id"]).alias("ids"))


@query(ctes("memories") + "SELECT id, tier FROM memories WHERE id IN (3, 5, 8, 13, 999999)")
def jon03_memories_by_ids(spark, sf):
    ids = spark.createDataFrame([(i,) for i in (3, 5, 8, 13, 999999)], "id long")
    return X.memories(spark, sf).join(F.broadcast(ids), "id", "left_semi").select("id", "tier")


@query(ctes("members", "vectors") + "SELECT cluster_id, memory_id, status, hit_count FROM members JOIN vectors ON memory_id = id ORDER BY cluster_id, added_at, memory_id")
def jon04_cluster_memories(spark, sf):
    some = X.vectors(spark, sf).select(F.col("id").alias("memory_id"), "status", "hit_count")
    return X.members(spark, sf).join(some, "memory_id").orderBy("cluster_id", "added_at", "memory_id").select("cluster_id", "memory_id", "status", "hit_count")


@query(
    ctes("vectors")
    + f""", s AS (SELECT id, tier, greatest(0, {_BEST}) AS sim, greatest(0, greatest(0, {_BEST}) * ({_BOOST}) * (0.9 + 0.1 * {_HOT})) AS score FROM vectors WHERE status <> 'archived')
    SELECT id, tier, round(sim, 4) AS sim, round(score, 4) AS score FROM s ORDER BY s.score DESC, id LIMIT 10"""
)
def jon05_semantic_search(spark, sf):
    r = S.search_memories(X.vectors(spark, sf), PHRASES, AS_OF)
    return r.select("id", "tier", F.round("sim", 4).alias("sim"), F.round("score", 4).alias("score"))


def _both(spark, sf):
    v = X.vectors(spark, sf).select("id", "label", "embedding")
    own = v.where("label < 5").select(F.col("id").alias("key"), F.concat(F.lit("s"), F.col("label")).alias("slug"), F.lit("internal").alias("source"), "embedding")
    other = v.where("label >= 5").select((F.col("id") + 100000).alias("key"), F.concat(F.lit("c"), F.col("label")).alias("slug"), F.lit("catalog").alias("source"), "embedding")
    return own.unionByName(other)


_BOTHSQL = """, u AS (SELECT id AS key, 's' || label AS slug, 'internal' AS source, embedding FROM vectors WHERE label < 5
    UNION ALL SELECT id + 100000, 'c' || label, 'catalog', embedding FROM vectors WHERE label >= 5)"""


@query(ctes("vectors") + _BOTHSQL + f", s AS (SELECT key, slug, source, greatest(0, {_BEST}) AS score FROM u) SELECT key, slug, source, round(score, 4) AS score FROM s ORDER BY s.score DESC, key LIMIT 5")
def jon06_skill_search(spark, sf):
    return S.search_skills(_both(spark, sf), PHRASES).select("key", "slug", "source", F.round("score", 4).alias("score"))


@query(
    ctes("vectors")
    + _BOTHSQL
    + f""", s AS (SELECT key, slug, greatest(0, {_BEST}) AS score FROM u ORDER BY score DESC, key LIMIT 10),
    b AS (SELECT key, slug, CASE WHEN slug IN ('s1', 'c7') THEN score * 1.15 ELSE score END AS raised FROM s)
    SELECT key, slug, round(raised, 4) AS score FROM b ORDER BY raised DESC, key LIMIT 5"""
)
def jon07_search_with_memory_context(spark, sf):
    linked = spark.createDataFrame([("s1",), ("c7",), ("s1",)], "slug string")
    return S.with_memory_context(_both(spark, sf), PHRASES, linked).select("key", "slug", F.round("score", 4).alias("score"))


@query(
    ctes("vectors")
    + f""", p AS (SELECT a.id AS new_id, b.id, b.tier, list_cosine_similarity(a.embedding, b.embedding) AS sim FROM vectors a JOIN vectors b
        ON a.memory_type = b.memory_type WHERE a.id % 100 = 0 AND b.id % 100 <> 0 AND b.status <> 'archived'),
    r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY sim DESC, CASE tier WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END, id) AS r FROM p WHERE sim >= {LOW})
    SELECT new_id, id, round(sim, 4) AS sim FROM r WHERE r = 1"""
)
def jon08_near_duplicate(spark, sf):
    v = X.vectors(spark, sf)
    new = v.where("id % 100 = 0").select(F.col("id").alias("new_id"), "memory_type", "embedding")
    return S.nearest_duplicate(new, v.where("id % 100 <> 0"), LOW).select("new_id", "id", F.round("sim", 4).alias("sim"))


_PAIRS = f""", p AS (SELECT a.id AS id_a, b.id AS id_b, a.hit_count AS ha, b.hit_count AS hb, list_cosine_similarity(a.embedding, b.embedding) AS sim FROM vectors a JOIN vectors b
    ON a.memory_type = b.memory_type AND a.id < b.id WHERE a.status <> 'archived' AND b.status <> 'archived' AND list_cosine_similarity(a.embedding, b.embedding) >= {LOW})"""


@query(ctes("vectors") + _PAIRS + " SELECT CASE WHEN ha >= hb THEN id_a ELSE id_b END AS winner, CASE WHEN ha >= hb THEN id_b ELSE id_a END AS loser, round(sim, 4) AS sim FROM p")
def jon09_consolidation_pairs(spark, sf):
    return S.consolidation_pairs(X.vectors(spark, sf), LOW).select("winner", "loser", F.round("sim", 4).alias("sim"))


_CENT = """, e AS (SELECT cluster_id, unnest(range(1, 65)) AS p, unnest(embedding) AS x FROM members JOIN vectors ON memory_id = id),
    m AS (SELECT cluster_id, p, avg(x) AS x FROM e GROUP BY cluster_id, p), c AS (SELECT cluster_id, list(x ORDER BY p) AS centroid FROM m GROUP BY cluster_id)"""


@query(
    ctes("members", "vectors")
    + _CENT
    + f""", s AS (SELECT id, cluster_id, list_cosine_similarity(embedding, centroid) AS sim FROM vectors CROSS JOIN c),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, cluster_id) AS r FROM s)
    SELECT id, CASE WHEN sim >= {LOW} THEN cluster_id END AS cluster_id, CASE WHEN sim >= {LOW} THEN round(sim, 4) END AS sim FROM r WHERE r = 1"""
)
def jon10_assign_to_cluster(spark, sf):
    c = S.centroids(X.members(spark, sf), X.vectors(spark, sf))
    return S.nearest_centroid(X.vectors(spark, sf), c, LOW).select("id", "cluster_id", F.round("sim", 4).alias("sim"))


@query(ctes("skills") + ", n AS (SELECT unnest(categories) AS name FROM skills), c AS (SELECT unnest(['STEEL','TIN','COPPER','GOLD','LARGE','none']) AS name) SELECT c.name, count(n.name) AS skill_count FROM c LEFT JOIN n ON c.name = n.name GROUP BY c.name")
def jon11_categories_with_counts(spark, sf):
    c = spark.createDataFrame([(x,) for x in ("STEEL", "TIN", "COPPER", "GOLD", "LARGE", "none")], "name string")
    return A.category_counts(X.skills(spark, sf), c)


@query(ctes("memories") + "SELECT id, CASE WHEN list_contains(tags, 'lang:de') THEN 'archived' ELSE status END AS status FROM memories")
def jon12_tagged(spark, sf):
    return W.archive_by_tag(X.memories(spark, sf), "lang:de").select("id", "status")


@query(
    ctes("memories")
    + """SELECT 'tier' AS "grouping", tier AS value, count(*) AS n FROM memories GROUP BY tier UNION ALL SELECT 'memory_type', memory_type, count(*) FROM memories GROUP BY memory_type
    UNION ALL SELECT 'status', status, count(*) FROM memories GROUP BY status UNION ALL SELECT 'total', 'all', count(*) FROM memories"""
)
def agg01_memory_stats(spark, sf):
    return A.memory_stats(X.memories(spark, sf))


@query(ctes("memories") + "SELECT count(*) AS n FROM memories WHERE memory_type = 'life' AND tier = 'cold'")
def agg02_memory_count(spark, sf):
    return X.memories(spark, sf).where("memory_type = 'life' AND tier = 'cold'").agg(F.count(F.lit(1)).alias("n"))


_SEG = """count(*) AS total, count(*) FILTER (WHERE labeled) AS labeled, count(*) FILTER (WHERE labeled AND score >= 0.7) AS memory_eligible"""


@query(
    ctes("segments")
    + f"""SELECT {_SEG}, count(*) FILTER (WHERE labeled AND score >= 0.8) AS sft_eligible, round(coalesce(avg(score) FILTER (WHERE labeled), 0), 4) AS avg_score,
    count(*) FILTER (WHERE labeled AND score >= 0.85) AS excellent, count(*) FILTER (WHERE labeled AND score >= 0.7 AND score < 0.85) AS good,
    count(*) FILTER (WHERE labeled AND (score IS NULL OR score < 0.7)) AS weak, count(*) FILTER (WHERE memory_extracted) AS extracted FROM segments"""
)
def agg03_segment_stats(spark, sf):
    return A.segment_stats(X.segments(spark, sf)).withColumn("avg_score", F.round("avg_score", 4))


@query(
    ctes("segments")
    + """SELECT count(*) AS total, count(*) FILTER (WHERE segmented) AS segmented, count(*) FILTER (WHERE labeled) AS labeled, count(*) FILTER (WHERE labeled AND score >= 0.7) AS memory_eligible,
    round(coalesce(avg(score) FILTER (WHERE labeled), 0), 4) AS avg_score, count(*) FILTER (WHERE memory_extracted) AS extracted FROM segments"""
)
def agg04_trajectory_stats(spark, sf):
    return A.trajectory_stats(X.segments(spark, sf)).withColumn("avg_score", F.round("avg_score", 4))


@query(ctes("segments") + "SELECT count(*) AS sessions_total, count(*) FILTER (WHERE segmented) AS sessions_segmented, count(*) FILTER (WHERE labeled AND score >= 0.85) AS excellent FROM segments")
def agg05_composite_stats(spark, sf):
    s = X.segments(spark, sf)
    t = A.trajectory_stats(s).select(F.col("total").alias("sessions_total"), F.col("segmented").alias("sessions_segmented"))
    return t.crossJoin(A.segment_stats(s).select("excellent"))


@query(ctes("catalog") + "SELECT category_id, min(category_name) AS category_name, count(*) AS n, count(*) FILTER (WHERE description_en <> '') AS with_en FROM catalog GROUP BY category_id")
def agg06_catalog_stats(spark, sf):
    return X.catalog(spark, sf).groupBy("category_id").agg(F.min("category_name").alias("category_name"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("description_en") != "").alias("with_en"))


@query(ctes("skills", "catalog") + "SELECT name, sum(n) AS n FROM (SELECT c AS name, count(*) AS n FROM (SELECT unnest(categories) AS c FROM skills) GROUP BY c UNION ALL SELECT category_name, count(*) FROM catalog GROUP BY category_name) GROUP BY name".replace("sum(n)", "CAST(sum(n) AS BIGINT)"))
def agg07_overview(spark, sf):
    own = X.skills(spark, sf).select(F.explode("categories").alias("name"))
    return own.unionByName(X.catalog(spark, sf).select(F.col("category_name").alias("name"))).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


_DIM = {"STEEL": "metal", "TIN": "metal", "COPPER": "metal", "NICKEL": "metal", "BRASS": "metal", "LARGE": "size", "SMALL": "size", "MEDIUM": "size"}


@query(
    ctes("skills")
    + """SELECT CASE WHEN c IN ('STEEL','TIN','COPPER','NICKEL','BRASS') THEN 'metal' WHEN c IN ('LARGE','SMALL','MEDIUM') THEN 'size' ELSE 'other' END AS dimension, count(*) AS skills
    FROM (SELECT unnest(categories) AS c FROM skills) GROUP BY dimension"""
)
def agg08_category_dimensions(spark, sf):
    return A.dimension_rollup(X.skills(spark, sf), _DIM)


_SINCE = "TIMESTAMP '2024-01-10 00:00:00'"


@query(ctes("segments") + f"SELECT count(*) AS eligible FROM segments WHERE labeled AND score >= 0.8 AND created_at > {_SINCE}")
def agg09_eligible_since(spark, sf):
    return A.eligible(X.segments(spark, sf), DEFAULTS.sft_score, since=F.lit("2024-01-10").cast("timestamp_ntz")).agg(F.count(F.lit(1)).alias("eligible"))


_EVO = """, e AS (SELECT cluster_id, TIMESTAMP '2024-01-05' + to_hours(cluster_id) AS timestamp, status FROM evolutions WHERE cluster_id < 6),
    l AS (SELECT cluster_id, max(timestamp) AS last FROM e WHERE status IN ('crystallized', 'recrystallized') GROUP BY cluster_id),
    n AS (SELECT m.cluster_id, count(*) FILTER (WHERE last IS NULL OR added_at > last) AS n FROM members m LEFT JOIN l ON m.cluster_id = l.cluster_id GROUP BY m.cluster_id)"""


def _since(spark, sf):
    e = X.evolutions(spark, sf).where("cluster_id < 6").select("cluster_id", F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00' + make_dt_interval(0, cluster_id, 0, 0)").alias("timestamp"), "status")
    return A.members_since(X.members(spark, sf), e)


@query(ctes("members", "evolutions") + _EVO + " SELECT cluster_id, n FROM n")
def agg10_members_since(spark, sf):
    return _since(spark, sf)


@query(ctes("members", "evolutions", "clusters") + _EVO + " SELECT c.cluster_id, n FROM clusters c JOIN n ON c.cluster_id = n.cluster_id WHERE skill_slug <> '' AND n >= 3")
def top06_ready_to_recrystallize(spark, sf):
    ready = _since(spark, sf).where(F.col("n") >= DEFAULTS.recrystallize_delta)
    return X.clusters(spark, sf).where("skill_slug <> ''").join(ready, "cluster_id").select("cluster_id", "n")


@query(ctes("members", "vectors") + _CENT + " SELECT cluster_id, p - 1 AS p, round(x, 4) + 0.0 AS x FROM m")
def agg11_centroids(spark, sf):
    c = S.centroids(X.members(spark, sf), X.vectors(spark, sf))
    return c.select("cluster_id", F.posexplode("centroid").alias("p", "x")).select("cluster_id", F.col("p").cast("long").alias("p"), (F.round("x", 4) + 0.0).alias("x"))


@query("SELECT count(*) AS files, sum(length(html)) AS bytes, round(sum(length(html)) / 1048576.0, 2) AS mb FROM pages".replace("sum(length(html)) AS bytes", "CAST(sum(length(html)) AS BIGINT) AS bytes"))
def agg12_storage_stats(spark, sf):
    return X.uploads(spark, sf).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.round(F.sum("size") / 1048576.0, 2).alias("mb"))


@query(ctes("memories") + "SELECT (SELECT count(*) FROM memories) AS memories, (SELECT count(*) FROM part) AS skills, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS vectors")
def agg13_all_stats(spark, sf):
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    return n(X.memories(spark, sf), "memories").crossJoin(n(X.skills(spark, sf), "skills")).crossJoin(n(X.vectors(spark, sf).where("embedding IS NOT NULL"), "vectors"))


@query(ctes("hits") + "SELECT id, CAST(sum(weight) + 1 AS BIGINT) AS hit_count, min(ts) AS created_at, max(ts) AS last_hit_at FROM hits GROUP BY id")
def agg14_adoption(spark, sf):
    return A.adoption(X.hits(spark, sf))


_TIER = """, r AS (SELECT id, tier, row_number() OVER (ORDER BY hit_count DESC, last_hit_at DESC, id) AS rank, count(*) OVER () AS n FROM memories WHERE status <> 'archived'),
    t AS (SELECT id, tier, rank, CASE WHEN rank <= ceil(n * 0.1) THEN 'hot' WHEN rank <= ceil(n * 0.1) + ceil(n * 0.4) THEN 'warm' ELSE 'cold' END AS new_tier FROM r)"""


@query(ctes("memories") + _TIER + " SELECT id, new_tier, tier <> new_tier AS changed FROM t")
def win01_tier_rebalance(spark, sf):
    return R.tier_rebalance(X.memories(spark, sf)).select("id", "new_tier", "changed")


@query(ctes("memories") + _TIER + " SELECT id, rank FROM t")
def win02_ranked_ids(spark, sf):
    live = X.memories(spark, sf).where("status <> 'archived'")
    return R.global_rank(live, [F.col("hit_count").desc(), F.col("last_hit_at").desc(), F.col("id").asc()]).select("id", F.col("rank").cast("long").alias("rank"))


_LEAD = " SELECT tier, id, hit_count, rank FROM (SELECT tier, id, hit_count, row_number() OVER (PARTITION BY tier ORDER BY hit_count DESC, id) AS rank FROM memories WHERE status = 'active') WHERE rank <= {n}"


@query(ctes("memories") + _LEAD.format(n=20))
def win03_tier_leaderboard(spark, sf):
    return R.leaderboard(X.memories(spark, sf), 20).select("tier", "id", "hit_count", F.col("rank").cast("long").alias("rank"))


@query(ctes("memories") + _LEAD.format(n=200))
def top04_leaderboard_page(spark, sf):
    return R.leaderboard(X.memories(spark, sf), max(1, min(200, 500))).select("tier", "id", "hit_count", F.col("rank").cast("long").alias("rank"))


@query(ctes("memories") + ", w AS (SELECT *, row_number() OVER (ORDER BY hit_count, last_hit_at, id) AS r, count(*) OVER () AS n FROM memories WHERE tier = 'warm' AND status <> 'archived') SELECT id, hit_count FROM w WHERE r <= n - 100")
def win04_warm_overflow(spark, sf):
    return R.warm_overflow(X.memories(spark, sf), 100).select("id", "hit_count")


@query(
    """WITH s AS (SELECT conv_id AS session, turn + 1 AS s, turn + 1 AS e FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn = 1)), n AS (SELECT conv_id AS session, max(turn) + 1 AS n FROM conversations GROUP BY conv_id),
    j AS (SELECT s.session, s, e, n, lag(e) OVER (PARTITION BY s.session ORDER BY s, e) AS prev FROM s JOIN n ON s.session = n.session)
    SELECT session, bool_and(CASE WHEN prev IS NULL THEN s = 1 ELSE s = prev + 1 END) AND max(e) = max(n) AS ok FROM j GROUP BY session"""
)
def win05_contiguous_segments(spark, sf):
    c = X.table(spark, sf, "conversations")
    n = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("n"))
    s = c.where("NOT (conv_id % 5 = 0 AND turn = 1)").join(n, "conv_id").select(F.col("conv_id").alias("session"), (F.col("turn") + 1).alias("start"), (F.col("turn") + 1).alias("end"), "n")
    return R.contiguous(s)


@query(ctes("skills", "catalog") + "SELECT 'internal' AS source, CAST(key AS VARCHAR) AS id, name FROM skills UNION ALL SELECT 'catalog', full_name, name FROM catalog")
def set01_skill_union(spark, sf):
    own = X.skills(spark, sf).select(F.lit("internal").alias("source"), F.col("key").cast("string").alias("id"), "name")
    return own.unionByName(X.catalog(spark, sf).select(F.lit("catalog").alias("source"), F.col("full_name").alias("id"), "name"))


_TAGS = "['  ' || upper(event_type), event_type, 'user:' || (user_id % 3), '', 'User:' || (user_id % 3), 'k' || (event_id % 2)]"


@query(
    f"""WITH t AS (SELECT event_id, unnest({_TAGS}) AS raw, unnest(range(6)) AS i FROM events), c AS (SELECT event_id, trim(raw) AS t, i FROM t WHERE trim(raw) <> ''),
    f AS (SELECT event_id, arg_min(t, i) AS t, min(i) AS i FROM c GROUP BY event_id, lower(t)) SELECT event_id, list(t ORDER BY i) AS tags FROM f GROUP BY event_id"""
)
def set02_merged_tags(spark, sf):
    e = X.table(spark, sf, "events")
    raw = F.array(
        F.concat(F.lit("  "), F.upper("event_type")), F.col("event_type"), F.concat(F.lit("user:"), F.col("user_id") % 3), F.lit(""), F.concat(F.lit("User:"), F.col("user_id") % 3), F.concat(F.lit("k"), F.col("event_id") % 2)
    )
    return e.select("event_id", T.fold_tags(raw, DEFAULTS.tag_cap).alias("tags"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN ['View'] ELSE [upper(event_type[1:1]) || event_type[2:], 'view'] END AS phrases FROM events")
def set03_distinct_phrases(spark, sf):
    e = X.table(spark, sf, "events")
    return e.select("event_id", T.fold_tags(F.array(F.concat(F.lit(" "), F.initcap("event_type")), F.col("event_type"), F.lit("view ")), None).alias("phrases"))


@query(
    ctes("segments")
    + """, old AS (SELECT agent_id, segment_index AS i, md5(task_type) AS fp FROM segments WHERE segment_index % 7 <> 0), new AS (SELECT agent_id, segment_index AS i, md5(CASE WHEN segment_index % 10 = 0 THEN task_type || 'x' ELSE task_type END) AS fp FROM segments WHERE segment_index % 11 <> 0)
    SELECT 'inserted' AS what, i FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.agent_id = new.agent_id AND old.fp = new.fp AND old.i = new.i)
    UNION ALL SELECT 'superseded', old.i FROM old JOIN new ON old.agent_id = new.agent_id AND old.i = new.i AND old.fp <> new.fp"""
)
def set04_fingerprint_difference(spark, sf):
    s = X.segments(spark, sf).select("agent_id", F.col("segment_index").alias("i"), F.get_json_object("quality_metrics", "$.summary.task_type").alias("t"))
    # Each side lacks some rows of every range.
    old = s.where("i % 7 <> 0").select("agent_id", "i", F.md5("t").alias("fp"))
    new = s.where("i % 11 <> 0").select("agent_id", "i", F.md5(F.when(F.col("i") % 10 == 0, F.concat("t", F.lit("x"))).otherwise(F.col("t"))).alias("fp"))
    added = new.join(old, ["agent_id", "fp", "i"], "left_anti").select(F.lit("inserted").alias("what"), "i")
    gone = old.alias("o").join(new.alias("n"), ["agent_id", "i"]).where("o.fp <> n.fp").select(F.lit("superseded").alias("what"), "i")
    return added.unionByName(gone)


@query(ctes("messages") + "SELECT session, msg_idx, role FROM messages WHERE trim(content) <> '' OR role = 'tool'")
def set07_kept_messages(spark, sf):
    return X.messages(spark, sf).where("trim(content) <> '' OR role = 'tool'").select("session", "msg_idx", "role")
