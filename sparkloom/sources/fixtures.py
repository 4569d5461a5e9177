"""The domain tables as views of the driver's tables, each with the DuckDB text that defines the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import messages as M
from sparkloom.functions.text import WHITE
from sparkloom.scratch import saved

AS_OF = "2024-02-01 00:00:00"
TYPES = ["pattern", "error", "security", "life", "correction", "preference"]
TIERS = ["hot", "warm", "cold"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """df over all tasks: a small file of many rows is read by one, and what is then done to each row takes long.

    Written, as Spark moves filters below an exchange and would read texts for them in the one task."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return saved(df.repartition(n, *key), "dealt")


def _pick(values: list[str], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _after(minutes: str):
    return F.expr(f"TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, {minutes}, 0)")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.col("lang").alias("context"),
        F.col("source").alias("resolution"),
        _pick(TYPES, "doc_id").alias("memory_type"),
        _pick(TIERS, "doc_id").alias("tier"),
        (F.col("doc_id") % 50 + 1).alias("hit_count"),
        F.when(F.col("doc_id") % 17 == 0, "archived").otherwise("active").alias("status"),
        _after("doc_id").alias("created_at"),
        _after("(doc_id * 37) % 43200").alias("last_hit_at"),
        F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("src:"), "source")).alias("tags"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        _pick(TYPES, "label").alias("memory_type"),
        _pick(TIERS, "vec_id").alias("tier"),
        (F.col("vec_id") % 50 + 1).alias("hit_count"),
        F.when(F.col("vec_id") % 17 == 0, "archived").otherwise("active").alias("status"),
        _after("(vec_id * 37) % 43200").alias("last_hit_at"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").alias("label"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("agent_id"),
        F.concat(F.lit("s"), F.col("event_id") % 5).alias("session_file"),
        F.col("event_id").alias("segment_index"),
        F.concat(F.lit('{"summary":{"overall_score":'), F.round(k.cast("double") / 100, 2), F.lit(',"task_type":"'), "event_type", F.lit('"}}')).alias("quality_metrics"),
        (F.col("event_id") % 4 != 0).alias("labeled"),
        (F.col("event_id") % 3 == 0).alias("memory_extracted"),
        (F.col("event_id") % 7 == 0).alias("segmented"),
        F.col("ts").alias("created_at"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(table(spark, sf_dir, "events"))


def hits_of(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").alias("id"), F.col("ts").alias("ts"), F.when(F.col("event_type") == "click", 2).otherwise(1).cast("long").alias("weight"))


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        (F.col("p_partkey") % 500).cast("string").alias("slug"),
        F.concat(F.lit("1."), F.col("p_partkey") % 7, F.lit(".0")).alias("version"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.split("p_type", " ").alias("categories"),
        (F.lit(1704067200000) + F.col("p_partkey") * 1000).alias("published_at"),
        F.col("p_partkey").alias("key"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("full_name"),
        F.concat(F.lit("doc "), F.col("doc_id")).alias("name"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Doc "), F.col("doc_id"))).alias("display_name"),
        F.col("text").alias("description"),
        F.when(F.col("lang") == "en", F.reverse("text")).otherwise(F.lit("")).alias("description_en"),
        F.col("lang").alias("category_id"),
        F.col("source").alias("category_name"),
        F.col("doc_id").alias("key"),
        _after("doc_id").alias("created_at"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir)
    return m.select("cluster_id").distinct().select(
        "cluster_id",
        F.concat(F.lit("topic "), "cluster_id").alias("topic"),
        F.when(F.col("cluster_id") % 2 == 0, F.concat(F.lit("skill-"), "cluster_id")).otherwise(F.lit("")).alias("skill_slug"),
        _after("cast(cluster_id as long) * 60").alias("created_at"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("memory_id"), _after("vec_id * 30").alias("added_at"))


def evolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 10).alias("cluster_id"),
        F.concat(F.lit("skill-"), F.col("o_custkey") % 10).alias("skill_slug"),
        F.when(F.col("o_orderstatus") == "F", "crystallized").when(F.col("o_orderstatus") == "O", "recrystallized").otherwise("revert").alias("status"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").alias("new_score"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("id"), F.concat(F.regexp_extract("url", "://([^/]*)", 1), F.lit("/upload")).alias("source"), F.length("html").cast("long").alias("size"), _after("page_id").alias("created_at"), F.encode("html", "UTF-8").alias("payload"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session"), (F.col("turn") + 1).alias("msg_idx"), "role", F.col("text").alias("content"))


def native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages with the fields of native ones: every second assistant message has a reason, every third a call."""
    m = messages(spark, sf_dir)
    assistant = F.col("role") == "assistant"
    call = F.concat(F.lit('[{"id": "c'), F.col("msg_idx"), F.lit('", "type": "function", "function": {"name": "look", "arguments": "{\\"n\\": '), F.col("msg_idx"), F.lit('}"}}]'))
    return m.withColumns(
        {
            "reasoning_content": F.when(assistant, F.when(F.col("msg_idx") % 2 == 0, F.concat(F.lit("why "), F.col("msg_idx"))).otherwise("")),
            "tool_calls": F.when(assistant & (F.col("msg_idx") % 3 == 0), call),
            "name": F.lit(None).cast("string"),
            "tool_call_id": F.lit(None).cast("string"),
            "stop_reason": F.when(assistant & (F.col("session") % 2 == 0), F.lit(" end ")),
        }
    ).withColumn("body", M.body())


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        (F.col("c_custkey") % 100).alias("user_id"),
        F.col("c_custkey").alias("agent_id"),
        F.col("c_name").alias("display_name"),
        F.col("c_mktsegment").alias("product"),
        (F.col("c_custkey") % 9 + 1).alias("revision"),
        _after("c_custkey").alias("created_at"),
    )


_MEM_TYPE = "(['pattern','error','security','life','correction','preference'])"
SQL = {
    "memories": f"""memories AS (SELECT doc_id AS id, text AS content, lang AS context, source AS resolution, {_MEM_TYPE}[doc_id % 6 + 1] AS memory_type,
        (['hot','warm','cold'])[doc_id % 3 + 1] AS tier, doc_id % 50 + 1 AS hit_count, CASE WHEN doc_id % 17 = 0 THEN 'archived' ELSE 'active' END AS status,
        TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 37) % 43200) AS last_hit_at,
        ['lang:' || lang, 'src:' || source] AS tags FROM documents)""",
    "vectors": f"""vectors AS (SELECT vec_id AS id, {_MEM_TYPE}[label % 6 + 1] AS memory_type, (['hot','warm','cold'])[vec_id % 3 + 1] AS tier,
        vec_id % 50 + 1 AS hit_count, CASE WHEN vec_id % 17 = 0 THEN 'archived' ELSE 'active' END AS status,
        TIMESTAMP '2024-01-01' + to_minutes((vec_id * 37) % 43200) AS last_hit_at, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings)""",
    "segments": """segments AS (SELECT event_id AS id, user_id AS agent_id, 's' || (event_id % 5) AS session_file, event_id AS segment_index,
        CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS score, event_type AS task_type, event_id % 4 <> 0 AS labeled, event_id % 3 = 0 AS memory_extracted,
        event_id % 7 = 0 AS segmented, ts AS created_at FROM events)""",
    "hits": "hits AS (SELECT user_id AS id, ts, CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS weight FROM events)",
    "skills": """skills AS (SELECT CAST(p_partkey % 500 AS VARCHAR) AS slug, '1.' || (p_partkey % 7) || '.0' AS version, p_name AS name, p_type AS description,
        string_split(p_type, ' ') AS categories, 1704067200000 + p_partkey * 1000 AS published_at, p_partkey AS key FROM part)""",
    "catalog": """catalog AS (SELECT CAST(doc_id AS VARCHAR) AS full_name, 'doc ' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Doc ' || doc_id END AS display_name,
        text AS description, CASE WHEN lang = 'en' THEN reverse(text) ELSE '' END AS description_en, lang AS category_id,
        source AS category_name, doc_id AS key, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at FROM documents)""",
    "members": "members AS (SELECT CAST(label AS BIGINT) AS cluster_id, vec_id AS memory_id, TIMESTAMP '2024-01-01' + to_minutes(vec_id * 30) AS added_at FROM embeddings)",
    "clusters": """clusters AS (SELECT DISTINCT CAST(label AS BIGINT) AS cluster_id, 'topic ' || label AS topic, CASE WHEN label % 2 = 0 THEN 'skill-' || label ELSE '' END AS skill_slug,
        TIMESTAMP '2024-01-01' + to_minutes(CAST(label AS BIGINT) * 60) AS created_at FROM embeddings)""",
    "evolutions": """evolutions AS (SELECT o_orderkey AS id, o_custkey % 10 AS cluster_id, 'skill-' || (o_custkey % 10) AS skill_slug,
        CASE o_orderstatus WHEN 'F' THEN 'crystallized' WHEN 'O' THEN 'recrystallized' ELSE 'revert' END AS status, o_orderdate AS timestamp, o_totalprice AS new_score FROM orders)""",
    "uploads": """uploads AS (SELECT page_id AS id, regexp_extract(url, '://([^/]*)', 1) || '/upload' AS source, CAST(length(html) AS BIGINT) AS size,
        TIMESTAMP '2024-01-01' + to_minutes(page_id) AS created_at FROM pages)""",
    "messages": "messages AS (SELECT conv_id AS session, turn + 1 AS msg_idx, role, text AS content FROM conversations)",
    "native": r"""native AS (SELECT conv_id AS session, turn + 1 AS msg_idx, role, text AS content, {s} AS said, role = 'assistant' AND turn % 2 = 1 AS thinks,
        'why ' || (turn + 1) AS reason, CASE WHEN role = 'assistant' AND (turn + 1) % 3 = 0 THEN '[{{"id": "c' || (turn + 1) || '", "type": "function", "function": {{"name": "look", "arguments": "{{\"n\": ' || (turn + 1) || '}}"}}}}]' END AS calls,
        role = 'assistant' AND conv_id % 2 = 0 AS stops FROM conversations),
        shown AS (SELECT *, CASE WHEN role = 'assistant' THEN nullif(concat_ws(chr(10) || chr(10), CASE WHEN thinks THEN '[reasoning]' || chr(10) || reason END, '[tool_calls]' || chr(10) || calls, nullif(said, '')), '')
        WHEN role = 'tool' THEN said ELSE nullif(said, '') END AS body FROM native)""".format(s="trim(text, '" + WHITE + "')"),
    "agents": """agents AS (SELECT c_custkey % 100 AS user_id, c_custkey AS agent_id, c_name AS display_name, c_mktsegment AS product, c_custkey % 9 + 1 AS revision,
        TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS created_at FROM customer)""",
}


def ctes(*names: str) -> str:
    """WITH clause of the named domain tables."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
