"""Search from query texts, details and the hits that reading leaves: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS
from sparkloom.operators import search as Q
from sparkloom.plans.analytics import _BOOST, _HOT
from sparkloom.plans.registry import query, strip_sql
from sparkloom.scratch import new_path
from sparkloom.sources import fixtures as X
from sparkloom.sources.fixtures import AS_OF, ctes
from sparkloom.streaming import maintenance


def sha_digits(text):
    """An embedder that SQL can say as well: the 64 hexadecimal digits of the text's SHA-256 around zero."""
    h = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("double") - 7.5)


_VECTOR = "list_transform(range(1, 65), lambda i: strpos('0123456789abcdef', substr(sha256({t}), i, 1)) - 8.5)"


def _analyzer(query):
    """Stand-in for a model: the query spelled otherwise, its first 40 characters, and the last of its lines, none for queries of few characters."""
    return F.when(F.length(query) >= 60, F.array(F.concat(F.lit(" "), F.replace(query, F.lit("e"), F.lit("E"))), F.substring(query, 1, 40), F.substring_index(query, "\n", -1), F.lit("  ")))


#: The query first, then what the analyzer gives, each once without regard to case.
_PHRASES = f"""q AS (SELECT conv_id * 100 + turn AS query_id, text FROM conversations WHERE role = 'user'),
    g AS (SELECT query_id, {strip_sql('text')} AS own, CASE WHEN length(text) >= 60 THEN list_filter(list_transform([' ' || replace(text, 'e', 'E'), substring(text, 1, 40), string_split(text, chr(10))[-1], '  '], lambda x: {strip_sql('x')}), lambda x: x <> '') ELSE [] END AS given FROM q),
    o AS (SELECT query_id, CASE WHEN len(given) = 0 OR own = '' THEN [own] WHEN lower(given[1]) = lower(own) THEN given ELSE list_prepend(own, given) END AS l FROM g),
    ph AS (SELECT query_id, arg_min(p, i) AS phrase, min(i) AS i FROM (SELECT query_id, unnest(l) AS p, unnest(range(len(l))) AS i FROM o) GROUP BY query_id, lower(p))"""


def _queries(spark, sf):
    return X.table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")


@query(f"WITH {_PHRASES} SELECT query_id, list(phrase ORDER BY i) AS phrases FROM ph GROUP BY query_id")
def udf12_analyzed_queries(spark, sf):
    return _queries(spark, sf).select("query_id", Q.phrases(F.col("text"), _analyzer).alias("phrases"))


@query(
    ctes("vectors") + f""", {_PHRASES}, pv AS MATERIALIZED (SELECT query_id, {_VECTOR.format(t='phrase')} AS v FROM ph),
    live AS (SELECT id, embedding, ({_BOOST}) * (0.9 + 0.1 * {_HOT}) AS factor FROM vectors WHERE status <> 'archived'),
    s AS (SELECT query_id, id, greatest(0, round(max(list_cosine_similarity(v, embedding)), 12)) AS sim, any_value(factor) AS factor FROM pv, live GROUP BY query_id, id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT *, greatest(0, round(sim * factor, 12)) AS score FROM s))
    SELECT query_id, rank, id, round(sim, 6) AS sim, round(score, 6) AS score FROM r WHERE rank <= 10"""
)
def jon05_query_texts(spark, sf):
    """Every user turn of the conversations as a query."""
    out = Q.search_texts(_queries(spark, sf), X.vectors(spark, sf), AS_OF, sha_digits, _analyzer)
    return out.select("query_id", "rank", "id", F.round("sim", 6).alias("sim"), F.round("score", 6).alias("score"))


def _requests(spark, sf):
    """Each event asks for its user's number and two others; some are unknown, some asked for twice."""
    e = X.table(spark, sf, "events")
    ids = F.array(F.col("user_id"), F.col("event_id") % 97, F.when(F.col("event_id") % 5 == 0, F.col("user_id")).otherwise(F.lit(10**9)))
    return e.select(F.col("event_id").alias("request"), F.posexplode(ids).alias("pos", "id"))


_ASKED = "asked AS (SELECT event_id AS request, unnest([user_id, event_id % 97, CASE WHEN event_id % 5 = 0 THEN user_id ELSE 1000000000 END]) AS id, unnest([0, 1, 2]) AS pos FROM events)"


@query(ctes("memories") + f", {_ASKED} SELECT request, pos, m.id, tier, hit_count + 2 * n AS hit_count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY request, pos) AS n FROM asked) a JOIN memories m ON m.id = a.id")
def pipe17_details(spark, sf):
    return Q.details(X.memories(spark, sf), _requests(spark, sf)).select("request", "pos", "id", "tier", "hit_count")


@query(ctes("memories") + f", {_ASKED}, n AS (SELECT id, 2 * count(*) AS hits FROM asked GROUP BY id) SELECT m.id, hit_count + coalesce(hits, 0) AS hit_count, CASE WHEN hits > 0 THEN TIMESTAMP '{AS_OF}' ELSE last_hit_at END AS last_hit_at FROM memories m LEFT JOIN n USING (id)")
def pipe17_hits_of_details(spark, sf):
    """The memories after all those readings."""
    hits = Q.hits_of_details(_requests(spark, sf), AS_OF).groupBy("id").agg(F.sum("weight").alias("__hits"), F.max("ts").alias("__ts"))
    out = X.memories(spark, sf).select("id", "hit_count", "last_hit_at").join(hits, "id", "left")
    return out.select("id", (F.col("hit_count") + F.coalesce("__hits", F.lit(0))).alias("hit_count"), F.coalesce("__ts", "last_hit_at").alias("last_hit_at"))


@query(ctes("hits") + " SELECT date_trunc('day', ts) AS day, id, sum(weight)::BIGINT AS hits FROM hits WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM hits) GROUP BY ALL")
def dml02_hit_stream(spark, sf):
    """Hits by day as a stream with a watermark, each closed day put in by key, so that a batch that comes again changes nothing."""
    events = X.table(spark, sf, "events")
    source, out = new_path(spark, "events"), new_path(spark, "hit-days")
    events.write.parquet(source)
    stream = maintenance.adoption_stream(X.hits_of(spark.readStream.schema(events.schema).parquet(source)))
    maintenance.apply_by_batch(stream.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "id", "hits"), out, new_path(spark, "checkpoint"))
    return spark.read.parquet(out).select("day", "id", "hits")
