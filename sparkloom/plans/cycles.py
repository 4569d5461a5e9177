"""The maintenance cycle over a stream that comes in two parts: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import quality
from sparkloom.plans.evolution import WINDOWS_SQL, digits
from sparkloom.plans.registry import query
from sparkloom.scratch import new_path
from sparkloom.sources import fixtures as X
from sparkloom.sources.fixtures import AS_OF, ctes
from sparkloom.streaming import cycle


@query(
    ctes("native").replace("WITH ", "WITH RECURSIVE ", 1)
    + WINDOWS_SQL(65536)
    + """, c AS (SELECT session, count(*) AS n FROM shown WHERE body IS NOT NULL GROUP BY session), g AS (SELECT p.session, p.msg_idx, CASE WHEN n <= 2 THEN 0 ELSE win END AS segment_index FROM packed p JOIN c USING (session)),
    spans AS (SELECT session, segment_index, min(msg_idx) AS start_line, max(msg_idx) AS end_line FROM g GROUP BY session, segment_index),
    t AS (SELECT s.session, s.segment_index, start_line, end_line, sum(length(body)) + count(body) - 1 AS size FROM spans s JOIN shown m ON m.session = s.session AND msg_idx BETWEEN start_line AND end_line GROUP BY ALL)
    SELECT session, segment_index, start_line, end_line, round(least(1.0, size / 200.0), 4) AS score, true AS labeled, round(least(1.0, size / 200.0), 4) >= 0.7 AS memory_extracted FROM t"""
)
def pipe16_cycle_segments(spark, sf):
    """The segments after two cycles: of each session's first two lines, then of all of them, which take the place of the former."""
    lines = X.native(spark, sf).select(*[f.split()[0] for f in cycle.SCHEMAS["messages"].split(", ")])
    store, source, checkpoint = cycle.Store(spark, new_path(spark, "state")), new_path(spark, "lines"), new_path(spark, "checkpoint")
    for part in (lines.where("msg_idx <= 2"), lines.where("msg_idx > 2")):
        part.write.mode("append").parquet(source)
        cycle.run_stream(store, spark.readStream.schema(lines.schema).parquet(source), cycle.steps(lambda _: AS_OF, embedder=digits), checkpoint).awaitTermination()
    failed = [r for r in map(store.record, store.records()) if r["status"] != "ok"]
    if failed:
        raise RuntimeError(f"maintenance: {failed}")
    s = store.tables()["segments"]
    return s.select("session", "segment_index", "start_line", "end_line", F.round(quality.score(F.col("quality_metrics")), 4).alias("score"), "labeled", "memory_extracted")
