"""Clusters that grow row by row, as a batch and as a stream: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import clusters as C
from sparkloom.plans.evolution import LEADERS_SQL
from sparkloom.plans.registry import query
from sparkloom.scratch import new_path
from sparkloom.sources import fixtures as X
from sparkloom.sources.fixtures import ctes
from sparkloom.streaming import clustering

_ROWS = "own AS (SELECT {k} AS k, row_number() OVER (PARTITION BY {k} ORDER BY id) AS i, id, embedding AS v FROM vectors WHERE status <> 'archived'), "


def _sql(kind: str) -> str:
    return ctes("vectors").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _ROWS.format(k=kind) + LEADERS_SQL.format(rows="own")


@query(_sql("'all'") + " SELECT id, cluster_id FROM leaders WHERE id IS NOT NULL")
def pipe05_leader_clusters(spark, sf):
    return C.leader_clusters(X.vectors(spark, sf).where("status <> 'archived'"), 0.3).assigned


@query(_sql("'all'") + " SELECT cluster_id, count(*) AS n FROM leaders WHERE id IS NOT NULL GROUP BY cluster_id")
def pipe05_cluster_sizes(spark, sf):
    """Two calls, the second of which goes on from the clusters of the first."""
    live = X.vectors(spark, sf).where("status <> 'archived'")
    half = F.lit(live.agg(F.expr("percentile_approx(id, 0.5)")).first()[0])
    first = C.leader_clusters(live.where(F.col("id") <= half), 0.3)
    return C.leader_clusters(live.where(F.col("id") > half), 0.3, start=first.clusters).clusters.select("cluster_id", "n")


@query(_sql("memory_type") + " SELECT k AS shard, id, cluster_id FROM leaders WHERE id IS NOT NULL")
def pipe05_clusters_of_a_stream(spark, sf):
    """A stream that comes in two parts, with a restart in between: the clusters of each type go on from the state store."""
    live = X.vectors(spark, sf).where("status <> 'archived'").select(F.col("memory_type").alias("shard"), "id", "embedding")
    half = F.lit(live.agg(F.expr("percentile_approx(id, 0.5)")).first()[0])
    source, out, checkpoint = (new_path(spark, f"cluster-{n}") for n in ("source", "out", "checkpoint"))
    for part in (live.where(F.col("id") <= half), live.where(F.col("id") > half)):
        part.write.mode("append").parquet(source)
        clustering.run(spark.readStream.schema(live.schema).parquet(source), out, checkpoint, 0.3)
    return spark.read.parquet(out).select("shard", "id", "cluster_id")
