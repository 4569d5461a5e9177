"""Counting and statistics, each in one pass over its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS
from sparkloom.functions.quality import score


def memory_stats(memories: DataFrame) -> DataFrame:
    """(grouping, value, n): counts by tier, by type, by status and in all, by one grouping-sets aggregate."""
    sets = memories.groupingSets([["tier"], ["memory_type"], ["status"], []], "tier", "memory_type", "status").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    # The id's bits are set for the columns that are left out: tier 4, memory_type 2, status 1.
    kind = F.when(F.col("g") == 3, "tier").when(F.col("g") == 5, "memory_type").when(F.col("g") == 6, "status").otherwise("total")
    return sets.select(kind.alias("grouping"), F.coalesce("tier", "memory_type", "status", F.lit("all")).alias("value"), "n")


def segment_stats(segments: DataFrame, metrics: str = "quality_metrics") -> DataFrame:
    """One row of nine figures; the mean of no score is 0."""
    s = segments.withColumn("__s", F.when(F.col("labeled"), score(F.col(metrics))))
    v = F.col("__s")
    return s.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("labeled").alias("labeled"),
        F.count_if(v >= DEFAULTS.memory_score).alias("memory_eligible"),
        F.count_if(v >= DEFAULTS.sft_score).alias("sft_eligible"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("avg_score"),
        F.count_if(v >= 0.85).alias("excellent"),
        F.count_if((v >= 0.7) & (v < 0.85)).alias("good"),
        F.count_if(F.col("labeled") & (v.isNull() | (v < 0.7))).alias("weak"),
        F.count_if("memory_extracted").alias("extracted"),
    )


def trajectory_stats(sessions: DataFrame, metrics: str = "quality_metrics") -> DataFrame:
    """One row of six figures on session rows."""
    v = F.when(F.col("labeled"), score(F.col(metrics)))
    return sessions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("segmented").alias("segmented"),
        F.count_if("labeled").alias("labeled"),
        F.count_if(v >= DEFAULTS.memory_score).alias("memory_eligible"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("avg_score"),
        F.count_if("memory_extracted").alias("extracted"),
    )


def category_counts(skills: DataFrame, categories: DataFrame) -> DataFrame:
    """(name, skill_count) for every category, 0 where no skill has it."""
    n = skills.select(F.explode("categories").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("k"))
    return categories.join(n, "name", "left").select("name", F.coalesce("k", F.lit(0)).alias("skill_count"))


def dimension_rollup(skills: DataFrame, dimension_of: dict[str, str], other: str = "other") -> DataFrame:
    """(dimension, skills): a skill counts once in each of its categories."""
    pairs = F.create_map(*[F.lit(x) for kv in dimension_of.items() for x in kv])
    d = F.coalesce(F.try_element_at(pairs, F.col("c")), F.lit(other))
    return skills.select(F.explode("categories").alias("c")).groupBy(d.alias("dimension")).agg(F.count(F.lit(1)).alias("skills"))


def members_since(members: DataFrame, evolutions: DataFrame) -> DataFrame:
    """(cluster_id, n): members added after the cluster's last (re)crystallisation, all if there is none."""
    last = evolutions.where(F.col("status").isin("crystallized", "recrystallized")).groupBy("cluster_id").agg(F.max("timestamp").alias("last"))
    joined = members.join(last, "cluster_id", "left")
    return joined.groupBy("cluster_id").agg(F.count_if(F.col("last").isNull() | (F.col("added_at") > F.col("last"))).alias("n"))


def adoption(hits: DataFrame) -> DataFrame:
    """(id, hit_count, created_at, last_hit_at) of a hit log; one hit is the row's own."""
    return hits.groupBy("id").agg((F.sum("weight") + 1).alias("hit_count"), F.min("ts").alias("created_at"), F.max("ts").alias("last_hit_at"))


def eligible(segments: DataFrame, least: float, metrics: str = "quality_metrics", since: Column | None = None) -> DataFrame:
    """Labelled segments whose score reaches `least`, and newer than `since` where that is given."""
    out = segments.where(F.col("labeled") & (score(F.col(metrics)) >= least))
    return out.where(F.col("created_at") > since) if since is not None else out
