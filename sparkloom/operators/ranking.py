"""Percentile tiers, leaderboards, overflow and contiguity checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.config import DEFAULTS
from sparkloom.scratch import saved


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place (from 1) in a total order, without one task for all rows.

    Rows are dealt once by range of the order, sorted inside their range, and numbered there by Spark's row ids, which
    hold the range's number and the row's; what is saved is read twice, for the sizes of the ranges before a row's
    own (one row a range), and for the rows. Pass only the columns that are needed: all of them are saved.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = saved(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("__id", 33).alias("__p"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(name, place + F.col("__before") + 1).drop("__p", "__id", "__before")


def tier_rebalance(memories: DataFrame, hot: float = DEFAULTS.hot_percent, warm: float = DEFAULTS.warm_percent) -> DataFrame:
    """(id, tier, hit_count, last_hit_at, rank, new_tier, changed, newly_hot) of memories that are not archived: the
    first ceil(n x hot %) by hits, last hit and id are hot, the next ceil(n x warm %) warm, the rest cold."""
    live = memories.where("status <> 'archived'").select("id", "tier", "hit_count", "last_hit_at")
    order = [F.col("hit_count").desc(), F.col("last_hit_at").desc(), F.col("id").asc()]
    total = live.count()
    n_hot, n_warm = math.ceil(total * hot / 100), math.ceil(total * warm / 100)
    ranked = global_rank(live, order)
    tier = F.when(F.col("rank") <= n_hot, "hot").when(F.col("rank") <= n_hot + n_warm, "warm").otherwise("cold")
    return ranked.withColumn("new_tier", tier).withColumns({"changed": F.col("tier") != F.col("new_tier"), "newly_hot": (F.col("new_tier") == "hot") & (F.col("tier") != "hot")})


def rebalance_summary(rebalanced: DataFrame) -> DataFrame:
    """One row: counts by tier, changes and newly hot."""
    return rebalanced.agg(
        F.count_if(F.col("new_tier") == "hot").alias("hot"),
        F.count_if(F.col("new_tier") == "warm").alias("warm"),
        F.count_if(F.col("new_tier") == "cold").alias("cold"),
        F.count_if("changed").alias("changed"),
        F.count_if("newly_hot").alias("newly_hot"),
    )


def leaderboard(memories: DataFrame, limit: int) -> DataFrame:
    """The active rows with most hits in each tier, ties by id; each task passes on at most `limit` a tier."""
    w = Window.partitionBy("tier").orderBy(F.col("hit_count").desc(), "id")
    return memories.where("status = 'active'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def warm_overflow(memories: DataFrame, most: int) -> DataFrame:
    """(id, hit_count, last_hit_at, rank) of the warm rows beyond the cap: those with fewest hits, then the longest unhit."""
    warm = memories.where("tier = 'warm' AND status <> 'archived'").select("id", "hit_count", "last_hit_at")
    over = max(0, warm.count() - most)
    return global_rank(warm, [F.col("hit_count"), F.col("last_hit_at"), F.col("id")]).where(F.col("rank") <= over)


def contiguous(segments: DataFrame) -> DataFrame:
    """(session, ok): whether a session's segments(session, start, end, n) run from 1 to n without gap or overlap."""
    w = Window.partitionBy("session").orderBy("start", "end")
    step = F.when(F.lag("end").over(w).isNull(), F.col("start") == 1).otherwise(F.col("start") == F.lag("end").over(w) + 1) & (F.col("end") >= F.col("start"))
    return segments.withColumn("ok", step).groupBy("session").agg((F.bool_and("ok") & (F.max("end") == F.max("n"))).alias("ok"))
