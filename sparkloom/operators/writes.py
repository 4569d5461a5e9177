"""State changes as functions from tables to tables; the caller writes the result as the next snapshot.

Each is one join or anti join on the key: nothing is read back row by row, and a repeated run gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """old with the rows of new put in by key; columns in keep stay as they were where the row is there already.

    Of several new rows with a key the last by __seq counts, if new has that column.
    """
    if "__seq" in new.columns:
        w = Window.partitionBy(*key).orderBy(F.col("__seq").desc())
        new = new.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__seq")
    cols = old.columns
    both = old.select(F.struct(*cols).alias("o"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]).join(
        new.select(F.struct(*cols).alias("n"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]), [f"__k{i}" for i in range(len(key))], "full"
    )
    pick = lambda c: F.when(F.col("n").isNull(), F.col(f"o.{c}")).when(F.col("o").isNotNull() & F.lit(c in keep), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select(*[pick(c).alias(c) for c in cols])


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and those rows of new, one a key, whose key old lacks."""
    fresh = new.dropDuplicates(key).join(old.select(*key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def update(old: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """old with columns taken from changes where its key is there and the value not null."""
    c = changes.select(*key, *[F.col(x).alias(f"__{x}") for x in columns])
    return old.join(c, key, "left").select(*[F.coalesce(f"__{x}", x).alias(x) if x in columns else F.col(x) for x in old.columns])


def set_where(old: DataFrame, condition: Column, **values) -> DataFrame:
    """old with columns set where the condition holds."""
    return old.withColumns({k: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def delete(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return old.join(keys.select(*key).distinct(), key, "left_anti")


def archive_stale(memories: DataFrame, as_of: str, ttl_days: float) -> DataFrame:
    """Cold rows not hit for more than ttl_days (fractions count) archived; 0 days archives nothing."""
    if ttl_days <= 0:
        return memories
    age = F.timestamp_diff("MICROSECOND", F.col("last_hit_at"), F.lit(as_of).cast("timestamp_ntz")) / F.lit(86_400_000_000.0)
    stale = (F.col("tier") == "cold") & (F.col("status") != "archived") & (age > ttl_days)
    return set_where(memories, stale, status="archived")


def archive_by_tag(memories: DataFrame, tag: str) -> DataFrame:
    return set_where(memories, F.array_contains("tags", tag) & (F.col("status") != "archived"), status="archived")


def reset_extracted(segments: DataFrame, session_contains: str | None = None, agent_id=None) -> DataFrame:
    """The extracted flag cleared for sessions whose file name has the text and, or, an agent's; never for all."""
    if not session_contains and agent_id is None:
        raise ValueError("a session text or an agent is needed")
    hit = F.lit(True)
    if session_contains:
        hit = hit & F.contains("session_file", F.lit(session_contains))
    if agent_id is not None:
        hit = hit & (F.col("agent_id") == F.lit(agent_id))
    return set_where(segments, hit, memory_extracted=False)


def apply_hits(memories: DataFrame, hits: DataFrame) -> DataFrame:
    """memories with a hit log's weights added and its latest time taken."""
    h = hits.groupBy("id").agg(F.sum("weight").alias("__w"), F.max("ts").alias("__t"))
    return memories.join(h, "id", "left").withColumns({"hit_count": F.col("hit_count") + F.coalesce("__w", F.lit(0)), "last_hit_at": F.greatest("last_hit_at", "__t")}).drop("__w", "__t")


def next_revision(profiles: DataFrame, changed: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """profiles with columns of changed put in by key, the revision raised by one, or 1 for new keys."""
    new = changed.join(profiles.select(*key, F.col("revision").alias("__rev")), key, "left").withColumn("revision", F.coalesce(F.col("__rev") + 1, F.lit(1).cast("long"))).drop("__rev")
    return upsert(profiles, new.select(*profiles.columns), key)


def unique_slugs(skills: DataFrame, by: list[str], order: str) -> DataFrame:
    """skills with `unique_slug`: the second and later of a slug get -2, -3, .."""
    w = Window.partitionBy(*by).orderBy(order)
    n = F.row_number().over(w)
    return skills.withColumn("__n", n).withColumn("unique_slug", F.when(F.col("__n") > 1, F.concat("slug", F.lit("-"), "__n")).otherwise(F.col("slug"))).drop("__n")
