"""Skills out of clusters of memories: the gates that a synthesised skill must pass, what is saved, and the audit rows.

What a model does is an argument, a column function:
    synthesize(prompt, topic)  -> struct<quality, name, description, content>, null for no skill
    revise(skill text, version, prompt, number of new memories) -> struct<evolution, name, description, content>
    verify(content, prompt)    -> struct<grounded, contradiction, clarity, specificity, preserves>, null for not checked
    topic(summaries)           -> a label for at most TOPIC_ENTRIES summaries; quotes around it go, 80 characters stay
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.config import DEFAULTS
from sparkloom.functions import text as T
from sparkloom.operators.aggregates import members_since
from sparkloom.scratch import saved

_AUDIT = ["skill_slug", "cluster_id", "old_version", "new_version", "old_score", "new_score", "status", "trigger", "memory_count", "new_memory_ids", "mutation_summary"]


#: Memories of a cluster that a topic is made of.
TOPIC_ENTRIES = 10


def first_members(members: DataFrame, memories: DataFrame, most: int | None) -> DataFrame:
    """(cluster_id, i, memory_id): the first `most` memories of each cluster in the order they came, i from 1; all where most is None.

    Ranked on keys alone, and cut in every task before a cluster's rows meet."""
    known = members.select("cluster_id", "memory_id", "added_at").join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    placed = known.withColumn("i", F.row_number().over(Window.partitionBy("cluster_id").orderBy("added_at", "memory_id")))
    return (placed if most is None else placed.where(F.col("i") <= most)).select("cluster_id", "i", "memory_id")


def prompt(members: DataFrame, memories: DataFrame, most: int = 600, entries: int | None = None) -> DataFrame:
    """(cluster_id, n, ids, prompt): each cluster's number of memories, their ids in the order they came, and all of them, or the first
    `entries`, as text, fields cut to their share of `most` characters."""
    cut = lambda c, share: T.truncate(F.coalesce(c, F.lit("")), most // share)
    line = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(f"\n- {label}: "), F.col(c)))
    shown = first_members(members, memories, entries).join(memories.select(F.col("id").alias("memory_id"), "content", "context", "resolution"), "memory_id")
    short = shown.select("cluster_id", "i", "memory_id", cut(F.col("content"), 3).alias("c"), cut(F.col("context"), 4).alias("x"), cut(F.col("resolution"), 3).alias("r"))
    head = F.concat(F.lit("### Experience "), F.col("i"), F.lit(" (id: "), F.substring(F.col("memory_id").cast("string"), 1, 8), F.lit(")"))
    entry = F.concat(head, F.lit("\n- Content: "), F.col("c"), F.coalesce(line("Context", "x"), F.lit("")), F.coalesce(line("Resolution", "r"), F.lit("")))
    text = short.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", entry.alias("e")))), lambda e: e["e"]), "\n\n").alias("prompt"))
    known = members.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("added_at", "memory_id"))), lambda e: e["memory_id"])
    return known.groupBy("cluster_id").agg(F.count(F.lit(1)).cast("int").alias("n"), ids.alias("ids")).join(text, "cluster_id").select("cluster_id", "n", "ids", "prompt")


def summaries(members: DataFrame, memories: DataFrame, most: int = TOPIC_ENTRIES) -> DataFrame:
    """(cluster_id, summaries): a line for each of a cluster's first `most` memories, its short summary or the beginning of its
    content; those with neither are left out."""
    short = F.coalesce(F.nullif(F.col("summary_l0"), F.lit("")), F.substring("content", 1, 100)) if "summary_l0" in memories.columns else F.substring("content", 1, 100)
    lines = first_members(members, memories, most).join(memories.select(F.col("id").alias("memory_id"), short.alias("s")), "memory_id").where("coalesce(s, '') <> ''")
    return lines.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: F.concat(F.lit("- "), e["s"])), "\n").alias("summaries"))


def topic_label(said: Column) -> Column:
    """A model's answer as a label: without white space and quotes at its ends, at most 80 characters."""
    return F.substring(F.trim(F.trim(T.strip(said), F.lit('"')), F.lit("'")), 1, 80)


def _checked(rows: DataFrame, verify) -> DataFrame:
    """rows with bar, verified and score of the text `content`."""
    checked = verify(F.col("content"), F.col("prompt")) if verify else F.lit(None).cast("struct<grounded:double,contradiction:boolean,clarity:double,specificity:double,preserves:double>")
    v = rows.withColumn("v", checked)
    given = F.col("v").isNotNull()
    return v.withColumns(
        {
            "bar": T.quality_bar(F.col("content")),
            "verified": T.verification_passed(F.col("v.grounded"), F.col("v.contradiction"), given),
            "score": T.structure_score(F.col("v.clarity"), F.col("v.specificity"), F.col("v.preserves"), given),
        }
    ).drop("v")


def crystallize(clusters: DataFrame, members: DataFrame, memories: DataFrame, skills: DataFrame, synthesize=None, verify=None, topic=None, least: int = DEFAULTS.crystallize_members) -> DataFrame:
    """(cluster_id, outcome, topic, n, ids, slug, version, name, description, content, score) of clusters without a skill.

    outcome is the gate that a cluster ends at: too_few, insufficient, low_quality, unverified, or crystallized. Only
    the last have a slug: the name's, or one of the cluster's number, with the first free number behind it where
    skills(slug, version) or a cluster before has it.
    """
    p = prompt(members, memories)
    c = clusters.where("coalesce(skill_slug, '') = ''").select("cluster_id", "topic").join(p, "cluster_id", "left")
    label = F.lit("")
    if topic:
        c = c.join(summaries(members, memories), "cluster_id", "left")
        label = F.when(F.col("summaries").isNotNull(), topic_label(topic(F.col("summaries")))).otherwise("")
    c = c.withColumns({"n": F.coalesce("n", F.lit(0)), "topic": F.coalesce(F.nullif("topic", F.lit("")), label)})
    made = synthesize(F.col("prompt"), F.col("topic")) if synthesize else F.lit(None).cast("struct<quality:string,name:string,description:string,content:string>")
    m = c.withColumn("m", F.when(F.col("n") >= least, made)).select("*", "m.quality", "m.name", "m.description", "m.content")
    g = _checked(m, verify)
    poor = F.col("m").isNull() | F.coalesce(F.col("quality") == "insufficient", F.lit(False))
    outcome = F.when(F.col("n") < least, "too_few").when(poor, "insufficient").when(~F.col("bar"), "low_quality").when(~F.col("verified"), "unverified").otherwise("crystallized")
    g = g.withColumn("outcome", outcome)
    done = F.col("outcome") == "crystallized"
    base = F.coalesce(F.nullif(T.slug(F.col("name")), F.lit("")), F.concat(F.lit("cluster-"), F.substring(F.col("cluster_id").cast("string"), 1, 8)))
    # The k-th new one of a name takes the k-th number that is free; 0 is the name itself.
    new = g.where(done).select("cluster_id", base.alias("base")).withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("cluster_id")))
    used = skills.where("version = '1.0.0'").select(F.explode(F.array(F.struct(F.col("slug").alias("base"), F.lit(0).alias("i")), F.struct(F.regexp_extract("slug", r"^(.*)-(\d+)$", 1).alias("base"), F.regexp_extract("slug", r"^(.*)-(\d+)$", 2).try_cast("int").alias("i")))).alias("u"))
    taken = used.select("u.*").where("i IS NOT NULL").groupBy("base").agg(F.collect_set("i").alias("used"))
    free = new.join(taken, "base", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    number = F.get(F.array_except(F.sequence(F.lit(0), F.size("used") + F.col("k")), "used"), F.col("k") - 1)
    named = free.select("cluster_id", F.when(number == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), number)).alias("slug"))
    out = g.join(named, "cluster_id", "left")
    keep = lambda c: F.when(done, F.col(c)).alias(c)
    return out.select("cluster_id", "outcome", "topic", "n", "ids", "slug", F.when(done, "1.0.0").alias("version"), keep("name"), keep("description"), keep("content"), keep("score"))


def recrystallize(clusters: DataFrame, members: DataFrame, memories: DataFrame, skills: DataFrame, grown: DataFrame, revise=None, verify=None) -> DataFrame:
    """(cluster_id, outcome, skill_slug, n, ids, old_version, new_version, old_score, score, name, description, content) of
    clusters with a skill among skills(slug, version, name, description, text, structure_score), one row a slug.

    grown(cluster_id, n) counts the memories since the skill was made. outcome is unnecessary, low_quality,
    constraint_failed (not verified), revert (no better than before) or recrystallized.
    """
    s = skills.select(F.col("slug").alias("skill_slug"), F.col("version").alias("old_version"), F.col("name").alias("old_name"), F.col("description").alias("old_description"), "text", F.coalesce("structure_score", F.lit(0.0)).alias("old_score"))
    c = clusters.where("coalesce(skill_slug, '') <> ''").select("cluster_id", "skill_slug").join(s, "skill_slug").join(prompt(members, memories), "cluster_id")
    c = c.join(grown.select("cluster_id", F.col("n").alias("new_n")), "cluster_id", "left").withColumn("new_n", F.coalesce("new_n", F.lit(0)).cast("int"))
    made = revise(F.col("text"), F.col("old_version"), F.col("prompt"), F.col("new_n")) if revise else F.lit(None).cast("struct<evolution:string,name:string,description:string,content:string>")
    g = _checked(c.withColumn("m", made).select("*", "m.evolution", "m.name", "m.description", "m.content"), verify)
    idle = F.col("m").isNull() | F.coalesce(F.col("evolution") == "unnecessary", F.lit(False))
    better = F.col("score") > F.col("old_score")
    outcome = F.when(idle, "unnecessary").when(~F.col("bar"), "low_quality").when(~F.col("verified"), "constraint_failed").when(~better, "revert").otherwise("recrystallized")
    g = g.withColumn("outcome", outcome)
    done = F.col("outcome") == "recrystallized"
    last = F.when(done & (F.col("new_n") > 0), F.slice("ids", F.greatest(F.size("ids") - F.col("new_n") + 1, F.lit(1)), F.col("new_n")))
    either = lambda c: F.when(done, F.coalesce(F.nullif(c, F.lit("")), f"old_{c}")).alias(c)
    return g.select(
        "cluster_id", "outcome", "skill_slug", "n", last.alias("ids"), "old_version", F.when(done, T.bump_minor(F.col("old_version"))).alias("new_version"), "old_score",
        F.when(F.col("outcome").isin("revert", "recrystallized"), F.col("score")).when(F.col("outcome") == "constraint_failed", 0.0).alias("score"),
        either("name"), either("description"), F.when(done, F.col("content")).alias("content"),
    )


def audit_of_new(crystallized: DataFrame, trigger: str = "new_memory") -> DataFrame:
    """Audit rows of crystallize(): one for each skill made."""
    none = lambda kind: F.lit(None).cast(kind)
    return crystallized.where("outcome = 'crystallized'").select(
        F.col("slug").alias("skill_slug"), "cluster_id", none("string").alias("old_version"), F.col("version").alias("new_version"), none("double").alias("old_score"), F.col("score").alias("new_score"),
        F.lit("crystallized").alias("status"), F.lit(trigger).alias("trigger"), F.col("n").alias("memory_count"), F.col("ids").alias("new_memory_ids"),
        F.concat(F.lit("Crystallized from "), "n", F.lit(" memories")).alias("mutation_summary"),
    )


def audit_of_revised(revised: DataFrame, trigger: str = "new_memory") -> DataFrame:
    """Audit rows of recrystallize(): one for each skill that was revised, reverted or failed its verification."""
    two = lambda c: F.format_string("%.2f", c)
    ids = F.coalesce("ids", F.slice(F.array_repeat(F.get("ids", F.lit(0)), 1), 1, 0))
    summary = (
        F.when(F.col("outcome") == "recrystallized", F.concat(F.lit("Re-crystallized with "), F.size(ids), F.lit(" new memories")))
        .when(F.col("outcome") == "revert", F.concat(F.lit("Upgrade gate: "), two("score"), F.lit(" <= "), two("old_score")))
        .otherwise("Failed faithfulness verification")
    )
    return revised.where("outcome IN ('recrystallized', 'revert', 'constraint_failed')").select(
        "skill_slug", "cluster_id", "old_version", F.coalesce("new_version", F.lit("")).alias("new_version"), "old_score", F.col("score").alias("new_score"), F.col("outcome").alias("status"),
        F.lit(trigger).alias("trigger"), F.col("n").alias("memory_count"), ids.alias("new_memory_ids"), summary.alias("mutation_summary"),
    )


def with_audit(history: DataFrame, rows: DataFrame) -> DataFrame:
    """history with audit rows put at its end."""
    return history.select(*_AUDIT).unionByName(rows.select(*_AUDIT))


def with_skills(clusters: DataFrame, crystallized: DataFrame) -> DataFrame:
    """clusters with the topics and slugs that crystallize() gave."""
    new = crystallized.select("cluster_id", F.nullif("topic", F.lit("")).alias("__topic"), F.col("slug").alias("__slug"))
    out = clusters.join(new, "cluster_id", "left").withColumns({"topic": F.coalesce("__topic", "topic"), "skill_slug": F.coalesce("__slug", "skill_slug")})
    return out.drop("__topic", "__slug")


def cycle(clusters: DataFrame, members: DataFrame, memories: DataFrame, skills: DataFrame, evolutions: DataFrame, limit: int = DEFAULTS.evolution_batch, synthesize=None, revise=None, verify=None, topic=None) -> tuple[DataFrame, DataFrame]:
    """(crystallize(), recrystallize()) of one evolution cycle of at most `limit` skills made.

    The first `limit` clusters that are large enough and have no skill, the youngest first, are tried. What is left of the limit after those
    that succeeded, and no others, goes to clusters whose skill has enough new memories. skills(slug, version, name, description,
    text, structure_score) has one row a slug.
    """
    n = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    youngest = [F.col("created_at").desc(), F.col("cluster_id")]
    ready = clusters.where("coalesce(skill_slug, '') = ''").join(n.where(F.col("n") >= DEFAULTS.crystallize_members), "cluster_id", "left_semi").orderBy(*youngest).limit(limit)
    own = members.join(F.broadcast(ready.select("cluster_id")), "cluster_id", "left_semi")
    made = saved(crystallize(ready, own, memories, skills, synthesize, verify, topic), "evolved")
    remaining = limit - made.where("outcome = 'crystallized'").count()
    since = members_since(members, evolutions).where(F.col("n") >= DEFAULTS.recrystallize_delta)
    grown = clusters.where("coalesce(skill_slug, '') <> ''").join(since.select("cluster_id", "n"), "cluster_id").orderBy(*youngest).limit(max(remaining, 0))
    own = members.join(F.broadcast(grown.select("cluster_id")), "cluster_id", "left_semi")
    return made, recrystallize(grown.drop("n"), own, memories, skills, grown.select("cluster_id", "n"), revise, verify)
