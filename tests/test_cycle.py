"""The maintenance cycle: killed, replayed and failing, against one that runs through."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import evolution as E
from sparkloom.streaming import cycle

GOOD = "when it fails, use this: " + "x" * 450 + "\n1. a\n2. b\n3. c"


def line(session, i, role, text):
    return (session, i, role, text, None, None, None, None, None, text)


def batches(spark):
    one = [line(s, i, "user" if i % 2 else "assistant", f"line {i if s < 6 else i + s} of what is said " * 6) for s in range(8) for i in (1, 2)]
    two = [line(s, i, "user" if i % 2 else "assistant", f"more {i} {s} " * 9) for s in range(4) for i in (3, 4)]
    make = lambda rows: spark.createDataFrame(rows, cycle.SCHEMAS["messages"])
    return make(one), make(two)


def steps():
    flat = lambda t: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.conv(F.substring(F.md5(t), i, F.lit(1)), 16, 10).cast("double") + 1)
    new = lambda prompt, topic: F.struct(F.lit("ok").alias("quality"), F.lit("A skill").alias("name"), F.lit("d").alias("description"), F.lit(GOOD).alias("content"))
    return cycle.steps(lambda b: f"2024-01-0{b + 1} 00:00:00", embedder=flat, synthesize=new, cluster=0.5, trigger=3)


def state(store):
    return {n: sorted(map(str, t.drop("embedding", "sums").collect())) for n, t in store.tables().items()}


class Killed(BaseException):
    pass


def test_killed_and_replayed_batches_change_nothing(spark, tmp_path):
    one, two = batches(spark)
    through = cycle.Store(spark, f"file://{tmp_path}/a")
    assert set(cycle.run_cycle(through, one, 0, steps()).values()) == {"ok"}
    assert set(cycle.run_cycle(through, two, 1, steps()).values()) == {"ok"}
    want = state(through)
    assert len(want["messages"]) == 24 and len(want["segments"]) == 8 and want["memories"] and want["clusters"] and want["runs"]
    assert list(steps()) == ["segment", "label", "extract", "rebalance", "evolve", "consolidate", "train"]

    other = cycle.Store(spark, f"file://{tmp_path}/b")
    broken = steps()

    def kill(tables, batch, batch_id):
        raise Killed

    broken["rebalance"] = kill
    with pytest.raises(Killed):
        cycle.run_cycle(other, one, 0, broken)
    assert len(other.records()) == 3
    ran = []
    counted = {n: (lambda t, b, i, n=n, f=f: (ran.append(n), f(t, b, i))[1]) for n, f in steps().items()}
    cycle.run_cycle(other, one, 0, counted)
    assert ran == ["rebalance", "evolve", "consolidate", "train"]
    cycle.run_cycle(other, two, 1, counted)
    before = len(ran)
    assert set(cycle.run_cycle(other, one, 0, counted).values()) == set(cycle.run_cycle(other, two, 1, counted).values()) == {"ok"}
    assert len(ran) == before
    assert state(other) == want


def test_a_step_that_fails_hinders_no_other(spark, tmp_path):
    one, _ = batches(spark)
    store, some = cycle.Store(spark, f"file://{tmp_path}/c"), steps()

    def fails(tables, batch, batch_id):
        raise ValueError("no")

    got = cycle.run_cycle(store, one, 0, some | {"label": fails, "evolve": fails})
    assert got == {"segment": "ok", "label": "failed: ValueError", "extract": "ok", "rebalance": "ok", "evolve": "failed: ValueError", "consolidate": "ok", "train": "ok"}
    t = store.tables()
    assert t["segments"].where("labeled").count() == 0 and t["memories"].count() == 0 and t["segments"].count() == 8
    # The next batch takes up what was left.
    assert cycle.run_cycle(store, one.limit(0), 1, {k: some[k] for k in ("segment", "label")})["label"] == "ok"
    assert store.tables()["segments"].where("labeled").count() == 8


def test_first_members_of_a_large_cluster(spark):
    """However many memories a cluster has, a prompt shows the first ones, and a topic is made of ten."""
    members = spark.range(20_000).select((F.col("id") % 2 * (F.col("id") > 9).cast("int")).alias("cluster_id"), F.col("id").alias("memory_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("added_at"))
    memories = spark.range(20_000).select("id", F.concat(F.lit("m"), "id").alias("content"), F.lit("").alias("context"), F.lit("").alias("resolution"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), "id")).alias("summary_l0"))
    got = {r.cluster_id: r for r in E.prompt(members, memories, entries=3).collect()}
    assert got[0].n == 10_005 and got[0].prompt.count("### Experience") == 3 and len(got[0].ids) == 10_005
    said = {r.cluster_id: r.summaries for r in E.summaries(members, memories).collect()}
    assert said[0].split("\n") == [f"- {'s' if i % 3 == 0 else 'm'}{i}" for i in range(10)]
    assert said[1].split("\n")[0] == "- m11" and len(said[1].split("\n")) == 10
    df = spark.createDataFrame([(' "A \'topic\'" ',), ("'" + "x" * 90,), ("",)], "s string")
    assert [r.t for r in df.select(E.topic_label(F.col("s")).alias("t")).collect()] == ["A 'topic", "x" * 80, ""]


def test_budget_is_spent_by_successes(spark):
    """Random outcomes of the first phase: the second gets what is left."""
    import random

    rng = random.Random(3)
    time = lambda i: f"2024-01-{i + 1:02d} 00:00:00"
    clusters = [(i, "t", "" if i < 10 else f"s{i}", time(rng.randrange(20))) for i in range(18)]
    c = spark.createDataFrame(clusters, "cluster_id long, topic string, skill_slug string, t string").withColumn("created_at", F.col("t").cast("timestamp_ntz")).drop("t")
    m = spark.range(18 * 6).select((F.col("id") % 18).alias("cluster_id"), F.col("id").alias("memory_id"), F.lit("2024-02-01").cast("timestamp_ntz").alias("added_at")).where("cluster_id <> 2")
    memories = spark.range(200).select("id", F.lit("c").alias("content"), F.lit("").alias("context"), F.lit("").alias("resolution"))
    skills = spark.createDataFrame([(f"s{i}", "1.0.0", "n", "d", "t", 0.9) for i in range(10, 18)], "slug string, version string, name string, description string, text string, structure_score double")
    history = spark.createDataFrame([], "cluster_id long, skill_slug string, status string, timestamp timestamp_ntz")
    by_age = sorted(clusters, key=lambda r: (tuple(-ord(x) for x in r[3]), r[0]))
    for limit in (1, 3, 6, 30):
        good = [i for i in range(10) if rng.random() < 0.5]
        new = lambda prompt, topic: F.when(F.col("cluster_id").isin(good), F.struct(F.lit("ok").alias("quality"), F.lit("n").alias("name"), F.lit("d").alias("description"), F.lit(GOOD).alias("content")))
        tried = [r[0] for r in by_age if r[2] == "" and r[0] != 2][:limit]
        rest = limit - len([i for i in tried if i in good])
        one, two = E.cycle(c, m, memories, skills, history, limit, new)
        assert {r.cluster_id: r.outcome for r in one.collect()} == {i: "crystallized" if i in good else "insufficient" for i in tried}
        assert {r.cluster_id for r in two.collect()} == {r[0] for r in by_age if r[2]}.intersection([r[0] for r in by_age if r[2]][: max(rest, 0)])


def test_prompts_of_whole_clusters(spark):
    """A skill is made of all memories of its cluster, not of the first ones."""
    members = spark.range(450).select(F.lit(0).cast("long").alias("cluster_id"), F.col("id").alias("memory_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("added_at"))
    memories = spark.range(450).select("id", F.lit("c").alias("content"), F.lit("").alias("context"), F.lit("").alias("resolution"))
    clusters = spark.createDataFrame([(0, "t", "")], "cluster_id long, topic string, skill_slug string")
    skills = spark.createDataFrame([], "slug string, version string")
    size = lambda prompt, topic: F.struct(F.lit("ok").alias("quality"), F.regexp_count(prompt, F.lit("### Experience")).cast("string").alias("name"), F.lit("d").alias("description"), F.lit(GOOD).alias("content"))
    verify = lambda content, prompt: F.struct(F.lit(0.9).alias("grounded"), F.lit(False).alias("contradiction"), F.lit(0.8).alias("clarity"), F.lit(1.0).alias("specificity"), F.lit(1.0).alias("preserves"))
    got = E.crystallize(clusters, members, memories, skills, synthesize=size, verify=verify).first()
    assert (got.outcome, got.name) == ("crystallized", "450")
