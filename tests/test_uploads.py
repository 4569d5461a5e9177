"""Uploads row after row, what they leave behind, and clusters that grow, against sequential plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import clusters as C
from sparkloom.operators import knowledge as K
from sparkloom.sources import fixtures as X
from sparkloom.streaming import clustering


def numbers(text):
    """An embedder: the numbers that the content lists."""
    return F.transform(F.split(F.regexp_extract(text, r"content: (\S*)", 1), ","), lambda x: x.try_cast("double"))


def cosine(a, b):
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(a @ b / size), 12) if size else 0.0


def plain_upload(new, old, soft, hard, confirm=None):
    """(action, id, earlier_id) of rows (new_id, vector) after existing (id, vector, tier)."""
    place = {"hot": 0, "warm": 1, "cold": 2}
    inserted, out = [], {}
    for n, (i, v) in enumerate(new):
        found = [(-cosine(v, w), place[t], j, None, w) for j, w, t in old] + [(-cosine(v, w), 3, k, j, w) for k, j, w in inserted]
        found = sorted((f for f in found if -f[0] >= soft), key=lambda f: f[:3])
        best = found[0] if found else None
        if best and (-best[0] >= hard or (confirm and confirm(best[4], v))):
            out[i] = ("merge", None if best[3] is not None else best[2], best[3])
        else:
            out[i] = ("insert", None, None)
            inserted.append((n, i, v))
    return out


def listed(v):
    return ",".join(str(int(x)) for x in v)


@pytest.mark.parametrize("n, dims, asks", [(250, 3, False), (250, 3, True), (2300, 5, False), (40, 3, True)])
def test_upload_one_by_one(spark, n, dims, asks):
    rng = np.random.default_rng(n + asks)
    vectors = rng.integers(-3, 4, (n + 30, dims)).astype(float)
    vectors[rng.integers(0, n, n // 5)] = vectors[0]
    old = [(1000 + k, vectors[n + k], ["hot", "warm", "cold"][k % 3]) for k in range(30)]
    new = [(int(i), vectors[k]) for k, i in enumerate(sorted(rng.permutation(5 * n)[:n] + 10_000))]
    confirm = (lambda a, b: len(listed(a)) % 2 == 0) if asks else None
    column = (lambda a, ax, b, bx: F.length(a) % 2 == 0) if asks else None
    want = plain_upload(new, old, 0.9, 0.97, confirm)
    have = spark.createDataFrame([(i, "pattern", t, "active", listed(v), "", "") for i, v, t in old], "id long, memory_type string, tier string, status string, content string, context string, resolution string")
    df = spark.createDataFrame([(i, listed(v), "", "", k) for k, (i, v) in enumerate(new)], "new_id long, content string, context string, resolution string, own int").repartition(5)
    got = K.upload(df, have, 0.9, 0.97, numbers, column).collect()
    assert {r.new_id: (r.action, r.duplicate_of, r.duplicate_of_new) for r in got} == want
    assert {r.own for r in got} == set(range(n))
    assert sum(w[2] is not None for w in want.values()) > n // 8


def test_two_equal_rows(spark):
    have = spark.createDataFrame([], "id long, memory_type string, tier string, status string, content string, context string, resolution string")
    df = spark.createDataFrame([(7, "1,2", "", ""), (3, "1,2", "", ""), (5, None, None, None)], "new_id long, content string, context string, resolution string")
    got = {r.new_id: (r.action, r.duplicate_of_new) for r in K.upload(df, have, embedder=numbers).collect()}
    assert got == {3: ("insert", None), 7: ("merge", 3), 5: ("insert", None)}
    assert K.upload(df.limit(0), have, embedder=numbers).count() == 0


def test_texts_are_embedded_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(text):
        calls.add(1)
        return [1.0, float(len(text))]

    have = spark.createDataFrame([], "id long, memory_type string, tier string, status string, content string, context string, resolution string")
    df = spark.range(40).select(F.col("id").alias("new_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("content"), F.lit("").alias("context"), F.lit("").alias("resolution"))
    up = K.upload(df, have, embedder=counted)
    assert up.count() == 40 and up.where("action = 'insert'").count() > 0
    assert calls.value == 40


def test_dealt_rows_are_filtered_where_they_are_dealt(spark):
    df = spark.range(100).select("id", F.concat(F.lit("t"), "id").alias("t")).coalesce(1)
    some = X.dealt(df, "id").where(F.col("t").rlike("t[0-4]"))
    assert "Repartition" not in some._jdf.queryExecution().optimizedPlan().toString()
    assert some.count() == 45


def test_names_of_keys_once_a_word(spark):
    plain = T.CREDENTIAL_PATTERNS[6][0]
    texts = ["api_key = abc", "my_token:'x-y'", "\"password\": \"a.b\" pwd=c", "token=abc\"secret=x", "9token=1", "tokentoken=2pwd=3", "x'apikey=4'", "no key at all: 1", "passwd =", "''token=q"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(F.regexp_replace("t", "(?i)" + plain, "<C>").alias("a"), T.replace_all(F.col("t"), [(plain, "<C>")]).alias("b")).collect()
    assert T.ONCE_A_WORD[plain] != plain and all(r.a == r.b for r in got) and sum("<C>" in r.b for r in got) >= 6


def test_completion_in_order(spark, monkeypatch):
    monkeypatch.setattr(K, "FOLD", 3)
    rng = random.Random(4)
    old = [(i, "pattern", f"old {i}", "x", "", ["A", f"t{i}"], 5, "hot", "active") for i in range(4)]
    schema = "id long, memory_type string, content string, context string, resolution string, tags array<string>, hit_count long, tier string, status string"
    rows = []
    for k in range(60):
        kind = "insert" if k < 3 else "merge"
        target = rng.choice([0, 0, 0, 1, 100, 101])
        rows.append((100 + k, "pattern", f"n{k}" if k % 7 else "", f"c{k}", "r" if k % 5 else "", [rng.choice(["a", "B", "b ", "Straße", "STRASSE", f"T{k % 14}", ""]) for _ in range(3)], kind, target if kind == "merge" and target < 100 else None, target if kind == "merge" and target >= 100 else None))
    up = spark.createDataFrame(rows, "new_id long, memory_type string, content string, context string, resolution string, tags array<string>, action string, duplicate_of long, duplicate_of_new long").repartition(4)
    memories = spark.createDataFrame(old, schema)
    merger = lambda a, b: F.when(b[0] != "", F.struct(F.concat(a[0], F.lit("+"), b[0]).alias("content"), b[1].alias("context"), a[2].alias("resolution")))
    state = {r[0]: {"content": r[2], "context": r[3], "resolution": r[4], "tags": list(r[5]), "hits": r[6]} for r in old}
    said = 0
    for r in rows:
        if r[6] == "insert":
            state[r[0]] = {"content": r[2], "context": r[3], "resolution": r[4], "tags": r[5], "hits": 1}
    touched = set()
    for r in rows:
        if r[6] == "merge":
            m = state[r[7] if r[7] is not None else r[8]]
            touched.add(r[7] if r[7] is not None else r[8])
            m["hits"] += 1
            said += bool(r[2] or r[4])
            if r[2]:
                m["content"], m["context"] = m["content"] + "+" + r[2], r[3]
            seen, out = set(), []
            for t in [*m["tags"], *r[5]]:
                t = t.strip()
                if t and t.casefold() not in seen:
                    seen.add(t.casefold())
                    out.append(t)
            m["tags"] = out[:10]
    got = {r.id: r for r in K.complete_uploads(memories, up, "2024-02-01", merger, numbers).collect()}
    assert set(got) == set(state)
    for i, m in state.items():
        assert (got[i].content, got[i].context, got[i].hit_count) == (m["content"], m["context"], m["hits"])
        if i in touched:
            assert got[i].tags == m["tags"]
    assert got[101].tier == "warm" and got[0].tier == "hot"
    assert K.contributions(up, "2024-02-01").count() == said
    plain = {r.id: r for r in K.complete_uploads(memories, up, "2024-02-01").collect()}
    assert plain[0].content == "old 0" and plain[0].hit_count == state[0]["hits"]


def plain_leaders(rows, threshold):
    clusters, out = [], {}
    for i, v in rows:
        if v is None:
            out[i] = None
            continue
        v = np.array(v)
        sims = [cosine(c[1], v) for c in clusters]
        best = int(np.argmax(sims)) if sims else -1
        if best >= 0 and sims[best] >= threshold:
            clusters[best][1] += v
            out[i] = clusters[best][0]
        else:
            clusters.append([i, v.copy()])
            out[i] = i
    return out


@pytest.mark.parametrize("block, nearest", [(4096, 8), (50, 2), (64, 1), (7, 3)])
def test_leader_clusters_one_by_one(spark, block, nearest):
    g = np.random.default_rng(5)
    rows = [(i, g.normal(size=4).tolist() if i % 40 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    want = plain_leaders(rows, 0.8)
    got = C.leader_clusters(df, 0.8, block=block, nearest=nearest)
    assert {r.id: r.cluster_id for r in got.assigned.collect()} == want
    sizes = {r.cluster_id: r.n for r in got.clusters.collect()}
    assert sizes == {c: sum(x == c for x in want.values()) for c in set(want.values()) - {None}}
    assert len(sizes) > 20


def test_leader_clusters_settle_whole_blocks(spark, monkeypatch):
    """Many centroids near every vector: a block that a task can hold is settled at once; lists grow where it cannot."""
    g = np.random.default_rng(8)
    rows = [(i, g.normal(size=16).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    names, plain = [], C.saved
    monkeypatch.setattr(C, "saved", lambda d, name: names.append(name) or plain(d, name))
    got = C.leader_clusters(df, 0.3, block=200)
    assert {r.id: r.cluster_id for r in got.assigned.collect()} == plain_leaders(rows, 0.3)
    assert names.count("leader-settled") == 2
    names.clear()
    got = C.leader_clusters(df, 0.3, block=200, nearest=4, held=40)
    assert {r.id: r.cluster_id for r in got.assigned.collect()} == plain_leaders(rows, 0.3)
    assert names.count("leader-settled") < 15


def test_leader_clusters_go_on(spark):
    g = np.random.default_rng(6)
    rows = [(i, g.normal(size=3).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    first = C.leader_clusters(df.where("id < 90"), 0.85)
    again = C.leader_clusters(df.where("id >= 90"), 0.85, start=first.clusters)
    got = {r.id: r.cluster_id for x in (first, again) for r in x.assigned.collect()}
    assert got == plain_leaders(rows, 0.85)
    assert C.leader_clusters(df.limit(0)).assigned.count() == 0


def test_clusters_of_a_stream(spark, tmp_path):
    g = np.random.default_rng(7)
    rows = [(i, "ab"[i % 2], g.normal(size=3).tolist() if i != 5 else None) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, shard string, embedding array<double>")
    source, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("source", "out", "checkpoint"))
    # The second part brings some rows again: they keep their cluster and move nothing.
    for part in (df.where("id < 70"), df.where("id >= 60")):
        part.repartition(3).write.mode("append").parquet(source)
        clustering.run(spark.readStream.schema(df.schema).parquet(source), out, checkpoint, 0.85)
    got = spark.read.parquet(out).collect()
    want = {}
    for shard in "ab":
        want |= plain_leaders([(i, v) for i, s, v in rows if s == shard], 0.85)
    assert {(r.id, r.cluster_id) for r in got} == {(i, c) for i, c in want.items()} and len(got) == 170


def test_rows_are_compared_again_only_where_their_nearest_was_not_inserted(spark, monkeypatch):
    """Of far apart rows and their copies none is looked for again among those inserted."""
    texts = [f"{np.cos(k % 12 * 0.5):.3f},{np.sin(k % 12 * 0.5):.3f},{k % 12}" for k in range(36)]
    new = spark.createDataFrame([(k, t, "", "") for k, t in enumerate(texts)], "new_id long, content string, context string, resolution string")
    old = spark.createDataFrame([], "id long, memory_type string, tier string, status string, content string, context string, resolution string")
    sizes, real = [], K.best_match
    monkeypatch.setattr(K, "best_match", lambda left, *a, **b: sizes.append(left.count()) or real(left, *a, **b))
    got = {r.new_id: (r.action, r.earlier_id) for r in K.upload(new, old, soft=0.99999, hard=0.999999, embedder=numbers).collect()}
    assert got == {k: ("insert", None) if k < 12 else ("merge", k % 12) for k in range(36)}
    assert sizes == [36, 0, 0]


def test_a_confirmation_reads_only_texts_of_its_pairs(spark, tmp_path):
    """Texts that no pair needs are left out before they are shuffled, by keys that are broadcast."""
    spark.range(500).selectExpr("id AS __place", "id", "concat('t', id) AS content", "'' AS context").write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    ready = spark.createDataFrame([(7, 3, 0.9, None, None), (9, None, None, 4, 0.8), (8, None, None, None, None), (10, 5, 0.8, 2, 0.85)], "__place long, old_id long, old_sim double, new_place long, new_sim double")
    said = []
    out = K._merged(ready, texts.drop("id"), texts.drop("__place"), lambda a, ax, b, bx: said.append((a, b)) or F.concat(a, b).isin("t3t7", "t2t10"), 1.1)
    assert sorted(r[0] for r in out.collect()) == [7, 10] and len(said) == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 3
