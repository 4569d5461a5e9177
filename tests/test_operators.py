"""Operators against the published contracts and plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import knowledge as K
from sparkloom.operators import lookup as L
from sparkloom.operators import ranking as R
from sparkloom.operators import similarity as S
from sparkloom.operators import writes as W


def memories(spark, n, tier="warm"):
    rows = [(i, tier, "active", n - i, "2024-01-01 00:00:00") for i in range(n)]
    return spark.createDataFrame(rows, "id long, tier string, status string, hit_count long, t string").withColumn("last_hit_at", F.col("t").cast("timestamp_ntz")).drop("t")


@pytest.mark.parametrize("n, hot, warm, want", [(10, 10, 40, (1, 4, 5)), (100, 50, 40, (50, 40, 10)), (1, 10, 40, (1, 0, 0)), (3, 10, 40, (1, 2, 0))])
def test_tiers(spark, n, hot, warm, want):
    r = R.rebalance_summary(R.tier_rebalance(memories(spark, n), hot, warm)).first()
    assert (r.hot, r.warm, r.cold) == want


def test_tiers_of_nothing(spark):
    assert R.tier_rebalance(memories(spark, 3).limit(0)).count() == 0


def test_global_rank_with_ties(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "id long, k long")
    got = {r.id: r.rank for r in R.global_rank(df, [F.col("k").desc(), F.col("id").asc()]).collect()}
    want = {i: k + 1 for k, i in enumerate(sorted(range(50), key=lambda i: (-(i % 3), i)))}
    assert got == want


def test_search_order_by_boost(spark):
    rows = [(1, "warm", [0.0, 1.0]), (2, "hot", [1.0, 0.0]), (3, "cold", [-1.0, 0.0]), (4, "hot", [])]
    df = spark.createDataFrame(rows, "id long, tier string, embedding array<double>").withColumns({"status": F.lit("active"), "last_hit_at": F.lit("2024-01-01").cast("timestamp_ntz")})
    got = S.search_memories(df, [[1.0, 0.0]], "2024-01-01", weight=0.0).collect()
    assert [r.id for r in got] == [2, 1, 3, 4]
    assert got[0].score == pytest.approx(1.2) and got[2].score == 0


def test_pairs_against_brute_force(spark):
    g = np.random.default_rng(0)
    v = g.normal(size=(120, 8))
    df = spark.createDataFrame([(i, "ab"[i % 2], v[i].tolist()) for i in range(120)], "id long, memory_type string, embedding array<double>").withColumn("status", F.lit("active"))
    got = {(r.id_a, r.id_b) for r in S.similar_pairs(df, 0.5, block=16).collect()}
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if i % 2 == j % 2 and n[i] @ n[j] >= 0.5}
    assert got == want


def test_nearest_duplicate_prefers_hot(spark):
    new = spark.createDataFrame([(1, "error", [1.0, 0.0])], "new_id long, memory_type string, embedding array<double>")
    old = spark.createDataFrame([(5, "error", [1.0, 0.0], "cold"), (7, "error", [2.0, 0.0], "hot"), (8, "life", [1.0, 0.0], "hot")], "id long, memory_type string, embedding array<double>, tier string").withColumn("status", F.lit("active"))
    assert S.nearest_duplicate(new, old).first().id == 7


def plain_best(left, right, threshold):
    out = {}
    for i, k, v in left:
        best = None
        for j, kk, place, w in right:
            if kk != k or w is None or v is None:
                continue
            n = np.linalg.norm(v) * np.linalg.norm(w)
            sim = round(float(np.dot(v, w) / n), 12) if n else 0.0
            if sim >= threshold and (best is None or (-sim, place, j) < best):
                best = (-sim, place, j)
        if best:
            out[i] = best[2]
    return out


@pytest.mark.parametrize("block", [1024, 40, 7])
def test_best_match_in_blocks(spark, block):
    """A right side that is broadcast, a left one, and pairs of blocks all give what every pair compared gives."""
    g = np.random.default_rng(3)
    vec = lambda: g.normal(size=4).round(1).tolist()
    left = [(i, "ab"[i % 2], None if i == 5 else vec()) for i in range(30)]
    right = [(100 + j, "abc"[j % 3], j % 3, None if j == 7 else ([0.0] * 4 if j == 8 else vec())) for j in range(70)]
    right += [(500, "a", 2, left[0][2]), (400, "a", 1, left[0][2]), (401, "a", 1, left[0][2])]
    l = spark.createDataFrame(left, "left_id long, kind string, embedding array<double>")
    r = spark.createDataFrame(right, "right_id long, kind string, place int, embedding array<double>")
    got = {x.left_id: x.right_id for x in S.best_match(l, r, 0.5, "kind", block).collect()}
    assert got == plain_best([(i, k, v) for i, k, v in left], right, 0.5)
    assert got[0] == 400


def greedy(pairs, most):
    lost, out = set(), []
    for sim, w, lo in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if len(out) < most and w not in lost and lo not in lost:
            out.append((w, lo))
            lost.add(lo)
    return out


def merges(spark, pairs, most):
    df = spark.createDataFrame([(w, lo, s) for s, w, lo in pairs], "winner long, loser long, sim double")
    return [(r.winner, r.loser) for r in K.greedy_merges(df, most).collect()]


@pytest.mark.parametrize("most", [1, 3, None])
def test_greedy_merges(spark, most):
    cases = [
        [(0.9, 1, 2), (0.8, 2, 3), (0.7, 1, 3), (0.95, 4, 1), (0.6, 5, 6), (0.6, 6, 7)],
        [(0.9, 1, 2), (0.89, 1, 3), (0.88, 1, 4), (0.5, 100, 101), (0.499, 102, 103), (0.498, 104, 105)],
        [(0.9 - k / 100, k, k + 1) for k in range(8)],
    ]
    for pairs in cases:
        assert merges(spark, pairs, most) == greedy(pairs, 99 if most is None else most)


@pytest.mark.parametrize("seed", [2, 5])
def test_greedy_merges_of_random_pairs(spark, seed):
    g = np.random.default_rng(seed)
    pairs = sorted({(float(g.integers(0, 8)) / 8, int(a), int(b)) for a, b in g.integers(0, 14, (30, 2)) if a != b})
    seen, unique = set(), []
    for s, a, b in pairs:
        if (a, b) not in seen:
            seen.add((a, b))
            unique.append((s, a, b))
    for most in (4, None):
        assert merges(spark, unique, most) == greedy(unique, 99 if most is None else most)


def test_greedy_merges_of_nothing(spark):
    assert K.greedy_merges(spark.createDataFrame([], "winner long, loser long, sim double"), 5).count() == 0


def test_mergeable(spark):
    df = spark.createDataFrame([(1, 2, 0.9), (3, 4, 0.8), (5, 6, 0.8)], "winner long, loser long, sim double")
    ids = lambda d: {r.winner for r in d.collect()}
    assert ids(K.mergeable(df, 0.85)) == {1, 3, 5}
    assert ids(K.mergeable(df, 0.85, dry_run=True)) == {1}
    assert ids(K.mergeable(df, 0.85, confirm=F.col("winner") == 3)) == {1, 3}


def test_merges_without_a_merger_change_nothing(spark):
    df = spark.createDataFrame([(1, "a", "", "", ["t"], 3, "active"), (2, "b", "", "", ["u"], 1, "active")], "id long, content string, context string, resolution string, tags array<string>, hit_count long, status string")
    pair = spark.createDataFrame([(1, 2, 0.9)], "winner long, loser long, sim double")
    assert sorted(K.apply_merges(df, pair).collect()) == sorted(df.collect())
    got = {r.id: r for r in K.apply_merges(df, pair, K.rule_merger).collect()}
    assert (got[1].content, got[1].hit_count, got[1].tags, got[2].status) == ("a\n\n---\n\nb", 4, ["t", "u"], "archived")


def plain_tasks(said, segment, budget):
    """Windows and restarts, told once more over the whole list."""
    done, at = [], 0
    while True:
        end = at
        while end < len(said) and (end == at or len("\n".join(f"[{k + 1}] {t}" for k, t in enumerate(said[at : end + 1]))) <= budget):
            end += 1
        tasks = segment([f"[{k + 1}] {t}"[:budget] for k, t in enumerate(said[at:end])])
        done = [d for d in done if d[0] < at + tasks[0][0]] + [(at + a, at + b) for a, b, _ in tasks]
        if end == len(said):
            return done
        at = end if len(tasks) == 1 else done[-1][0] - 1


@pytest.mark.parametrize("budget", [60, 130, 100000])
def test_task_segments(spark, budget):
    from sparkloom.plans.evolution import by_user_turns

    g = np.random.default_rng(1)
    rows = [(s, i + 1, "user" if g.random() < 0.3 else "assistant", "w" * int(g.integers(1, 30))) for s in range(6) for i in range((0, 2, 5, 9, 14, 20)[s])]
    df = spark.createDataFrame(rows, "session long, msg_idx long, role string, body string")
    got = {}
    for r in K.task_segments(df, by_user_turns(), budget).orderBy("session", "segment_index").collect():
        got.setdefault(r.session, []).append((r.start_line, r.end_line))
    for s in range(2, 6):
        assert got[s] == plain_tasks([f"[{r}]: {b}" for x, _, r, b in rows if x == s], by_user_turns(), budget)
    assert got[1] == [(1, 2)] and 0 not in got
    assert {r.session for r in K.task_segments(df, None, budget).collect()} == {1}
    assert K.task_segments(df, lambda lines: [(1, 1, "x")], budget).where("session = 5").count() == 0


def test_hash_embedding(spark):
    import hashlib
    import re

    texts = ["one two two", "", None, "Ünïcode wörds " * 50, "!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: np.array(r.e) for r in df.select("i", K.embed(F.col("t"), 16).alias("e")).collect()}
    for i, t in enumerate(texts):
        v = np.zeros(16)
        for w in re.findall(r"\w+", (t or "").lower()):
            h = hashlib.md5(w.encode()).digest()
            v[int.from_bytes(h[:2]) % 16] += 1 if h[2] & 1 else -1
        n = np.linalg.norm(v)
        assert np.allclose(got[i], v / n if n else v)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from sparkloom import scratch

    assert scratch.shared_dir(spark).startswith("file://") or spark.conf.get("spark.checkpoint.dir", None)
    if not spark.conf.get("spark.checkpoint.dir", None):
        monkeypatch.setattr(type(spark.sparkContext), "master", "spark://host:7077", raising=False)
        with pytest.raises(RuntimeError):
            scratch.shared_dir(spark)


def test_contiguous(spark):
    rows = [("a", 1, 3, 5), ("a", 4, 5, 5), ("b", 1, 2, 4), ("b", 4, 4, 4), ("c", 2, 3, 3), ("d", 1, 2, 2), ("d", 2, 2, 2)]
    df = spark.createDataFrame(rows, "session string, start int, end int, n int")
    assert {r.session: r.ok for r in R.contiguous(df).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, v string, at long")
    new = spark.createDataFrame([(2, "B", 99), (3, "C", 98)], "id long, v string, at long")
    assert {tuple(r) for r in W.upsert(old, new, ["id"], keep=["at"]).collect()} == {(1, "a", 10), (2, "B", 20), (3, "C", 98)}
    assert {r.id for r in W.insert_or_ignore(old, new.union(new), ["id"]).collect()} == {1, 2, 3}
    assert W.insert_or_ignore(old, new.union(new), ["id"]).count() == 3
    with pytest.raises(ValueError):
        W.reset_extracted(old)


def test_detail_levels(spark):
    df = spark.createDataFrame([("c", "x", "r", [1.0])], "content string, context string, resolution string, embedding array<double>")
    assert L.detail_level(df, "l1").first().asDict() == {"content": "", "context": "x", "resolution": ""}
    with pytest.raises(ValueError):
        L.detail_level(df, "l9")


def test_members_since_nothing(spark):
    from sparkloom.operators.aggregates import members_since

    m = spark.createDataFrame([(1, 5, 10), (1, 6, 30), (2, 7, 10)], "cluster_id long, memory_id long, added_at long")
    e = spark.createDataFrame([(1, "crystallized", 20), (1, "revert", 40)], "cluster_id long, status string, timestamp long")
    assert {r.cluster_id: r.n for r in members_since(m, e).collect()} == {1: 1, 2: 1}


def test_hotness(spark):
    from sparkloom.functions.vectors import hotness

    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-03-01 00:00:00",), (None,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = [r.h for r in df.select(hotness(F.col("t"), F.lit("2024-01-11").cast("timestamp_ntz"), 0.05).alias("h")).collect()]
    assert got == [pytest.approx(math.exp(-0.5)), 1.0, 0.0]


@pytest.mark.parametrize("block", [1024, 4, 1])
def test_best_match_of_copies_and_lengths(spark, block):
    """Equal vectors count once, the first of them; vectors of another length are similar to none, whatever stands first."""
    v = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0, 0.0]]
    left = spark.createDataFrame([(i, v[i % 3]) for i in range(60)], "left_id long, embedding array<double>")
    right = spark.createDataFrame([(i, i % 2, v[i % 3]) for i in range(90)], "right_id long, place int, embedding array<double>")
    got = {r.left_id: (r.right_id, round(r.sim, 9)) for r in S.best_match(left, right, 0.9, block=block).collect()}
    assert got == {i: ([0, 4, 2][i % 3], 1.0) for i in range(60)}
    before = {r.left_id: r.right_id for r in S.best_match(left, right.withColumn("place", F.lit(0)), 0.9, block=block, earlier=True).collect()}
    assert before == {i: i % 3 for i in range(3, 60)}


def test_pairs_go_without_joins(spark):
    """Winners are told where pairs are found: no exchange of pairs for the hits of their ends."""
    rows = [(i, "a", "active", i % 3, [1.0, i / 50]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, memory_type string, status string, hit_count long, embedding array<double>")
    pairs = S.consolidation_pairs(df, 0.9, block=8)
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    hits = {r[0]: r[3] for r in rows}
    got = [(r.winner, r.loser) for r in pairs.collect()]
    assert len(got) == len(set(got)) and all((hits[w], -w) > (hits[lo], -lo) for w, lo in got)
    x = np.array([r[4] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {frozenset(p) for p in got} == {frozenset((i, j)) for i in range(30) for j in range(i) if x[i] @ x[j] >= 0.9}


def test_front_matter_is_read_once_a_row(spark):
    """Front matter is cut out of a text once, however many of its fields are taken."""
    from sparkloom.sources import packages as P

    df = spark.createDataFrame([("---\nA: 1\nb: 2\nA: 3\n---\nx",)], "t string").withColumn("f", P.simple_front_matter(F.col("t"), lower=True))
    out = df.select(F.try_element_at("f.meta", F.lit("a")).alias("a"), F.try_element_at("f.meta", F.lit("b")).alias("b"), "f.body")
    assert tuple(out.first()) == ("3", "2", "x")
    front = spark.createDataFrame([("---\nA: 1\n---\nx",)], "t string").select(P.front_matter(F.col("t")).alias("f"))
    for frame in (out, front):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 2


def test_front_matter_of_odd_files(spark):
    from sparkloom.sources import packages as P

    cases = {
        "---\na: 1\nb : 'x'  \n  more: of b\n- c: d\na: 3\n---\n\nbody": [("b", "'x'\n  more: of b"), ("- c", "d"), ("a", "3")],
        "---\nno colon\n: no key\n\tindented: 1\n---\n": [],
        "--- \x0b\n\n　k\x85:\xa0v\r\n---\t\nx: y": [("k", "v")],
        "---\n---\n": None,
        "---\na: 1\n--- b\n": None,
        "x---\na: 1\n---\n": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = df.select("t", F.map_entries(P.front_matter(F.col("t"))).alias("f"))
    assert {r.t: None if r.f is None else [tuple(e) for e in r.f] for r in got.collect()} == cases
    # A text is parsed once a row, by one call, not by expressions that each read it anew.
    plan = df.select(F.explode(P.front_matter(F.col("t"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "RLIKE" not in plan
    skills = P.skills(spark.createDataFrame([("a/SKILL.md", "---\nname: x\n---\n"), ("b/SKILL.md", "none")], "path string, text string"))
    assert skills._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1 and [r.name for r in skills.collect()] == ["x"]


def test_best_match_moves_vectors_once(spark, monkeypatch):
    """However many blocks there are, vectors are dealt and written once; no pairs of blocks are made, and the driver takes a block at a time."""
    g = np.random.default_rng(5)
    rows = [(i, i % 3, g.normal(size=3).round(1).tolist()) for i in range(400)]
    right = spark.createDataFrame(rows, "right_id long, place int, embedding array<double>")
    left = right.selectExpr("right_id AS left_id", "embedding")
    for ours, earlier in ((left, False), (left.where("left_id < 150"), False), (left, True), (left.where("left_id >= 250"), True)):
        theirs = right.withColumn("place", F.lit(0)) if earlier else right
        blocks, real = [], type(right).toArrow
        with monkeypatch.context() as m:
            m.setattr(type(right), "toArrow", lambda self: blocks.append(real(self)) or blocks[-1])
            m.setattr(S, "HELD_BYTES", 50 * 24)
            out = S.best_match(ours, theirs, 0.9, block=8, earlier=earlier)
            got = {x.left_id: (x.right_id, x.sim) for x in out.collect()}
        assert len(blocks) > 2 and max(map(len, blocks)) < 130
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
        assert got == {x.left_id: (x.right_id, x.sim) for x in S.best_match(ours, theirs, 0.9, earlier=earlier).collect()}
