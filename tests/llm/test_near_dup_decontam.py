"""Near duplicates, connected components and decontamination against brute force."""

import random

from pyspark.sql import functions as F

from sparkloom.llm import decontam, near_dup
from sparkloom.llm.components import connected_components

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "so", "ti") for b in ("dor", "fen", "gal", "his", "jun", "kel", "lom", "pas", "rit", "ves")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def changed(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = rng.choice(WORDS) + "x"
    return " ".join(w)


def groups(links, nodes):
    at = {x: x for x in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    df = spark.createDataFrame([*edges, (None, 3), (5, 5)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {k: v for k, v in groups(edges, nodes).items() if k in nodes}
    assert connected_components(df.limit(0)).count() == 0


def brute(texts, n):
    import math
    from collections import Counter

    def counted(t):
        w = (t or "").lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    sets = [counted(t) for t in texts]
    df = Counter(s for c in sets for s in c)
    idf = {s: 1 + 0.5 * min(1, max(0, math.log(n / k) / math.log(1 / near_dup.RARE))) if k >= near_dup.RARE * n else 1.5 for s, k in df.items()}
    links = []
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j]:
                links.append((i, j))
                continue
            a, b = sets[i], sets[j]
            low = sum(min(a[s], b[s]) * idf[s] for s in a.keys() & b.keys())
            high = sum(max(a[s], b[s]) * idf[s] for s in a.keys() | b.keys())
            if a and b and low / high >= 0.8:
                links.append((i, j))
    return groups(links, range(len(texts)))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(60, 300)) for _ in range(60)]
    for k in range(25):
        texts.append(changed(rng, texts[k], 1))
    base = prose(rng, 200)
    texts += [base] * 12 + [changed(rng, base, 1) for _ in range(40)] + ["short text", "short text", "", "", "one two three four"]
    rng.shuffle(texts)
    rows = [(i, t if t else (None if i % 2 else ""), "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, class_id string")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()}
    assert got == brute(["" if t is None else t for t in texts], len(texts))
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(got.values())


def test_large_bucket_that_its_leader_does_not_link(spark):
    # 30 classes of one bucket at 0.79 from its leader, each a group of its own: all pairs are to be compared but those that bounds rule out,
    # and a pair that meets in more buckets is formed once.
    rows = [(b, 31, i, i, 99, 0.79, 100.0, 95.0) for b in (1, 2) for i in range(30) if b == 1 or i < 20] + [(1, 31, 30, 30, 99, 0.79, 100.0, 70.0), (1, 31, 31, 31, 99, 0.5, 100.0, 95.0)]
    members = spark.createDataFrame(rows, "bucket long, members long, node long, g long, ml long, ms double, w double, held double")
    got = [(r.src, r.dst) for r in near_dup._cross(members, 0.8).collect()]
    assert sorted(got) == [(i, j) for i in range(30) for j in range(i)]
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g"), (3, "p q r s t")], "node long, text string")
    none = near_dup.Idf(3, near_dup.np.zeros(0, near_dup.np.uint64), near_dup.np.zeros(0, near_dup.np.int64))
    near_dup.ship(spark)
    assert sorted((r.node, r.w, r.held) for r in near_dup._shareable(texts, none).collect()) == [(1, 3.0, 1.5), (2, 3.0, 1.5), (3, 1.5, 0.0)]


def test_rare_share_and_named_counters(spark):
    # A shingle in 0.3 % of all documents has an idf of its own, and small partitions do not name what is rare.
    rng = random.Random(4)
    texts = ["one two three four five" if i < 6 else " ".join(f"{w}{rng.randrange(10**6)}" for w in WORDS[:12]) for i in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(40)
    idf = near_dup.corpus_idf(df)
    assert [round(float(x), 6) for x in idf.idf] == [round(1 + 0.5 * near_dup.math.log(2000 / 6) / near_dup.math.log(500), 6)]
    assert near_dup.named_counters(df).where("bucket >= 0").count() < 10


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "g"), (None, None)], "doc_id long, text string")
    rows = near_dup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_docs) for r in rows) == [("1", "1", 3), ("1", "1", 3), ("2", "2", 1), ("None", "1", 3), ("None", "None", 1)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in near_dup.keep_one(df).collect()) == ["1", "2", "None"]


def contained(text, item):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    q = shingles(item)
    return len(q & shingles(text)), len(q)


def test_items_against_brute_force(spark):
    rng = random.Random(2)
    items = [prose(rng, n) for n in (5, 6, 9, 17, 40, 40, 130, 3)] + [None, ""]
    texts = [prose(rng, 4000) for _ in range(6)] + [None, "", "few words"]
    for k, item in enumerate(items[:7]):
        at = rng.randrange(100, 3000)
        w = texts[k % 6].split()
        part = item.split() if k % 2 else changed(rng, item, len(item.split()) // 40).split()
        texts[k % 6] = " ".join(w[:at] + part + w[at:])
    texts.append(items[4].upper() + "\n" + items[5])
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontam.contained_items(docs, bench).collect()}
    want = set()
    for i, t in enumerate(texts):
        for j, q in enumerate(items):
            n, m = contained(t, q)
            if m and n >= 0.8 * m:
                want.add((i, j, n, m))
    assert got == want and len(want) >= 6
    clean = decontam.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {w[0] for w in want}


def test_items_under_other_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "p q r s t")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "b c d e f", "x")], "number long, passage string, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contained_items(docs, bench, item_text="passage", item_key="number").collect()] == [(1, 7)]
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench, item_text="passage", item_key="number").collect()] == [2]


def test_naming_reads_bounded_text(spark, monkeypatch):
    """Long texts are not gathered in one task, and what is counted stays the same."""
    rng = random.Random(6)
    df = spark.createDataFrame([(prose(rng, 200) + (" same five words each time" if i % 2 else ""),) for i in range(120)], "text string").repartition(12)
    want = near_dup.corpus_idf(df)
    monkeypatch.setattr(near_dup, "NAMING_CHARS", 20_000)
    assert near_dup.named_counters(df).where("bucket = -1").first().n == 120
    got = near_dup.corpus_idf(df)
    assert got.hashes.tolist() == want.hashes.tolist() and got.idf.tolist() == want.idf.tolist()


def test_items_in_blocks_and_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "q r s t u v")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e"), (2, "q r s t u"), (2, "q r s t u")], "item_id long, text string")
    want = [("1", 1), ("1", 1), ("None", 2), ("None", 2)]
    assert sorted((str(r.doc_id), r.item_id) for r in decontam.contained_items(docs, bench).collect()) == want
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 1)
    for blocks in (4, 1):
        monkeypatch.setattr(decontam, "PASS_BLOCKS", blocks)
        assert sorted((str(r.doc_id), r.item_id) for r in decontam.contained_items(docs, bench).collect()) == want
        assert decontam.drop_contaminated(docs, bench.where("item_id = 1")).count() == 1
    assert decontam.contained_items(docs.limit(0), bench).count() == 0
    assert decontam.contained_items(docs, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == 3
    assert decontam.drop_contaminated(docs.select("doc_id", F.col("text")), bench).count() == 0
