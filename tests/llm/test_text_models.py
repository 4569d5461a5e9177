"""Language identification, lattice scores, quality rules."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lang_id, lattice_lm, quality_rules

SYLLABLES = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "eng", "ver", "ung"], "cc": ["oux", "ean", "ile", "que"]}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def labelled(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, "abc"[i % 3] * 2, 60), "abc"[i % 3] * 2, "s", "z") for i in range(90)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")


def test_forward_backward_is_exact():
    g = np.random.default_rng(0)
    e, links, first = g.normal(size=(95, 3)), g.normal(size=(3, 3)), g.normal(size=3)
    firsts = np.array([0, 1, 1, 34, 95])
    post, pairs = lang_id.marginals(e, links, first, firsts, pairs=True)
    total = np.zeros((3, 3))
    for a, b in zip(firsts[:-1], firsts[1:]):
        if a == b:
            continue
        al = [np.exp(first + e[a])]
        for t in range(a + 1, b):
            al.append((al[-1] @ np.exp(links)) * np.exp(e[t]))
        be = [np.ones(3)]
        for t in range(b - 1, a, -1):
            be.append(np.exp(links) @ (np.exp(e[t]) * be[-1]))
        be = be[::-1]
        z = al[-1].sum()
        assert np.allclose(np.array(al) * np.array(be) / z, post[a:b])
        for t in range(b - a - 1):
            total += al[t][:, None] * np.exp(links) * (np.exp(e[a + t + 1]) * be[t + 1])[None] / z
    assert np.allclose(total, pairs)


def test_languages(spark):
    rng = random.Random(9)
    model = lang_id.train(labelled(spark))
    assert model.langs == ["aa", "bb", "cc"]
    mixed = words(rng, "aa", 40) + " " + words(rng, "bb", 25)
    rows = [(i, words(rng, x, 30)) for i, x in enumerate(["aa", "bb", "cc"])] + [(3, mixed), (4, None), (5, "123 -- !"), (6, ""), (7, words(rng, "cc", 9000)), (8, "1 é")]
    got = lang_id.predict(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit("x")), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:4]] == ["aa", "bb", "cc", "aa"] and got[7].lang_pred == "cc"
    assert [r.lang_pred for r in got[4:7]] == ["und"] * 3 and got[8].lang_pred in model.langs
    assert [r.score for r in got[4:7]] == [0.0] * 3 and all(0 <= r.score <= 1 for r in got)
    spans = got[3].lang_spans
    assert spans[0].lang == "aa" and spans[-1].lang == "bb" and sum(s.words for s in spans) == 65
    assert abs(spans[-1].first - 40) <= 2


def test_many_languages_and_a_long_text():
    """Whole texts of 20 000 words, 40 languages: exact marginals in bounded memory."""
    import tracemalloc

    g = np.random.default_rng(2)
    e, links, first = g.normal(size=(20_000, 40)), g.normal(size=(40, 40)) * 0.3, g.normal(size=40)
    tracemalloc.start()
    post = lang_id.marginals(e, links, first, np.array([0, 20_000]))
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    step, al, be = np.exp(links), [np.exp(first + e[0])], [np.ones(40)]
    for t in range(1, 20_000):
        a = (al[-1] @ step) * np.exp(e[t])
        al.append(a / a.sum())
        b = step @ (np.exp(e[20_000 - t]) * be[-1])
        be.append(b / b.sum())
    want = np.array(al) * np.array(be[::-1])
    assert np.allclose(post, want / want.sum(1, keepdims=True))


def test_all_languages_are_learned(spark, monkeypatch):
    """However many there are; beyond the total of rows each language has fewer."""
    monkeypatch.setattr(lang_id, "TRAIN_TOTAL", 240)
    rng = random.Random(8)
    names = [chr(97 + i // 9) + chr(97 + i % 9) for i in range(70)]
    text = lambda name: " ".join(name + rng.choice(names) for _ in range(40))
    rows = [(i, text(names[i % 70]), names[i % 70]) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(df)
    assert model.langs == sorted(names)
    got = lang_id.predict(df, model).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.95 * len(got)


def test_training_texts_are_whole(spark, monkeypatch):
    """Rows are chosen, never parts of them; a language with none but long texts learns from these."""
    seen = []
    monkeypatch.setattr(lang_id, "fit", lambda texts, langs: seen.append(list(zip(langs, texts, strict=True))))
    rows = [(i, ("ab " * (30 if i % 2 else 300)).strip(), "short") for i in range(40)] + [(i, "cd " * 500, "long") for i in range(100, 104)]
    lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=5, length=200)
    assert [t for n, t in seen[0] if n == "short"] == [("ab " * 30).strip()] * 5
    assert [t for n, t in seen[0] if n == "long"] == ["cd " * 500] * 4


def test_hot_rows_of_one_key(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, "abc"[i % 3] * 2, 40), "abc"[i % 3] * 2) for i in range(90)] + [(1000, words(rng, "aa", 40), "rare")] + [(5, words(rng, "cc", 40), "cc")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(df)
    assert model.langs == ["aa", "bb", "cc", "rare"]
    assert lang_id.predict(df.where("doc_id < 3"), model).orderBy("doc_id").first().lang_pred == "aa"


def test_no_labels(spark):
    empty = labelled(spark).limit(0)
    model = lang_id.train(empty)
    assert [r.lang_pred for r in lang_id.predict(labelled(spark).limit(2), model).collect()] == ["und", "und"]
    assert lang_id.predict(empty, model).count() == 0


def test_held_out(spark):
    import zlib

    rows = spark.range(200).select("id", lang_id.held_out(F.col("id")).alias("a"), lattice_lm.held_out(F.col("id")).alias("b")).collect()
    assert all(r.a == (zlib.crc32(str(r.id).encode()) % 4 == 2) and r.b == (zlib.crc32(str(r.id).encode()) % 10 == 0) for r in rows)


def test_lattice_sums_all_segmentations():
    v = lattice_lm.load_vocabulary(lattice_lm.default_vocabulary())
    score = lambda b: float(np.append(v.scores, -np.inf)[v.find(np.array([lattice_lm.B.hash_of(b)], np.uint64))][0])

    def total(word):
        if not word:
            return 1.0
        return sum(math.exp(score(word[:k])) * total(word[k:]) for k in range(1, len(word) + 1) if np.isfinite(score(word[:k])))

    for w in (b" the", b" xq", " né".encode(), b" thorn", b" \xff"):
        got = lattice_lm.word_scores(v, np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
        assert got == pytest.approx(math.log(total(w)))


def test_a_long_word_in_blocks(monkeypatch):
    v = lattice_lm.load_vocabulary(lattice_lm.default_vocabulary())
    w = np.frombuffer(b" " + b"thornbush" * 40, np.uint8)
    sums = lambda: np.zeros(len(v.scores))
    whole, cut = sums(), sums()
    a = lattice_lm.word_scores(v, w, np.array([0]), np.array([len(w)]), np.array([2.0]), whole)
    monkeypatch.setattr(lattice_lm, "BLOCK", 37)
    b = lattice_lm.word_scores(v, w, np.array([0]), np.array([len(w)]), np.array([2.0]), cut)
    assert np.allclose(a, b) and np.allclose(whole, cut) and whole.sum() > 2


def test_learned_scores_against_brute_force(spark):
    """Expected piece counts over all segmentations, listed one by one, give what learn() gives."""
    v = lattice_lm.load_vocabulary(lattice_lm.default_vocabulary())
    counts = {"then": 4, "at": 7, "it": 2, "ant": 3, "rat": 5, "tea": 1, "hen": 3, "net": 2, "ten": 6, "thin": 2, "on": 9, "no": 1}
    df = spark.createDataFrame([*counts.items(), ("", 6)], "word string, n long")
    lattice_lm.ship(spark)
    kept = {r.word for r in df.where("pmod(xxhash64(word), 5) = 0").collect()}
    id_of = lambda b: int(v.find(np.array([lattice_lm.B.hash_of(b)], np.uint64))[0])

    def ways(word):
        if not word:
            return [[]]
        return [[i, *rest] for k in range(1, len(word) + 1) if (i := id_of(word[:k])) >= 0 for rest in ways(word[k:])]

    def expected(some, scores, ends):
        out = np.zeros(len(scores))
        for w, n in some.items():
            paths = ways(b" " + w.encode())
            p = np.array([math.exp(sum(scores[i] for i in x)) for x in paths])
            for x, q in zip(paths, p / p.sum()):
                for i in x:
                    out[i] += n * q
        out[-1] += ends
        return out

    def mixed(n, weight):
        p = weight * np.exp(v.scores) + (1 - weight) * (n + 1e-9) / (n + 1e-9).sum()
        return np.log(p / p.sum())

    learn_on = {w: n for w, n in counts.items() if w not in kept}
    scores = v.scores
    for _ in range(lattice_lm.ROUNDS):
        n = expected(learn_on, scores, 6 * 0.8)
        scores = mixed(n, lattice_lm.WEIGHTS[0])
    likely = lambda s: sum(c * math.log(sum(math.exp(sum(s[i] for i in x)) for x in ways(b" " + w.encode()))) for w, c in counts.items() if w in kept)
    best = max(lattice_lm.WEIGHTS, key=lambda w: (likely(mixed(n, w)), -w))
    want = mixed(expected(counts, mixed(n, best), 6), best)
    assert kept and np.allclose(np.exp(lattice_lm.learn(df, v).scores), np.exp(want), atol=1e-6)
    assert lattice_lm.learn(df.where("word = ''"), v) is v


def test_scores(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, "aa", 30).title()) for i in range(40)] + [(40, None), (41, ""), (40, "repeated katora"), (None, "katora"), (42, "ka" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("own"))
    held = lattice_lm.held_out(F.col("doc_id"))
    token = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    import zlib

    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in token(t))
    n, v, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    for frequent in (0, 5, 100_000):
        got = lattice_lm.score_texts(df, ~held, frequent=frequent).collect()
        assert len(got) == len(rows)
        want = sorted(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in token(t)) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1))) for _, t in rows)
        assert np.allclose(sorted(r.base_score for r in got), want)
        assert {r.train_tokens for r in got} == {n} and sum(r.n_tokens for r in got) == sum(len(token(t)) + 1 for _, t in rows)
        assert sum(r.n_known for r in got) == sum(sum(c[w] > 0 for w in token(t)) + 1 for _, t in rows)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lattice_lm.score_texts(df.limit(0), ~held).count() == 0


def statistics(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(win)
    twice = {j for i, x in enumerate(win) if n[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum((text or "").count(s) for s in "#*$%&|<>"), dup, len(twice)


def test_statistics(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t ", "a", "a a a a", "x y z x y z", "l\nl\n\nl\n ", "é# ñ| b <c>", "a b\n" * 400, words(rng, "aa", 3000)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(3, 40))) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = quality_rules.judge(df, quality_rules.DecisionList(())).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        want = statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)


def plain_cover(rows, bins):
    """The same choices, by trying every condition on every row."""
    ok = lambda b, rule: all((b[f] >= at) == up for f, up, at in rule)
    rules, left, told = [], list(rows), []

    def bits():
        n, out = sum(bins) * 2, 0.0
        for r in rules:
            out += (math.log2(len(r) + 1) + len(r) * math.log2(max(n, 2))) / 2
        gone = len(rows) - len(left)
        wrong = sum(r[0] for r in rows) - sum(r[0] for r in left)
        missed = sum(not r[0] for r in left)
        return out + math.log2(math.comb(gone, wrong)) + math.log2(math.comb(len(left), missed))

    told.append(bits())
    while True:
        rule = []
        while len(rule) < quality_rules.MOST_CONDITIONS:
            live = [r for r in left if r[1] and ok(r[2], rule)]
            p0 = sum(not r[0] for r in live)
            if p0 in (0, len(live)):
                break
            best = None
            for c in [(f, up, at) for f, k in enumerate(bins) for at in range(k, 0, -1) for up in (True, False)]:
                met = [r for r in live if ok(r[2], [c])]
                p = sum(not r[0] for r in met)
                if p >= quality_rules.LEAST_COVERED:
                    gain = p * (math.log2(p / len(met)) - math.log2(p0 / len(live)))
                    if gain > (best[0] if best else 1e-9):
                        best = (gain, c)
            if best is None:
                break
            rule.append(best[1])
        tried = []
        for k in range(1, len(rule) + 1):
            met = [r for r in left if ok(r[2], rule[:k])]
            bad, other = sum(not r[0] for r in met), [r for r in met if not r[1]]
            if bad >= quality_rules.LEAST_COVERED and bad / len(met) >= quality_rules.LEAST_PRECISION:
                p = sum(not r[0] for r in other)
                tried.append(((2 * p - len(other)) / len(other) if other else -1.0, -k))
        if not tried:
            break
        rules.append(rule[: -max(tried)[1]])
        left = [r for r in left if not ok(r[2], rules[-1])]
        told.append(bits())
        if told[-1] > min(told) + quality_rules.SLACK_BITS:
            break
    return rules[: told.index(min(told))]


@pytest.mark.parametrize("seed", range(6))
def test_rules_against_brute_force(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(250):
        b = [rng.randrange(5) for _ in range(3)]
        bad = (b[0] >= 3 and b[1] < 2) or b[2] >= 4 or rng.random() < 0.02
        rows.append((not bad, rng.random() < 0.67, b))
    got = quality_rules.cover(rows, [4, 4, 4])
    assert got == plain_cover(rows, [4, 4, 4]) and got
    assert quality_rules.cover([r for r in rows if r[0]], [4, 4, 4]) == [] and quality_rules.cover([], [4, 4, 4]) == []


def test_judged_rows_keep_columns_of_any_name(spark):
    own = ["q", "row", "__text", "__words", "__step", "__q", "__row", "kept"]
    df = spark.createDataFrame([("a b c", *own), (None, *own)], "text string, " + ", ".join(f"`{c}` string" for c in own))
    got = quality_rules.judge(df, quality_rules.DecisionList(())).collect()
    assert [r.asDict()[c] for r in got for c in own[:-1]] == own[:-1] * 2 and [r.kept for r in got] == [False, False]


def test_rules_are_learned(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        t = words(rng, "aa", 120)
        rows.append((i, "$$ ".join(t.split(" ")) if bad else t))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 0), (5, None), (9999, 0)], "doc_id long, quality int")
    rules = quality_rules.learn(docs, marks)
    assert rules.rules
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, rules).collect()}
    assert all(kept[i] == (y == 1) for i, y in labels)
    assert quality_rules.learn(docs, marks.limit(0)).rules == ()
    assert quality_rules.judge(docs.limit(0), rules).count() == 0
