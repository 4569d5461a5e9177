"""Substring deduplication, source divergence and tokenizer alignment against plain versions."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import alignment, divergence, queries, substring_dedup

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "so", "ti") for b in ("dor", "fen", "gal", "his", "jun", "kel", "lom", "pas", "rit", "ves")]
SPACES = [" ", " ", " ", "\n", "  ", "\t", "\x0b", "\r\n"]


def prose(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice(SPACES) for _ in range(n))


def words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def removed(rows):
    """{row: flags of the words that go}; rows: (doc_id, text), a null doc_id last."""
    place = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            first[key] = min(first.get(key, ((True, 1 << 70), 0)), (place(d), i))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (place(d), i):
                gone[i : i + 20] = [True] * 20
        out.append((str(d), len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out)


def repeats():
    rng = random.Random(5)
    passages = [prose(rng, n) for n in (19, 20, 21, 25, 60, 200)]
    texts = [prose(rng, rng.randrange(0, 300)) for _ in range(60)]
    for k in range(120):
        a, b = rng.choice(texts), rng.choice(passages)
        cut = rng.randrange(0, len(a) + 1)
        texts.append(a[:cut] + " " + b + " " + a[cut:])
    loop = " ".join(["na"] * 70)
    turns = " ".join(["one two three"] * 30)
    texts += [loop, loop + " " + turns, turns + " ende", passages[4] + passages[4] + passages[5], "", None, "É " * 45, " ", " ".join(WORDS[:30]), " ".join(WORDS[:19])]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("together", [400_000, 60])
@pytest.mark.parametrize("spread", ["none", "some"])
def test_repeats_against_brute_force(spark, monkeypatch, together, spread):
    monkeypatch.setattr(substring_dedup, "TOGETHER", together)
    if spread == "some":
        # Every anchor may be dealt by content.
        monkeypatch.setattr(substring_dedup, "SAMPLE", 0.9)
        monkeypatch.setattr(substring_dedup, "HOT", 4)
    rows = repeats()
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, doc string, at string").repartition(7)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in substring_dedup.remove_repeats(df).collect())
    assert got == removed(rows)
    assert sum(r[2] for r in got) > 3000


def test_factors_refer_to_equal_words(spark):
    rows = repeats()
    at = {d: words(t) for d, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    covered = defaultdict(set)
    longest = 0
    for r in substring_dedup.factors(df).collect():
        assert r.length >= 20 and (r.ref_doc_id, r.ref_start) < (r.doc_id, r.start)
        assert at[r.doc_id][r.start : r.start + r.length] == at[r.ref_doc_id][r.ref_start : r.ref_start + r.length]
        covered[r.doc_id] |= set(range(r.start, r.start + r.length))
        longest = max(longest, r.length)
    assert longest >= 200
    assert {d: len(c) for d, c in covered.items()} == {int(d): n for d, _, n, _ in removed(rows) if n}


def test_repeats_of_odd_rows(spark, monkeypatch):
    rng = random.Random(9)
    long = prose(rng, 60)
    other = prose(rng, 10) + long
    rows = [(1, long), (1, long), (1, other), (None, long), (None, None), (7, ""), (2, "few words"), (5, prose(rng, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed(rows)
    for size in (10_000, 2):
        monkeypatch.setattr(substring_dedup, "TOGETHER", size)
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in substring_dedup.remove_repeats(df).collect())
        assert got == want
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0
    assert substring_dedup.factors(df.limit(0)).count() == 0


def test_block_in_small_batches():
    """The stream of a block gives the same whatever batches it comes in."""
    rng = random.Random(2)
    rows = sorted((rng.randrange(6), rng.randrange(4), rng.randrange(5), rng.randrange(3) << substring_dedup.START | rng.randrange(2)) for _ in range(300))
    rows = [(b, b * 10 + d, doc, at) for b, d, doc, at in rows]
    want = None
    for size in (300, 1, 2, 7):
        batches = []
        for i in range(0, 300, size):
            part = [np.array(c, np.int64) for c in zip(*rows[i : i + size], strict=True)]
            batches.append(substring_dedup._batch(*part, refs=None, names=substring_dedup.PHRASES))
        out = sorted(str(r) for b in substring_dedup._parse_block(iter(batches)) for r in b.to_pylist())
        want = want or out
        assert out == want


def same_as_sql(spark, rows, schema, query, sql):
    df = spark.createDataFrame(rows, schema)
    c = duckdb.connect()
    c.register("documents", pa.Table.from_batches(df._jdf and [pa.RecordBatch.from_pylist([r.asDict() for r in df.collect()], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())]))]))
    want = c.execute(sql)
    names = [d[0] for d in want.description]
    got = query(df)
    assert sorted(got.columns) == sorted(names)
    got = [tuple(r[n] for n in names) for r in got.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))
    return got


def test_divergence_against_sql(spark):
    rng = random.Random(7)
    rows = []
    for i in range(700):
        lang = rng.choice(["en", "de", "fr", None])
        mine = WORDS[: 20 if lang == "en" else 40] + ["Äpfel", "x1y", "日本", "can't", "AKB"]
        rows.append((i, " ".join(rng.choice(mine) for _ in range(rng.randrange(0, 30))) if i % 50 else None, lang, rng.choice(["s1", "s2", "sé", None])))
    rows += [(900, "only once here", "it", "s1"), (901, "", "it", "s2"), (902, "", "es", "s1"), rows[0], rows[0], (None, "BADOR bador", "en", "lone")]
    got = same_as_sql(spark, rows, "doc_id long, text string, lang string, source string", divergence.audit, divergence.ORACLE_SQL)
    assert {r[2] for r in got} == {"pair", "term"} and len(got) > 200
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert divergence.audit(df.limit(0)).count() == 0
    small = divergence.audit(df, least_docs=1, top=2).where("part = 'term'")
    assert small.groupBy("lang", "source").count().agg({"count": "max"}).first()[0] == 2


def test_shares_of_large_counts(spark):
    from pyspark.sql import functions as F

    n, total, v = 3 * 10**12 + 7, 10**15 + 3, 10**8
    df = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    assert df.select(divergence._p(F.col("n"), F.col("total"), F.col("v")).alias("p")).first().p == 1 + 10**9 * (n + 5) // (total + 5 * v)


ODD = [
    "plain words here", " lead", "trail ", "two  spaces", "tab\there", "line\nbreak \n x", " hard  space", "x  y", "x　 y", "“quoted” — dash", "é è ü ß", "日本語 テキスト です", "🙂 🙂🙂x", "a" * 300, "1234567890" * 20,
    "<|endoftext|> text <s> </s> <unk> <0x41>", "sharp▁mark", "▁", " ", "\n", "\x00 nul\x00", "don't we'll", "x \u0085y", "\x1c x\x1d y", "https://a.b/c?d=e&f#g", "ﬁ ½ Å", "​zero ​ width", "mixed\r\n  lines \r\n\r\n end",
    "\t\t x", "== == ==", "    indented = 4", "é combined", "\U0001f468‍\U0001f469‍\U0001f467 family",
]


def plain_alignment(texts):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    chars = alignment.byte_level()
    docs, holds = [], Counter()
    for t in texts:
        groups = []
        if t:
            x = a.encode(" " + t, add_special_tokens=False)
            ta = [bytes(chars[c] for c in s) for s in x.tokens]
            ib = b.encode(t)
            tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(ta) == b"".join(tb) == (" " + t).encode():
                ea, eb = list(itertools.accumulate(map(len, ta))), list(itertools.accumulate(map(len, tb)))
                last = 0
                for end in sorted(set(ea) & set(eb)):
                    groups.append(([i for i, e in zip(x.ids, ea, strict=True) if last < e <= end], [i for i, e in zip(ib, eb, strict=True) if last < e <= end]))
                    last = end
        links = Counter((p, q) for ga, gb in groups for p in ga for q in gb)
        holds.update(links.keys())
        docs.append((groups, links))
    top = defaultdict(int)
    for (p, _), n in holds.items():
        top[p] = max(top[p], n)
    out = []
    for groups, links in docs:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()), sum(n for k, n in links.items() if holds[k] == top[k[0]]), sum(n * holds[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_alignment_against_plain_version(spark, monkeypatch, small):
    if small:
        for name, n in (("CHUNK_POSTINGS", 50), ("CHUNK_DOCS", 3), ("TOGETHER", 10), ("KNOWN_UNITS", 30), ("LARGE_GROUP", 2)):
            monkeypatch.setattr(alignment, name, n)
    rng = random.Random(3)
    texts = ODD + [None, ""]
    for _ in range(80):
        texts.append("".join(rng.choice([*ODD, *WORDS[:20], "ing", "Été"]) + rng.choice(["", " ", " ", " ", "\n", "  "]) for _ in range(rng.randrange(1, 40))))
    texts += ["the same text"] * 40 + [" ".join(rng.choice(WORDS) for _ in range(3000))]
    rows = [(None if i % 17 == 3 else i // 2, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(6)
    got = sorted(str((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in alignment.align(df).collect())
    assert got == sorted(str((d, *x)) for (d, _, _), x in zip(rows, plain_alignment(texts), strict=True))
    assert alignment.align(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_source_divergence"])
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = [tuple(r[n] for n in names) for r in queries.QUERIES[name](spark, sf).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))
