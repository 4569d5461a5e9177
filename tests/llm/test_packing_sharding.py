"""Packing and sharding: exact round trips and laws, with nulls, long texts, repeated rows and empty tables."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import packing, sharding

TEXTS = [(1, "it's DON'T <|endoftext|> café  x y 12,5"), (2, None), (3, ""), (4, "word " * 6000), (5, "same"), (5, "same"), (None, "no id"), (6, "ΣΑΣ \U0001f600 x y")]


def docs(spark):
    return spark.createDataFrame([(i, t, "own", 7) for i, t in TEXTS], "doc_id long, text string, ids string, size int")


def test_pieces_hold_every_id_once(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs(spark)).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and len(r.ids) == 4 * r.length and 1 << r.bucket == r.length for r in rows)
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start)):
        by.setdefault((r.doc_id, r.start), []).append(r)
    for i, text in {(i, t) for i, t in TEXTS}:
        want = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        copies = Counter(x for x, _ in TEXTS)[i]
        own = [r for k, r in enumerate(own) if k % copies == 0]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == want
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert {r.doc_tokens for r in own} == {len(want)}
        assert zlib.crc32(own[0].ids) == packing.pack(docs(spark)).where(F.col("doc_id").eqNullSafe(i) & (F.col("start") == 0)).select(F.crc32("ids")).first()[0]


def test_cuts():
    assert packing.cuts(4096 * 2 + 13) == [4096, 4096, 8, 4, 1]
    assert packing.cuts(1) == [1]


def test_packing_nothing(spark):
    assert packing.pack(docs(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark), most=1000)


def check_shards(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return {k: sum(r.size for r in v) for k, v in by.items()}


def test_shards_are_near_equal(spark):
    df = spark.createDataFrame([(i, "x" * (i * 37 % 101), 1) for i in range(4000)], "doc_id long, text string, shard int")
    rows = sharding.histogram_shards(df).collect()
    sizes = check_shards(rows, 8)
    assert len(rows) == 4000 and set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 102 + 0.002 * sum(sizes.values())
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in order] == sorted(r.doc_id for r in rows)


def test_splitters_are_those_of_sorted_sums(spark):
    """Without tolerance each boundary is the one of the sorted rows whose bytes below come nearest to its share."""
    import random

    rng = random.Random(12)
    rows = [(k, "x" * rng.choice([0, 3, 40, 41, 700])) for k in rng.sample(range(-(10**12), 10**12), 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.histogram_shards(df, tolerance=0.0).collect()}
    ordered = sorted(rows)
    below = [0]
    for _, t in ordered:
        below.append(below[-1] + len(t) + 1)
    cuts = [min(range(len(below)), key=lambda j, w=below[-1] * i / 8: (abs(below[j] - w), j)) for i in range(1, 8)]
    want, seen = {}, {}
    for i, (k, _) in enumerate(ordered):
        shard = sum(j <= i for j in cuts)
        want[k] = (shard, seen.get(shard, 0))
        seen[shard] = seen.get(shard, 0) + 1
    assert got == want


def test_a_hot_id_is_parted(spark):
    df = spark.createDataFrame([(7, "same text")] * 1000 + [(i, "y" * 9) for i in range(1000, 2000)], "doc_id long, text string")
    sizes = check_shards(sharding.histogram_shards(df).collect(), 8)
    assert max(sizes.values()) < 1.3 * min(sizes.values())


def test_shards_of_odd_rows(spark):
    rows = sharding.histogram_shards(docs(spark)).collect()
    assert len(rows) == len(TEXTS)
    check_shards(rows, 8)
    assert {(r.doc_id, r.size) for r in rows} == {(i, len((t or "").encode()) + 1) for i, t in TEXTS}
    assert all(r.text_crc32 == zlib.crc32((dict(TEXTS).get(r.doc_id) or "").encode()) for r in rows if r.doc_id)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert sharding.histogram_shards(docs(spark).limit(0)).count() == 0


def test_shards_keep_columns_of_any_name(spark):
    own = ["k", "salt", "range", "at", "row", "block", "__k", "__range"]
    df = spark.createDataFrame([(i, "x" * (i % 7), *own) for i in range(100)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in own))
    out = sharding.histogram_shards(df)
    assert out.columns == [*df.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = out.collect()
    assert len(got) == 100 and all([r.asDict()[c] for c in own] == own for r in got)
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_one_exchange(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    plan = sharding.histogram_shards(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_buckets_are_written_by_length(spark, tmp_path):
    df = spark.createDataFrame([(1, "one two three"), (2, None), (3, "a " * 5000)], "doc_id long, text string")
    packed = packing.pack(df)
    packing.write_buckets(packed, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]
    assert back.where("length <> power(2, bucket)").count() == 0 and back.where("octet_length(ids) <> 4 * length").count() == 0
