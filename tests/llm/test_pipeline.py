"""The corpus pipeline on the smallest tables: each stage keeps what its own operator says, and nothing else."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_stages(spark):
    import corpus_pipeline as P
    from sparkloom.llm import decontam, lang_id, near_dup, packing, quality_rules
    from sparkloom.llm.store import saved

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.unionByName(spark.createDataFrame([(10**6, "123 456", "en", "s", 7), (10**6 + 1, None, None, None, None)], docs.schema))
    assert [n for n, _ in P.STAGES] == ["language ID", "quality rules", "near-dedup", "decontamination", "packing"]
    now = own
    seen = []
    for name, f in P.STAGES:
        out = saved(f(spark, now, SF), "test")
        seen.append((name, now, out))
        if name != "packing":
            assert out.columns == docs.columns
        now = out
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, p) = seen
    model = lang_id.train(docs.where(~lang_id.held_out(F.col("doc_id"))))
    assert ids(b) == ids(lang_id.predict(a, model, spans=False).where("lang_pred <> 'und' AND score >= 0.5")) and not {10**6, 10**6 + 1} & ids(b)
    rules = quality_rules.learn(b, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(c) == ids(quality_rules.judge(b, rules).where("kept"))
    groups = near_dup.near_duplicates(c)
    assert ids(d) == {r.class_id for r in groups.select("class_id").collect()} and d.count() == len(ids(d))
    hits = decontam.contained_items(d, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(e) == ids(d) - ids(hits)
    assert p.agg(F.sum("length")).first()[0] == packing.pack(e).agg(F.sum("length")).first()[0] and ids(p) == ids(e)


@pytest.mark.parametrize("rows", ["none", "twice"])
def test_stages_of_odd_tables(spark, rows):
    """An empty table passes every stage; rows that come twice are one document after near-dedup, with columns of any name."""
    import corpus_pipeline as P
    from sparkloom.llm.store import saved

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("node", F.lit("own")).withColumn("__q", F.lit("own"))
    now = docs.limit(0) if rows == "none" else docs.unionByName(docs)
    for name, f in P.STAGES:
        now = saved(f(spark, now, SF), "odd")
        if name != "packing":
            assert now.columns == docs.columns
        if name == "near-dedup" and rows == "twice":
            assert now.count() == now.select("doc_id").distinct().count() > 50
    assert (now.count() == 0) == (rows == "none")
