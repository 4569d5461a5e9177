"""A training corpus from documents: language, quality, near duplicates, benchmark items, then packing.

Each stage is one of the operators of sparkloom.llm and takes the Parquet that the stage before it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontam, lang_id, near_dup, packing, quality_rules
from sparkloom.llm.queries import pieces, table
from sparkloom.llm.store import discard, saved

#: A document is rejected if no language takes at least this share of its words.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; rejected are those without letters and those in no one language."""
    source = table(spark, sf_dir, "documents")
    model = lang_id.train(source.where(~lang_id.held_out(F.col("doc_id"))))
    out = lang_id.predict(docs, model, spans=False)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list and the base rules keep."""
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return near_dup.keep_one(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left."""
    return pieces(packing.pack(docs))


STAGES = [("language ID", language), ("quality rules", quality), ("near-dedup", near_duplicates), ("decontamination", decontaminate), ("packing", pack)]

#: Learned models and tokenizers are not expressible in SQL; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage{k}")
            # What a stage read goes once its own result is written.
            discard(before)
    return docs
