"""Memories out of texts and of segments of sessions. An extractor is a column function from a text to
array<struct<content, context, resolution, tags>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS
from sparkloom.functions import messages as M
from sparkloom.functions import quality
from sparkloom.functions.text import strip
from sparkloom.operators import knowledge as K
from sparkloom.sources.sessions import slices


def first_line(text: Column) -> Column:
    """An extractor for want of a model: one memory with the text's first line."""
    none = F.lit("")
    return F.array(F.struct(F.substring_index(strip(text), "\n", 1).alias("content"), none.alias("context"), none.alias("resolution"), F.array().cast("array<string>").alias("tags")))


#: What an extractor as a table function gives, behind the key of its window.
EXTRACTED = "key string, pos int, content string, context string, resolution string, tags array<string>"


def table_extractor(extract):
    """An extractor that sees a whole window, as a Python table function over TABLE(...) PARTITION BY key ORDER BY place, with rows(key, text).

    extract takes the window's texts in order and gives dictionaries of content and, where there are, context, resolution and tags. A
    window's rows come to it one by one; they are held until it ends, as far as `window` characters of the caller's windows go.
    """

    @F.udtf(returnType=EXTRACTED)
    class Extract:
        def __init__(self):
            self.key, self.texts = None, []

        def eval(self, row):
            self.key = row["key"]
            self.texts.append(row["text"] or "")

        def terminate(self):
            for pos, m in enumerate(extract(self.texts)):
                if (m.get("content") or "").strip():
                    yield str(self.key), pos, m["content"], m.get("context") or "", m.get("resolution") or "", list(m.get("tags") or [])

    return Extract


def extracted_by_table(windows: DataFrame, extractor, place: str = "place") -> DataFrame:
    """(key, pos, content, context, resolution, tags) of windows(key, place, text) by a table_extractor."""
    rows = windows.select("key", place, "text").asTable().partitionBy("key").orderBy(place)
    return extractor(rows)


def extracted(texts: DataFrame, key: list[str], base_tags: Column, extractor) -> DataFrame:
    """(key, pos, content, context, resolution, tags) of texts(key, text); memories without content go."""
    each = texts.select(*key, base_tags.alias("__base"), F.posexplode(extractor(F.col("text"))).alias("pos", "m"))
    tags = F.concat("__base", F.coalesce("m.tags", F.array().cast("array<string>")))
    out = each.select(*key, "pos", F.col("m.content").alias("content"), F.coalesce("m.context", F.lit("")).alias("context"), F.coalesce("m.resolution", F.lit("")).alias("resolution"), tags.alias("tags"))
    return out.where(strip(F.coalesce("content", F.lit(""))) != "")


def ingest_texts(texts: DataFrame, existing: DataFrame, extractor=first_line, **options) -> DataFrame:
    """What knowledge.upload() makes of the memories in texts(source_file, text), with new_id, tags and source_file.

    Blank texts are left out. A file's name without folders is put after the extracted tags as source:<name>.
    """
    some = texts.where(strip(F.coalesce("text", F.lit(""))) != "")
    found = extracted(some, ["source_file"], F.array().cast("array<string>"), extractor)
    name = F.substring_index("source_file", "/", -1)
    tagged = found.withColumn("tags", F.when(F.coalesce("source_file", F.lit("")) != "", F.concat("tags", F.array(F.concat(F.lit("source:"), name)))).otherwise(F.col("tags")))
    new = tagged.withColumn("new_id", F.xxhash64("source_file", "pos", "content"))
    return K.upload(new, existing, order=("source_file", "pos", "new_id"), **options)


def segment_tags() -> Column:
    """Tags of what comes from a segment: its kind, number, topic and agent; blank ones are left out."""
    given = lambda c, tag: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", tag)
    return F.array_compact(
        F.array(
            F.lit("trajectory"),
            F.concat(F.lit("type:"), quality.task_type(F.col("quality_metrics"))),
            F.concat(F.lit("segment:"), F.substring(F.col("id").cast("string"), 1, 8)),
            given(F.col("topic"), F.concat(F.lit("topic:"), F.substring("topic", 1, 40))),
            given(F.col("agent_id"), F.concat(F.lit("agent:"), F.col("agent_id").cast("string"))),
        )
    )


def extract(segments: DataFrame, messages: DataFrame, window: int = DEFAULTS.extract_window_tokens, extractor=first_line) -> DataFrame:
    """(id, window, pos, content, context, resolution, tags): what an extractor makes of each token window of each of
    segments(id, session, start_line, end_line, topic, agent_id, quality_metrics)."""
    w = M.windows(slices(segments, messages), ["id"], window)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", F.concat(F.lit("["), "role", F.lit("]: "), "text").alias("l")))), lambda e: e["l"])
    texts = w.groupBy("id", "window").agg(F.array_join(lines, "\n").alias("text"))
    own = segments.select("id", segment_tags().alias("__tags"))
    return extracted(texts.join(own, "id"), ["id", "window"], F.col("__tags"), extractor)


def extract_and_upload(segments: DataFrame, messages: DataFrame, existing: DataFrame, window: int = DEFAULTS.extract_window_tokens, extractor=first_line, **options) -> DataFrame:
    """What knowledge.upload() makes of the memories in segments of sufficient score that none were taken from yet."""
    score = quality.score(F.col("quality_metrics"))
    fit = segments.where("labeled AND NOT memory_extracted").where(score >= DEFAULTS.memory_score)
    found = extract(fit, messages, window, extractor).withColumnRenamed("id", "segment_id")
    new = found.withColumn("new_id", F.xxhash64("segment_id", "window", "pos"))
    return K.upload(new, existing, order=("segment_id", "window", "pos"), **options)


def memories_of_segments(memories: DataFrame, superseded: DataFrame) -> DataFrame:
    """memories with those that came from superseded segments(id) archived, found by their tags."""
    tags = superseded.select(F.concat(F.lit("segment:"), F.substring(F.col("id").cast("string"), 1, 8)).alias("tag")).distinct()
    hit = memories.where("status <> 'archived'").select("id", F.explode("tags").alias("tag")).join(tags, "tag", "left_semi").select("id").distinct()
    return memories.join(hit.withColumn("__gone", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("__gone"), "archived").otherwise(F.col("status"))).drop("__gone")
