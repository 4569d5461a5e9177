"""Periodic maintenance as Structured Streaming micro-batches: every batch runs the due steps, each on its own."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger(__name__)
Step = Callable[[DataFrame, int], None]


def run_steps(batch: DataFrame, batch_id: int, steps: dict[str, Step]) -> dict[str, str]:
    """Run every step on the batch; one that fails is noted and does not stop the others."""
    batch = batch.persist()
    out = {}
    try:
        for name, step in steps.items():
            try:
                step(batch, batch_id)
                out[name] = "ok"
            except Exception as e:
                log.warning("step %s failed on batch %s: %s", name, batch_id, e)
                out[name] = f"failed: {e}"
    finally:
        batch.unpersist()
    return out


def maintain(source: DataFrame, steps: dict[str, Step], checkpoint: str, every: str | None = None, seen: Callable[[int, dict[str, str]], None] | None = None) -> StreamingQuery:
    """Start the loop over a streaming source: once over what is there, or `every` interval such as '6 hours'.

    Steps must tolerate a batch that comes again after a failure: they upsert or insert by key.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        result = run_steps(batch, batch_id, steps)
        if seen:
            seen(batch_id, result)

    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def hit_log(spark: SparkSession, path: str, schema: str = "id long, ts timestamp_ntz, weight long") -> DataFrame:
    """A folder of Parquet files with hits as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def adoption_stream(hits: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window, id, hits): weights by id and day, late rows up to the watermark."""
    return hits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "id").agg(F.sum("weight").alias("hits"))


def apply_by_batch(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write what a stream gives, once over what is there, a folder for each batch; a batch that comes again replaces its own folder."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
