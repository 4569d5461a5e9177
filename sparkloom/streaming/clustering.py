"""Leader clustering of a stream: centroids and counts live in the state store, so that a batch goes on where the last ended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.config import DEFAULTS
from sparkloom.operators.clusters import Leader


class LeaderProcessor(StatefulProcessor):
    """State of a shard: one entry for each cluster, (seq) to (cluster_id, n, sums). A row that comes again keeps its cluster."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clusters = handle.getMapState("clusters", "seq long", "cluster_id long, n long, sums array<double>")
        self.members = handle.getMapState("members", "id long", "cluster_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("id", kind="stable")
        lead = Leader(self.threshold)
        for (seq,), (name, n, sums) in sorted(self.clusters.iterator(), key=lambda e: e[0][0]):
            lead.hold(seq, name, n, np.array(sums, float))
        before, touched, given = len(lead.seqs), set(), []
        for i, e in zip(batch["id"], batch["embedding"], strict=True):
            i = int(i)
            if self.members.containsKey((i,)):
                given.append(self.members.getValue((i,))[0])
                continue
            if e is None or not len(e):
                given.append(None)
                continue
            v = np.array(e, float)
            sim, k = lead.nearest(v)
            if k >= 0 and sim >= self.threshold:
                lead.join(k, v)
            else:
                k = lead.hold(len(lead.seqs), i, 1, v)
            touched.add(k)
            given.append(lead.names[k])
            self.members.updateValue((i,), (lead.names[k],))
        for k in touched:
            self.clusters.updateValue((lead.seqs[k],), (lead.names[k], lead.counts[k], lead.sums[k].tolist()))
        yield pd.DataFrame({"shard": key[0], "id": batch["id"].to_numpy(), "cluster_id": pd.array(given, "Int64"), "founded": len(lead.seqs) - before})

    def close(self) -> None:
        pass


def cluster_stream(vectors: DataFrame, threshold: float = DEFAULTS.cluster_similarity) -> DataFrame:
    """(shard, id, cluster_id, founded) of a stream of vectors(shard, id, embedding): each shard is clustered by itself, in order
    of id within a batch and of batches else. founded is the number of clusters that the shard's batch began.

    Needs the RocksDB state store. A task holds the centroids of one shard, and its rows of the batch.
    """
    return vectors.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=LeaderProcessor(threshold), outputStructType="shard string, id long, cluster_id long, founded long", outputMode="Append", timeMode="None"
    )


def run(vectors: DataFrame, out: str, checkpoint: str, threshold: float = DEFAULTS.cluster_similarity) -> None:
    """Cluster what a stream has, once, and write it to the folder out; the next call with the same checkpoint goes on."""
    conf, name = vectors.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = cluster_stream(vectors, threshold).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)
