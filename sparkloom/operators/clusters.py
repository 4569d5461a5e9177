"""Sequential leader clustering: each vector joins the nearest centroid, which then moves, or founds a cluster.

Every step depends on all before it. While there are few centroids, a block of vectors is settled in order by one small task that
holds them all. Beyond that the comparison of the block with all centroids is done in Spark, which leaves each vector its few nearest,
and the task needs those alone: a vector's nearest is either one that no vector of the block has touched, and stands in its list, or one
that was touched or founded in the block, and is held there. Where a list is used up before that is sure, the block ends early, and the
next one keeps longer lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS
from sparkloom.operators.ranking import global_rank
from sparkloom.scratch import discard, saved

#: Vectors of a block, centroids that each keeps at first and at most, and centroids up to which a task holds them all.
BLOCK, NEAREST, FARTHEST, HELD = 4096, 8, 256, 8192
CLUSTERS = "seq long, cluster_id {kind}, n long, sums array<double>"
OUT = "place long, id {kind}, cluster_id {kind}, seq long, n long, sums array<double>"


@dataclass
class Clustering:
    """assigned(id, cluster_id): null for a row without a vector; clusters(seq, cluster_id, n, sums): in order of founding, with the
    number and the sum of their members' vectors."""

    assigned: DataFrame
    clusters: DataFrame


class Leader:
    """Centroids as sums of vectors, and the rule of one step."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.seqs: list[int] = []
        self.names: list[object] = []
        self.counts: list[int] = []
        self.sums = np.zeros((0, 0))
        self.sizes = np.zeros(0)

    def hold(self, seq: int, name: object, n: int, vector: np.ndarray) -> int:
        k = len(self.seqs)
        if k == len(self.sums) or self.sums.shape[1] != len(vector):
            bigger, sizes = np.zeros((max(64, 2 * k), len(vector))), np.zeros(max(64, 2 * k))
            if k:
                bigger[:k], sizes[:k] = self.sums[:k], self.sizes[:k]
            self.sums, self.sizes = bigger, sizes
        self.sums[k] = vector
        self.sizes[k] = np.linalg.norm(vector)
        self.seqs.append(seq)
        self.names.append(name)
        self.counts.append(n)
        return k

    def nearest(self, v: np.ndarray) -> tuple[float, int]:
        """Greatest cosine similarity with a held centroid, and its place; ties to the one founded first. -2 if none."""
        n = len(self.seqs)
        if not n:
            return -2.0, -1
        size = self.sizes[:n] * np.linalg.norm(v)
        sim = np.divide(self.sums[:n] @ v, size, out=np.zeros(n), where=size > 0)
        # Rounding keeps the order, so that only those near the top can be it.
        near = np.flatnonzero(sim >= sim.max() - 1e-11)
        sim = dict(zip(near.tolist(), np.round(sim[near], 12).tolist(), strict=True))
        k = min(sim, key=lambda i: (-sim[i], self.seqs[i]))
        return float(sim[k]), int(k)

    def join(self, k: int, v: np.ndarray) -> None:
        self.sums[k] += v
        self.sizes[k] = np.linalg.norm(self.sums[k])
        self.counts[k] += 1


def _near(block: list[tuple[int, list[float]]], threshold: float, most: int):
    """Batches of clusters to (place, sim, seq, cluster_id, n, sums): the `most` of the task's that are nearest to each vector."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, v = [p for p, _ in block], np.array([x for _, x in block], float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                c = np.array(part.column(3).to_pylist(), float).reshape(part.num_rows, -1)
                size = np.linalg.norm(c, axis=1)
                sim = np.round(v @ np.where(size[:, None] > 0, c / np.where(size > 0, size, 1)[:, None], 0).T, 12)
                seq = np.asarray(part.column(0))
                kept = []
                for i in range(len(places)):
                    near = np.flatnonzero(sim[i] >= threshold)
                    if len(near):
                        near = near[np.lexsort((seq[near], -sim[i, near]))[:most]]
                        kept += [(i, k) for k in near]
                if kept:
                    i, k = np.array(kept).T
                    rows = part.take(pa.array(k))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(places)[i]), pa.array(sim[i, k]), *rows.columns], names=["place", "sim", "seq", "cluster_id", "n", "sums"])

    return scan


def leader_clusters(vectors: DataFrame, threshold: float = DEFAULTS.cluster_similarity, order: str = "id", start: DataFrame | None = None, block: int = BLOCK, nearest: int = NEAREST, held: int = HELD) -> Clustering:
    """vectors(id, embedding) clustered one after the other by `order`, going on from the clusters `start` if given.

    A vector joins the cluster whose centroid, the mean of its members, is most similar (cosine, at the threshold, ties to the
    cluster founded first), else it founds one of its id. Rows without a vector get none. Vectors must be of one length.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    spark = vectors.sparkSession
    kind = vectors.schema["id"].dataType.simpleString()
    some = vectors.where("size(embedding) > 0").select("id", F.col("embedding").cast("array<double>").alias("embedding"), F.col(order).alias("__order"))
    rows = global_rank(some, [F.col("__order"), F.col("id")], "place").select("place", "id", "embedding")
    rows = saved(rows, "leader-rows")
    total = rows.count()
    clusters = saved(start.select("seq", F.col("cluster_id").cast(kind).alias("cluster_id"), "n", "sums"), "leader-start") if start is not None else spark.createDataFrame([], CLUSTERS.format(kind=kind))
    founded = (clusters.agg(F.max("seq")).first()[0] or 0) + 1
    done, parts, known, most = 0, [], clusters.count(), nearest
    while done < total:
        own = rows.where((F.col("place") > done) & (F.col("place") <= done + block))
        if known <= held:
            # One group of at most `block` vectors and `held` centroids.
            both = own.unionByName(clusters.select("seq", "cluster_id", "n", F.col("sums").alias("embedding")), allowMissingColumns=True).withColumn("one", F.lit(1))
            settled = saved(both.groupBy("one").applyInArrow(_settle_held(threshold, founded + done), OUT.format(kind=kind)), "leader-settled")
            clusters = settled.where("place IS NULL").select("seq", "cluster_id", "n", "sums")
        else:
            listed = [(r.place, list(r.embedding)) for r in own.select("place", "embedding").collect()]  # at most `block` rows
            near = clusters.mapInArrow(_near(listed, threshold, most + 1), f"place long, sim double, seq long, cluster_id {kind}, n long, sums array<double>")
            # One group of at most `block` rows, each with its nearest centroids of every task cut to `most`.
            top = near.groupBy("place").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("d"), "seq", "cluster_id", "n", "sums"))), 1, most + 1).alias("near"))
            grouped = own.join(top, "place", "left").select("place", "id", "embedding", "near").withColumn("one", F.lit(1))
            settled = saved(grouped.groupBy("one").applyInArrow(_settle(threshold, most, founded + done), OUT.format(kind=kind)), "leader-settled")
            touched = settled.where("place IS NULL").select("seq", "cluster_id", "n", "sums")
            before, clusters = clusters, saved(clusters.join(F.broadcast(touched.select("seq")), "seq", "left_anti").select("seq", "cluster_id", "n", "sums").unionByName(touched), "leader-clusters")
            discard(before)
        parts.append(settled.where("place IS NOT NULL").select("place", "id", "cluster_id"))
        step = parts[-1].count()
        if known > held and step < min(block, total - done) // 2:
            most = min(2 * most, max(FARTHEST, nearest))
        done, known = done + step, clusters.count()
    assigned = spark.createDataFrame([], f"place long, id {kind}, cluster_id {kind}")
    for p in parts:
        assigned = assigned.unionByName(p)
    assigned = vectors.select("id").join(assigned.drop("place"), "id", "left")
    return Clustering(assigned, clusters)


def _settle(threshold: float, nearest: int, next_seq: int):
    """The block's vectors in order to their clusters, then the clusters that they touched (place is null)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        lead = Leader(threshold)
        held: dict[int, int] = {}
        ids, given = group.column("id").to_pylist(), []
        for i, (v, near) in enumerate(zip(group.column("embedding").to_pylist(), group.column("near").to_pylist(), strict=True)):
            v = np.array(v)
            sim, k = lead.nearest(v)
            lists = near or []
            fresh = next((c for c in lists[:nearest] if c["seq"] not in held), None)
            if fresh is None and len(lists) > nearest:
                # All that it knows of were touched and there are more: the next block looks anew.
                break
            if fresh is not None and -fresh["d"] > sim or fresh is not None and -fresh["d"] == sim and fresh["seq"] < lead.seqs[k]:
                sim, k = -fresh["d"], lead.hold(fresh["seq"], fresh["cluster_id"], fresh["n"], np.array(fresh["sums"]))
                held[fresh["seq"]] = k
            if k >= 0 and sim >= threshold:
                lead.join(k, v)
            else:
                k = lead.hold(next_seq + i, ids[i], 1, v)
                held[next_seq + i] = k
            given.append(lead.names[k])
        return _told(group, ids, given, lead)

    return run


def _settle_held(threshold: float, next_seq: int):
    """The block's vectors in order to their clusters, then all clusters; the group has both, clusters without a place."""

    def run(group: pa.Table) -> pa.Table:
        known = group.filter(pc.is_null(group.column("place"))).sort_by("seq")
        group = group.filter(pc.is_valid(group.column("place"))).sort_by("place")
        lead = Leader(threshold)
        for c in zip(*(known.column(n).to_pylist() for n in ("seq", "cluster_id", "n", "embedding")), strict=True):
            lead.hold(*c[:3], np.array(c[3]))
        ids, given = group.column("id").to_pylist(), []
        for i, v in enumerate(group.column("embedding").to_pylist()):
            v = np.array(v)
            sim, k = lead.nearest(v)
            if k >= 0 and sim >= threshold:
                lead.join(k, v)
            else:
                k = lead.hold(next_seq + i, ids[i], 1, v)
            given.append(lead.names[k])
        return _told(group, ids, given, lead)

    return run


def _told(group: pa.Table, ids: list, given: list, lead: Leader) -> pa.Table:
    """OUT of a block: the first rows of the group with the clusters given to them, then the clusters held."""
    n, m = len(given), len(lead.seqs)
    kind = group.schema.field("id").type
    return pa.table(
        {
            "place": pa.array(group.column("place").to_pylist()[:n] + [None] * m, pa.int64()),
            "id": pa.array(ids[:n] + [None] * m, kind),
            "cluster_id": pa.array(given + lead.names, kind),
            "seq": pa.array([None] * n + lead.seqs, pa.int64()),
            "n": pa.array([None] * n + lead.counts, pa.int64()),
            "sums": pa.array([None] * n + [s.tolist() for s in lead.sums[:m]], pa.list_(pa.float64())),
        }
    )
