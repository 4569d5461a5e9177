"""The maintenance cycle over state tables: seven steps in order, each on its own, committed one by one.

A table's versions are Parquet folders that never change. A step that ends writes one small record: the batch and step, how it ended, and the
folders of all tables from then on. The record is put in place by a rename, so a step is done or not done. What comes again, a batch
after a restart or a whole batch delivered twice, passes over the steps that have a record and goes on with the next; what a
step wrote before it was killed is in no record. A step that fails leaves the tables as they were, and the others go on.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.config import DEFAULTS
from sparkloom.functions import quality
from sparkloom.operators import aggregates as A
from sparkloom.operators import clusters as C
from sparkloom.operators import evolution as E
from sparkloom.operators import extraction as Q
from sparkloom.operators import knowledge as K
from sparkloom.operators import ranking as R
from sparkloom.operators import similarity as V
from sparkloom.operators import writes as W
from sparkloom.sources.sessions import slices

log = logging.getLogger(__name__)
#: Takes the tables, the batch's rows and number; gives the tables that change.
Step = Callable[[dict[str, DataFrame], DataFrame, int], dict[str, DataFrame]]

SCHEMAS = {
    "messages": "session long, msg_idx long, role string, content string, reasoning_content string, tool_calls string, name string, tool_call_id string, stop_reason string, body string",
    "segments": "id long, session long, segment_index long, start_line long, end_line long, fingerprint string, topic string, agent_id string, labeled boolean, memory_extracted boolean, quality_metrics string",
    "memories": "id long, memory_type string, content string, context string, resolution string, tier string, hit_count long, status string, created_at timestamp_ntz, last_hit_at timestamp_ntz, embedding array<double>, tags array<string>",
    "contributions": "memory_id long, content string, context string, resolution string, contributed_at timestamp_ntz",
    "centroids": "seq long, cluster_id long, n long, sums array<double>",
    "clusters": "cluster_id long, topic string, skill_slug string, created_at timestamp_ntz",
    "members": "cluster_id long, memory_id long, added_at timestamp_ntz",
    "skills": "slug string, version string, name string, description string, text string, structure_score double",
    "evolutions": "cluster_id long, skill_slug string, status string, new_score double, timestamp timestamp_ntz",
    "runs": "id long, eligible long, status string, created_at timestamp_ntz",
}


class Store:
    """State tables in a folder that driver and executors share, with the records of the steps that made them."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] | None = None) -> None:
        self.spark, self.root, self.schemas = spark, root, schemas or SCHEMAS
        self.jvm = spark._jvm

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def records(self) -> list[str]:
        fs, p = self._fs(f"{self.root}/log")
        return sorted(f.getPath().getName() for f in fs.listStatus(p) if not f.getPath().getName().startswith("_")) if fs.exists(p) else []

    def record(self, name: str) -> dict:
        fs, p = self._fs(f"{self.root}/log/{name}")
        stream = fs.open(p)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def paths(self) -> dict[str, str]:
        names = self.records()
        return self.record(names[-1])["tables"] if names else {}

    def tables(self) -> dict[str, DataFrame]:
        """All tables as the last record has them; those never written are empty."""
        paths = self.paths()
        return {n: self.spark.read.schema(s).parquet(paths[n]) if n in paths else self.spark.createDataFrame([], s) for n, s in self.schemas.items()}

    def write(self, name: str, table: DataFrame) -> str:
        schema = StructType.fromDDL(self.schemas[name])
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(path)
        return path

    def commit(self, key: str, record: dict) -> None:
        fs, target = self._fs(f"{self.root}/log/{key}")
        _, temporary = self._fs(f"{self.root}/log/_{key}-{uuid.uuid4().hex}")
        out = fs.create(temporary)
        try:
            out.write(bytearray(json.dumps(record).encode()))
        finally:
            out.close()
        if not fs.rename(temporary, target):
            fs.delete(temporary, False)


def run_cycle(store: Store, batch: DataFrame, batch_id: int, steps: dict[str, Step]) -> dict[str, str]:
    """Run the steps that the batch has no record of, in order; how each ended."""
    done, out = set(store.records()), {}
    for k, (name, step) in enumerate(steps.items()):
        key = f"{batch_id:012d}-{k:03d}"
        if key in done:
            out[name] = store.record(key)["status"]
            continue
        paths = store.paths()
        try:
            changed = step(store.tables(), batch, batch_id)
            paths |= {n: store.write(n, t) for n, t in changed.items()}
            status = "ok"
        except Exception as e:
            log.warning("step %s failed on batch %s: %s", name, batch_id, e)
            status = f"failed: {type(e).__name__}"
        store.commit(key, {"batch": batch_id, "step": name, "status": status, "tables": paths})
        out[name] = status
    return out


def run_stream(store: Store, lines: DataFrame, steps: dict[str, Step], checkpoint: str, every: str | None = None):
    """Start the cycle over a stream of session lines: once over what is there, or `every` interval such as '6 hours'."""
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, batch_id: run_cycle(store, batch, batch_id, steps) and None)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def steps(
    as_of: Callable[[int], str], embedder=K.embed, extractor=Q.first_line, scorer=None, confirm=None, merger=None, synthesize=None, revise=None, verify=None, topic=None,
    window: int = DEFAULTS.extract_window_tokens, soft: float = DEFAULTS.dedup_soft, hard: float = DEFAULTS.dedup_hard, cluster: float = DEFAULTS.cluster_similarity, trigger: int = DEFAULTS.sft_trigger,
) -> dict[str, Step]:
    """The seven steps; as_of gives a batch's time. Models are arguments, as in the operators that the steps call."""

    def time(batch_id: int):
        return F.lit(as_of(batch_id)).cast("timestamp_ntz")

    def segment(t: dict[str, DataFrame], batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        """New lines are put to their sessions, and these cut into segments; those that a longer one takes the place of go, with their memories archived."""
        messages = W.insert_or_ignore(t["messages"], batch.select(*t["messages"].columns), ["session", "msg_idx"])
        own = messages.join(batch.select("session").distinct(), "session", "left_semi").where("body IS NOT NULL")
        found = K.segment_sessions(own, window)
        new = found.join(t["segments"].select("session", "fingerprint"), ["session", "fingerprint"], "left_anti")
        old = t["segments"].alias("k").join(new.alias("f"), ["session", "segment_index"]).select("k.id")
        rows = new.select(
            F.xxhash64("session", "fingerprint").alias("id"), "session", "segment_index", "start_line", "end_line", "fingerprint", F.lit("").alias("topic"), F.lit("").alias("agent_id"),
            F.lit(False).alias("labeled"), F.lit(False).alias("memory_extracted"), F.lit(None).cast("string").alias("quality_metrics"),
        )
        kept = t["segments"].join(old, "id", "left_anti").select(*t["segments"].columns)
        return {"messages": messages, "segments": kept.unionByName(rows), "memories": Q.memories_of_segments(t["memories"], old)}

    def label(t: dict[str, DataFrame], batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        s = t["segments"]
        lines = F.array_sort(F.collect_list(F.struct("msg_idx", "body")))
        texts = slices(s.where("NOT labeled"), t["messages"]).groupBy("id").agg(F.array_join(F.transform(lines, lambda e: e["body"]), "\n").alias("text"))
        made = K.label(texts, scorer).select("id", F.col("quality_metrics").alias("__metrics"))
        out = s.join(made, "id", "left").withColumns({"labeled": F.col("labeled") | F.col("__metrics").isNotNull(), "quality_metrics": F.coalesce("__metrics", "quality_metrics")})
        return {"segments": out}

    def extract(t: dict[str, DataFrame], batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        """Memories of the segments of sufficient score, uploaded one after the other, and those inserted put to clusters."""
        s = t["segments"]
        up = Q.extract_and_upload(s, t["messages"], t["memories"], window=window, extractor=extractor, embedder=embedder, confirm=confirm, soft=soft, hard=hard)
        memories = K.complete_uploads(t["memories"], up, as_of(batch_id), merger, embedder)
        grown = C.leader_clusters(up.where("action = 'insert'").select(F.col("new_id").alias("id"), "embedding"), cluster, start=t["centroids"])
        members = grown.assigned.where("cluster_id IS NOT NULL").select("cluster_id", F.col("id").alias("memory_id"), time(batch_id).alias("added_at"))
        founded = grown.clusters.join(t["clusters"], "cluster_id", "left_anti").select("cluster_id", F.lit("").alias("topic"), F.lit("").alias("skill_slug"), time(batch_id).alias("created_at"))
        taken = F.col("labeled") & F.coalesce(quality.score(F.col("quality_metrics")) >= DEFAULTS.memory_score, F.lit(False))
        return {
            "memories": memories, "contributions": t["contributions"].unionByName(K.contributions(up, as_of(batch_id))), "centroids": grown.clusters, "clusters": t["clusters"].unionByName(founded),
            "members": t["members"].unionByName(members), "segments": s.withColumn("memory_extracted", F.col("memory_extracted") | taken),
        }

    def rebalance(t: dict[str, DataFrame], batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        tiers = R.tier_rebalance(t["memories"]).select("id", F.col("new_tier").alias("tier"))
        return {"memories": W.archive_stale(W.update(t["memories"], tiers, ["id"], ["tier"]), as_of(batch_id), DEFAULTS.cold_ttl_days)}

    def evolve(t: dict[str, DataFrame], batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        made, revised = E.cycle(t["clusters"], t["members"], t["memories"], t["skills"], t["evolutions"], synthesize=synthesize, revise=revise, verify=verify, topic=topic)
        new = made.where("outcome = 'crystallized'").select("slug", "version", "name", "description", F.col("content").alias("text"), F.col("score").alias("structure_score"))
        better = revised.where("outcome = 'recrystallized'").select(F.col("skill_slug").alias("slug"), F.col("new_version").alias("version"), "name", "description", F.col("content").alias("text"), F.col("score").alias("structure_score"))
        audit = E.audit_of_new(made).unionByName(E.audit_of_revised(revised), allowMissingColumns=True)
        history = t["evolutions"].unionByName(audit.select("cluster_id", "skill_slug", "status", "new_score", time(batch_id).alias("timestamp")))
        return {"skills": W.upsert(t["skills"], new.unionByName(better), ["slug"]), "clusters": E.with_skills(t["clusters"], made), "evolutions": history}

    def consolidate(t: dict[str, DataFrame], batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        pairs = V.consolidation_pairs(t["memories"], soft)
        merges = K.greedy_merges(K.mergeable(pairs, hard, dry_run=confirm is None), DEFAULTS.consolidate_most)
        return {"memories": K.apply_merges(t["memories"], merges, merger, embedder, as_of(batch_id))}

    def train(t: dict[str, DataFrame], batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        """A pending run where enough segments are good enough."""
        run = A.eligible(t["segments"], DEFAULTS.sft_score).agg(F.count(F.lit(1)).alias("eligible")).where(F.col("eligible") >= trigger)
        return {"runs": t["runs"].unionByName(run.select(F.lit(batch_id).cast("long").alias("id"), "eligible", F.lit("pending").alias("status"), time(batch_id).alias("created_at")))}

    return {"segment": segment, "label": label, "extract": extract, "rebalance": rebalance, "evolve": evolve, "consolidate": consolidate, "train": train}
