"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Equal texts form one class first, so copies are never compared. Each class gets SAMPLES consistent weighted
samples of its weighted shingles (Ioffe 2010), banded by ROWS; classes that meet in a band are linked when
their exact weighted Jaccard similarity reaches the threshold; linked classes are one group.

Weights: times in the text x idf, idf = 1 + 0.5 * min(1, ln(N / df) / ln(1 / RARE)). A shingle in less than the
share RARE of all documents counts fully, so only the others need to be known in the tasks: there are at most
(mean shingles of a document) / RARE of them, whatever the size of the corpus. The range of idf is narrow so
that large groups of copies, which make their own shingles common, keep their links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import bytesops as B
from sparkloom.llm.components import connected_components
from sparkloom.llm.store import discard, free_name, saved, ship

WIDTH = 5
THRESHOLD = 0.8
RARE = 0.002
#: Counters are named over at least so many rows of the share RARE, so that chance names few of them.
LEAST_NAMED = 16
#: Characters of texts that a task of that pass reads at most, but for a single text.
NAMING_CHARS = 128 << 20
ROWS, BANDS = 7, 25
SAMPLES = ROWS * BANDS
#: What stars leave open in a bucket is compared in blocks of so many classes.
SMALL_BUCKET = 24
BUCKET_BITS = 22
#: Of 128 samples' lowest bits, 13 differ on average at a similarity of 0.8, with a deviation of 3.4.
MOST_BITS = 25

_TABLE_BITS = 16
_LOW = np.uint64(0xFFFFFFFF)


def _draws() -> dict[str, np.ndarray]:
    """Tabulated variates of the sampling scheme, and two multipliers for each sample."""
    g = np.random.Generator(np.random.PCG64(7))
    n = 1 << _TABLE_BITS
    r, c, beta = g.gamma(2.0, 1.0, n), g.gamma(2.0, 1.0, n), g.random(n)
    return {"r": r, "lnc": np.log(c), "beta": beta, "a": g.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), "b": g.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)}


def _ordered(x: np.ndarray) -> np.ndarray:
    """float32 as integers in the same order, in the upper half of 64 bits."""
    bits = x.astype(np.float32).view(np.int32).astype(np.int64)
    return ((bits ^ ((bits >> 31) & 0x7FFFFFFF)) + 0x80000000).astype(np.uint64) << np.uint64(32)


def _keys(d: dict, index: np.ndarray, weight: np.ndarray | float) -> np.ndarray:
    """Sampling key: what is minimised in the upper half, the level's mark in the lower."""
    r, beta = d["r"][index], d["beta"][index]
    t = np.floor(np.log(weight) / r + beta)
    return _ordered(d["lnc"][index] - r * (t - beta) - r) | (B.mix(t.astype(np.int64).astype(np.uint64)) & _LOW)


class Sampler:
    """Signatures of weighted sets: of each sample 32 bits that name the sampled element and level."""

    def __init__(self, usual: float) -> None:
        self.d = _draws()
        self.usual = usual
        self.table = _keys(self.d, np.arange(1 << _TABLE_BITS), usual)

    def __call__(self, hashes: np.ndarray, weights: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        sets = np.flatnonzero(np.diff(firsts) > 0)
        out = np.zeros((len(firsts) - 1, SAMPLES), np.uint32)
        if not len(sets):
            return out
        begin = firsts[:-1][sets]
        other = np.flatnonzero(weights != self.usual)
        for j in range(SAMPLES):
            x = hashes * self.d["a"][j] + self.d["b"][j]
            index = (x >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            key = self.table[index]
            if len(other):
                key[other] = _keys(self.d, index[other], weights[other])
            key ^= (x >> np.uint64(12)) & _LOW
            out[sets, j] = (np.minimum.reduceat(key, begin) & _LOW).astype(np.uint32)
        return out


class Idf:
    """Weights of shingles from the corpus: n documents, and the shingles that are not rare with their counts."""

    def __init__(self, n: int, hashes: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, counts = hashes[order], counts[order]
        self.idf = 1 + 0.5 * np.clip(np.log(max(n, 1) / np.maximum(counts, 1)) / math.log(1 / RARE), 0, 1)

    def weights(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = np.full(len(hashes), 1.5)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            found = self.hashes[at] == hashes
            w[found] = self.idf[at[found]]
        return w * times


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over sum of the greater ones; 0 if a side is empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if len(a[0]) and len(b[0]) else 0.0


def named_counters(texts: DataFrame) -> DataFrame:
    """(bucket, n): the counters of hashed shingles that reach the share RARE of some task's rows, and the rows under -1.

    Small partitions are read together, up to NAMING_CHARS of text: in a task of few rows the share is a row or two, which nearly
    all shingles reach.
    """
    mask = np.uint64((1 << BUCKET_BITS) - 1)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, rows = np.zeros(1 << BUCKET_BITS, np.int32), 0
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                h, _, _ = B.text_shingles(piece.column(0), WIDTH)
                at, k = np.unique(h & mask, return_counts=True)
                counters[at] += k.astype(np.int32)
                rows += piece.num_rows
        hot = np.flatnonzero(counters >= max(RARE * rows, 1)) if rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hot, -1), pa.int64()), pa.array(np.append(np.zeros(len(hot), np.int64), rows), pa.int64())], names=["bucket", "n"])

    size = texts.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars")).first()
    tasks = max(1, int(size.rows * RARE / LEAST_NAMED), (size.chars or 0) // NAMING_CHARS)
    # At most 2**22 + 1 groups, whatever the corpus.
    return texts.coalesce(tasks).mapInArrow(name, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def corpus_idf(docs: DataFrame, text: str = "text") -> Idf:
    """Exact document counts of all shingles that reach the share RARE, over all rows of docs.

    A shingle with that share of all documents has it in some task's rows at least. So each task keeps a table
    of 2**22 counters of hashed shingles and names those that reach the share of its own rows; only shingles
    that fall on a named counter are then counted, exactly, by a second pass.
    """
    spark = docs.sparkSession
    ship(spark)
    mask = np.uint64((1 << BUCKET_BITS) - 1)
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    named = named_counters(texts).toPandas()
    n = int(named.loc[named.bucket < 0, "n"].sum())
    wanted = np.zeros(1 << BUCKET_BITS, bool)
    wanted[named.bucket[named.bucket >= 0].to_numpy(np.int64)] = True
    bits = spark.sparkContext.broadcast(np.packbits(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                h, _, _ = B.text_shingles(piece.column(0), WIDTH)
                h, k = np.unique(h[on[(h & mask).astype(np.int64)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k.astype(np.int64))], names=["shingle", "df"])

    # At most (mean shingles of a document) / RARE rows reach the share.
    heavy = texts.mapInArrow(count, "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df")).where(F.col("df") >= RARE * n).toPandas()
    return Idf(n, heavy.shingle.to_numpy(np.int64).view(np.uint64), heavy.df.to_numpy(np.int64))


def _band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit key for each band, of samples taken in turn."""
    picks = np.arange(rows * bands).reshape(bands, rows)
    out = np.zeros((len(sig), bands), np.uint64)
    for b, pick in enumerate(picks):
        h = np.full(len(sig), b + 1, np.uint64)
        for k in pick:
            h = B.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, k].astype(np.uint64) + np.uint64(1))
        out[:, b] = h
    return out


def buckets(signed: DataFrame, rows: int, bands: int) -> DataFrame:
    """(bucket, node): each class once for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, SAMPLES)
                keys = _band_keys(sig, rows, bands)
                rep = pa.array(np.repeat(np.arange(len(sig)), bands))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), part.column(0).take(rep)], names=["bucket", "node"])

    return signed.select("node", "sig").mapInArrow(run, "bucket long, node long")


def _alike(a: str, b: str) -> str:
    return f"bit_count({a}.s1 ^ {b}.s1) + bit_count({a}.s2 ^ {b}.s2) <= {MOST_BITS}"


def verified(pairs: DataFrame, texts: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """(src, dst, similarity) of the pairs (src, dst) whose exact weighted Jaccard similarity reaches the threshold."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for piece in (q for p in B.pieces(batch, "ta") for q in B.pieces(p, "tb")):
                src, dst, out = piece.column(0).to_numpy(), piece.column(1).to_numpy(), []
                # The leader of a star comes in many rows: each text once.
                ta, tb = (piece.column(k).dictionary_encode() for k in (2, 3))
                sides = []
                for t in (ta, tb):
                    h, times, firsts = B.text_shingles(t.dictionary, WIDTH)
                    sides.append((h, w.weights(h, times), firsts, t.indices.to_numpy()))
                for i in range(piece.num_rows):
                    (ha, wa, fa, ia), (hb, wb, fb, ib) = sides
                    a, b = slice(fa[ia[i]], fa[ia[i] + 1]), slice(fb[ib[i]], fb[ib[i] + 1])
                    out.append(weighted_jaccard((ha[a], wa[a]), (hb[b], wb[b])))
                sim = np.array(out)
                keep = sim >= threshold
                yield pa.RecordBatch.from_arrays([pa.array(src[keep]), pa.array(dst[keep]), pa.array(sim[keep])], names=["src", "dst", "similarity"])

    first = pairs.join(texts.select(F.col("node").alias("src"), F.col("text").alias("ta")), "src")
    both = first.join(texts.select(F.col("node").alias("dst"), F.col("text").alias("tb")), "dst")
    return both.select("src", "dst", "ta", "tb").mapInArrow(run, "src long, dst long, similarity double")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, copy_of, class_id, copies, class_docs.

    copy_of is the least doc_id with an equal text, copies the number of rows with it; class_id is the least
    doc_id of the group of near duplicates (equal texts and texts linked by weighted Jaccard similarity of at
    least the threshold, transitively), class_docs the number of rows in the group. Null text counts as empty.
    Texts of fewer than five words have no shingle and are only grouped with equal texts. Repeated rows are
    copies of each other and each is returned; a null doc_id is returned as null and names no group unless the
    group has no other. An empty table gives an empty result; further columns are ignored. Texts are told apart
    by a 64-bit hash: two different ones are taken for equal with a chance of 2**-64.
    """
    return _grouped(docs, text, key, threshold).select("doc_id", "copy_of", "class_id", "copies", "class_docs")


def _grouped(docs: DataFrame, text: str, key: str, threshold: float) -> DataFrame:
    """near_duplicates with the class and the group that each row belongs to, as node and g."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("node", F.xxhash64("text"))
    idf = corpus_idf(base)

    shared = spark.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, w = Sampler(1.5), shared.value
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                # A text that comes again in this piece is signed once.
                node, first = np.unique(piece.column(1).to_numpy(), return_index=True)
                some_texts = piece.column(2).take(pa.array(first))
                h, times, firsts = B.text_shingles(some_texts, WIDTH)
                sig = sampler(h, w.weights(h, times), firsts)
                ones = np.packbits((sig[:, :128] & np.uint32(1)).astype(np.uint8), axis=1).view(np.int64)
                at = np.searchsorted(node, piece.column(1).to_numpy())
                head = np.zeros(piece.num_rows, bool)
                head[first] = True
                sigs = [sig[k].tobytes() if new and firsts[k + 1] > firsts[k] else None for k, new in zip(at, head)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(ones[at, 0]), pa.array(ones[at, 1]), pa.array(sigs, pa.binary())], names=["doc_id", "node", "s1", "s2", "sig"]
                )

    rows = saved(base.select("doc_id", "node", "text").mapInArrow(sign, "doc_id long, node long, s1 long, s2 long, sig binary"), "nd-rows")
    classes = saved(
        rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("s1").alias("s1"), F.max("s2").alias("s2"), F.max("sig").alias("sig")),
        "nd-classes",
    )
    signed = classes.where("sig IS NOT NULL")

    # Stars: in each bucket its most central class against the others. Central is what meets most classes in all
    # its buckets; then what has most copies, then the least.
    entries = saved(buckets(signed, ROWS, BANDS), "nd-buckets")
    shared_buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met_in = entries.join(shared_buckets, "bucket")
    several = saved(met_in.join(signed.select("node", "s1", "s2", "copies"), "node").select("bucket", "node", "s1", "s2", "copies", "members"), "nd-several")
    discard(entries)
    degree = several.groupBy("node").agg(F.sum("members").alias("degree"))
    ranked = several.join(degree, "node")
    lead = (
        ranked.groupBy("bucket")
        .agg(F.max(F.struct("degree", "copies", -F.col("node"), "s1", "s2")).alias("top"))
        .select("bucket", F.expr("-top.col3").alias("leader"), F.col("top.s1").alias("s1"), F.col("top.s2").alias("s2"), F.col("top.degree").alias("rank"))
    )
    met = saved(several.alias("e").join(lead.alias("l"), "bucket").select("bucket", "members", "e.node", "e.s1", "e.s2", "e.copies", "leader", "rank", F.expr(_alike("e", "l")).alias("alike")), "nd-met")
    discard(several)
    # Each class's main leader, the most central one, is compared with it in any case.
    main = saved(
        met.groupBy("node").agg(F.max(F.struct(F.col("rank"), -F.col("leader"))).alias("m")).select("node", F.expr("-m.col2").alias("leader")), "nd-main"
    )
    pair = lambda d: d.where("node <> leader").select(F.greatest("node", "leader").alias("src"), F.least("node", "leader").alias("dst"))
    star = pair(met.where("alike")).unionByName(pair(main)).distinct()
    wanted = met.select("node").distinct().join(classes.select("node", "rep"), "node")
    # The texts of classes that met another, once each: from a row with the class's least id and the class's hash.
    texts = saved(
        base.alias("b").join(wanted.alias("w"), (F.col("b.node") == F.col("w.node")) & F.col("b.doc_id").eqNullSafe(F.col("w.rep"))).select("b.node", "b.text").dropDuplicates(["node"]),
        "nd-texts",
    )
    compared = saved(verified(star, texts, idf, 0.0), "nd-links")
    links = compared.where(F.col("similarity") >= threshold)
    group = connected_components(links)
    # How far each class is from its main leader: the distance is a metric, which spares most comparisons below.
    far = (
        main.withColumns({"src": F.greatest("node", "leader"), "dst": F.least("node", "leader")})
        .join(compared, ["src", "dst"], "left")
        .select("node", F.col("leader").alias("ml"), F.when(F.col("node") == F.col("leader"), 1.0).otherwise(F.col("similarity")).alias("ms"))
    )

    # What stars have not settled: buckets whose members are not all of one group yet.
    labelled = saved(
        met.join(group, "node", "left").join(far, "node").select("bucket", "members", "node", "s1", "s2", "copies", "ml", "ms", F.coalesce("component", "node").alias("g")),
        "nd-labelled",
    )
    discard(met, main)
    unsettled = labelled.groupBy("bucket").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("bucket")
    again = labelled.join(unsettled, "bucket")
    held = _shareable(again.select("node").distinct().join(texts, "node"), idf)
    cross = saved(_cross(again.join(held, "node"), threshold), "nd-cross")
    more = saved(verified(cross, texts, idf, threshold), "nd-links")
    group2 = connected_components(links.select("src", "dst").unionByName(more.select("src", "dst")))

    done = saved(
        classes.select("node", "rep", "copies").join(group2, "node", "left").select("node", "rep", "copies", F.coalesce("component", "node").alias("g")),
        "nd-groups",
    )
    named = done.groupBy("g").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_docs"))
    whole = done.join(named, "g").select("node", "g", F.col("rep").alias("copy_of"), "class_id", "copies", "class_docs")
    out = saved(rows.select("doc_id", "node").join(whole, "node"), "nd-out")
    discard(rows, classes, texts, compared, labelled, cross, more, done)
    return out


def _shareable(texts: DataFrame, idf: Idf) -> DataFrame:
    """(node, w, held): the weight of each class and the part of it in shingles that another class of texts has too."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                h, times, firsts = B.text_shingles(piece.column(1), WIDTH)
                w = np.concatenate([[0.0], np.cumsum(shared.value.weights(h, times))])
                node = piece.column(0).to_numpy()
                each = np.repeat(node, np.diff(firsts))
                # A class's whole weight is a row of its own, under its own name in place of a shingle.
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(each, node)), pa.array(np.append(h.view(np.int64), node)), pa.array(np.arange(len(each) + len(node)) >= len(each)), pa.array(np.append(np.diff(w), w[firsts[1:]] - w[firsts[:-1]]))],
                    names=["node", "shingle", "whole", "w"],
                )

    rows = texts.select("node", "text").mapInArrow(run, "node long, shingle long, whole boolean, w double")
    by = rows.groupBy("shingle", "whole").agg(F.count(F.lit(1)).alias("k"), F.max("node").alias("node"), F.max("w").alias("w")).where("whole OR k = 1")
    return by.groupBy("node").agg(F.sum(F.expr("if(whole, w, 0D)")).alias("w"), F.sum(F.expr("if(whole, w, -w)")).alias("held"))


def _cross(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs of bucket-mates of different groups that can reach the threshold, in buckets of any size.

    Pairs of one group could add nothing to what is linked already, so one of a pair is always outside the group
    with most classes of the bucket: these classes are compared with all others of the bucket, which are dealt
    over blocks of about SMALL_BUCKET, so that a large bucket is the work of many tasks. A pair is left out only
    by bounds that hold for certain. Two classes share no more than the lesser of their weights in shingles that
    are not theirs alone; and weighted Jaccard distance is a metric, so the similarities of a pair at the
    threshold with a common leader differ by no more than 1 - threshold.
    """
    able = members.where(f"held >= {threshold} * w * (1 - 1e-9)")
    # At most one bucket a band.
    able = able.join(able.groupBy("node").agg(F.collect_list("bucket").alias("own")), "node")
    sizes = able.groupBy("bucket", "g").agg(F.count(F.lit(1)).alias("k"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("k", "g")).alias("m"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("bucket", F.col("m.g").alias("most"))
    blocks = F.ceil(F.col("members") / SMALL_BUCKET)
    b = able.withColumn("block", F.pmod("node", blocks)).alias("b")
    a = able.join(most, "bucket").where("g <> most").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).alias("a")
    once = "(b.g = a.most OR a.node > b.node)"
    near = f"coalesce(a.ml <> b.ml OR abs(a.ms - b.ms) <= 1 - {threshold} + 1e-9, true)"
    enough = f"least(a.held, b.held) * (1 + 1e-9) >= {threshold} * (a.w + b.w - least(a.held, b.held))"
    here = "array_min(array_intersect(a.own, b.own)) = a.bucket"
    met = a.join(b, F.expr(f"a.bucket = b.bucket AND a.block = b.block AND a.g <> b.g AND {once} AND {near} AND {enough} AND {here}"))
    return met.select(F.greatest("a.node", "b.node").alias("src"), F.least("a.node", "b.node").alias("dst"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that are the first of their group of near duplicates, all columns as they were.

    Of rows with the same doc_id and text one stays. Rows with a null doc_id stay only if their group has no other.
    """
    own, n, i = (free_name(docs, x) for x in ("node", "n", "id"))
    tagged = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    found = _grouped(docs, text, key, THRESHOLD)
    # A group's first row, and of several texts with that id the one with the least hash.
    first = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("g").agg(F.min(F.struct("node", "doc_id")).alias("f")).select(F.col("f.node").alias(n), F.col("f.doc_id").alias(i))
    kept = tagged.join(first, (F.col(own) == F.col(n)) & F.col(key).cast("long").eqNullSafe(F.col(i)), "left_semi")
    return kept.dropDuplicates([key, own]).drop(own)
