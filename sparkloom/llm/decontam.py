"""Benchmark decontamination: size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with the whole of it. So items are put into
size classes (shingle counts from 2**k up to 2**(k+1) - 1), and for each class a document is cut into overlapping
windows of twice the class's greatest size, every such size; an item's passage lies whole in some window, where
its Jaccard similarity is at least 0.8 / 4.2 = 0.19 if its containment is 0.8. One-row bands of SLOTS minima then
miss it with a chance of 0.81**64, about 10**-6. What is found is verified by exact containment of the item's shingles in the
whole document.

Items are the query set: they are worked through in blocks of at most BLOCK_ITEMS items with BLOCK_BYTES bytes
of text, PASS_BLOCKS of them in one pass over the documents, so that what is broadcast is bounded whatever the number
of items. Documents stay where they are; each is read and cut into words and shingles once a pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import bytesops as B
from sparkloom.llm.store import ship

WIDTH = 5
THRESHOLD = 0.8
SLOTS = 64
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
PASS_BLOCKS = 4
SCHEMA = "doc_id long, item_id long, shared long, item_shingles long, containment double"

_G = np.random.Generator(np.random.PCG64(5))
_MULT = _G.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _minima(h: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """For each slot the minimum of every segment of h that begins at starts."""
    for m in _MULT:
        yield np.minimum.reduceat(h * m, starts)


class Items:
    """A block of items: their distinct shingles, and for each size class the sorted minima of each slot."""

    def __init__(self, ids: np.ndarray, texts: pa.Array) -> None:
        h, _, firsts = B.text_shingles(texts, WIDTH)
        sizes = np.diff(firsts)
        self.ids, self.sizes = ids, sizes
        self.shingles, self.firsts = h, firsts
        # Every (shingle, item), by shingle, for the exact count.
        order = np.argsort(h, kind="stable")
        self.by_shingle, self.item_of = h[order], np.repeat(np.arange(len(ids)), sizes)[order]
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        level = np.where(sizes > 0, np.floor(np.log2(np.maximum(sizes, 1))).astype(int), -1)
        for k in np.unique(level[level >= 0]):
            members = np.flatnonzero(level == k)
            own = np.concatenate([h[firsts[i] : firsts[i + 1]] for i in members])
            starts = np.concatenate([[0], np.cumsum(sizes[members])[:-1]])
            slots = []
            for low in _minima(own, starts):
                o = np.argsort(low, kind="stable")
                slots.append((low[o], members[o]))
            self.classes[int(k)] = slots


def _pairs(left: np.ndarray, right: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index into keys and position in the sorted array for all matches; left, right from searchsorted."""
    n = right - left
    at = np.repeat(np.arange(len(keys)), n)
    return at, np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def shingled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every shingle of the texts in order, and the index of its text."""
    import pyarrow.compute as pc

    data, offsets = B.column_bytes(pc.utf8_lower(column))
    starts, ends, firsts = B.words(data, offsets)
    return B.shingles(B.Spans(data).hash(starts, ends), firsts, WIDTH)


def search(items: Items, h: np.ndarray, doc: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of text, index of item, shared shingles) where containment reaches the threshold, of shingled() texts."""
    found: list[np.ndarray] = []
    n_items = len(items.ids)
    if len(h) and items.classes:
        doc_starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        lengths = np.diff(np.append(doc_starts, len(h)))
        # Blocks of the least class's size with their minima; those of the next class are two of them each.
        least = min(items.classes)
        per = -(-lengths // (2 << least))
        begin = np.repeat(doc_starts, per) + (2 << least) * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
        levels: list[tuple[int, np.ndarray, np.ndarray | None, np.ndarray]] = []
        block_doc, join = doc[begin], None
        for k in range(least, max(items.classes) + 1):
            if k > least:
                within = np.arange(len(block_doc)) - np.searchsorted(block_doc, block_doc, "left")
                join = np.flatnonzero(within % 2 == 0)
                block_doc = block_doc[join]
            levels.append((k, block_doc, join, np.append(block_doc[1:] == block_doc[:-1], False)))
        for slot, low in enumerate(_minima(h, begin)):
            for k, block_doc, join, followed in levels:
                if join is not None:
                    low = np.minimum.reduceat(low, join)
                if k not in items.classes:
                    continue
                sorted_low, members = items.classes[k][slot]
                # A window is a block with the next one of the same text.
                window = np.where(followed, np.minimum(low, np.append(low[1:], low[-1:])), low)
                left = np.searchsorted(sorted_low, window, "left")
                hit = np.flatnonzero(sorted_low[np.minimum(left, len(sorted_low) - 1)] == window)
                if len(hit):
                    left, right = left[hit], np.searchsorted(sorted_low, window[hit], "right")
                    at, pos = _pairs(left, right, hit)
                    found.append(np.unique(block_doc[hit[at]] * n_items + members[pos]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z
    code = np.unique(np.concatenate(found))
    # Exact containment over the whole texts that have a candidate.
    has = np.unique(code // n_items)
    mine = np.isin(doc, has)
    doc, h = doc[mine], h[mine]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    doc, h = doc[new], h[new]
    left, right = np.searchsorted(items.by_shingle, h, "left"), np.searchsorted(items.by_shingle, h, "right")
    hit = np.flatnonzero(right > left)
    at, pos = _pairs(left[hit], right[hit], hit)  # at: index into hit
    pair, shared = np.unique(doc[hit[at]] * n_items + items.item_of[pos], return_counts=True)
    among = np.isin(pair, code)
    pair, shared = pair[among], shared[among]
    ok = shared >= threshold * items.sizes[pair % n_items] - 1e-9
    return pair[ok] // n_items, pair[ok] % n_items, shared[ok]


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The items in blocks of bounded size, in the order that toLocalIterator reads them, a partition at a time."""
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for row in benchmark.select(F.col(key).cast("long").alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or size + len(row.t) > BLOCK_BYTES):
            yield np.array(ids, object), pa.array(texts, pa.string())
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t)
    if ids:
        yield np.array(ids, object), pa.array(texts, pa.string())


def _passes(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[np.ndarray, pa.Array]]]:
    blocks = _blocks(benchmark, key, text)
    while some := list(islice(blocks, PASS_BLOCKS)):
        yield some


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): a row for each row of docs and item that it contains.

    containment is the share of the item's distinct five-word shingles (lower case, words between ASCII white
    space) that the whole text has. Items with fewer than five words, or null, have no shingle and match nothing;
    null texts count as empty and contain nothing. A repeated row of either table gives its own rows. Ids are
    carried as they are, null too. Empty tables give an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for blocks in _passes(benchmark, item_key, item_text):
        shared = spark.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = [Items(*b) for b in shared.value]
            for batch in batches:
                for piece in B.pieces(batch, "text"):
                    h, doc = shingled(piece.column(1))
                    for items in held:
                        d, i, n = search(items, h, doc, threshold)
                        size = items.sizes[i].astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [piece.column(0).take(pa.array(d)), pa.array(list(items.ids[i]), pa.int64()), pa.array(n.astype(np.int64)), pa.array(size), pa.array(n / size)],
                            names=["doc_id", "item_id", "shared", "item_shingles", "containment"],
                        )

        out = out.unionByName(texts.mapInArrow(run, SCHEMA))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of docs, all columns as they were, that contain no item; nothing is moved between tasks.

    The same search as contained_items, as a filter on the texts themselves.
    """
    spark = docs.sparkSession
    ship(spark)

    def cleaner(shared):
        @F.arrow_udf("boolean")
        def clean(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
            held = [Items(*b) for b in shared.value]
            for part in column:
                batch = pa.RecordBatch.from_arrays([part.fill_null("")], names=["text"])
                bad = np.zeros(len(part), bool)
                at = 0
                for piece in B.pieces(batch, "text"):
                    h, doc = shingled(piece.column(0))
                    for items in held:
                        d, _, _ = search(items, h, doc, threshold)
                        bad[at + np.unique(d)] = True
                    at += piece.num_rows
                yield pa.array(~bad)

        return clean

    out = docs
    for blocks in _passes(benchmark, item_key, item_text):
        out = out.where(cleaner(spark.sparkContext.broadcast(blocks))(F.col(text).cast("string")))
    return out
