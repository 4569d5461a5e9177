"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is factored against the text of all documents that come before it, and its own text before. The
reference is cut into blocks by content: in each window of WINDOW words the run of ANCHOR words with the least hash is
its anchor, a phrase is the longest run of windows with one anchor, and a block is all phrases whose anchors fall to
it. Two equal windows have the same anchor at the same place, so they meet in one block, and a phrase is factored
against every block by going to the one block that can hold its windows.

A block is indexed by sorting: its phrases stand by anchor, then by content, then in corpus order, in Spark's sorted
and spillable streams. A phrase whose content came before is a factor that refers to its first occurrence; phrases that
go on in the same reference are one factor (`factors`). A factor ends where an anchor returns with other words around
it. Those boundary phrases alone are looked at window by window, in a second index of the same kind.

Copies are combined before they are shuffled: of a phrase that repeats within a task's piece of work only the first
occurrence goes to the block, the others refer to it at once. An anchor that many different phrases share is spread by
content, and all of its phrases are boundary phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import bytesops as B
from sparkloom.llm.store import discard, saved, ship

#: Words of a window, which is the least length of a factor, and of the anchors in it.
WINDOW = 20
ANCHOR = 8
#: A place is the index of its first word, above the number of windows (4 bits), above the variant of the text.
START, VARIANT = 25, 21
#: Phrases that a task combines before it gives them away.
TOGETHER = 400_000
#: Of this share of all documents, the SPREAD anchors met most often, HOT times or more, are dealt by content.
SAMPLE, SPREAD, HOT = 1 / 64, 2000, 256

PHRASES = "block long, digest long, doc long, at long, ref_doc long, ref_at long"
FOUND = "doc long, at long, ref_doc long, ref_at long"
_STEP = np.uint64(0xD6E8FEB86659FD93)


def place(start: np.ndarray, windows: np.ndarray | int, variant: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << START) | (np.asarray(windows, np.int64) << VARIANT) | variant.astype(np.int64)


class Runs:
    """Hashes of any runs of words, each in constant time."""

    def __init__(self, hashes: np.ndarray) -> None:
        up, self.down = B.powers(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return B.mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def least(x: np.ndarray, width: int) -> np.ndarray:
    """For every run of `width` values the index of its least one, the leftmost of equals."""
    at, size = np.arange(len(x)), 1
    while size < width and len(at):
        step = min(size, width - size)
        a, b = at[:-step], at[step:]
        at, size = np.where(x[b] < x[a], b, a), size + step
    return at


def windows(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window, and the index of its text; firsts: each text's first word, and the end."""
    counts = np.maximum(np.diff(firsts) - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(text)) + np.repeat(firsts[:-1] - (np.cumsum(counts) - counts), counts), text


def phrases(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(anchor, content, text, start in the text, windows) of the phrases of the texts, in order."""
    data, offsets = B.column_bytes(column)
    starts, ends, firsts = B.words(data, offsets)
    begin, text = windows(firsts)
    if not len(begin):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    run = Runs(B.Spans(data).hash(starts, ends))
    i = np.arange(len(starts) - ANCHOR + 1)
    grams = run.hash(i, i + ANCHOR)
    at = least(grams, WINDOW - ANCHOR + 1)[begin]
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    count = np.diff(np.append(new, len(begin)))
    first, text = begin[new], text[new]
    return grams[at[new]], run.hash(first, first + count + WINDOW - 1), text, first - firsts[text], count


def _batch(*columns: np.ndarray, refs: tuple[np.ndarray, np.ndarray] | None, names: str) -> pa.RecordBatch:
    n = len(columns[0])
    own = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]
    own += [pa.array(r) for r in refs] if refs else [pa.nulls(n, pa.int64())] * 2
    return pa.RecordBatch.from_arrays(own, names=[c.split()[0] for c in names.split(", ")])


def _combined(block: np.ndarray, digest: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The first occurrence of every content, to be dealt by block; later ones with their reference, dealt evenly."""
    order = np.lexsort((at, doc, digest))
    block, digest, doc, at = block[order], digest[order], doc[order], at[order]
    n = len(digest)
    new = np.append(True, digest[1:] != digest[:-1])
    rep = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    first = (doc == doc[rep]) & (at >> START == at[rep] >> START)
    again = np.append(False, (digest[1:] == digest[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]))
    k = first & ~again
    yield _batch(block[k], digest[k], doc[k], at[k], refs=None, names=PHRASES)
    k = ~first & ~again
    if k.any():
        yield _batch(B.mix(digest[k] + np.flatnonzero(k).astype(np.uint64)), digest[k], doc[k], at[k], refs=(doc[rep[k]], at[rep[k]]), names=PHRASES)


def _together(rows: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows of _combined, TOGETHER of them at a time."""
    part, n = [], 0
    for r in rows:
        part.append(r)
        n += len(r[0])
        if n >= TOGETHER:
            yield from _combined(*(np.concatenate(c) for c in zip(*part, strict=True)))
            part, n = [], 0
    if n:
        yield from _combined(*(np.concatenate(c) for c in zip(*part, strict=True)))


def _numbers(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    return np.asarray(column.fill_null(0)).view(kind)


def _parse_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted phrases of blocks to factors (with their reference) and boundary phrases (without).

    Carried from batch to batch is the first occurrence of the last content alone, and whether it was given away.
    """
    held, told = None, False
    for batch in batches:
        known = np.asarray(batch.column(4).is_valid())
        block, digest = (_numbers(batch.column(k), np.uint64) for k in (0, 1))
        doc, at, ref_doc, ref_at = (_numbers(batch.column(k)) for k in (2, 3, 4, 5))
        if known.any():
            yield _batch(doc[known], at[known], refs=(ref_doc[known], ref_at[known]), names=FOUND)
        rows = [x[~known] for x in (block, digest, doc, at)]
        before = 0
        if held is not None:
            before = len(held[0])
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        block, digest, doc, at = rows
        n = len(block)
        if n == before:
            continue
        new_block = np.append(True, block[1:] != block[:-1])
        new = new_block | np.append(True, digest[1:] != digest[:-1])
        rep = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        first = (doc == doc[rep]) & (at >> START == at[rep] >> START)
        run = np.cumsum(new_block) - 1
        many = np.bincount(run[new]) > 1
        if before and told:
            many[0] = True
        boundary = many[run] | (block == digest)
        k = ~first
        if k.any():
            yield _batch(doc[k], at[k], refs=(doc[rep[k]], at[rep[k]]), names=FOUND)
        k = first & boundary
        if told:
            k[:before] = False
        if k.any():
            yield _batch(doc[k], at[k], refs=None, names=FOUND)
        last = np.flatnonzero(first[rep[-1] :]) + rep[-1]
        held, told = [x[last] for x in rows], bool(boundary[-1])


def _parsed(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("block").sortWithinPartitions("block", "digest", "doc", "at").mapInArrow(_parse_block, FOUND)


def _variant() -> Column:
    """Tells texts of the same doc_id apart."""
    return F.crc32("text").bitwiseAND(F.lit((1 << VARIANT) - 1))


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return texts.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), _variant().alias("variant"), "text")


def _hot_anchors(texts: DataFrame) -> np.ndarray:
    """Anchors to deal by content: at most SPREAD. Which they are decides where work is done, never a result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(phrases(piece.column(0))[0].view(np.int64))], names=["anchor"])

    some = texts.sample(SAMPLE, 11).select("text").mapInArrow(run, "anchor long").groupBy("anchor").count()
    top = some.where(F.col("count") >= HOT).orderBy(F.desc("count"), "anchor").limit(SPREAD).collect()
    return np.sort(np.array([r.anchor for r in top], np.int64).view(np.uint64))


def parse(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of factors (doc, at, ref_doc, ref_at) of all documents, saved; discard() it after use.

    doc is the key, null counting as the greatest long; at packs the start of the piece in words, its windows and the
    variant of the text (`place`); ref_doc and ref_at are an earlier occurrence of the same words.
    """
    ship(docs.sparkSession)
    texts = _texts(docs, text, key)
    hot = _hot_anchors(texts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                doc, variant = (_numbers(piece.column(k)) for k in (0, 1))
                anchor, digest, of, start, count = phrases(piece.column(2))
                yield np.where(np.isin(anchor, hot), digest, anchor), digest, doc[of], place(start, count, variant[of])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                doc, variant = (_numbers(piece.column(k)) for k in (0, 1))
                data, offsets = B.column_bytes(piece.column(2))
                starts, ends, firsts = B.words(data, offsets)
                run = Runs(B.Spans(data).hash(starts, ends))
                at = piece.column(3)
                of = np.repeat(np.arange(len(doc)), np.asarray(at.value_lengths()))
                at = np.asarray(at.flatten())
                n = at >> VARIANT & 15
                of, start = np.repeat(of, n), np.repeat(at >> START, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i = start + firsts[of]
                h = run.hash(i, i + WINDOW)
                yield h, h, doc[of], place(start, 1, variant[of])

    columns = texts.select("doc", "variant", "text")
    parsed = saved(_parsed(columns.mapInArrow(lambda b: _together(cut(b)), PHRASES)), "factors")
    # The windows of boundary phrases: those that occur before are factors too.
    boundary = _by_text(parsed.where("ref_doc IS NULL"))
    joined = columns.join(boundary, ["doc", "variant"]).select("doc", "variant", "text", "ats")
    edges = _parsed(joined.mapInArrow(lambda b: _together(look(b)), PHRASES)).where("ref_doc IS NOT NULL")
    edges = saved(edges, "factor-edges")
    out = parsed.where("ref_doc IS NOT NULL").unionByName(edges)
    out._parts = (parsed, edges)
    return out


def release(parsed: DataFrame) -> None:
    """Delete the tables behind parse()'s result."""
    discard(*parsed._parts)


def _by_text(found: DataFrame) -> DataFrame:
    return found.groupBy("doc", F.col("at").bitwiseAND(F.lit((1 << VARIANT) - 1)).alias("variant")).agg(F.collect_list("at").alias("ats"))


def factors(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Factors (doc_id, start, length, ref_doc_id, ref_start), in words, of WINDOW words or more.

    Pieces that go on in the same reference are one factor. Rows of one doc_id are one document, a null doc_id stands
    after all others and is given as the greatest long. Texts of fewer than WINDOW words, empty and null ones have none.
    """
    f = parse(docs, text, key).select(
        "doc", F.col("at").bitwiseAND(F.lit((1 << VARIANT) - 1)).alias("variant"), F.shiftright("at", START).alias("s"), F.shiftright("at", VARIANT).bitwiseAND(F.lit(15)).alias("n"),
        "ref_doc", F.shiftright("ref_at", START).alias("r"),
    ).distinct()
    along = Window.partitionBy("doc", "variant", "ref_doc", F.col("s") - F.col("r")).orderBy("s")
    ended = F.max(F.col("s") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    f = f.withColumn("new", F.when(F.col("s") <= ended, 0).otherwise(1)).withColumn("island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    f = f.groupBy("doc", "variant", "ref_doc", (F.col("s") - F.col("r")).alias("shift"), "island").agg(F.min("s").alias("start"), F.max(F.col("s") + F.col("n")).alias("end"))
    return f.select(F.col("doc").alias("doc_id"), "start", (F.col("end") - F.col("start") + WINDOW - 1).alias("length"), F.col("ref_doc").alias("ref_doc_id"), (F.col("start") - F.col("shift")).alias("ref_start"))


def kept_words(column: pa.Array, of: np.ndarray, ats: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text, those that the pieces at `ats` of the texts `of` cover, and the others joined by one space."""
    data, offsets = B.column_bytes(column)
    starts, ends, firsts = B.words(data, offsets)
    n = len(starts)
    change = np.zeros(n + 1, np.int64)
    begin = firsts[of] + (ats >> START)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + (ats >> VARIANT & 15) + WINDOW - 1, -1)
    kept = np.cumsum(change)[:n] == 0
    total = np.concatenate([[0], np.cumsum(kept)])[firsts]
    at = np.flatnonzero(kept)
    # All words but a text's last kept one take a space after them.
    more = np.ones(len(at), bool)
    more[total[1:][np.diff(total) > 0] - 1] = False
    own, cuts = B.gather(data, starts[at], ends[at] + more)
    own[cuts[1:][more] - 1] = 32
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(cuts[total].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(own)))
    return np.diff(firsts), np.diff(firsts) - np.diff(total), texts.cast(pa.string())


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents (doc_id, n_words, n_removed, text) without the words of windows that occur earlier in the corpus.

    Words are runs of other than ASCII white space, unchanged; a window is WINDOW consecutive words of one document. Each
    word goes that lies in a window whose words also start earlier: in a document with a smaller doc_id, or before it in the
    same one; windows are judged on the input. The words that stay are joined by one space. One row for each row of docs.
    Null text counts as empty; a text of fewer words than a window stays. Rows of one doc_id are one document, so that equal
    rows are not earlier than one another; a null doc_id stands after all others. Columns of any other name are ignored, an
    empty table gives an empty result, texts of any length are worked through whole.
    """
    found = parse(docs, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                ats = piece.column(2)
                of = np.repeat(np.arange(len(ats)), _numbers(ats.value_lengths().cast(pa.int64())))
                n_words, n_removed, texts = kept_words(piece.column(1), of, np.asarray(ats.flatten()))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n_words), pa.array(n_removed), texts], names=["doc_id", "n_words", "n_removed", "text"])

    joined = _texts(docs, text, key).join(_by_text(found), ["doc", "variant"], "left").select("doc_id", "text", "ats")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")
