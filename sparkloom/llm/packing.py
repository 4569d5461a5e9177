"""Sequence packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: whole pieces of `most` tokens, then
the binary digits of the rest, largest first. Every piece is a sequence of its own, so no sequence crosses
documents and none needs padding; sequences of equal length form the buckets that batches are drawn from.
Each document is cut where it is read: packing moves nothing between tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import bytesops as B
from sparkloom.llm.store import ship

MOST = 4096
END_ID = 2
#: Words that a Python worker remembers with their ids; further words are encoded each time.
KNOWN_WORDS = 250_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts word by word, for a tokenizer whose pre-tokens never cross white space.

    Words are looked up by a hash of their bytes; those not seen before are encoded together and remembered
    up to KNOWN_WORDS of them.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[int, bytes] = {}

    def encode_words(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 512):
            part = texts[at : at + 512]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.cumsum([0, *(len(t) + 1 for t in part)])
            ids = np.array(e.ids, np.uint32)
            first = np.array([o[0] for o in e.offsets], np.int64)
            cut = np.searchsorted(first, begins, "left")
            out += [ids[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's begin (one more entry at the end)."""
        data, offsets = B.column_bytes(column)
        starts, ends, firsts = B.words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        unique, at, which = np.unique(B.Spans(data).hash(starts, ends), return_index=True, return_inverse=True)
        found = [self.known.get(h) for h in unique.tolist()]
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            raw = data.tobytes()
            for k, ids in zip(new, self.encode_words([raw[starts[at[k]] : ends[at[k]]].decode("utf-8", "replace") for k in new]), strict=True):
                found[k] = ids
                if len(self.known) < KNOWN_WORDS:
                    self.known[int(unique[k])] = ids
        sizes = np.array([len(x) for x in found], np.int64) // 4
        table = np.frombuffer(b"".join(found), "<u4")
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        ids, cuts = B.gather(table, begin[which], (begin + sizes)[which])
        return ids, cuts[firsts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file; its remembered words serve all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(n: int, most: int = MOST) -> list[int]:
    """Lengths of the pieces of a document with n tokens: whole ones, then the binary digits of the rest."""
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, text: str = "text", key: str = "doc_id", most: int = MOST, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, bucket, ids, sequence_id, offset), one row each.

    A document's ids are the tokenizer's, without special tokens, then end_id; ids holds the piece's as
    little-endian unsigned 32-bit numbers, bucket is the binary logarithm of its length, sequence_id is
    unique for the piece and offset its place there, always 0. Null or empty text: the end id alone, one piece
    of one token. A repeated row is packed again, null doc_ids are carried, an empty table gives an empty
    result, further columns are ignored. A very long text makes more pieces, nothing is cut off. most must be a
    power of two.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                ids, firsts = encode(piece.column(1))
                # The end id after each text's own.
                ids = np.insert(ids, firsts[1:], end_id)
                sizes = np.diff(firsts) + 1
                lengths = [cuts(int(n), most) for n in sizes]
                count = np.array([len(x) for x in lengths])
                length = np.concatenate([np.array(x, np.int64) for x in lengths])
                ends = np.cumsum(length)
                begin = ends - length
                start = begin - np.repeat(np.cumsum(sizes) - sizes, count)
                offsets = np.append(begin, ends[-1]) * 4
                own = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                rep = pa.array(np.repeat(np.arange(len(sizes)), count))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(rep), pa.array(start), pa.array(length), pa.array(np.repeat(sizes, count)), pa.array(np.log2(length).astype(np.int32)), own],
                    names=["doc_id", "start", "length", "doc_tokens", "bucket", "ids"],
                )

    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = texts.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, bucket int, ids binary")
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write packed sequences with one folder for each length, for training that draws batches of equal length."""
    packed.write.partitionBy("bucket").parquet(path)
