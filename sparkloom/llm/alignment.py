"""Cross-tokenizer alignment: which ids of two tokenizers stand for the same bytes, and how often corpus-wide.

Each document is cut at the byte offsets where a token of A and one of B both end; the tokens between two cuts are a group,
and each A occurrence of a group is linked with each B occurrence of it. Texts are tokenized once, in parts that both
tokenizers treat alone (`unit_starts`); what a part gives is remembered by its bytes. Every task writes, a chunk of documents
at a time, one row a document and one posting row for each A id: its B ids, the number of documents for each, then document and multiplicity
of every pair.

Posting rows are shuffled by A id and sorted, so that each id comes as one stream: first the numbers of documents of its pairs, added up to counts and
their maximum (as many entries as B has ids, at most), then its postings, from which each document's contribution follows. The
contributions are shuffled by chunk and summed by document. An A id with more postings than a quarter of a partition's share is dealt over several tasks, all of which
get its counts; those come from an aggregate then, so that no task gets more than its share.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import bytesops as B
from sparkloom.llm.store import saved, ship

#: Parts of texts that a worker remembers at once; beyond that it begins anew.
KNOWN_UNITS = 400_000
#: Postings of a chunk, and its documents at most (a document's number in its chunk has 16 bits).
CHUNK_POSTINGS, CHUNK_DOCS = 1_500_000, 60_000
#: Parts that A encodes in one call.
JOINED_UNITS = 5000
#: Groups with more pairs than this are counted by distinct ids.
LARGE_GROUP = 1024
#: Postings whose contributions a task adds up before it gives them away.
TOGETHER = 1_000_000

FACTS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, bs array<int>, ns array<int>, docs binary, times binary"


def byte_level() -> dict[str, int]:
    """Character of a byte-level vocabulary to its byte: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pieces:
    """The bytes of every id of a vocabulary."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.ends = np.cumsum(self.sizes)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return B.gather(self.data, (self.ends - self.sizes)[ids], self.ends[ids])[0]


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the texts, which begin with a space each, can be cut so that both tokenizers give the same tokens.

    Before a space that follows a character that is not white space, and has another one than a space behind it: A's
    pre-tokens never cross that place, and no piece of B has a space behind another character. Characters that might be white space beyond ASCII
    are taken for it.
    """
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = ((data[:-1] > 0x20) & (data[:-1] != 0x7F))[: n - 1]
    if n > 2:
        c2 = (data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0))
        before[2:] &= ~c2
    if n > 3:
        a, b = data[:-3], data[1:-2]
        before[3:] &= ~(((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80)))
    after = np.zeros(n, bool)
    after[:-1] = data[1:] > 0x20
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    cut = (data == 0x20) & before & after
    cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(cut)


class Aligner:
    """Groups and links of texts for a byte-level tokenizer A and a piece tokenizer B that adds a space in front."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        chars = byte_level()
        vocabulary = self.a.get_vocab()
        tokens: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            tokens[i] = bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode()
        self.of_a = Pieces(tokens)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.of_b = Pieces([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.names_a, self.names_b = ([str(i) for i in range(len(p.sizes))] for p in (self.of_a, self.of_b))
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.right: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []
        self.strings: list[str] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def encoded_a(self, units: list[bytes], texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of the parts one after the other, and how many each has. Parts that end in a letter of Latin-1 or a printable ASCII
        character go through the tokenizer many at a time: a text may be cut before the next one's space."""
        plain = np.array([0x20 < u[-1] < 0x7F or (u[-1] >= 0x80 and u[-2] == 0xC3) for u in units])
        alone = np.flatnonzero(~plain)
        given = {int(k): e.ids for k, e in zip(alone, self.a.encode_batch([texts[k] for k in alone], add_special_tokens=False), strict=True)}
        flat, counts = [], np.zeros(len(units), np.int64)
        some = np.flatnonzero(plain)
        for at in range(0, len(some), JOINED_UNITS):
            part = some[at : at + JOINED_UNITS]
            ids = np.array(self.a.encode("".join([texts[k] for k in part]), add_special_tokens=False).ids, np.int64)
            ends, bounds = np.cumsum(self.of_a.sizes[ids]), np.cumsum(sizes[part])
            cuts = np.searchsorted(ends, bounds, "right")
            if not len(ids) or ends[-1] != bounds[-1] or (ends[cuts - 1] != bounds).any():
                # Not a tokenizer that treats parts alone.
                for k, e in zip(part, self.a.encode_batch([texts[k] for k in part], add_special_tokens=False), strict=True):
                    given[int(k)] = e.ids
                continue
            counts[part] = np.diff(cuts, prepend=0)
            flat.append((part, ids))
        for k, ids in given.items():
            counts[k] = len(ids)
        out = np.zeros(int(counts.sum()), np.int64)
        begin = np.cumsum(counts) - counts
        for part, ids in flat:
            n = counts[part]
            out[np.arange(len(ids)) + np.repeat(begin[part] - (np.cumsum(n) - n), n)] = ids
        for k, ids in given.items():
            out[begin[k] : begin[k] + len(ids)] = ids
        return out, counts

    def learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        """Remember what these parts give: numbers (A, B, groups, links), the groups as text, distinct pairs and their multiplicities."""
        texts = [u.decode("utf-8", "replace") for u in units]
        sizes = np.array([len(u) for u in units], np.int64)
        flat_a, n_a = self.encoded_a(units, texts, sizes)
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        n_b = np.fromiter(map(len, ids_b), np.int64, len(ids_b))
        flat_b = np.fromiter(chain.from_iterable(ids_b), np.int64, int(n_b.sum()))
        of_a, of_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        right = np.ones(len(units), bool)
        for of, flat, pieces in ((of_a, flat_a, self.of_a), (of_b, flat_b, self.of_b)):
            right &= np.bincount(of, pieces.sizes[flat], len(units)).astype(np.int64) == sizes
        flat_a, of_a, flat_b, of_b = flat_a[right[of_a]], of_a[right[of_a]], flat_b[right[of_b]], of_b[right[of_b]]
        good = np.flatnonzero(right)
        want = np.frombuffer(b"".join(units[k] for k in good), np.uint8)
        at = np.repeat(good, sizes[good])
        for flat, pieces in ((flat_a, self.of_a), (flat_b, self.of_b)):
            right[at[pieces.bytes_of(flat) != want]] = False
        ends_a, ends_b = np.cumsum(self.of_a.sizes[flat_a]), np.cumsum(self.of_b.sizes[flat_b])
        both_a, both_b = np.isin(ends_a, ends_b), np.isin(ends_b, ends_a)
        group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
        groups = int(both_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        unit_of = of_a[both_a]
        # All pairs of a group, but for large ones.
        small = in_a * in_b <= LARGE_GROUP
        first_b = np.cumsum(in_b) - in_b
        k = small[group_a]
        reps = in_b[group_a[k]]
        left = np.repeat(flat_a[k], reps)
        of = np.repeat(of_a[k], reps)
        other = flat_b[np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first_b[group_a[k]], reps)]
        pair, times = (left << 32) | other, np.ones(len(left), np.int64)
        first_a = np.cumsum(in_a) - in_a
        for g in np.flatnonzero(~small):
            (x, m), (y, n) = (np.unique(f[s : s + c], return_counts=True) for f, s, c in ((flat_a, first_a[g], in_a[g]), (flat_b, first_b[g], in_b[g])))
            pair = np.append(pair, ((x << 32)[:, None] | y[None, :]).ravel())
            times = np.append(times, (m[:, None] * n[None, :]).ravel())
            of = np.append(of, np.full(len(x) * len(y), unit_of[g]))
        of, pair, times = _added((of, pair), times)
        cut = np.searchsorted(of, np.arange(len(units) + 1))
        n_groups = np.bincount(unit_of, minlength=len(units))
        links = np.bincount(unit_of, in_a * in_b, len(units)).astype(np.int64)
        names_a, names_b = self.names_a, self.names_b
        list_a, list_b, begin_a, begin_b = flat_a.tolist(), flat_b.tolist(), first_a.tolist() + [len(flat_a)], first_b.tolist() + [len(flat_b)]
        words = [
            f"{names_a[list_a[i]]}|{names_b[list_b[p]]}" if j - i == 1 == q - p else ",".join(names_a[x] for x in list_a[i:j]) + "|" + ",".join(names_b[x] for x in list_b[p:q])
            for i, j, p, q in zip(begin_a[:-1], begin_a[1:], begin_b[:-1], begin_b[1:], strict=True)
        ]
        bounds = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        numbers = np.stack([n_a, n_b, n_groups, links], 1)
        base = len(self.strings)
        self.known.update(zip(hashes.tolist(), range(base, base + len(units)), strict=True))
        self.strings += [";".join(words[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        self.right.append(right)
        self.numbers.append(numbers)
        self.pairs.append(pair)
        self.times.append(times)
        self.sizes.append(np.diff(cut))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(numbers and hash of the groups of each text; then text, pair and multiplicity of its distinct pairs).

        The texts begin with the added space; empty ones have no tokens, as those have that a tokenizer does not give back.
        """
        data, offsets = B.column_bytes(column)
        n = len(offsets) - 1
        starts = unit_starts(data, offsets) if len(data) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        of = np.searchsorted(offsets, starts, "right") - 1
        hashes, at, which = np.unique(B.Spans(data).hash(starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > KNOWN_UNITS:
            self.forget()
        new = np.array([k for k, h in enumerate(hashes.tolist()) if h not in self.known], np.int64)
        if len(new):
            raw = data.tobytes()
            self.learn(hashes[new], [raw[starts[k] : ends[k]] for k in at[new]])
        if not len(starts):
            return np.zeros((n, 4), np.int64), [""] * n, *(np.zeros(0, np.int64) for _ in range(3))
        for name in ("right", "numbers", "pairs", "times", "sizes"):
            setattr(self, name, [np.concatenate(getattr(self, name))])
        unit = np.array([self.known[h] for h in hashes.tolist()], np.int64)[which]
        wrong = np.zeros(n, bool)
        wrong[of[~self.right[0][unit]]] = True
        k = ~wrong[of]
        of, unit = of[k], unit[k]
        numbers = np.zeros((n, 4), np.int64)
        np.add.at(numbers, of, self.numbers[0][unit])
        cut = np.searchsorted(of, np.arange(n + 1)).tolist()
        names = list(map(self.strings.__getitem__, unit.tolist()))
        shas = [hashlib.sha256(";".join(names[i:j]).encode()).hexdigest() if j > i else "" for i, j in zip(cut[:-1], cut[1:], strict=True)]
        # Parts of a text first, then their pairs.
        of, unit, times = _added((of, unit), np.ones(len(of), np.int64))
        size, first = self.sizes[0][unit], (np.cumsum(self.sizes[0]) - self.sizes[0])[unit]
        i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        return numbers, shas, *_added((np.repeat(of, size), self.pairs[0][i]), np.repeat(times, size) * self.times[0][i])


def _added(keys: tuple[np.ndarray, np.ndarray], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their times."""
    if not len(times):
        return keys[0], keys[1], times
    order = np.lexsort(keys[::-1])
    x, y = keys[0][order], keys[1][order]
    new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    return x[new], y[new], np.add.reduceat(times[order], new)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _posting_rows(chunk: int, doc: np.ndarray, pair: np.ndarray, times: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """A row for each A id of the chunk."""
    order = np.lexsort((doc, pair))
    doc, pair, times = doc[order], pair[order], times[order]
    new_pair = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    a = pair[new_pair] >> 32
    new_a = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    n = len(new_a)
    of_pair, of_doc = np.append(new_a, len(a)), np.append(new_pair[new_a], len(doc))
    own = {
        "row": pa.array(np.full(n, chunk)), "a": pa.array(a[new_a].astype(np.int32)), "bs": _lists(pair[new_pair] & 0xFFFFFFFF, of_pair),
        "ns": _lists(np.diff(np.append(new_pair, len(doc))), of_pair), "docs": _blobs(doc.astype("<u2"), of_doc), "times": _blobs(times.astype("<u4"), of_doc),
    }
    return pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in FACTS.split(", ")])


def facts(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each document (a is null) and the posting rows of each chunk of documents (row is its first), saved."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align, schema = aligner(path_a, path_b), _schema()
        row = TaskContext.get().partitionId() << 40
        chunk, parts, n = row, [], 0
        for batch in batches:
            for piece in B.pieces(batch, "text", B.PIECE_BYTES // 2):
                if n and row + piece.num_rows - chunk > CHUNK_DOCS:
                    yield _posting_rows(chunk, *(np.concatenate(c) for c in zip(*parts, strict=True)), schema)
                    parts, n = [], 0
                for at in range(0, piece.num_rows, CHUNK_DOCS):
                    part = piece.slice(at, CHUNK_DOCS)
                    if not n:
                        chunk = row
                    numbers, shas, doc, pair, times = align(part.column(1))
                    m = part.num_rows
                    own = {"row": pa.array(np.arange(row, row + m)), "doc_id": part.column(0), "groups_sha256": pa.array(shas, pa.string())}
                    own |= {c: pa.array(numbers[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                    yield pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(m, f.type)) for f in schema], schema=schema)
                    if len(doc):
                        parts.append((doc + (row - chunk), pair, times))
                        n += len(doc)
                    row += m
                    if n >= CHUNK_POSTINGS or (n and m == CHUNK_DOCS):
                        yield _posting_rows(chunk, *(np.concatenate(c) for c in zip(*parts, strict=True)), schema)
                        parts, n = [], 0
        if n:
            yield _posting_rows(chunk, *(np.concatenate(c) for c in zip(*parts, strict=True)), schema)

    t = F.col(text).cast("string")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.when(t != "", F.concat(F.lit(" "), t)).otherwise("").alias("text"))
    return saved(texts.mapInArrow(run, FACTS), "alignment")


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of A ids, counts before postings, to contributions (chunk, docs, best, sums) of the documents of a chunk, added up
    for as many postings as a task gathers."""
    rows, best, sums, n = [], [], [], 0
    stream, heard, bs, counts, most = None, [], None, None, 0

    def added() -> pa.RecordBatch:
        chunk, doc = (np.concatenate([x[k] for x in rows]) for k in (0, 1))
        order = np.lexsort((doc, chunk))
        chunk, doc = chunk[order], doc[order]
        new = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (doc[1:] != doc[:-1])))
        b, s = (np.add.reduceat(np.concatenate(x)[order], new) for x in (best, sums))
        chunk, doc = chunk[new], doc[new]
        cuts = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk))
        return pa.RecordBatch.from_arrays([pa.array(chunk[cuts[:-1]]), _blobs(doc.astype("<u2"), cuts), _blobs(b.astype("<u8"), cuts), _blobs(s.astype("<u8"), cuts)], names=["chunk", "docs", "best", "sums"])

    for batch in batches:
        a, salt, tag, first, own_bs, own_ns, docs, times = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "salt", "tag", "row", "bs", "ns", "docs", "times"))
        for k in range(batch.num_rows):
            now = (a[k].as_py(), salt[k].as_py())
            if now != stream:
                stream, heard, bs = now, [], None
            b, m = (np.asarray(x[k].values).astype(np.int64) for x in (own_bs, own_ns))
            if tag[k].as_py() == 0:
                heard.append((b, m))
                if len(heard) > 64:
                    heard = [_counts(heard)]
                continue
            if bs is None:
                bs, counts = _counts(heard)
                most = counts.max()
            c = np.repeat(counts[np.searchsorted(bs, b)], m)
            t = np.frombuffer(times[k].as_buffer(), "<u4").astype(np.int64)
            rows.append((np.full(len(t), first[k].as_py()), np.frombuffer(docs[k].as_buffer(), "<u2").astype(np.int64)))
            best.append(np.where(c == most, t, 0))
            sums.append(c * t)
            n += len(t)
            if n >= TOGETHER:
                yield added()
                rows, best, sums, n = [], [], [], 0
    if n:
        yield added()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contributions sorted by chunk to (row, n_best, count_sum): what is held is the sums of one chunk's documents."""
    now, best, sums = None, None, None

    def told() -> pa.RecordBatch:
        at = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(now + at), pa.array(best[at]), pa.array(sums[at])], names=["row", "n_best", "count_sum"])

    for batch in batches:
        chunk, docs, own_best, own_sums = batch.columns
        for k in range(batch.num_rows):
            if chunk[k].as_py() != now:
                if now is not None:
                    yield told()
                now, best, sums = chunk[k].as_py(), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
            at = np.frombuffer(docs[k].as_buffer(), "<u2")
            # A document is there once a row.
            best[at] += np.frombuffer(own_best[k].as_buffer(), "<i8")
            sums[at] += np.frombuffer(own_sums[k].as_buffer(), "<i8")
    if now is not None:
        yield told()


def _counts(heard: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    b, n = (np.concatenate(x) for x in zip(*heard, strict=True))
    order = np.argsort(b, kind="stable")
    b = b[order]
    new = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    return b[new], np.add.reduceat(n[order], new)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of docs.

    A encodes a space and the text, B the text, which it puts a space before; both without special tokens. Links are all pairs of an A and
    a B occurrence in one group; the count of a pair of ids is the number of documents that link it anywhere; n_best is the links whose count is
    the highest of their A id, count_sum the sum of counts over links. groups_sha256 is the hash of the groups as text, `a1,a2|b1;a3|b2,b3`.
    A text that is null or empty, or that a tokenizer's tokens do not give back byte for byte, has no tokens: zeros, and '' as hash. A repeated row is
    a document of its own, null doc_ids are carried, other columns are ignored, an empty table gives an empty result.
    """
    if not (path_a and path_b):
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    both = facts(docs, path_a, path_b, text, key)
    postings = both.where("a IS NOT NULL").select("a", "row", "bs", "ns", "docs", "times")
    # Postings of each A id: as many rows as A has ids. Large ones are dealt over several tasks.
    sizes = {r.a: r.n for r in postings.groupBy("a").agg(F.sum(F.length("docs")).alias("n")).collect()}
    share = max(1.0, sum(sizes.values()) / (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = spark.createDataFrame([(a, int(-(-n // share))) for a, n in sizes.items() if n > share], "a int, salts int")
    dealt = postings.join(F.broadcast(salts), "a", "left")
    large, small = dealt.where("salts IS NOT NULL"), dealt.where("salts IS NULL")
    none = F.lit(None).cast("binary")
    pairs = large.select("a", "salts", F.explode(F.arrays_zip("bs", "ns")).alias("p")).groupBy("a", "salts", F.col("p.bs").alias("b")).agg(F.sum("p.ns").alias("n"))
    counts = pairs.groupBy("a", "salts").agg(F.collect_list(F.struct("b", "n")).alias("p"))
    streams = [
        small.select("a", F.lit(0).alias("salt"), F.lit(0).alias("tag"), "row", "bs", F.col("ns").cast("array<long>").alias("ns"), none.alias("docs"), none.alias("times")),
        counts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("tag"), F.lit(0).cast("long").alias("row"), F.col("p.b").alias("bs"), F.col("p.n").alias("ns"), none.alias("docs"), none.alias("times")),
        dealt.select("a", F.coalesce(F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"), F.lit(0)).alias("salt"), F.lit(1).alias("tag"), "row", "bs", F.col("ns").cast("array<long>").alias("ns"), "docs", "times"),
    ]
    stream = streams[0].unionByName(streams[1]).unionByName(streams[2]).repartition("a", "salt").sortWithinPartitions("a", "salt", "tag", "row")
    given = stream.mapInArrow(_contributions, "chunk long, docs binary, best binary, sums binary").repartition("chunk").sortWithinPartitions("chunk")
    given = given.mapInArrow(_sums, "row long, n_best long, count_sum long")
    out = both.where("a IS NULL").join(given, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
