"""Language-model scores by the marginal likelihood of a subword lattice.

The pieces of an existing subword vocabulary span a lattice over every word; a word's probability is the sum
over all its segmentations of the product of piece probabilities, by a forward recursion in log space. The
vocabulary's own scores start the estimate and stay a part of it: a mixture with the expected piece counts over the
training words, by forward-backward over the same lattice, whose weight is learned. A text is its words and an end.

Beside it stands the plain unigram score of the same tokens, from exact counts of all training tokens. Frequent
words' counts, a table of bounded size, are known to every task; the others are joined by hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import bytesops as B
from sparkloom.llm.store import saved, ship

#: Words whose counts are sent to every task.
FREQUENT = 300_000
#: Words whose lattice score a Python worker remembers.
KNOWN_WORDS = 300_000
ROUNDS = 2
#: Shares of the vocabulary's own scores that learning chooses from.
WEIGHTS = (0.0001, 0.001, 0.01, 0.1, 0.5)
#: Places of a word whose pieces are looked up together.
BLOCK = 4096
SMOOTH = 0.1
_FIXED = 1 << 20
_TABLE_BITS = 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Lattice:
    """Pieces as bytes, a word's start being a space, with a natural-log score each; found by hash of bytes."""

    hashes: np.ndarray  # open table of piece hashes, 0 where empty
    piece: np.ndarray  # the piece in each place of the table
    scores: np.ndarray  # by piece; the last is the end of text
    longest: int

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 if none."""
        mask = np.uint64(len(self.hashes) - 1)
        at = (h & mask).astype(np.int64)
        out = np.where(self.hashes[at] == h, self.piece[at], -1)
        at = ((h >> np.uint64(32)) & mask).astype(np.int64)
        return np.where((out < 0) & (self.hashes[at] == h), self.piece[at], out)


def load_vocabulary(path: str) -> Lattice:
    """The pieces of a SentencePiece file with the Zipf probabilities that its scores' order gives."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    singles: dict[bytes, float] = {}
    low = min(sp.get_score(i) for i in range(sp.get_piece_size()) if sp.get_score(i) > -1e6)
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        text, score = sp.id_to_piece(i), sp.get_score(i)
        if sp.is_byte(i):
            singles[bytes([int(text[3:5], 16)])] = low
        elif "▁" not in text[1:] and score > -1e6:
            pieces[text.replace("▁", " ").encode()] = score
    for b, score in singles.items():
        pieces.setdefault(b, score)
    names = list(pieces)
    weight = np.array([1 / (10.0 - pieces[x]) for x in names] + [1 / 10.0])
    data, offsets = np.frombuffer(b"".join(names), np.uint8), np.cumsum([0, *map(len, names)])
    h = B.Spans(data).hash(offsets[:-1], offsets[1:])
    table, place, mask = np.zeros(1 << _TABLE_BITS, np.uint64), np.full(1 << _TABLE_BITS, -1, np.int64), (1 << _TABLE_BITS) - 1
    for k, x in enumerate(h.tolist()):
        at = x & mask
        if place[at] >= 0:
            at = (x >> 32) & mask
        if place[at] >= 0:
            raise ValueError("the table of pieces is too small")
        table[at], place[at] = x, k
    return Lattice(table, place, np.log(weight / weight.sum()), max(map(len, names)))


def _spread(lattice: Lattice, spans: B.Spans, begin: np.ndarray, size: int, low: int, high: int) -> np.ndarray:
    """Piece over each span that starts at low .. high - 1 in words of `size` bytes: (words, start, length), -1 if none."""
    most = min(lattice.longest, size)
    ids = np.full((len(begin), high - low, most), -1, np.int64)
    for length in range(1, most + 1):
        end = min(high, size - length + 1)
        if end > low:
            at = begin[:, None] + np.arange(low, end)
            ids[:, : end - low, length - 1] = lattice.find(spans.hash(at, at + length))
    return ids


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(x - top[:, None]).sum(1))


def word_scores(lattice: Lattice, data: np.ndarray, begin: np.ndarray, end: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
    """Natural-log probability of each word of data[begin:end], each starting with a space, over all segmentations.

    With counts, the pieces' expected counts are added to expected. Spans are looked up for BLOCK places of a word at
    a time, so that a very long word takes no more memory than a few numbers for each of its bytes.
    """
    out = np.zeros(len(begin))
    spans = B.Spans(data)
    padded = np.append(lattice.scores, -np.inf)  # -1 is no piece
    sizes = end - begin
    for size in np.unique(sizes):
        size = int(size)
        group = np.flatnonzero(sizes == size)
        most = min(lattice.longest, size)
        step = max(1, 400_000 // (min(size, BLOCK + most) * most))
        for cut in range(0, len(group), step):
            g = group[cut : cut + step]
            alpha = np.full((len(g), size + 1), -np.inf)
            alpha[:, 0] = 0
            ids = low = None
            for a in range(0, size, BLOCK):
                b = min(a + BLOCK, size)
                low = max(0, a - most + 1)
                ids = _spread(lattice, spans, begin[g], size, low, b)
                s = padded[ids]
                for i in range(a + 1, b + 1):
                    # Pieces of length 1..n that end at i start at i - 1, .., i - n.
                    n = min(i, most)
                    back = np.arange(i - 1, i - n - 1, -1)
                    alpha[:, i] = _log_sum(alpha[:, back] + s[:, back - low, np.arange(n)])
            out[g] = alpha[:, size]
            if counts is None:
                continue
            beta = np.full((len(g), size + 1), -np.inf)
            beta[:, size] = 0
            for a in reversed(range(0, size, BLOCK)):
                b = min(a + BLOCK, size)
                if size > BLOCK:
                    low, ids = a, _spread(lattice, spans, begin[g], size, a, b)
                s = padded[ids]
                for i in range(b - 1, a - 1, -1):
                    n = min(size - i, most)
                    x = s[:, i - low, :n] + beta[:, i + 1 : i + 1 + n]
                    beta[:, i] = _log_sum(x)
                    post = np.exp(alpha[:, i, None] + x - alpha[:, size, None]) * counts[g, None]
                    expected += np.bincount(ids[:, i - low, :n].ravel() + 1, post.ravel(), len(expected) + 1)[1:]
    return out


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes (A-Z only), the words' starts and ends, each text's first word, and word hashes."""
    data, offsets = B.column_bytes(column)
    data = B.LOWER[data]
    starts, ends, firsts = B.words(data, offsets)
    return data, starts, ends, firsts, B.Spans(data).hash(starts, ends)


def _with_space(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after the other, a space before each: bytes, starts, ends."""
    own, offsets = B.gather(data, starts, ends)
    at = offsets + np.arange(len(offsets))
    out = np.full(at[-1] if len(starts) else 0, 32, np.uint8)
    out[np.arange(len(own)) + np.repeat(np.arange(1, len(starts) + 1), ends - starts)] = own
    return out, at[:-1], at[1:]


def count_words(texts: DataFrame) -> DataFrame:
    """(h, word, n) for the words of texts(text), and one row with an empty word for the ends: h is 0, n the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                rows += piece.num_rows
                data, starts, ends, _, h = _lowered(piece.column(0))
                h, at, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), B.strings(data, starts[at], ends[at]), pa.array(n.astype(np.int64))], names=["h", "word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([""], pa.string()), pa.array([rows], pa.int64())], names=["h", "word", "n"])

    return texts.mapInArrow(run, "h long, word string, n long").groupBy("h", "word").agg(F.sum("n").alias("n"))


def learn(counts: DataFrame, lattice: Lattice, rounds: int = ROUNDS) -> Lattice:
    """The lattice with scores fitted to counts(word, n); the end counts as a piece.

    Scores are a mixture of the vocabulary's own and of the pieces' expected counts, by forward-backward over the
    lattice. Rounds run on four fifths of the words, by their hash; the mixture's weight is the one of WEIGHTS that
    gives the other words the greatest likelihood, and a last round over all words uses it. Each round adds up at
    most as many rows for each task as there are pieces, in fixed point, so that sums do not depend on the order of
    tasks. Without words the vocabulary's own scores stay."""
    size, own = len(lattice.scores), np.exp(lattice.scores)
    words = counts.where("word <> ''").select("word", "n")
    kept = F.pmod(F.xxhash64("word"), F.lit(5)) == 0
    ends = counts.where("word = ''").agg(F.sum("n")).first()[0] or 0

    def mixed(n: np.ndarray, weight: float) -> Lattice:
        p = weight * own + (1 - weight) * (n + 1e-9) / (n + 1e-9).sum()
        return Lattice(lattice.hashes, lattice.piece, np.log(p / p.sum()), lattice.longest)

    def expected(some: DataFrame, model: Lattice, ends: float) -> np.ndarray:
        shared = some.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size)
            for batch in batches:
                for piece in B.pieces(batch, "word"):
                    data, offsets = B.column_bytes(piece.column(0))
                    word_scores(shared.value, *_with_space(data, offsets[:-1], offsets[1:]), piece.column(1).to_numpy().astype(np.float64), sums)
            fixed = np.rint(sums * _FIXED).astype(np.int64)
            there = np.flatnonzero(fixed)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(fixed[there])], names=["piece", "n"])

        got = some.mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros(size)
        n[got.piece.to_numpy(np.int64)] += got.n.to_numpy(np.float64) / _FIXED
        n[-1] += ends
        return n

    def likelihoods(some: DataFrame, models: list[Lattice]) -> list[float]:
        shared = some.sparkSession.sparkContext.broadcast(models)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(models))
            for batch in batches:
                for piece in B.pieces(batch, "word"):
                    data, offsets = B.column_bytes(piece.column(0))
                    spaced, n = _with_space(data, offsets[:-1], offsets[1:]), piece.column(1).to_numpy()
                    sums += [n @ word_scores(m, *spaced) for m in shared.value]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(models))), pa.array(np.rint(sums * _FIXED).astype(np.int64))], names=["model", "l"])

        got = {r.model: r.l for r in some.mapInArrow(run, "model long, l long").groupBy("model").agg(F.sum("l").alias("l")).collect()}
        return [got.get(i, 0) / _FIXED for i in range(len(models))]

    if words.isEmpty():
        return lattice
    model, n = lattice, np.zeros(size)
    for _ in range(rounds):
        n = expected(words.where(~kept), model, ends * 0.8)
        model = mixed(n, WEIGHTS[0])
    models = [mixed(n, w) for w in WEIGHTS]
    found = likelihoods(words.where(kept), models)
    best = max(range(len(WEIGHTS)), key=lambda i: (found[i], -i))
    return mixed(expected(words, models[best], ends), WEIGHTS[best])


def score_texts(docs: DataFrame, training: Column, vocabulary: str | None = None, text: str = "text", key: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    training says which rows are learned from; all rows are scored. Tokens are the words between ASCII white
    space, A-Z lower-cased, then one end. base_score adds log10((c + 0.1) / (N + 0.1 * (V + 1))) over tokens, with
    the token's count c, all N and the distinct V tokens in training; score is the log10 of the text's marginal
    probability over all segmentations. Null texts count as empty: the end alone. Without training rows counts
    are 0 and pieces are equally likely. Repeated rows are scored each; null doc_ids are carried; an empty table
    gives an empty result; further columns are ignored. Words are told apart by a 64-bit hash of their bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    counts = saved(count_words(docs.where(training).select(raw)), "lm-words")
    totals = counts.agg(F.sum("n").alias("N"), F.sum(F.expr("CASE WHEN n > 0 THEN 1 ELSE 0 END")).alias("V"), F.sum(F.expr("CASE WHEN word = '' THEN n ELSE 0 END")).alias("ends")).first()
    n_all, n_distinct, ends = (int(x or 0) for x in totals)
    below = n_all + SMOOTH * (n_distinct + 1)
    lattice = learn(counts, load_vocabulary(vocabulary or default_vocabulary()))

    # The least count that leaves at most `frequent` words, by classes of counts: at most a few hundred classes.
    level = F.floor(8 * F.log2("n")).cast("int")
    known = counts.where("word <> ''").select("h", "n", level.alias("level"))
    left, cut = frequent, None
    for r in sorted(known.groupBy("level").count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, cut = left - r["count"], r.level
    top = known.where(F.col("level") >= cut).select("h", "n").toPandas() if cut is not None else known.limit(0).select("h", "n").toPandas()
    order = np.argsort(top.h.to_numpy(np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast((lattice, top.h.to_numpy(np.int64).view(np.uint64)[order], top.n.to_numpy(np.int64)[order], ends, below))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes, n, ends, below = shared.value
        scored: dict[int, float] = {}
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                data, starts, stops, firsts, h = _lowered(piece.column(2))
                unique, at, which = np.unique(h, return_index=True, return_inverse=True)
                # Lattice scores, remembered by word.
                found = [scored.get(x) for x in unique.tolist()]
                new = np.array([k for k, x in enumerate(found) if x is None], np.int64)
                values = np.array([0.0 if x is None else x for x in found])
                if len(new):
                    own, begin, end = _with_space(data, starts[at[new]], stops[at[new]])
                    values[new] = word_scores(m, own, begin, end)
                    if len(scored) < KNOWN_WORDS:
                        scored.update(zip(unique[new].tolist(), values[new].tolist(), strict=True))
                # Counts of frequent words; the others go on as (hash, times).
                c = np.zeros(len(unique), np.int64)
                if len(hashes):
                    p = np.minimum(np.searchsorted(hashes, unique), len(hashes) - 1)
                    hit = hashes[p] == unique
                    c[hit] = n[p[hit]]
                words = np.diff(firsts)
                cum = lambda x: np.concatenate([[0], np.cumsum(x)])
                over = lambda x: (lambda s: s[firsts[1:]] - s[firsts[:-1]])(cum(x))
                mine = c[which]
                # As if all others were unknown; what training knows of them is added after.
                base = over(np.log10(mine + SMOOTH)) + math.log10(ends + SMOOTH)
                rest = np.flatnonzero(mine == 0)
                doc = np.searchsorted(firsts, rest, "right") - 1
                o = np.lexsort((h[rest], doc))
                rh, rd = h[rest][o], doc[o]
                head = np.ones(len(rh), bool)
                head[1:] = (rh[1:] != rh[:-1]) | (rd[1:] != rd[:-1])
                q = np.flatnonzero(head)
                items = pa.StructArray.from_arrays([pa.array(rh[q].view(np.int64)), pa.array(np.diff(np.append(q, len(rh))).astype(np.int32))], names=["h", "k"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rd[q], np.arange(len(words) + 1)).astype(np.int32)), items)
                score = (over(values[which]) + m.scores[-1]) / math.log(10)
                tokens = words + 1
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(tokens.astype(np.int64)), pa.array((over(mine > 0) + int(ends > 0)).astype(np.int64)), pa.array(base), pa.array(score), lists],
                    names=["row", "doc_id", "n_tokens", "n_known", "logs", "score", "rest"],
                )

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), raw)
    part = saved(
        texts.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, logs double, score double, rest array<struct<h:long,k:int>>"), "lm-part"
    )
    # Rarer words: only those that training has are joined, and these at most as often there as the cut says. A word that
    # training lacks meets nothing, so that Spark can split it however common it is.
    rest = part.select("row", F.explode("rest").alias("w")).select("row", "w.h", "w.k")
    rare = counts.where("word <> ''").select("h", "n")
    if cut is not None:
        rare = rare.where(F.floor(8 * F.log2("n")).cast("int") < cut)
    per = (
        rest.join(rare, "h")
        .groupBy("row")
        .agg(F.sum(F.col("k") * (F.log10(F.col("n") + F.lit(SMOOTH)) - F.lit(math.log10(SMOOTH)))).alias("more"), F.sum(F.col("k").cast("long")).alias("known"))
    )
    return (
        part.select("row", "doc_id", "n_tokens", "n_known", "logs", "score")
        .join(per, "row", "left")
        .select(
            "doc_id",
            "n_tokens",
            (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(n_all).cast("long").alias("train_tokens"),
            (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(below) if below > 0 else 0.0)).alias("base_score"),
            "score",
        )
    )


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is divisible by 10 (false for a null id)."""
    return F.coalesce(F.crc32(key.cast("string")) % 10 == 0, F.lit(False))
