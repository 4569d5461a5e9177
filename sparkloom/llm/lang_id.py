"""Language identification by a linear-chain conditional random field over the words of a text.

Each word has affix, n-gram and lexicon features, hashed into one table of weights per language; learned
transitions tie neighbouring words together. Forward-backward gives every word's marginal probabilities, so
code-switched text is labelled word by word, and a document's language is the one with the most expected words.

Training reads a bounded sample of labelled rows on the driver; prediction runs where the texts are, on whole
texts, and moves nothing between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import bytesops as B
from sparkloom.llm.store import free_name, hash_limit, ship

#: Bounds of the training sample: documents of a language, of all languages together, and the length in characters up to
#: which texts are preferred (longer ones teach, whole, where a language has too few others).
TRAIN_DOCS = 160
TRAIN_TOTAL = 10_240
TRAIN_LENGTH = 20_000
TABLE_BITS = 17
LINK = 40  # words of a training sequence
BLOCK = 32  # words whose products are formed together in prediction
_NONE = 1 << TABLE_BITS

#: A word is a run of letters: ASCII letters and all bytes of characters beyond ASCII.
_APART = np.ones(256, dtype=bool)
_APART[65:91] = _APART[97:123] = _APART[128:] = False
_KINDS = np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (2**TABLE_BITS + 1, languages); the last row is 0
    links: np.ndarray  # (languages, languages): from, to
    first: np.ndarray  # scores of the first word's language
    lexicon: np.ndarray  # sorted hashes of the words that have a feature of their own


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    return ((h * _KINDS[kind]) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words: per-word feature slots (words, 8), then slots of n-grams (letters, 2), where each word's letters begin, and word hashes."""
    spans = B.Spans(data)
    word = spans.hash(starts, ends)
    per = []
    for n in (1, 2, 3):
        per.append(np.where(ends - starts >= n, _slot(spans.hash(starts, np.minimum(starts + n, ends)), n), _NONE))
    for n in (1, 2, 3, 4):
        per.append(np.where(ends - starts >= n, _slot(spans.hash(np.maximum(ends - n, starts), ends), 3 + n), _NONE))
    known = np.zeros(len(word), bool)
    if len(lexicon):
        known = lexicon[np.minimum(np.searchsorted(lexicon, word), len(lexicon) - 1)] == word
    per.append(np.where(known, _slot(word, 8), _NONE))
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(starts - first, sizes)
    end = np.repeat(ends, sizes)
    grams = []
    for n in (2, 3):
        grams.append(np.where(at + n <= end, _slot(spans.hash(at, np.minimum(at + n, end)), 7 + n), _NONE))
    return np.stack(per, 1) if len(word) else np.zeros((0, 8), np.int64), np.stack(grams, 1) if len(at) else np.zeros((0, 2), np.int64), first, word


def emissions(weights: np.ndarray, per: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Score of each word for each language; n-grams count half as much as affixes."""
    out = weights[per[:, 0]]
    for k in range(1, per.shape[1]):
        out = out + weights[per[:, k]]
    if len(grams):
        out = out + 0.5 * np.add.reduceat(weights[grams[:, 0]] + weights[grams[:, 1]], first, axis=0)
    return out


def marginals(e: np.ndarray, links: np.ndarray, first: np.ndarray, firsts: np.ndarray, pairs: bool = False):
    """Posterior probability of each word's language, for texts that begin at firsts (one more entry at the end);
    with pairs also the expected number of each transition.

    Exact forward-backward: each block's product of transition and emission factors is formed for all blocks of all
    texts at once, then the blocks' ends are linked text by text, then every word's messages follow. Memory is
    words x languages, and languages squared only once a block.
    """
    n, size = e.shape
    if not n:
        return e
    scaled = np.exp(np.maximum(e - e.max(1, keepdims=True), -30))
    step = np.exp(links)
    lengths = np.diff(firsts)
    per = -(-lengths // BLOCK)
    total = int(per.sum())
    block0 = np.cumsum(per) - per
    doc = np.repeat(np.arange(len(lengths)), per)
    within = np.arange(total) - block0[doc]
    begin = firsts[:-1][doc] + within * BLOCK
    used = np.minimum(firsts[1:][doc] - begin, BLOCK)
    index = np.minimum(begin[:, None] + np.arange(BLOCK), n - 1)
    real = np.arange(BLOCK) < used[:, None]
    full = real.all(0)
    em = scaled[index]  # (blocks, BLOCK, languages)

    # Each block's product of factors, so that blocks can be linked; only one product a block is held.
    whole = np.broadcast_to(np.eye(size), (total, size, size)).copy()
    for t in range(BLOCK):
        new = (whole.reshape(-1, size) @ step).reshape(total, size, size) * em[:, t, None, :]
        if t % 8 == 7:
            new /= new.sum((1, 2), keepdims=True)
        whole = new if full[t] else np.where(real[:, t, None, None], new, whole)

    # Messages at the blocks' borders, one block of every text at a time. Before the first word the factor is
    # exp(first) in place of a transition: solve for a start vector s with s @ step proportional to it.
    start = np.exp(first - first.max())
    enter = np.empty((total, size))
    leave = np.ones((total, size))
    most = int(per.max())
    order = np.argsort(-per, kind="stable")
    count = np.searchsorted(-per[order], -np.arange(most), "left")  # texts with more than k blocks
    virtual = np.linalg.solve(step.T, start) if abs(np.linalg.det(step)) > 1e-12 else np.ones(size)
    for k in range(most):
        rows = block0[order[: count[k]]] + k
        if k == 0:
            enter[rows] = virtual
        else:
            a = np.einsum("bi,bij->bj", enter[rows - 1], whole[rows - 1])
            enter[rows] = a / np.abs(a).sum(1, keepdims=True)
    for k in range(most - 2, -1, -1):
        rows = block0[order[: count[k + 1]]] + k
        a = np.einsum("bij,bj->bi", whole[rows + 1], leave[rows + 1])
        leave[rows] = a / a.sum(1, keepdims=True)
    # Then every word's messages, as vectors, in all blocks at once.
    alpha, beta = np.empty((BLOCK, total, size)), np.empty((BLOCK, total, size))
    now = enter
    for t in range(BLOCK):
        now = np.maximum((now @ step) * em[:, t], 0)
        if t % 8 == 7:
            now = now / np.maximum(now.sum(1, keepdims=True), 1e-300)
        alpha[t] = now
    now = leave
    for t in range(BLOCK - 1, -1, -1):
        beta[t] = now
        new = (em[:, t] * now) @ step.T
        if t % 8 == 0:
            new = new / np.maximum(new.sum(1, keepdims=True), 1e-300)
        now = new if full[t] else np.where(real[:, t, None], new, now)
    alpha, beta = (x.transpose(1, 0, 2)[real] for x in (alpha, beta))
    post = alpha * beta
    post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
    if not pairs:
        return post
    inner = np.ones(n, bool)
    inner[firsts[1:][lengths > 0] - 1] = False
    left = np.flatnonzero(inner)
    pair = alpha[left][:, :, None] * step * (scaled * beta)[left + 1][:, None, :]
    pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
    return post, pair.sum(0)


def fit(texts: list[str], langs: list[str], epochs: int = 6, rate: float = 0.4, penalty: float = 1e-6) -> Model:
    """Learn from labelled texts, on the driver. Sequences of LINK words are put together from runs of words of
    random texts, so that switches are seen; all weights and transitions are learned by gradient steps."""
    names = sorted(set(langs))
    size = len(names)
    label = np.array([names.index(x) for x in langs], np.int64)
    import pyarrow.compute as pc

    data, offsets = B.column_bytes(pc.utf8_lower(pa.array(texts, pa.string())))
    starts, ends, firsts = B.words(data, offsets, _APART)
    word_lang = np.repeat(label, np.diff(firsts))
    _, _, _, word = features(data, starts, ends, np.zeros(0, np.uint64))
    seen, times = np.unique(word, return_counts=True)
    lexicon = seen[times >= 3]
    per, grams, first, _ = features(data, starts, ends, lexicon)
    n = len(word)
    weights = np.zeros((_NONE + 1, size))
    links, begin = np.eye(size) * 2.0, np.zeros(size)
    if n and size > 1:
        g = np.random.Generator(np.random.PCG64(1))
        hw, hl, hb = np.full_like(weights, 1e-2), np.full_like(links, 1e-2), np.full_like(begin, 1e-2)
        per_first = np.append(first, len(grams))
        for _ in range(epochs):
            # Runs of 1 to LINK words, put in random order, then cut into sequences.
            at, runs = 0, []
            while at < n:
                step = int(g.integers(4, LINK + 1))
                runs.append((at, min(at + step, n)))
                at += step
            order = g.permutation(len(runs))
            index = np.concatenate([np.arange(*runs[k]) for k in order])
            for cut in range(0, n, LINK * 128):
                ids = index[cut : cut + LINK * 128]
                bounds = np.append(np.arange(0, len(ids), LINK), len(ids))
                sizes = per_first[ids + 1] - per_first[ids]
                pos = np.arange(sizes.sum()) + np.repeat(per_first[ids] - (np.cumsum(sizes) - sizes), sizes)
                e = emissions(weights, per[ids], grams[pos], np.cumsum(sizes) - sizes)
                post, gl = marginals(e, links, begin, bounds, pairs=True)
                y = word_lang[ids]
                diff = post.copy()
                diff[np.arange(len(ids)), y] -= 1
                grad = np.zeros_like(weights)
                flat = per[ids]
                of_gram = np.repeat(np.arange(len(ids)), sizes)
                for k in range(size):
                    grad[:, k] = np.bincount(flat.ravel(), np.repeat(diff[:, k], flat.shape[1]), _NONE + 1)
                    grad[:, k] += np.bincount(grams[pos].ravel(), 0.5 * np.repeat(diff[of_gram, k], 2), _NONE + 1)
                grad /= LINK
                grad += penalty * weights
                inner = np.ones(len(ids), bool)
                inner[bounds[1:] - 1] = False
                left = np.flatnonzero(inner)
                right = left + 1
                np.add.at(gl, (y[left], y[right]), -1.0)
                gl /= LINK
                gb = (post[bounds[:-1]].sum(0) - np.bincount(y[bounds[:-1]], minlength=size)) / LINK
                for value, gradient, history in ((weights, grad, hw), (links, gl, hl), (begin, gb, hb)):
                    history += gradient**2
                    value -= rate * gradient / np.sqrt(history)
                weights[_NONE] = 0
    return Model(names, weights.astype(np.float32), links, begin, lexicon)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = TRAIN_DOCS, length: int = TRAIN_LENGTH) -> Model:
    """Fit on at most per_lang labelled rows of every language, those with the least hashes of their key, whole texts.

    A language with enough texts of up to `length` characters learns from these; else longer ones teach too. Beyond
    TRAIN_TOTAL / per_lang languages each has fewer rows, one at least. Rows with a null lang, key or text teach nothing. The model's
    size and the driver's work grow with the number of languages.

    Rows are chosen by a limit on the hash, from the number of keys of each language, so that no key's rows meet
    in one task. The number of a language's keys is estimated (within a few per cent)."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t")).where("k IS NOT NULL AND l IS NOT NULL AND t IS NOT NULL")
    rows = rows.withColumn("short", F.length("t") <= length)
    counts = rows.groupBy("l").agg(F.approx_count_distinct("k").alias("n"), F.approx_count_distinct(F.when(F.col("short"), F.col("k"))).alias("n_short")).orderBy("l").collect()  # one row a language
    if not counts:
        return fit([], [])
    per_lang = max(1, min(per_lang, TRAIN_TOTAL // len(counts)))
    # More than per_lang are let through by four deviations and the counts' error, so that nearly always enough are; the
    # least hashes of them stay.
    enough = {r.l: r.n_short >= 1.2 * per_lang for r in counts}
    share = {r.l: 1.2 * (per_lang + 4 * per_lang**0.5 + 4) / max(r.n_short if enough[r.l] else r.n, 1) for r in counts}
    plan = docs.sparkSession.createDataFrame([(name, hash_limit(s), enough[name]) for name, s in share.items()], "l string, most long, enough boolean")
    near = rows.join(F.broadcast(plan), "l").where((F.xxhash64("k") <= F.col("most")) & (F.col("short") | ~F.col("enough")))
    # One row a key: about per_lang rows a language.
    once = near.groupBy("l", "k").agg(F.min("t").alias("t")).select("k", "l", "t", F.xxhash64("k").alias("h"))
    got = sorted((r.l, r.h, r.k, r.t) for r in once.collect())
    place: dict[str, int] = {}
    some = []
    for name, _, k, t in got:
        place[name] = place.get(name, 0) + 1
        if place[name] <= per_lang:
            some.append((k, name, t))
    some.sort()
    return fit([x[2] for x in some], [x[1] for x in some])


def predict(docs: DataFrame, model: Model, text: str = "text", spans: bool = True) -> DataFrame:
    """docs with lang_pred, score and, if asked for, lang_spans (replacing columns of those names).

    lang_pred is the language with the most expected words, 'und' if the text is null or has no letter or the
    model knows no language; score its share of the expected words, 0 for 'und'. lang_spans are the runs of words
    of one language as (first, words, lang), counting runs of letters. Whole texts are labelled, however long;
    ties go to the language first in the alphabet. Repeated rows get equal results; other columns stay.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = "struct<lang_pred:string,score:double" + (",lang_spans:array<struct<first:int,words:int,lang:string>>>" if spans else ">")

    @F.arrow_udf(kind)
    def label(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column.fill_null("")], names=["text"])
            parts = [_label(m, p.column(0), spans) for p in B.pieces(batch, "text")]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    own = free_name(docs, "label")
    out = docs.withColumn(own, label(F.col(text).cast("string")))
    names = ["lang_pred", "score", *(["lang_spans"] if spans else [])]
    return out.withColumns({k: F.col(f"{own}.{k}") for k in names}).drop(own)


def _label(m: Model, column: pa.Array, spans: bool) -> pa.Array:
    import pyarrow.compute as pc

    n, size = len(column), max(len(m.langs), 1)
    data, offsets = B.column_bytes(pc.utf8_lower(column))
    starts, ends, firsts = B.words(data, offsets, _APART)
    lettered = np.zeros(n, bool)
    ascii_letter = (data >= 97) & (data <= 122)
    some = np.concatenate([[0], np.cumsum(ascii_letter)])
    lettered = some[offsets[1:]] > some[offsets[:-1]]
    for i in np.flatnonzero(~lettered & (offsets[1:] > offsets[:-1])):
        lettered[i] = any(c.isalpha() for c in column[int(i)].as_py())
    counts = np.zeros((n, size))
    if len(starts) and m.langs:
        # Words that come again in this piece are scored once.
        h = B.Spans(data).hash(starts, ends)
        _, at, which = np.unique(h, return_index=True, return_inverse=True)
        per, grams, first, _ = features(data, starts[at], ends[at], m.lexicon)
        post = marginals(emissions(m.weights, per, grams, first)[which].astype(np.float64), m.links, m.first, firsts)
        full = np.flatnonzero(np.diff(firsts) > 0)
        counts[full] = np.add.reduceat(post, firsts[:-1][full], axis=0)
    best = counts.argmax(1)
    total = counts.sum(1)
    sure = lettered & (total > 0)
    score = np.where(sure, counts[np.arange(n), best] / np.where(total > 0, total, 1), 0.0)
    names = np.array([*m.langs, "und"], object)
    fields = [pa.array(names[np.where(sure, best, len(m.langs))], pa.string()), pa.array(np.clip(score, 0, 1))]
    keys = ["lang_pred", "score"]
    if spans:
        if len(starts) and m.langs:
            word = post.argmax(1)
            new = np.ones(len(word), bool)
            new[1:] = word[1:] != word[:-1]
            new[firsts[:-1][np.diff(firsts) > 0]] = True
            run = np.flatnonzero(new)
            runs_at = np.searchsorted(run, firsts)
            doc = np.repeat(np.arange(n), np.diff(runs_at))
            values = pa.StructArray.from_arrays(
                [pa.array((run - firsts[:-1][doc]).astype(np.int32)), pa.array(np.diff(np.append(run, len(word))).astype(np.int32)), pa.array(names[word[run]], pa.string())], names=["first", "words", "lang"]
            )
        else:
            runs_at = np.zeros(n + 1, np.int64)
            values = pa.array([], pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
        fields.append(pa.ListArray.from_arrays(pa.array(runs_at.astype(np.int32)), values))
        keys.append("lang_spans")
    return pa.StructArray.from_arrays(fields, names=keys)


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text modulo 4 is 2 (false for a null id)."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))
