"""Language identification: a linear-chain conditional random field over the words of a text.

A word's features are its character n-grams, its affixes and the lexicon it stands in; transitions between the
languages of neighbouring words are learned. Forward-backward gives every word a probability for each language, also in
text that switches between languages; their mean over all words decides on a document.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, batches, frugal, held_out, materialize
from .words import Words, slices

#: Bounds of the sample that the model is fitted on: documents, and characters of all of them; whole texts of any length.
TRAIN_DOCS, TRAIN_CHARS = 4_000, 40_000_000
#: Training sequences are made of the sample's words; half of them switch the language once.
SEQUENCES, LENGTH, EPOCHS, BATCH, RATE, DECAY, SEED = 10_000, 24, 4, 250, 0.2, 1e-4, 5
BLOCK = 64
GRAMS, AFFIX, LEXICON = 1 << 16, 1 << 15, 1 << 17
#: Weights are multiples of 1 / SCALE, probabilities are summed in multiples of 1 / PARTS; ids are dealt to 2^16 ranges of hashes.
SCALE, PARTS, RANGE_BITS = 1 << 16, 1 << 40, 16
#: More languages than this are taken for an error in the column.
LANGUAGES = 1000
#: A word belongs to a language's lexicon if it occurs at least so often, and so large a share of it in that language.
LEAST, PURE = 3, 0.9
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def _mixed(x: np.ndarray, size: int) -> np.ndarray:
    return ((x.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - size.bit_length() + 1)).astype(np.int32)


class Features:
    """Feature ids: n-grams by the byte they start at, affixes and the word itself by word."""

    COUNT = 2 * GRAMS + 2 * AFFIX

    def __init__(self, words: Words):
        raw = words.raw.astype(np.uint32)
        two = raw[:-2] | raw[1:-1] << 8
        three = two | np.where(raw[1:-1] == 32, 32, raw[2:]) << 16  # behind a word's end nothing is read: the next word is not its feature
        self.two, self.three = two.astype(np.int32), _mixed(three, GRAMS) + GRAMS  # 256 * 256 pairs are as many as GRAMS
        last = np.maximum(words.end - 3, words.start)
        self.prefix = _mixed(three[words.start] ^ np.uint32(0x5BD1E995), AFFIX) + 2 * GRAMS
        self.suffix = _mixed(three[last] ^ np.uint32(0x1B873593), AFFIX) + 2 * GRAMS + AFFIX
        self.word = (words.hashes(words.start, words.end) >> np.uint64(47)).astype(np.int32)
        self.start, self.end = words.start, words.end

    def of(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature ids, first of each word) of the words w, without lexicon features."""
        n = self.end[w] - self.start[w] + 1
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(begin, n) + np.repeat(self.start[w] - 1, n)
        out = np.empty(2 * len(place) + 2 * len(w), dtype=np.int32)
        first = 2 * begin + 2 * np.arange(len(w))
        at = 2 * np.arange(len(place)) + 2 * np.repeat(np.arange(len(w)), n)
        out[at], out[at + 1] = self.two[place], self.three[place]
        out[first + 2 * n], out[first + 2 * n + 1] = self.prefix[w], self.suffix[w]
        return out, first


class CRF:
    def __init__(self, names: list[str]):
        k = len(names)
        self.names = names
        self.weights = np.zeros((Features.COUNT, k), dtype=np.float32)
        self.lexicon = np.zeros(LEXICON, dtype=np.int8)  # 0: no language's, else 1 + its place in names
        self.known = np.zeros((k + 1, k))
        self.moves = np.zeros((k, k))

    def emissions(self, f: Features) -> np.ndarray:
        """(words, languages): the sum of each word's feature weights."""
        if not len(f.start):
            return np.zeros((0, len(self.names)))
        out = np.empty((len(f.start), len(self.names)))
        total = np.zeros(len(f.two) + 1)
        for c, w in enumerate(np.ascontiguousarray(self.weights.T)):  # by language: plain vectors are quickest
            np.cumsum(w.take(f.two) + w.take(f.three), out=total[1:])
            out[:, c] = total[f.end] - total[f.start - 1] + w.take(f.prefix) + w.take(f.suffix)
        return out + self.known[self.lexicon[f.word]]

    def forward_backward(self, e: np.ndarray, first: np.ndarray):
        """(alpha, beta, x, a) with alpha, beta and x as (languages, words); sequence s is words first[s] to first[s + 1].

        Sequences are cut into blocks of BLOCK words. All blocks advance together, a word at a time: first as products of
        matrices, which carry the values at the blocks' edges from block to block, then from those values as vectors.
        Values are scaled at the edges alone: x is 1 for some language of each word, so a block cannot make them vanish.
        """
        k = e.shape[1]
        a = np.exp(self.moves)
        x = np.exp(e.T - e.T.max(axis=0)) if len(e) else e.T.copy()
        n = np.diff(first)
        blocks = -(-n // BLOCK)
        lead = np.cumsum(blocks) - blocks
        sequence = np.repeat(np.arange(len(n)), blocks)
        nth = np.arange(len(sequence)) - lead[sequence]
        begin = first[:-1][sequence] + nth * BLOCK
        length = np.minimum(BLOCK, n[sequence] - nth * BLOCK)
        order = np.argsort(-length, kind="stable")  # so that the blocks with a word at place t are the first
        begin, length, opening = begin[order], length[order], nth[order] == 0
        where = np.empty_like(order)
        where[order] = np.arange(len(order))
        alive = np.searchsorted(-length, -np.arange(1, BLOCK + 1), side="right")
        alive = alive[alive > 0]
        xs = [x[:, begin[:m] + t] for t, m in enumerate(alive)]
        # sums over languages go term by term: a column's value must not depend on how many columns there are
        after = lambda v: _terms(a[i][:, None] * v[i] for i in range(k))
        ahead = lambda v: _terms(a[:, j][:, None] * v[j] for j in range(k))
        # carry[i, j]: from value i before the block to value j at its end; no move leads to a sequence's first word
        carry = np.where(opening, np.eye(k)[:, :, None], a[:, :, None])
        for t, m in enumerate(alive):
            moved = _terms(carry[:, i, None, :m] * a[i][:, None] for i in range(k)) if t else carry[:, :, :m]
            carry[:, :, :m] = moved * xs[t]
        if len(order):
            carry /= _terms(carry[i, j] for i in range(k) for j in range(k))
        before, behind = np.ones((k, len(order))), np.ones((k, len(order)))
        by_count = np.argsort(-blocks, kind="stable")
        most = int(blocks.max()) if len(blocks) else 0
        spots = [where[lead[by_count[: np.searchsorted(-blocks[by_count], -b, side="right")]] + b - 1] for b in range(1, most + 1)]
        for here, there in zip(spots[:-1], spots[1:]):
            here = here[: len(there)]
            cur = _terms(before[i, here] * carry[i][:, here] for i in range(k))
            before[:, there] = cur / _terms(cur)
        for here, there in zip(spots[-2::-1], spots[:0:-1]):
            here = here[: len(there)]
            cur = _terms(carry[:, j][:, there] * behind[j, there] for j in range(k))
            behind[:, here] = cur / _terms(cur)
        alpha, beta = np.empty_like(x), np.empty_like(x)
        for t, m in enumerate(alive):
            cur = (np.where(opening[:m], before[:, :m], after(before[:, :m])) if not t else after(cur[:, :m])) * xs[t]
            alpha[:, begin[:m] + t] = cur
        cur = behind.copy()
        for t in range(len(alive) - 1, -1, -1):
            m = alive[t]
            beta[:, begin[:m] + t] = cur[:, :m]
            cur[:, :m] = ahead(xs[t] * cur[:, :m])
        return alpha, beta, x, a

    def posteriors(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(words, languages): probabilities of each word's languages."""
        alpha, beta, _, _ = self.forward_backward(e, first)
        out = alpha * beta
        return (out / _terms(out)).T if len(e) else out.T

    def settle(self) -> None:
        """Weights as multiples of 1 / SCALE: sums of them are exact, so a text's do not depend on the texts summed with it."""
        for w in (self.weights, self.known, self.moves):
            w[:] = np.rint(w * SCALE) / SCALE


def _terms(parts) -> np.ndarray:
    """The sum of parts, one after another."""
    return functools.reduce(np.add, parts)


def errors(model: CRF, e: np.ndarray, label: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the mean negative log-likelihood of sequences of `length` words: by emission (words, languages) and by move."""
    k, count = e.shape[1], len(e) // length
    alpha, beta, x, a = model.forward_backward(e, np.arange(count + 1) * length)
    post = alpha * beta
    gold = np.eye(k)[label]
    shape = (count, length, k)
    pair = alpha.T.reshape(shape)[:, :-1, :, None] * a * (x * beta).T.reshape(shape)[:, 1:, None, :]
    pair = (pair / pair.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))
    true = np.einsum("stc,std->cd", gold.reshape(shape)[:, :-1], gold.reshape(shape)[:, 1:])
    return ((post / post.sum(axis=0)).T - gold) / count, (pair - true) / count


def fit_texts(texts: list[str], langs: list[str], names: list[str]) -> CRF:
    """A model from texts and their languages; words take their text's language, sequences are cut and joined at random."""
    model = CRF(names)
    rng = np.random.default_rng(SEED)
    k = len(names)
    # first pass, a batch at a time: word counts and the lexicon
    n, word = [], []
    for lo, hi, words in _by_words(texts):
        n.append(np.diff(words.first))
        word.append(Features(words).word)
    n = np.concatenate([np.zeros(0, dtype=np.int64), *n])
    start = np.concatenate([[0], np.cumsum(n)])
    label = np.repeat(np.array([names.index(x) for x in langs], dtype=np.int64), n)
    if not len(label):
        return model
    word = np.concatenate(word)
    counts = np.zeros((LEXICON, k))
    np.add.at(counts, (word, label), 1)
    total = counts.sum(axis=1)
    pure = (total >= LEAST) & (counts.max(axis=1) >= PURE * total)
    model.lexicon[pure] = counts[pure].argmax(axis=1) + 1
    # sequences: texts of each language are drawn alike often, a text by its number of words
    full = np.flatnonzero(n)
    lang_of = np.array([names.index(x) for x in langs])[full]
    pools = [(full[lang_of == c], np.cumsum(n[full[lang_of == c]])) for c in range(k)]
    pools = [p for p in pools if len(p[0])]

    def draw(count: int) -> np.ndarray:
        pool, ends = pools[rng.integers(len(pools))]
        d = pool[np.searchsorted(ends, rng.integers(ends[-1]), side="right")]
        at = rng.integers(n[d])
        return start[d] + (at + np.arange(count)) % n[d]

    rows = np.empty((SEQUENCES, LENGTH), dtype=np.int64)
    for s in range(SEQUENCES):
        cut = LENGTH if s % 2 else int(rng.integers(4, LENGTH - 3))
        rows[s, :cut] = draw(cut)
        if cut < LENGTH:
            rows[s, cut:] = draw(LENGTH - cut)
    # second pass: the features of the words that stand in sequences
    needed = np.unique(rows)
    ids_of, width_of, at = [], [], 0
    for lo, hi, words in _by_words(texts):
        mine = needed[(needed >= at) & (needed < at + len(words.start))] - at
        ids, first = Features(words).of(mine)
        ids_of.append(ids)
        width_of.append(np.diff(np.append(first, len(ids))))
        at += len(words.start)
    ids_of, width_of = np.concatenate(ids_of), np.concatenate(width_of)
    begin_of = np.cumsum(width_of) - width_of
    step_w, step_k, step_m = np.full(model.weights.shape, 1e-6, dtype=np.float32), np.full(model.known.shape, 1e-6), np.full((k, k), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(SEQUENCES)
        for lo in range(0, SEQUENCES, BATCH):
            seq = rows[order[lo : lo + BATCH]]
            w = seq.ravel()
            spot = np.searchsorted(needed, w)
            width = width_of[spot]
            first = np.cumsum(width) - width
            ids = ids_of[np.arange(int(width.sum())) + np.repeat(begin_of[spot] - first, width)]
            lex = model.lexicon[word[w]]
            e = np.add.reduceat(model.weights[ids], first, axis=0).astype(np.float64) + model.known[lex]
            g, gm = errors(model, e, label[w], LENGTH)
            used, inverse = np.unique(ids, return_inverse=True)
            spread = np.repeat(g, width, axis=0)
            gw = np.stack([np.bincount(inverse, weights=spread[:, c], minlength=len(used)) for c in range(k)], axis=1) + DECAY * model.weights[used]
            step_w[used] += gw * gw
            model.weights[used] -= RATE * gw / np.sqrt(step_w[used])
            gk = np.zeros_like(model.known)
            np.add.at(gk, lex, g)
            step_k += gk * gk
            model.known -= RATE * gk / np.sqrt(step_k)
            gm += DECAY * model.moves
            step_m += gm * gm
            model.moves -= RATE * gm / np.sqrt(step_m)
    model.settle()
    return model


def fit(docs: DataFrame, rows: int = TRAIN_DOCS) -> CRF:
    """A model from rows of docs (doc_id, text, lang) with a language that are not held out.

    At most `rows` of them are used, alike many of each language (at least one), the first in the order of their ids'
    hashes (of rows that repeat an id the one with the smallest text), and of those as many as come before TRAIN_CHARS
    characters are full. Without rows there is no language to predict.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    names = sorted(r.lang for r in own.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"there are more than {LANGUAGES} languages")
    each = max(1, rows // max(1, len(names)))
    ids = own.select("doc_id", "lang").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    ids = materialize(ids.withColumn("hash", F.xxhash64("doc_id")).withColumn("range", F.shiftright("hash", 64 - RANGE_BITS)), "language-ids")
    # the ranges of hashes that hold a language's first rows are counted out first, so only little more than those is sorted
    counts = ids.groupBy("lang", "range").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("before", before).where(F.col("before") < each).groupBy("lang").agg(F.max("range").alias("last"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    near = ids.join(F.broadcast(last), "lang").where("range <= last")
    chosen = near.select("*", place.alias("place")).where(F.col("place") <= each).select("doc_id", "place")
    chosen = materialize(chosen, "language-sample")
    got = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "place").agg(F.min(F.struct("text", "lang")).alias("row"))
    got = materialize(got.select("doc_id", "place", "row.*"), "language-texts")
    before = Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # of at most `rows` rows
    fits = got.select("doc_id", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("chars")).where(F.col("chars") < TRAIN_CHARS)
    got = got.join(F.broadcast(fits.select("doc_id")), "doc_id").select("doc_id", "text", "lang").toArrow().to_pandas().sort_values("doc_id")
    return fit_texts(list(got["text"]), list(got["lang"]), names)


def _by_words(texts: list[str]):
    """(lo, hi, Words) for consecutive texts, as many as numpy needs to be quick and memory allows."""
    for lo, hi in slices(texts):
        yield lo, hi, Words(texts[lo:hi])


def predict(docs: DataFrame, model: CRF) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, lang_pred, score (0 to 1).

    lang_pred is the language with the largest mean probability over all words of the text, score that mean. Null texts and texts
    without a letter are `und` with score 0, as is every text if no language was learned. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(it):
        crf = sent.value
        for ids, texts in batches(it, "doc_id", "text"):
            for start in range(0, len(texts), 1000):
                part = texts.slice(start, 1000).to_pylist()
                lang, score = [UNKNOWN] * len(part), np.zeros(len(part))
                for lo, _, words in _by_words(part) if crf.names else ():
                    n = np.diff(words.first)
                    post = crf.posteriors(crf.emissions(Features(words)), words.first)
                    # sums of whole numbers: a text's do not depend on what stands before it
                    total = np.concatenate([np.zeros((1, len(crf.names)), np.int64), np.cumsum(np.rint(post * PARTS).astype(np.int64), axis=0)])
                    mean = (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(n, 1)[:, None] / PARTS
                    best = mean.argmax(axis=1)
                    for i in np.flatnonzero(n).tolist():
                        if LETTER.search(part[lo + i]):
                            lang[lo + i], score[lo + i] = crf.names[best[i]], min(1.0, max(0.0, mean[i, best[i]]))
                yield arrow_rows(schema, doc_id=ids.slice(start, 1000), lang_pred=lang, score=score)

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = cols.mapInArrow(frugal(run), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def label_words(docs: DataFrame, model: CRF) -> DataFrame:
    """(doc_id, runs array<struct<lang, words>>) of each row: consecutive words of one likeliest language, and how many they are.

    Null and empty texts have no runs.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("runs", kind)])

    def run(it):
        crf = sent.value
        for ids, texts in batches(it, "doc_id", "text"):
            part, out = texts.to_pylist(), []
            for _, _, words in _by_words(part):
                post = crf.posteriors(crf.emissions(Features(words)), words.first) if crf.names else np.zeros((len(words.start), 0))
                for a, b in zip(words.first[:-1], words.first[1:]):
                    best = post[a:b].argmax(axis=1) if crf.names and b > a else np.zeros(0, dtype=int)
                    cut = np.flatnonzero(np.diff(best)) + 1
                    out.append([{"lang": crf.names[x[0]], "words": len(x)} for x in np.split(best, cut) if len(x)])
            yield arrow_rows(schema, doc_id=ids, runs=out)

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(frugal(run), "doc_id long, runs array<struct<lang string, words long>>")
