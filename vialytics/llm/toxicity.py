"""Toxicity: a convolutional text classifier in numpy.

A word's vector is the sum of the hashed embeddings of the word and of its first bytes. Filters of several widths run
over all words of a text, each keeps its largest value (max pooling), and a logistic layer gives a probability. One
dimension of the embeddings starts as each word's standing among toxic texts, so that few labels are enough to start
from. Models of parts of the sample score the part they have not seen: that decides how long to train and gives
every language a threshold, which is moved to 0.5; the language is guessed from the text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, batches, fresh, frugal, give_back, held_out, materialize
from .words import Words, slices

#: Bounds of the sample that the model is fitted on: rows, and the characters of all of them; whole texts of any length.
TRAIN_ROWS, TRAIN_CHARS = 12_000, 60_000_000
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 6
PREFIXES = (6, 7, 8)
EPOCHS, PATIENCE, BATCH, RATE, DECAY, SEED = 8, 1, 64, 0.02, 2e-3, 11
#: Parts of the sample; each is scored by a model of the others, part by part until UNSEEN rows have such a score.
FOLDS, UNSEEN = 5, 3_000
#: Where training starts: the clip and scale of standings, the bias of the filters that look there, and the spread of all else.
CLIP, SCALE, BIAS, NOISE = 12, 8, -0.7, 0.01
#: A language's threshold counts as much as the common one when it rests on so many toxic texts.
SHRINK = 5


def buckets(words: Words) -> np.ndarray:
    """(words, 1 + prefixes): the rows of the embedding table whose sum is a word's vector. Row 0 is padding."""
    keys = [words.hashes(words.start, words.end)]
    keys += [words.hashes(words.start, np.minimum(words.end, words.start + p)) + np.uint64(p) for p in PREFIXES]
    return np.stack([(k >> np.uint64(32)) % np.uint64(BUCKETS - 1) for k in keys], axis=1).astype(np.uint32) + np.uint32(1)


class Net:
    """The classifier's parameters; `languages` guesses a language from words, `thresholds` belong to its guesses."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.table = (rng.normal(size=(BUCKETS, DIM)) * NOISE).astype(np.float32)
        self.table[0] = 0
        self.filters = [(rng.normal(size=(w * DIM, FILTERS)) * np.sqrt(2 / (w * DIM))).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out, self.prior = (rng.normal(size=len(WIDTHS) * FILTERS) * NOISE).astype(np.float32), 0.0
        self.languages = np.zeros((BUCKETS, 1), dtype=np.float32)
        self.thresholds = np.array([0.5])

    def start_from(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """Dimension 0 of words and beginnings: how many deviations the toxic texts that hold them are above their share; filter 0 looks there."""
        share = float(y.mean())
        seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for t, k in zip(texts, y.tolist()):
            parts = np.unique(t)
            seen[parts] += 1
            toxic[parts] += k
        standing = (toxic - seen * share) / np.sqrt(seen * share * (1 - share) + 0.5)
        self.table[:, 0] = np.clip(standing, -4, CLIP) / SCALE
        self.table[0] = 0
        for f in self.filters:
            f[:, 0] = 0
            f[0, 0] = 1
        for b in self.bias:
            b[0] = BIAS
        self.out[:: FILTERS] = 2.0
        self.prior = float(np.log(share / (1 - share))) - 1.0

    def pooled(self, ids: np.ndarray, first: np.ndarray):
        """(maxima, values of all windows by width, padded vectors, padded ids, begin of each text in them).

        Text k is words first[k] to first[k + 1] of ids. Every text gets max(WIDTHS) padding words behind it, so texts of
        any length have at least one window, and no window reaches into another text.
        """
        pad = max(WIDTHS)
        n = np.diff(first)
        begin = first[:-1] + pad * np.arange(len(n))
        padded = np.zeros((len(ids) + pad * len(n), ids.shape[1]), dtype=np.int32)
        padded[np.arange(len(ids)) + pad * np.repeat(np.arange(len(n)), n)] = ids
        vectors = self.table[padded[:, 0]]
        for c in range(1, ids.shape[1]):
            vectors += self.table[padded[:, c]]
        total = len(padded)
        values, places = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            rows = vectors @ f[:DIM]
            for j in range(1, w):
                rows[: total - j] += vectors[j:] @ f[j * DIM : (j + 1) * DIM]
            rows += b
            for j in range(1, w):
                rows[np.append(begin[1:], total) - j] = -np.inf  # such windows would reach into the next text
            best = np.maximum.reduceat(rows, begin, axis=0)
            values.append(best)
            places.append(rows)
        return np.concatenate(values, axis=1), places, vectors, padded, begin

    def probabilities(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        best = self.pooled(ids, first)[0]
        return 1 / (1 + np.exp(-(np.maximum(best, 0) @ self.out + self.prior)))

    def guesses(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest language of each text (naive Bayes over its words); 0 without words."""
        if not len(ids):
            return np.zeros(len(first) - 1, dtype=np.int64)
        total = np.concatenate([np.zeros((1, self.languages.shape[1])), np.cumsum(self.languages[ids[:, 0]], axis=0, dtype=np.float64)])
        return np.argmax(total[first[1:]] - total[first[:-1]], axis=1)

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probabilities, with the threshold of the guessed language moved to 0.5 and 0 and 1 kept."""
        p = self.probabilities(ids, first).astype(np.float64)
        t = self.thresholds[self.guesses(ids, first)]
        return np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t))


class _Adam:
    def __init__(self, x: np.ndarray, decay: float = 0.0):
        self.x, self.m, self.v, self.t, self.decay = x, np.zeros_like(x), np.zeros_like(x), 0, decay

    def step(self, g: np.ndarray, rows=slice(None)):
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * g
        self.v[rows] = 0.99 * self.v[rows] + 0.01 * g * g
        self.x[rows] -= RATE * ((self.m[rows] / (1 - 0.9**self.t)) / (np.sqrt(self.v[rows] / (1 - 0.99**self.t)) + 1e-6) + self.decay * self.x[rows])


def gradients(net: Net, ids: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Of the mean weighted log loss by (filters, biases, out, prior, rows of the table, their values); only maxima pass it on."""
    best, rows, vectors, padded, begin = net.pooled(ids, first)
    hidden = np.maximum(best, 0)
    p = 1 / (1 + np.exp(-(hidden @ net.out + net.prior)))
    d = ((p - y) * weight / len(y)).astype(np.float32)
    back = d[:, None] * net.out * (best > 0)
    at, grad, filters, biases = [], [], [], []
    end = np.append(begin[1:], len(padded))
    for k, w in enumerate(WIDTHS):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        place = np.stack([a + rows[k][a:b].argmax(axis=0) for a, b in zip(begin, end)])
        df = np.zeros_like(net.filters[k])
        for j in range(w):
            spot = np.minimum(place + j, len(padded) - 1)
            df[j * DIM : (j + 1) * DIM] = np.einsum("nfd,nf->df", vectors[spot], g)
            at.append(spot.ravel())
            grad.append((g[:, :, None] * net.filters[k][j * DIM : (j + 1) * DIM].T[None]).reshape(-1, DIM))
        filters.append(df)
        biases.append(g.sum(axis=0))
    at, grad = np.concatenate(at), np.concatenate(grad)
    used, inverse = np.unique(padded[at], return_inverse=True)
    sums = np.zeros((len(used), DIM), dtype=np.float32)
    for c in range(padded.shape[1]):
        np.add.at(sums, inverse.reshape(len(at), -1)[:, c], grad)
    sums[used == 0] = 0
    return filters, biases, hidden.T @ d, d.sum(), used, sums


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros((0, 1 + len(PREFIXES)), dtype=np.uint32), *texts]), np.cumsum([0, *map(len, texts)])


def _epochs(net: Net, texts: list[np.ndarray], y: np.ndarray):
    """Trains net by gradient descent on the log loss with decay; yields before the first epoch and after each."""
    rng = np.random.default_rng(SEED)
    net.start_from(texts, y)
    weight = np.where(y == 1, min(4.0, 0.5 / y.mean()), 1.0)
    table, prior = _Adam(net.table, DECAY), _Adam(np.array([net.prior]))
    out, filters, bias = _Adam(net.out, DECAY), [_Adam(f, DECAY) for f in net.filters], [_Adam(b) for b in net.bias]
    while True:
        yield
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            df, db, do, dp, used, dt = gradients(net, *_joined([texts[i] for i in pick]), y[pick], weight[pick])
            for steps, grads in ((filters, df), (bias, db)):
                for step, g in zip(steps, grads):
                    step.step(g)
            out.step(do)
            prior.step(np.array([dp]))
            net.prior = float(prior.x[0])
            table.step(dt, used)


def _probabilities(net: Net, texts: list[np.ndarray]) -> np.ndarray:
    """Probabilities of texts, some at a time."""
    return np.concatenate([np.zeros(0), *(net.probabilities(*_joined(texts[lo : lo + 256])) for lo in range(0, len(texts), 256))])


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p))))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, as a logit; between two values, so that none lies on it."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    k = int(np.argmax(f1))
    low = p[order[k + 1]] if k + 1 < len(y) else 0.0
    return float((_logit(p[order[k]]) + _logit(low)) / 2)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Net:
    """A model from rows of docs (doc_id, text, lang) that labels (doc_id, toxic) marks and that are not held out.

    At most `rows` of them are used, the first in the order of their ids' hashes, and of those only as many as come
    before TRAIN_CHARS characters are full. Of labels that repeat an id the largest counts, of documents the smallest
    text. With one class or no rows the model predicts that class for every text (nothing toxic without rows). lang only
    names the groups that thresholds are calibrated for: scores are made from text alone.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    chosen = marked.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = materialize(chosen, "toxic-sample")
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("lang", pa.string()), ("ids", pa.binary())])

    def run(it):
        for ids, toxic, langs, texts in batches(it, "doc_id", "toxic", "lang", "text"):
            for i, y, lang, t in zip(ids.to_pylist(), toxic.to_pylist(), langs.to_pylist(), texts):
                coded = buckets(Words([t.as_py()]))
                yield arrow_rows(schema, doc_id=[i], toxic=[y], lang=[lang], ids=[coded.astype("<u4").tobytes()])

    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang")).alias("row"))
    sample = materialize(sample.select("doc_id", "toxic", "row.lang", "row.text"), "toxic-texts")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # of at most `rows` rows
    fits = sample.select("doc_id", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("chars")).where(F.col("chars") < TRAIN_CHARS)
    got = sample.join(F.broadcast(fits.select("doc_id")), "doc_id").mapInArrow(frugal(run), "doc_id long, toxic int, lang string, ids binary")
    got = got.toArrow().to_pandas().sort_values("doc_id")
    return fit_rows([np.frombuffer(x, dtype="<u4").reshape(-1, 1 + len(PREFIXES)) for x in got["ids"]], got["toxic"].to_numpy(np.int64), [x or "" for x in got["lang"]])


def fit_rows(texts: list[np.ndarray], y: np.ndarray, langs: list[str]) -> Net:
    """A model from coded texts, their classes and languages. With fewer than FOLDS rows of a class nothing is held apart."""
    net = Net()
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.prior = 5.0 if len(y) and y[0] == 1 else -5.0
        return net
    names = sorted(set(langs))
    counts = np.full((BUCKETS, len(names)), 0.1)
    for t, lang in zip(texts, langs):
        np.add.at(counts, (t[:, 0], names.index(lang)), 1)
    net.languages = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    fold = np.zeros(len(y), dtype=np.int64)
    for k in (0, 1):  # each class is spread over all folds
        rows = np.random.default_rng(SEED + k).permutation(np.flatnonzero(y == k))
        fold[rows] = np.arange(len(rows)) % FOLDS
    whole = min(np.bincount(y)) < FOLDS
    used = min(FOLDS, -(-FOLDS * UNSEEN // len(y)))
    parts = [(np.ones(len(y), dtype=bool),) * 2] if whole else [(fold != k, fold == k) for k in range(used)]
    scored = whole | (fold < used)
    nets = [Net() for _ in parts]
    training = [_epochs(n, [texts[i] for i in np.flatnonzero(a)], y[a]) for n, (a, _) in zip(nets, parts)]
    best, p, epochs, since = np.inf, None, 0, 0
    for epoch in range(EPOCHS + 1):
        unseen = np.zeros(len(y))
        for n, step, (_, b) in zip(nets, training, parts):
            next(step)
            unseen[b] = _probabilities(n, [texts[i] for i in np.flatnonzero(b)])
        if (loss := _loss(unseen[scored], y[scored])) < best:
            best, p, epochs, since = loss, unseen, epoch, 0
        elif (since := since + 1) > PATIENCE:
            break
    steps = _epochs(net, texts, y)
    for _ in range(epochs + 1):
        next(steps)
    guess = np.concatenate([net.guesses(*_joined(texts[lo : lo + 256])) for lo in range(0, len(texts), 256)])
    p, y, guess = p[scored], y[scored], guess[scored]
    common, cuts = _threshold(p, y), []
    for k in range(len(names)):
        toxic = y[guess == k].sum()
        own = _threshold(p[guess == k], y[guess == k]) if toxic else common
        cuts.append((toxic * own + SHRINK * common) / (toxic + SHRINK))
    net.thresholds = 1 / (1 + np.exp(-np.array(cuts)))
    return net


def score(docs: DataFrame, net: Net) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Whole texts are scored; null and empty texts get the score of a text without words. Null ids count as held out.
    Every other column is ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(it):
        model = sent.value
        for ids, texts in batches(it, "doc_id", "text"):
            values = []
            for start in range(0, len(texts), 500):
                part = texts.slice(start, 500).to_pylist()
                for lo, hi in slices(part):
                    words = Words(part[lo:hi])
                    values.append(model.scores(buckets(words), words.first))
            yield arrow_rows(schema, doc_id=ids, score=np.concatenate(values))

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = cols.mapInArrow(frugal(run), "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, net: Net) -> DataFrame:
    """The rows of docs whose text scores below 0.5, all columns; null and empty texts are scored as texts without words."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def scored(texts: pa.Array) -> pa.Array:
        values = [np.zeros(0)]
        for start in range(0, len(texts), 500):
            part = texts.slice(start, 500).to_pylist()
            for lo, hi in slices(part):
                words = Words(part[lo:hi])
                values.append(sent.value.scores(buckets(words), words.first))
        give_back()
        return pa.array(np.concatenate(values))

    flag = fresh("_score", docs.columns)
    return docs.withColumn(flag, F.arrow_udf(scored, "double")(F.col("text").cast("string"))).where(F.col(flag) < 0.5).drop(flag)
