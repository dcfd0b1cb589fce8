"""The classifiers and the rollup against held-out accuracy and brute force."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vialytics.llm import language_id, token_counts, toxicity
from vialytics.llm.words import Words


def corpus(n=900, seed=2):
    """Texts of two made-up languages; toxic ones hold a marked word."""
    rng = random.Random(seed)
    parts = {"aa": ["ka", "lo", "mi", "tu", "ré"], "bb": ["sch", "ung", "ein", "öx", "zt"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words.insert(rng.randrange(len(words)), {"aa": "vilepig", "bb": "mistkerl"}[lang])
        rows.append((i, " ".join(words).title(), lang, toxic))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


ODD = [(None, "kalo", "aa"), (5001, None, "aa"), (5002, "", None), (5003, "123 !!", "bb"), (5004, "kalo " * 60_000, "aa"), (5005, "漢字", None), (5001, None, "aa")]


def test_toxicity_on_held_out_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows] + ODD, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as _score0").repartition(3)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, net).collect()}
    assert toxicity.score(docs, net).count() == len(rows) + len(ODD)
    assert all(r.held_out == held(i) for i, r in got.items() if i is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    right = [got[i].predicted == y for i, _, _, y in rows if held(i)]
    assert np.mean(right) > 0.95
    kept = toxicity.keep_clean(docs, net)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted == 0 for r in toxicity.score(docs, net).collect())
    # texts that share a batch do not touch each other's score
    lone = Words([rows[0][1]])
    assert abs(net.scores(toxicity.buckets(lone), lone.first)[0] - got[0].score) < 1e-6


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def plain_probability(net, ids):
    """Word vectors, then every filter at every place, in loops; padding stands behind the text."""
    vectors = [sum(net.table[r].astype(float) for r in row) for row in ids] + [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
    z, k = net.prior, 0
    for width, f, b in zip(toxicity.WIDTHS, net.filters, net.bias):
        for c in range(toxicity.FILTERS):
            values = [sum(vectors[i + j] @ f[j * toxicity.DIM : (j + 1) * toxicity.DIM, c] for j in range(width)) + b[c] for i in range(len(vectors) - width + 1)]
            z += max(0, max(values)) * net.out[k]
            k += 1
    return 1 / (1 + np.exp(-z))


def test_convolution_and_gradients_equal_plain_ones():
    rng = np.random.default_rng(3)
    net = toxicity.Net()
    net.table = net.table.astype(np.float64)
    net.filters, net.bias = [f.astype(np.float64) for f in net.filters], [b + rng.normal(size=b.shape) * 0.3 for b in net.bias]
    net.out = rng.normal(size=net.out.shape)
    texts = [rng.integers(1, 40, size=(n, 1 + len(toxicity.PREFIXES))) for n in (0, 1, 2, 7, 30)]
    ids, first = toxicity._joined(texts)
    got = net.probabilities(ids, first)
    assert np.allclose(got, [plain_probability(net, t) for t in texts], atol=1e-9)
    y, weight = np.array([0, 1, 0, 1, 1]), np.array([1.0, 2.0, 1.0, 2.0, 2.0])

    def loss():
        p = net.probabilities(ids, first)
        return float(np.mean(-weight * np.where(y == 1, np.log(p), np.log(1 - p))))

    filters, biases, out, prior, used, rows = toxicity.gradients(net, ids, first, y, weight)
    places = [(f, g, tuple(rng.integers(s) for s in f.shape)) for f, g in zip(net.filters, filters) for _ in range(6)]
    places += [(b, g, (int(rng.integers(len(b))),)) for b, g in zip(net.bias, biases)] + [(net.out, out, (k,)) for k in range(4)]
    full = np.zeros_like(net.table)
    full[used] = rows
    places += [(net.table, full, (int(used[k]), k % toxicity.DIM)) for k in range(1, len(used), 3)]
    for x, g, at in places:
        old = x[at]
        x[at] = old + 1e-5
        up = loss()
        x[at] = old - 1e-5
        down = loss()
        x[at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4, (up, down, g[at])


def test_toxicity_learns_from_few_labels():
    rows = corpus(120, seed=7)
    coded = [toxicity.buckets(Words([r[1]])) for r in rows]
    y = np.array([r[3] for r in rows])
    net = toxicity.fit_rows(coded[:80], y[:80], [r[2] for r in rows[:80]])
    assert np.mean((net.scores(*toxicity._joined(coded[80:])) >= 0.5) == y[80:]) > 0.9


def test_languages_on_held_out_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows] + ODD, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred").repartition(3)
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in rows if held(i)]) > 0.97
    assert {got[i].lang_pred for i in (5001, 5002, 5003)} == {"und"} and got[5004].lang_pred == "aa" and got[5005].lang_pred in ("aa", "bb")
    assert all(0 <= r.score <= 1 for r in got.values())
    mixed = spark.createDataFrame([(1, "kalo mitu lomi kaka reka schung einzt ungein schein ungung"), (2, None)], "doc_id long, text string")
    runs = {r.doc_id: [(x.lang, x.words) for x in r.runs] for r in language_id.label_words(mixed, model).collect()}
    assert runs == {1: [("aa", 5), ("bb", 5)], 2: []}
    nothing = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_forward_backward_equals_a_plain_recursion():
    rng = np.random.default_rng(1)
    model = language_id.CRF(["a", "b", "c"])
    model.moves = rng.normal(size=(3, 3))
    n = np.array([0, 1, 5, 63, 64, 65, 200, 0, 128, 129, 1000, 2])
    first = np.concatenate([[0], np.cumsum(n)])
    e = rng.normal(size=(first[-1], 3)) * 3
    got = model.posteriors(e, first)
    a = np.exp(model.moves)
    for lo, hi in zip(first[:-1], first[1:]):
        x = np.exp(e[lo:hi])
        alpha, beta = x.copy(), np.ones_like(x)
        for t in range(1, len(x)):
            alpha[t] = (alpha[t - 1] @ a) * x[t]
            alpha[t] /= alpha[t].sum()
        for t in range(len(x) - 2, -1, -1):
            beta[t] = (x[t + 1] * beta[t + 1]) @ a.T
            beta[t] /= beta[t].sum()
        want = alpha * beta
        assert np.allclose(got[lo:hi], want / want.sum(axis=1, keepdims=True), atol=1e-9)


def test_rollup_against_brute_force(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [(i, t, s, g) for i, (t, s, g) in enumerate([("a b", "x", "en"), ("a b", "y", "en"), (None, "x", None), ("", "x", "en"), ("c d e", None, "fr"), ("word " * 9000, "x", "en")])]
    rows += [(None, "a b", "z", "en"), (None, "a b", "z", "en"), (0, "a b", "x", "en")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, lang string, n_tokens int, tokenizer string").repartition(3)
    rollup = token_counts.corpus_rollup(docs, path, "v1")
    want = collections.Counter()
    smallest = {}
    for i, t, _, _ in rows:
        smallest[t or ""] = min(smallest.get(t or "", 1 << 62), 1 << 62 if i is None else i)
    for i, t, s, g in rows:
        if i == smallest[t or ""]:
            want[s, g, "docs"] += 1
            want[s, g, "tokens"] += len(lib.encode(t or "", add_special_tokens=False).ids) + 1
    got = rollup.totals().collect()
    assert {r.tokenizer for r in got} == {"v1+end"}
    assert {(r.source, r.lang, "docs"): r.docs for r in got} | {(r.source, r.lang, "tokens"): r.tokens for r in got} == dict(want)
    counts = token_counts.token_counts(docs, path, "v2")
    assert rollup.commit("more", token_counts.inserts(counts)) and not rollup.commit("more", token_counts.inserts(counts))
    assert rollup.commit("less", token_counts.deletes(counts))
    assert sorted(map(tuple, rollup.totals().collect()), key=str) == sorted(map(tuple, got), key=str)
    assert token_counts.Rollup(spark).totals().count() == 0
    assert token_counts.corpus_rollup(docs.limit(0), path, "v1").totals().count() == 0


def test_two_writers_of_one_batch_count_once(spark, monkeypatch):
    rows = spark.createDataFrame([("s", "en", "v", 1, 10)], "source string, lang string, tokenizer string, sign int, n_tokens long")
    first = token_counts.Rollup(spark)
    second = token_counts.Rollup(spark, first.folder)
    claim, done = second._claim, []

    def late(name, content):  # the first writer commits after the second has looked and written its draft
        done.append(first.commit("b", rows))
        return claim(name, content)

    monkeypatch.setattr(second, "_claim", late)
    assert (second.commit("b", rows), done) == (False, [True])
    assert [(r.docs, r.tokens) for r in first.totals().collect()] == [(1, 10)]
    assert first.commit("c", rows) and [(r.docs, r.tokens) for r in second.totals().collect()] == [(2, 20)]


def test_rollup_counts_documents_by_their_own_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [(1, "a b", "x"), (None, "a b", "x"), (None, "own text", "x"), (None, "own text", "y"), (2, "a b", "x"), (2, "other text here", "x"), (3, "a b", "x"), (1, "a b", "x"), (4, None, "y")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, source string, lang string").repartition(3)
    size = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)

    def sums(of, version, more):
        return {(s, version): (len(g), sum(map(size, g)) + more * len(g)) for s in "xy" if (g := [t for k, (_, t, source) in enumerate(rows) if k in of and source == s])}

    def totals(rollup):
        return {(r.source, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}

    assert totals(token_counts.corpus_rollup(docs, path, "v1")) == sums({0, 2, 3, 5, 7, 8}, "v1+end", 1)
    every = set(range(len(rows)))
    assert totals(token_counts.corpus_rollup(docs, path, "v1", whole=True)) == sums(every, "v1", 0) | sums(every, "v1+end", 1)


def test_a_text_is_predicted_alike_alone_and_among_others(spark):
    rng = random.Random(8)
    model = language_id.fit_texts(*zip(*[(t, l) for _, t, l, _ in corpus(300)]), ["aa", "bb"])
    texts = ["Je vais bien", "", "x", "Öl", "word", "zzz", "a", "ka", "schung öx", "ka lo " * 300, "1 2 3"] + ["".join(rng.choice("kalomitüß ß ") for _ in range(rng.randrange(1, 400))) for _ in range(200)]
    alone = {}
    for i, t in enumerate(texts):
        w = Words([t])
        post = model.posteriors(model.emissions(language_id.Features(w)), w.first)
        alone[i] = post.tobytes()
    for seed in range(3):
        order = list(range(len(texts)))
        random.Random(seed).shuffle(order)
        w = Words([texts[i] for i in order])
        post = model.posteriors(model.emissions(language_id.Features(w)), w.first)
        assert all(np.ascontiguousarray(post[a:b]).tobytes() == alone[i] for i, a, b in zip(order, w.first[:-1], w.first[1:]))
    frames = [spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").repartition(n) for n, order in ((1, range(len(texts))), (7, reversed(range(len(texts)))))]
    one, two = ({r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(f, model).collect()} for f in frames)
    assert one == two and len(one) == len(texts)


def test_crf_gradients_equal_differences_of_the_likelihood():
    rng = np.random.default_rng(3)
    k, length, count = 3, 7, 4
    model = language_id.CRF(["a", "b", "c"])
    model.moves = rng.normal(size=(k, k))
    e, label = rng.normal(size=(length * count, k)), rng.integers(0, k, length * count)

    def loss(e, moves):
        total = 0.0
        for s in range(count):
            part, y = e[s * length : (s + 1) * length], label[s * length : (s + 1) * length]
            v = part[0]
            for t in range(1, length):
                v = np.log(np.exp(v[:, None] + moves).sum(axis=0)) + part[t]
            total += np.log(np.exp(v).sum()) - part[np.arange(length), y].sum() - moves[y[:-1], y[1:]].sum()
        return total / count

    ge, gm = language_id.errors(model, e, label, length)
    for grad, x, f in ((ge, e, lambda x: loss(x, model.moves)), (gm, model.moves.copy(), lambda x: loss(e, x))):
        for at in np.ndindex(*x.shape):
            step = np.zeros_like(x)
            step[at] = 1e-5
            assert abs((f(x + step) - f(x - step)) / 2e-5 - grad[at]) < 1e-7
