import numpy as np
import pyarrow as pa
import pytest

from quire.llm import pseudolikelihood as L
from quire.llm.words import words

from .helpers import empty_docs, nasty_docs, nasty_texts, plain_words, prose, rows_of


@pytest.fixture(scope="module")
def net():
    return L.Network.start(np.random.default_rng(1).integers(0, 50, L._V), seed=3)


def test_contexts():
    ids, rows, around = L.ids_and_contexts(pa.array(["a b c", None, "d", "e f"]))
    hashed = {x: int(words(pa.array([x]), "plain").hashes[0] >> np.uint64(64 - L._BITS)) for x in "abcdef"}
    a, b, c, d, e, f = (hashed[x] for x in "abcdef")
    p = L._V
    assert ids.tolist() == [a, b, c, d, e, f] and rows.tolist() == [0, 0, 0, 2, 3, 3]
    assert around.T.tolist() == [[p, p, b, c], [p, a, c, p], [a, b, p, p], [p, p, p, p], [p, p, f, p], [p, e, p, p]]


def test_log_probabilities_against_plain_loops(net):
    ids, _, around = L.ids_and_contexts(pa.array([" ".join(prose(4, 30)), "x y"]))
    got = L.log_probabilities(net, ids, around)
    for i in range(len(ids)):
        h = np.tanh(net.hidden + sum(net.place[k][around[k, i]] for k in range(4)))
        c = h @ net.to_class + net.class_bias
        w = h @ net.to_word[ids[i] // L.CLASSES] + net.word_bias[ids[i] // L.CLASSES]
        want = c[ids[i] // L.CLASSES] - np.log(np.exp(c).sum()) + w[ids[i] % L.CLASSES] - np.log(np.exp(w).sum())
        assert got[i] == pytest.approx(want, abs=1e-4)


def test_probabilities_of_a_place_sum_to_one(net):
    around = np.repeat(np.array([[5], [9], [L._V], [77]]), L._V, axis=1)
    assert np.exp(L.log_probabilities(net, np.arange(L._V), around)).sum() == pytest.approx(1, abs=1e-4)


def test_gradient_against_differences(net):
    ids, _, around = L.ids_and_contexts(pa.array([" ".join(prose(6, 200))]))
    own = L.Network(net.flat.astype(np.float64))
    g = L._gradient(own, ids, around).flat
    for j in np.argsort(-abs(g))[[0, 30, 300, 1500]]:
        at = []
        for e in (1e-5, -1e-5):
            f = own.flat.copy()
            f[j] += e
            at.append(-L.log_probabilities(L.Network(f), ids, around).mean())
        assert g[j] == pytest.approx((at[0] - at[1]) / 2e-5, rel=1e-4)


def test_average_is_weighted():
    import pandas as pd

    body = [np.full(3, v, dtype=np.float32).tobytes() for v in (1, 4)]
    out = L._average(pd.DataFrame({"chunk": [2, 2], "part": [70, 65], "weight": [1.0, 2.0], "body": body}))
    assert np.frombuffer(out["body"][0], dtype=np.float32).tolist() == [3, 3, 3] and out["part"][0] == 1 and out["weight"][0] == 3


@pytest.mark.parametrize("fan", [64, 2])
def test_training_beats_counts_on_held_out_text(spark, monkeypatch, fan):
    """Words follow each other by a rule that counts alone can't see."""
    monkeypatch.setattr(L, "FAN", fan)
    monkeypatch.setattr(L, "BATCH", 512)
    r = np.random.default_rng(0)
    texts = []
    for _ in range(400):
        w = [int(r.integers(0, 40))]
        for _ in range(60):
            w.append((3 * w[-1] + int(r.integers(0, 2))) % 40)
        texts.append(" ".join(f"v{x}" for x in w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:350])], "doc_id long, text string").repartition(5)
    held = pa.array(texts[350:])
    ids, _, around = L.ids_and_contexts(held)
    counts = np.bincount(L.ids_and_contexts(pa.array(texts[:350]))[0], minlength=L._V)
    before = L.log_probabilities(L.Network.start(counts), ids, around).mean()
    after = L.log_probabilities(L.fit(docs).net, ids, around).mean()
    assert after > before + 0.5


def plain_training(parts, start, rounds):
    """The rounds word by word: ``parts`` lists each task's blocks, a block its documents' word hashes."""
    net = start
    for turn in range(rounds):
        copies = []
        for blocks in parts:
            own, squares, words_seen, held = L.Network(net.flat.copy()), np.zeros(L.Network.size()), 0, []
            todo = []
            for block in blocks:
                for doc in block:
                    key = sum(int(L.mix(np.array([h + np.uint64(1)]))[0]) for h in doc) + len(doc)
                    if (int(L.mix(np.array([key % 2**64], dtype=np.uint64))[0]) >> 33) % rounds == turn:
                        ids = [int(h) >> (64 - L._BITS) for h in doc]
                        held += [(ids[i], [ids[j] if 0 <= j < len(ids) else L._V for j in (i - 2, i - 1, i + 1, i + 2)])
                                 for i in range(len(ids))]
                if len(held) >= L.BATCH:
                    todo, held = [*todo, held], []
            for run in [*todo, held]:
                for i in range(0, len(run), L.BATCH):
                    grad = L.Network(np.zeros(L.Network.size()))
                    part = run[i:i + L.BATCH]
                    for id_, around in part:
                        c, w = divmod(id_, L.CLASSES)
                        h = np.tanh(own.hidden + sum(own.place[k][a] for k, a in enumerate(around)))
                        dc = np.exp(h @ own.to_class + own.class_bias)
                        dc = dc / dc.sum() - np.eye(L.CLASSES)[c]
                        dw = np.exp(h @ own.to_word[c] + own.word_bias[c])
                        dw = dw / dw.sum() - np.eye(L.CLASSES)[w]
                        grad.to_class += np.outer(h, dc)
                        grad.class_bias += dc
                        grad.to_word[c] += np.outer(h, dw)
                        grad.word_bias[c] += dw
                        dh = (own.to_class @ dc + own.to_word[c] @ dw) * (1 - h * h)
                        grad.hidden += dh
                        for k, a in enumerate(around):
                            grad.place[k][a] += dh
                    g = grad.flat / len(part)
                    squares += g * g
                    own.flat -= L.RATE * g / (np.sqrt(squares) + 1e-8)
                    words_seen += len(part)
            if words_seen:
                copies.append((words_seen, own.flat))
        if copies:
            net = L.Network(sum(n * f for n, f in copies) / sum(n for n, _ in copies))
    return net


def test_distributed_training_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(L, "FAN", 2)  # several levels of averages
    texts = [" ".join(prose(i, 5 + 3 * i, 300)) for i in range(24)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    blocks = L.word_blocks(docs, ["doc_id"])
    model = L.fit_blocks(blocks)
    parts = {}
    for r in blocks.select("words", "places", L.F.col("docs._words").alias("sizes"), L.F.spark_partition_id().alias("part")).collect():
        places = np.frombuffer(bytes(r.places), dtype=L._place_type(len(r.words))) if r.places else []
        flat = [np.uint64(r.words[p] % 2**64) for p in places]
        ends = np.cumsum(r.sizes)
        parts.setdefault(r.part, []).append([flat[e - n:e] for n, e in zip(r.sizes, ends)])
    start = L.Network.start(model.totals)
    want = plain_training(list(parts.values()), L.Network(start.flat.astype(np.float64)), L.ROUNDS)
    assert len(parts) > 2 and np.abs(want.flat - start.flat).max() > 0.05
    assert np.abs(model.net.flat - want.flat).max() < 1e-3


def plain_scores(texts, model, corpus):
    """(words, log-probability) of each text, word by word; words are counted as strings in ``corpus``."""
    from collections import Counter

    n = Counter(w for t in corpus for w in plain_words(t))
    kind = {w: int(words(pa.array([w]), "plain").hashes[0]) >> (64 - L._BITS) for w in {*n, *(w for t in texts for w in plain_words(t))}}
    total, distinct = Counter(), Counter()
    for w, k in n.items():
        total[kind[w]] += k
        distinct[kind[w]] += 1
    out = []
    for t in texts:
        ids, _, around = L.ids_and_contexts(pa.array([t], pa.string()))
        p = float(L.log_probabilities(model.net, ids, around).sum())
        for w in plain_words(t):
            d = max(distinct[kind[w]], 1)
            p += np.log((n[w] or d) / (total[kind[w]] + d))
        out.append((len(ids), p))
    return out


def test_shares_of_a_kind_sum_to_one():
    n = np.array([5, 1, 1, 0])
    assert np.exp(L.word_log_shares(n, np.full(4, 7), np.full(4, 3))).sum() == pytest.approx(1)
    assert L.word_log_shares(np.array([0]), np.array([0]), np.array([0]))[0] == 0


def test_awkward_rows(spark):
    docs = nasty_docs(spark)
    model = L.fit(docs, rounds=1)
    out = L.score(docs, model, keep=["doc_id", "score", "n_words"]).toDF("doc_id", "score", "of_input", "n_words", "log_prob")
    assert out.count() == docs.count()
    given = docs.collect()
    want = [(r.doc_id, n, p) for r, (n, p) in zip(given, plain_scores([r.text for r in given], model, [r.text for r in given]))]
    got = rows_of(out, "doc_id", "n_words", "log_prob")
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-4, abs=1e-3)
    assert out.where("n_words = 0 and log_prob != 0").count() == 0 and len(nasty_texts()) > 10


def test_words_of_a_kind_are_told_apart_and_unseen_ones_have_a_share(spark):
    """Rare and frequent words of one kind score by their own counts; the vocabulary grows with the corpus."""
    corpus = [" ".join(prose(i, 400, 8000)) for i in range(30)] + ["often " * 500]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "doc_id long, text string").repartition(3)
    model = L.fit(docs)
    assert model.vocabulary.count() == len({w for t in corpus for w in plain_words(t)})
    fresh = ["often often", "never heard of these", corpus[3], None]
    new = spark.createDataFrame([(i, t) for i, t in enumerate(fresh)], "doc_id long, text string")
    got = rows_of(L.score(new, model), "doc_id", "n_words", "log_prob")
    for (i, n, p), (m, q) in zip(got, plain_scores(fresh, model, corpus), strict=True):
        assert n == m and p == pytest.approx(q, rel=1e-4, abs=1e-3), i


def test_fitted_scores_are_those_of_fit_and_score(spark):
    texts = [" ".join(prose(i, 60, 200)) for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    a, b = L.fitted_scores(docs), L.score(docs, L.fit(docs))
    for x, y in zip(rows_of(a, "doc_id", "n_words", "log_prob"), rows_of(b, "doc_id", "n_words", "log_prob"), strict=True):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=1e-5)


def test_empty(spark):
    fitted = L.fit(empty_docs(spark))
    assert np.isfinite(fitted.net.flat).all() and L.score(empty_docs(spark), fitted).count() == 0
