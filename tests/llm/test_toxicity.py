"""Factorization machine: its algebra, an interaction that weights alone can't learn, held-out accuracy, edge rows."""

import numpy as np
from pyspark.sql import functions as F

from vitrine.llm.common import crc_fold
from vitrine.llm.toxicity_fm import FactorizationMachine, fit, score, train

SF = "/root/testdata/sf0.1"


def test_pair_sum_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    fm = FactorizationMachine(0.3, np.arange(20) * 7, rng.normal(size=20), rng.normal(size=(20, 4)))
    texts = [rng.choice(20, n, replace=False) * 7 for n in (0, 1, 5, 12)] + [np.array([3, 7])]
    for t, got in zip(texts, fm.scores(texts)):
        at = [int(x) // 7 for x in t if x % 7 == 0]
        z = fm.bias + sum(fm.weights[i] for i in at) + sum(fm.factors[i] @ fm.factors[j] for k, i in enumerate(at) for j in at[:k])
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_learns_a_pair():
    """Label 1 only where both of two terms stand together: no sum of single weights tells that apart from noise."""
    rng = np.random.default_rng(1)
    terms, labels = [], []
    for _ in range(1200):
        noise = rng.choice(np.arange(10, 60), 6, replace=False)
        a, b = rng.random(2) < 0.5
        terms.append(np.unique(np.concatenate((noise, [1] * int(a), [2] * int(b))).astype(np.int64)))
        labels.append(float(a == b))  # an exclusive or
    labels = np.array(labels)
    fm = fit(terms[:900], labels[:900], epochs=60)
    got = fm.scores(terms[900:]) >= 0.5
    assert (got == labels[900:]).mean() > 0.95


def test_learns_a_pair_among_thousands_of_words():
    """Half of the texts are decided by strong words, half by an exclusive or of two plain ones, beside 5,000 noise words."""
    rng = np.random.default_rng(3)
    terms, labels, plain = [], [], []
    for i in range(5000):
        noise = rng.choice(np.arange(100, 5100), 30, replace=False)
        a, b = rng.random(2) < 0.5
        if i % 2:
            y, own = rng.random() < 0.5, []
            own = rng.choice(np.arange(10, 30) + (30 if y else 0), 3, replace=False)
        else:
            y, own = a == b, np.array([1] * int(a) + [2] * int(b), np.int64)
        terms.append(np.unique(np.concatenate((noise, own)).astype(np.int64)))
        labels.append(float(y))
        plain.append(i % 2 == 0)
    labels, plain = np.array(labels), np.array(plain)
    fm = fit(terms[:4000], labels[:4000])
    assert {1, 2} <= set(fm.buckets.tolist()) and len(fm.buckets) < 200
    right = (fm.scores(terms[4000:]) >= 0.5) == labels[4000:]
    assert right[plain[4000:]].mean() >= 0.95 and right[~plain[4000:]].mean() >= 0.95


def test_fits_any_number_of_texts():
    """Whatever is left for the last mini-batch, and whether its texts hold known words or none."""
    words = np.array([5, 9], np.int64)
    for n in range(1, 301):
        terms = [words if i < 20 else np.zeros(0, np.int64) for i in range(n)]
        for labels in (np.arange(n) < 10, np.ones(n, bool), np.zeros(n, bool)):
            fm = fit(terms, labels.astype(float), epochs=2)
            got = fm.scores([words, np.zeros(0, np.int64), np.array([77], np.int64)])
            assert np.isfinite(got).all() and got[1] == got[2]


def test_gradient_is_that_of_the_loss():
    """One small step along each parameter changes the loss as the forward sums say."""
    from vitrine.llm.toxicity_fm import _forward, _sigmoid

    rng = np.random.default_rng(4)
    row, at = np.array([0, 0, 0, 1, 1]), np.array([0, 1, 2, 1, 2])
    w, v, y = rng.normal(size=3), rng.normal(size=(3, 2)), np.array([1.0, 0.0])
    loss = lambda w, v: float((lambda z: -(y * np.log(_sigmoid(z)) + (1 - y) * np.log(1 - _sigmoid(z))).sum())(_forward(row, at, 2, w, v)[0]))
    logit, sums = _forward(row, at, 2, w, v)
    err = (_sigmoid(logit) - y)[row]
    dv = np.stack([np.bincount(at, weights=err * sums[row, f]) for f in range(2)], axis=1) - np.bincount(at, weights=err)[:, None] * v
    dw = np.bincount(at, weights=err)
    for i in range(3):
        step = np.zeros(3)
        step[i] = 1e-6
        assert abs((loss(w + step, v) - loss(w - step, v)) / 2e-6 - dw[i]) < 1e-5
        for f in range(2):
            move = np.zeros((3, 2))
            move[i, f] = 1e-6
            assert abs((loss(w, v + move) - loss(w, v - move)) / 2e-6 - dv[i, f]) < 1e-5


def test_a_hot_id_does_not_unbind_the_sample(spark):
    docs = spark.createDataFrame([(1, f"word {i}") for i in range(300)] + [(2, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    model = train(docs, labels)
    assert len(model.buckets) == 0 and score(docs, model).count() == 301


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = train(docs, labels.where(crc_fold("doc_id", 3) != 1))
    rows = score(docs.join(labels, "doc_id").where(crc_fold("doc_id", 3) == 1), model).select("toxic", "score").toPandas()
    hit = rows["score"] >= 0.7
    assert hit[rows["toxic"] == 1].mean() > 0.75  # the small table has few labelled texts of three languages
    assert hit[rows["toxic"] == 0].mean() < 0.005


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot", 5), (1, "you idiot", 5), (2, None, 5), (3, "", 5), (None, "fine", 5), (4, "x " * 100_000, 5)], "doc_id long, text string, terms int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    out = score(docs, train(docs, labels))
    assert out.columns == ["doc_id", "text", "terms", "score"]
    assert all(0 <= r["score"] <= 1 for r in out.collect()) and out.count() == 6
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert {r["score"] for r in score(docs, train(docs, some)).collect()}.pop() < 0.01
    assert score(docs.limit(0), train(docs.limit(0), labels)).count() == 0
    assert [r["s"] for r in docs.limit(0).agg(F.count(F.lit(1)).alias("s")).collect()] == [0]
