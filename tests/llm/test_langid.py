"""Bidirectional network: gradients by differences, windows, held-out accuracy, edge rows."""

import numpy as np

from vitrine.llm.common import crc_fold
from vitrine.llm.langid_bigru import WINDOW, BiGru, _gradients, predict, predict_texts, train, windows_of

SF = "/root/testdata/sf0.1"


def random_params(rng, hidden=4, langs=3):
    shapes = [(3 * hidden, 256), (3 * hidden, hidden)] * 2 + [(langs, hidden), (langs, hidden), (langs,)]
    return [rng.normal(0, 0.5, s) for s in shapes]


def slow_probabilities(params, raw, hidden):
    sig = lambda x: 1 / (1 + np.exp(-x))
    states = []
    for d in (0, 1):
        h, hs = np.zeros(hidden), {}
        for t in range(len(raw)) if d == 0 else reversed(range(len(raw))):
            a, r = params[2 * d][:, raw[t]], params[2 * d + 1] @ h
            z, s = sig((a + r)[:hidden]), sig((a + r)[hidden:2 * hidden])
            h = (1 - z) * np.tanh(a[2 * hidden:] + s * r[2 * hidden:]) + z * h
            hs[t] = h
        states.append(hs)
    out = []
    for t in range(len(raw)):
        y = params[4] @ states[0][t] + params[5] @ states[1][t] + params[6]
        out.append(np.exp(y) / np.exp(y).sum())
    return np.array(out)


def test_forward_pass_and_pooling():
    rng = np.random.default_rng(0)
    params = random_params(rng)
    model = BiGru(["a", "b", "c"], [params[0].astype("f4"), params[2].astype("f4")], [params[1].astype("f4"), params[3].astype("f4")],
                  [params[4].astype("f4"), params[5].astype("f4")], params[6].astype("f4"))
    texts = ["x", "short text", "long " * 200, "y" * WINDOW, "z" * (WINDOW + 1), "", None, "123", "ß"]
    langs, scores = predict_texts(model, texts)
    for t, lang, s in zip(texts, langs, scores):
        if not t or t == "123":
            assert (lang, s) == ("und", 0.0)
            continue
        raw = t.encode()
        p = np.concatenate([slow_probabilities(params, raw[k:k + WINDOW], 4) for k in range(0, len(raw), WINDOW)]).mean(axis=0)
        assert lang == "abc"[p.argmax()] and abs(s - p.max()) < 1e-4


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    params = random_params(rng)
    flat, lengths, _ = windows_of([b"hello there", b"abc", "größe".encode()], 16)
    labels = np.array([0, 2, 1])

    def loss():
        total = sum(-np.log(slow_probabilities(params, flat[k][:n], 4)[:, y]).sum() for k, (n, y) in enumerate(zip(lengths, labels)))
        return total / lengths.sum()

    grads = _gradients(params, flat.T, lengths, labels, 4)
    for k, p in enumerate(params):
        spots = np.argwhere(np.abs(grads[k]) > 0) if k in (0, 2) else np.argwhere(np.ones(p.shape))
        for at in spots[:: max(1, len(spots) // 6)]:
            at, old = tuple(at), p[tuple(at)]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs.where(crc_fold("doc_id", 3) != 1))
    rows = predict(docs.where(crc_fold("doc_id", 3) == 1), model).select("lang", "lang_pred").toPandas()
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.97


def test_edge_rows(spark):
    rows = [(1, "the and of", "en"), (2, "der die das", "de"), (2, "der die das", "de"), (3, None, "fr"), (4, "", None), (None, "le la", "fr"), (5, "12 !?", "en"), (6, "x" * 300_000, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    out = predict(docs, train(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in predict(docs, train(docs.limit(0))).collect()} == {"und"}
    assert predict(docs.limit(0), None).count() == 0


def test_letters_are_those_of_unicode():
    from vitrine.llm.langid_bigru import has_letter

    assert [has_letter(x) for x in ("½", "²", "Ⅷ", "1_2", "", "٣", "é", "日", "ª", "ǅ", "-a-")] == [False] * 6 + [True] * 5
