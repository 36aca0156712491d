"""Non-negative PU learning: the prior, held-out accuracy without negative labels, edge rows."""

import numpy as np
from pyspark.sql import functions as F

from vitrine.llm.common import crc_fold
from vitrine.llm.quality_pu import features, fit, risk_slope, score, train

SF = "/root/testdata/sf0.1"


def test_prior_and_separation():
    rng = np.random.default_rng(0)
    pos, unl = rng.normal(2, 1, (4000, 4)), np.concatenate((rng.normal(2, 1, (6000, 4)), rng.normal(-2, 1, (4000, 4))))
    net = fit(pos, unl)
    assert 0.45 < net.prior < 0.62
    assert (net.scores(rng.normal(2, 1, (500, 4))) >= 0.5).mean() > 0.95
    assert (net.scores(rng.normal(-2, 1, (500, 4))) < 0.5).mean() > 0.95
    assert fit(pos[:0], unl) is None and fit(pos, unl[:0]) is None


def test_slope_is_that_of_the_risk():
    """Difference quotients of the written-out risk, in both of its branches and without a prior."""
    rng = np.random.default_rng(1)
    soft = lambda x: np.logaddexp(0, x)
    below = lambda g, n, prior: soft(g[n:]).mean() - prior * soft(g[:n]).mean()
    seen = set()
    for unl_mean in (2.0, -6.0):
        for prior in (0.3, 0.9, None):
            n = 5
            g = np.concatenate((rng.normal(2, 1, n), rng.normal(unl_mean, 1, n)))
            if prior is None:
                risk = lambda g: soft(-g[:n]).mean() + soft(g[n:]).mean()
            elif below(g, n, prior) >= 0:
                risk = lambda g: prior * soft(-g[:n]).mean() + below(g, n, prior)
            else:
                risk = lambda g: -below(g, n, prior)
            seen.add(prior and below(g, n, prior) >= 0)
            want = [(risk(g + d) - risk(g - d)) / 2e-6 for d in np.eye(2 * n) * 1e-6]
            assert np.allclose(risk_slope(g, n, prior), want, atol=1e-6)
    assert seen == {None, True, False}


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learn = crc_fold("doc_id", 5) != 0
    model = train(docs.where(learn), labels.where(learn & (F.col("quality") == 1)))
    rows = score(docs.join(labels, "doc_id").where(~learn), model).select("quality", "score").toPandas()
    hit = rows["score"] >= 0.3
    assert hit[rows["quality"] == 1].mean() > 0.97
    assert hit[rows["quality"] == 0].mean() < 0.15


def test_edge_rows(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in [(1, "A fine text, of words."), (1, "A fine text, of words."), (2, None), (3, ""), (None, "a b c"),
                                                         (4, "!!" * 100_000), (5, "one line\n" * 5000), (6, "Ein Satz.")]], "doc_id long, text string, x int")
    good = spark.createDataFrame([(1,), (6,), (None,), (77,)], "doc_id long")
    out = score(docs, train(docs, good))
    assert out.columns == ["doc_id", "text", "x", "score"]
    assert all(0 <= r["score"] <= 1 for r in out.collect()) and out.count() == 8
    assert {r["score"] for r in score(docs, train(docs, good.limit(0))).collect()} == {0.0}
    assert score(docs.limit(0), train(docs.limit(0), good)).count() == 0
    assert np.isfinite(features("")).all() and len(features("")) == len(features("é\n\n|"))
