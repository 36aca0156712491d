"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives and unlabelled web texts are all that is learned from; a
text labelled as bad counts as unlabelled like any other. With class prior pi,
the risk is pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)]); where the second
part falls below 0, the step goes up its gradient instead (Kiryo et al., 2017).
g is a network of one hidden layer over features of the text's form.

The prior is estimated from the two samples: a first network tells positives
from unlabelled texts, and the least ratio of the unlabelled share above a score threshold
to the positives' share above it bounds pi (no set can hold relatively more
positives than all its unlabelled texts).

Training: bounded samples (``PER_SET`` positives and as many unlabelled texts,
by a hash of the id), features computed by executors, the numpy fit on the
driver. Scoring: one pass of independent tasks over every whole text.

Defined cases: null counts as empty, and an empty text has the features of one
(all 0) and a score; rows with a null id or label are no positives; with no
positives or no texts to learn from every score is 0; repeated rows are scored
alike; other columns pass through ``score``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import hash_sample, text_or_empty

#: Trusted positives, and unlabelled texts, to learn from, about.
PER_SET = 6000
HIDDEN = 16
STEPS = 3000
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10,),
            "stop": (46,), "comma": (44,), "loud": (33, 63), "link": (47, 58, 64), "bar": (124,), "other": (35, 36, 37, 38, 42, 43, 60, 61, 62, 92, 94, 95, 96, 126),
            "quote": (34, 39, 40, 41, 45, 91, 93, 123, 125, 59), "control": [*range(9), *range(11, 32), 127], "wide": range(128, 256)}
_SPANS = [np.array(list(x)) for x in _CLASSES.values()]
_LETTER = re.compile(r"[^\W\d_]")


def features(text: str) -> np.ndarray:
    """Shares of character classes, and lengths and repetition of words and lines."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    w, k = max(1, len(words)), max(1, len(lines))
    seen = Counter(words)
    top = max(seen.values(), default=0)
    letters = sum(v for x, v in seen.items() if _LETTER.search(x))
    shares = counts[counts > 0] / n
    return np.array([
        *[counts[s].sum() / n for s in _SPANS],
        np.log1p(len(words)), np.log1p(len(lines)), len(raw) / w / 10, len(seen) / w, np.log1p(w / max(1, len(seen))),
        top / w, sum(a == b for a, b in zip(words, words[1:])) / w, len(set(lines)) / k, w / k / 50, letters / w,
        -(shares * np.log(shares)).sum() if len(raw) else 0.0, min(max(map(len, seen), default=0), 200) / 20])


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    params: list[np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _run(self.params, np.clip((x - self.mean) / self.scale, -8, 8))[1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _run(params, x):
    a, b, c, d = params
    h = np.tanh(x @ a + b)
    return h, h @ c + d[0]


def risk_slope(g: np.ndarray, n: int, prior: float | None) -> np.ndarray:
    """Slope in the logits ``g`` (``n`` positives, then as many unlabelled) of the risk.

    The risk is prior * mean softplus(-g) of the positives plus the negatives' part,
    mean softplus(g) of the unlabelled less prior * that of the positives. Where that
    part is below zero, the step is back up it alone. Without a prior: the plain
    risk of positives against unlabelled.
    """
    up = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # d softplus(g)
    gp, gu = up[:n], up[n:]
    if prior is None:
        return np.concatenate((gp - 1, gu)) / n
    bad = np.logaddexp(0, g[n:]).mean() - prior * np.logaddexp(0, g[:n]).mean()
    rest = np.concatenate((-prior * gp, gu)) / n
    return np.concatenate((prior * (gp - 1), np.zeros(n))) / n + rest if bad >= 0 else -rest


def _descend(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int, seed: int, batch: int = 256) -> list[np.ndarray]:
    """Adam on the non-negative risk, or for no prior on the plain risk of positives against unlabelled."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 1 / np.sqrt(pos.shape[1]), (pos.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        xp, xu = pos[rng.integers(0, len(pos), batch)], unl[rng.integers(0, len(unl), batch)]
        x = np.concatenate((xp, xu))
        h, g = _run(params, x)
        dg = risk_slope(g, batch, prior)
        dh = dg[:, None] * params[2] * (1 - h * h)
        grads = [x.T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ dg + 1e-4 * params[2], np.array([dg.sum()])]
        rate = 0.01 * (1 - t / steps) + 1e-4
        for p, gr, a, b in zip(params, grads, m, v):
            a += 0.1 * (gr - a)
            b += 0.01 * (gr * gr - b)
            p -= rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.99 ** t)) + 1e-8)
    return params


def class_prior(pos_scores: np.ndarray, unl_scores: np.ndarray) -> float:
    """Least ratio of the shares above a threshold, less four standard errors, over thresholds at which part of the positives lie below.

    Above them the unlabelled texts are (almost) positives only. A prior that is
    a little too small costs the positives some certainty; one that is too large
    would hide the negatives, hence the lower bound.
    """
    cuts = np.quantile(pos_scores, np.linspace(0.1, 0.6, 51))
    p = np.array([(pos_scores >= c).mean() for c in cuts])
    u = np.array([max((unl_scores >= c).mean(), 1 / len(unl_scores)) for c in cuts])
    error = np.sqrt((1 - p) / (p * len(pos_scores)) + (1 - u) / (u * len(unl_scores)))
    return float(np.clip((u / p * (1 - 4 * error)).min(), 0.02, 0.98))


def fit(positives: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS, seed: int = 11) -> Network | None:
    """None where there is nothing to learn from."""
    if not len(positives) or not len(unlabelled):
        return None
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    pos, unl = (np.clip((x - mean) / scale, -8, 8) for x in (positives, unlabelled))
    rng = np.random.default_rng(seed)  # the prior is estimated on halves that the first network did not see
    a, b = rng.permutation(len(pos)), rng.permutation(len(unl))
    first = _descend(pos[a[::2]], unl[b[::2]], None, steps // 2, seed)
    prior = class_prior(_run(first, pos[a[1::2]])[1], _run(first, unl[b[1::2]])[1]) if len(pos) > 1 and len(unl) > 1 else 0.5
    return Network(mean, scale, _descend(pos, unl, prior, steps, seed + 1), prior)


def _features_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def form(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return form(text)


def train(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_set: int = PER_SET) -> Network | None:
    """``docs``: the texts that may be learned from; ``positives``: ids of trusted ones among them."""
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).where("id IS NOT NULL")
    trusted = positives.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    n_texts, n_trusted = texts.count(), trusted.count()
    unl = hash_sample(texts, "id", {1: n_texts}, F.lit(1), per_set).select("id", F.lit(0).alias("y"), _features_column(F.col("text")).alias("x"))
    chosen = hash_sample(trusted, "id", {1: n_trusted}, F.lit(1), per_set)
    # the ids are a bounded sample
    pos = texts.join(F.broadcast(chosen), "id").select("id", F.lit(1).alias("y"), _features_column(F.col("text")).alias("x"))
    # one row an id and set, so that a repeated id can't unbind the sample
    rows = unl.union(pos).groupBy("id", "y").agg(F.min("x").alias("x")).toPandas()
    rows["first"] = [tuple(x) for x in rows["x"]]
    rows = rows.sort_values(["y", "id", "first"])
    part = lambda y: np.array([np.asarray(x) for x in rows.loc[rows["y"] == y, "x"]])
    return fit(part(1), part(0))


def scoring(text: Column, model: Network | None) -> Column:
    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if model is None:
                yield pd.Series(np.zeros(len(texts)))
            else:
                yield pd.Series(model.scores(np.array([features(t) for t in texts])) if len(texts) else np.zeros(0))

    return quality(text)


def score(docs: DataFrame, model: Network | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score, 0 to 1; higher: good quality is likelier."""
    return docs.withColumn(out_col, scoring(text_or_empty(text_col), model))
