"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed lower-cased words. The score is
sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over the terms it holds: the
factors v learn what a pair of terms adds (an insult together with a group
mention) beyond what each adds alone. The pair sum costs one pass, as
(|sum v_i|^2 - sum |v_i|^2) / 2.

Training: a bounded sample of labelled rows (``PER_LABEL`` of each label, by a
hash of the id, so the sample does not grow with the table); the terms of the
sample are hashed on the executors and the numpy fit runs on the driver over
that bounded sample. Of the terms in ``MIN_DOCS`` sampled texts or more it takes
those whose share of label 1 is not by chance (``EVIDENCE``), and both terms of
pairs whose share is not what the two terms' own shares add up to
(``PAIR_EVIDENCE``, among the ``PAIR_TERMS`` most common): two words that say
nothing alone may say much together. ``MOST_TERMS`` at most are taken. Scoring is
one pass of independent tasks over every whole text.

Defined cases: null and empty texts are scored by the bias alone, as are texts
without a known term; rows whose label or id is null are not learned from, an id
that repeats (in either table) is learned from once, by its least label and terms,
so the sample stays bounded; without any positive or any negative label the score is the share
of positives (0 with no labels at all); other columns pass through ``score``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import hash_sample, text_or_empty

BUCKETS = 1 << 20
FACTORS = 8
#: Labelled rows of each label to learn from, about.
PER_LABEL = 3000
#: Sampled texts that a term must occur in.
MIN_DOCS = 3
#: Texts times divergence of a term's share of label 1 from the sample's, in nats: a chance of about one in 1,000.
EVIDENCE = 7.0
#: The same for a pair's share against what its terms' shares add up to: by chance in none of the pairs of PAIR_TERMS terms.
PAIR_EVIDENCE = 24.0
PAIR_TERMS = 4096
MOST_TERMS = 8192
EPOCHS = 30
#: Words that a task remembers the bucket of before it starts afresh.
MEMO_WORDS = 300_000
_WORD = re.compile(r"\w+")


@dataclass
class FactorizationMachine:
    """Bias, the buckets known (sorted), their weights and factors."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, terms: list[np.ndarray]) -> np.ndarray:
        """Scores of texts given as arrays of distinct buckets."""
        if not len(self.buckets):
            return np.full(len(terms), _sigmoid(self.bias))
        sizes = np.fromiter(map(len, terms), np.int64, len(terms))
        flat = np.concatenate(terms) if len(terms) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.buckets, flat), len(self.buckets) - 1)
        known = self.buckets[at] == flat
        row = np.repeat(np.arange(len(terms)), sizes)[known]
        at = at[known]
        return _sigmoid(self.bias + _forward(row, at, len(terms), self.weights, self.factors)[0])


def _evidence(ones: np.ndarray, counts: np.ndarray, share: float) -> np.ndarray:
    p = ones / counts
    with np.errstate(divide="ignore", invalid="ignore"):
        one, zero = p * np.log(p / share), (1 - p) * np.log((1 - p) / (1 - share))
    return counts * (np.nan_to_num(one) + np.nan_to_num(zero))


def _pair_evidence(rows: list[np.ndarray], labels: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The strongest evidence of a pair that each term is part of.

    ``rows`` are the texts as places of the terms, whose label-1 and all texts are
    ``ones`` and ``counts``. A pair is expected to have the log-odds that its terms
    add to those of all texts; the evidence is the texts that hold both times the
    divergence of their share from that.
    """
    n, m = len(rows), len(counts)
    share = labels.mean()
    odds = lambda p: np.log(p / (1 - p))
    own = odds((ones + share) / (counts + 1)) - odds(share)
    held = np.zeros((n, m), np.float32)
    held[np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows)] = 1
    toxic = held[labels == 1]
    best = np.zeros(m)
    for lo in range(0, m, 512):  # a stretch of terms against all
        both, with_one = ((x[:, lo:lo + 512].T @ x).astype(np.float64) for x in (held, toxic))
        expected = _sigmoid(own[lo:lo + 512, None] + own + odds(share))
        p = np.clip(with_one / np.maximum(both, 1), 1e-9, 1 - 1e-9)
        found = both * (p * np.log(p / expected) + (1 - p) * np.log((1 - p) / (1 - expected)))
        found[np.arange(found.shape[0]), lo + np.arange(found.shape[0])] = 0
        best[lo:lo + 512] = found.max(axis=1)
    return best


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(row: np.ndarray, at: np.ndarray, n: int, w: np.ndarray, v: np.ndarray):
    """Logits without bias, and the factor sums, of ``n`` texts given as (row, term) pairs sorted by row."""
    linear = np.bincount(row, weights=w[at], minlength=n)
    sums = np.stack([np.bincount(row, weights=v[at, f], minlength=n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(row, weights=(v * v).sum(axis=1)[at], minlength=n)
    return linear + ((sums * sums).sum(axis=1) - squares) / 2, sums


def fit(terms: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS,
        min_docs: int = MIN_DOCS, rate: float = 0.05, decay: float = 2e-4, seed: int = 7) -> FactorizationMachine:
    """Logistic loss, mini-batches, Adagrad; classes weigh alike."""
    n, positives = len(terms), int(labels.sum()) if len(labels) else 0
    empty = np.zeros(0, np.int64)
    if positives in (0, n):
        share = positives / n if n else 0.0
        return FactorizationMachine(float(np.log((share + 1e-9) / (1 - share + 1e-9))), empty, np.zeros(0), np.zeros((0, factors)))
    buckets, of, counts = np.unique(np.concatenate(terms), return_inverse=True, return_counts=True)
    ones = np.bincount(of, weights=np.repeat(labels, [len(t) for t in terms]))
    weight = _evidence(ones, counts, positives / n) / EVIDENCE
    weight[counts < min_docs] = -1
    common = np.sort(np.argsort(-np.where(counts < min_docs, -1, counts), kind="stable")[:PAIR_TERMS])
    common = common[counts[common] >= min_docs]
    if len(common):
        place = np.full(len(buckets), -1)
        place[common] = np.arange(len(common))
        held = [x[x >= 0] for x in np.split(place[of], np.cumsum([len(t) for t in terms])[:-1])]
        weight[common] = np.maximum(weight[common], _pair_evidence(held, labels, ones[common], counts[common]) / PAIR_EVIDENCE)
    ranked = np.argsort(-weight, kind="stable")[:MOST_TERMS]
    buckets = np.sort(buckets[ranked[weight[ranked] >= 1]])
    if not len(buckets):
        return FactorizationMachine(float(np.log(positives / (n - positives))), empty, np.zeros(0), np.zeros((0, factors)))
    rows = []
    for t in terms:
        at = np.minimum(np.searchsorted(buckets, t), len(buckets) - 1)
        rows.append(at[buckets[at] == t])
    rng = np.random.default_rng(seed)
    bias, w, v = 0.0, np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), factors))
    gb, gw, gv = 1e-6, np.full(len(buckets), 1e-6), np.full(v.shape, 1e-6)
    cost = np.where(labels == 1, n / (2 * positives), n / (2 * (n - positives)))
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 128):
            pick = order[lo:lo + 128]
            sizes = np.array([len(rows[i]) for i in pick])
            row, at = np.repeat(np.arange(len(pick)), sizes), np.concatenate([rows[i] for i in pick])
            logit, sums = _forward(row, at, len(pick), w, v)
            err = cost[pick] * (_sigmoid(bias + logit) - labels[pick])
            g = err.sum()
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            if not len(at):  # no text of the batch holds a known term
                continue
            used, back = np.unique(at, return_inverse=True)
            e = err[row]
            dw = np.bincount(back, weights=e) + decay * len(pick) * w[used]
            gw[used] += dw * dw
            w[used] -= rate * dw / np.sqrt(gw[used])
            dv = np.stack([np.bincount(back, weights=e * sums[row, f]) for f in range(factors)], axis=1)
            dv -= np.bincount(back, weights=e)[:, None] * v[used] - decay * len(pick) * v[used]
            gv[used] += dv * dv
            v[used] -= rate * dv / np.sqrt(gv[used])
    return FactorizationMachine(float(bias), buckets, w, v)


class Terms:
    """The distinct hashed words of texts."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = set(_WORD.findall((text or "").lower()))
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS
        return np.unique(np.fromiter((memo[w] for w in words), np.int64, len(words)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", per_label: int = PER_LABEL) -> FactorizationMachine:
    """Learn from the rows of ``labels`` (already restricted to those that may be learned from)."""
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    counts = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = hash_sample(named, "id", counts, F.col("y"), per_label)

    @F.pandas_udf("array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms()
        for texts in batches:
            yield pd.Series([terms(t) for t in texts])

    # the sample's ids are bounded, the texts are not: those stay where they are
    rows = (docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "id")
            .select("id", "y", hashed("text").alias("terms")).groupBy("id").agg(F.min(F.struct("y", "terms")).alias("row"))
            .select("id", "row.y", "row.terms").toPandas())
    rows["first"] = [int(t[0]) if len(t) else -1 for t in rows["terms"]]
    rows = rows.sort_values(["id", "first"], kind="stable")  # the fit is the same whatever order rows arrive in
    return fit([np.asarray(t, np.int64) for t in rows["terms"]], rows["y"].to_numpy(np.float64))


def scoring(text: Column, model: FactorizationMachine) -> Column:
    """The score of a text column; the model's size is bounded by the sample it was fitted on."""

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms()
        for texts in batches:
            out = [model.scores([terms(t) for t in texts[i:i + 1000]]) for i in range(0, len(texts), 1000)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return toxicity(text)


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score, 0 to 1; higher: label 1 is likelier."""
    return docs.withColumn(out_col, scoring(text_or_empty(text_col), model))
