"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers, one from each end, read the bytes of a text; at
every byte the two states give a softmax over the languages, and a text's
probabilities are the mean over all its bytes. Whole texts are read, as
consecutive windows of ``WINDOW`` bytes whose states start at zero, so that all
windows of a batch advance together in numpy and the length of a text bounds
neither memory nor the number of steps.

Training: backpropagation through time in numpy on the driver, over a bounded
sample: ``PER_LANG`` texts of each language by a hash of the id, at most
``WINDOWS`` windows of each (cut on the executors; the first of them at the
text's start, the rest spread evenly over it). Prediction: independent tasks.

Defined cases: a text that is null, empty or without a letter is ``und`` with
score 0; rows without language or id teach nothing; without any language to
learn every text is ``und``; repeated rows are predicted alike; other columns
pass through ``predict``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import hash_sample, text_or_empty

UNKNOWN = "und"
HIDDEN = 8
WINDOW = 128
#: Texts of each language to learn from, about, and windows of each text at most.
PER_LANG = 800
WINDOWS = 4
STEPS = 500
BATCH = 128
#: Windows that advance together in prediction.
TOGETHER = 2048
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether a character of Unicode category L is in the text."""
    return bool(_ASCII_LETTER.search(text)) or any(unicodedata.category(c)[0] == "L" for c in text)


@dataclass
class BiGru:
    """Per direction: input table (3H, 256) of gates update, reset, new; recurrent weights (3H, H). Output (C, H) each, bias (C,)."""

    langs: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    outputs: list[np.ndarray]
    bias: np.ndarray

    def probabilities(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of byte-wise language probabilities of each window; (n, WINDOW) bytes in, only ``lengths`` of each are read."""
        n, width = windows.shape
        out = np.zeros((len(self.langs), n), np.float32)
        if not n:
            return out
        steps = int(lengths.max())
        by_step = np.ascontiguousarray(windows.T)
        mask = np.arange(width)[:, None] < lengths[None, :]
        full = mask.all(axis=1)
        half = len(self.recurrent[0][0])
        halves = np.ones((3 * half, 1), np.float32)
        halves[:2 * half] = 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2: one tanh for both gates
        tables = [t * halves for t in self.tables]
        weights = [u * halves for u in self.recurrent]
        forward = np.empty((steps, len(self.langs), n), np.float32)
        for direction in (0, 1):
            h = np.zeros((half, n), np.float32)
            for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
                a = tables[direction].take(by_step[t], axis=1)
                r = weights[direction] @ h
                gates = np.tanh(a[:2 * half] + r[:2 * half])
                gates *= 0.5
                gates += 0.5
                new = gates[half:]
                new *= r[2 * half:]
                new += a[2 * half:]
                np.tanh(new, out=new)
                h -= new
                h *= gates[:half]
                h += new
                if not full[t]:
                    h *= mask[t]
                y = self.outputs[direction] @ h
                if direction == 0:
                    forward[t] = y
                else:
                    y += forward[t]
                    y += self.bias[:, None]
                    np.clip(y, -40, 40, out=y)
                    np.exp(y, out=y)
                    y /= y.sum(axis=0)
                    if not full[t]:
                        y *= mask[t]
                    out += y
        return out


def fit(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = HIDDEN,
        steps: int = STEPS, seed: int = 3) -> BiGru:
    """Cross-entropy at every byte, Adam, gradients by backpropagation through time."""
    rng = np.random.default_rng(seed)
    n_lang = len(langs)
    params = []
    for _ in (0, 1):
        params += [rng.normal(0, 0.3, (3 * hidden, 256)), rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))]
    params += [rng.normal(0, 0.3, (n_lang, hidden)), rng.normal(0, 0.3, (n_lang, hidden)), np.zeros(n_lang)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    counts = np.bincount(labels, minlength=n_lang)
    chance = (1 / np.maximum(counts, 1))[labels]
    chance /= chance.sum()
    for step in range(1, steps + 1):
        pick = rng.choice(len(labels), BATCH, p=chance)
        grads = _gradients(params, windows[pick].T, lengths[pick], labels[pick], hidden)
        norm = np.sqrt(sum((g * g).sum() for g in grads))
        rate = 0.02 * (1 - step / steps) + 1e-4
        for p, g, a, b in zip(params, grads, m, v):
            g = g / max(1.0, norm)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)
    p = [x.astype(np.float32) for x in params]
    return BiGru(langs, [p[0], p[2]], [p[1], p[3]], [p[4], p[5]], p[6])


def _sigmoid(x):
    return np.tanh(x / 2) / 2 + 0.5


def _gradients(params: list[np.ndarray], x: np.ndarray, lengths: np.ndarray, labels: np.ndarray, hidden: int) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy over the bytes of a batch; ``x``: (time, batch) bytes."""
    steps, n = int(lengths.max()), x.shape[1]
    mask = (np.arange(steps)[:, None] < lengths[None, :]).astype(float)
    states, kept = [], []
    for d in (0, 1):
        table, u = params[2 * d], params[2 * d + 1]
        h, hs, gates = np.zeros((hidden, n)), [None] * steps, [None] * steps
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a, r = table[:, x[t]], u @ h
            z, s = _sigmoid(a[:hidden] + r[:hidden]), _sigmoid(a[hidden:2 * hidden] + r[hidden:2 * hidden])
            new = np.tanh(a[2 * hidden:] + s * r[2 * hidden:])
            gates[t] = (h, z, s, new, r[2 * hidden:])
            h = ((1 - z) * new + z * h) * mask[t]
            hs[t] = h
        states.append(hs)
        kept.append(gates)
    grads = [np.zeros_like(p) for p in params]
    total = mask.sum()
    back = [[None] * steps, [None] * steps]
    for t in range(steps):
        y = params[4] @ states[0][t] + params[5] @ states[1][t] + params[6][:, None]
        y = np.exp(y - y.max(axis=0))
        y /= y.sum(axis=0)
        y[labels, np.arange(n)] -= 1
        y *= mask[t] / total
        grads[4] += y @ states[0][t].T
        grads[5] += y @ states[1][t].T
        grads[6] += y.sum(axis=1)
        back[0][t], back[1][t] = params[4].T @ y, params[5].T @ y
    for d in (0, 1):
        u, gt, gu = params[2 * d + 1], grads[2 * d], grads[2 * d + 1]
        dh = np.zeros((hidden, n))
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            h, z, s, new, un = kept[d][t]
            dh = (dh + back[d][t]) * mask[t]
            dn = dh * (1 - z) * (1 - new * new)
            da = np.concatenate((dh * (h - new) * z * (1 - z), dn * un * s * (1 - s), dn))
            dr = np.concatenate((da[:2 * hidden], dn * s))
            np.add.at(gt.T, x[t], da.T)
            gu += dr @ h.T
            dh = dh * z + u.T @ dr
    return grads


def windows_of(texts: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of all texts: (n, width) bytes, length of each, index of its text."""
    counts = np.array([-(-len(b) // width) for b in texts], np.int64)
    flat = np.frombuffer(b"".join(b + b"\0" * (-len(b) % width) for b in texts), np.uint8).reshape(-1, width)
    owner = np.repeat(np.arange(len(texts)), counts)
    lengths = np.full(len(flat), width, np.int64)
    last = np.cumsum(counts) - 1
    some = counts > 0
    lengths[last[some]] = [(len(b) - 1) % width + 1 for b in texts if b]
    return flat, lengths, owner


def predict_texts(model: BiGru, texts: list[str]) -> tuple[list[str], list[float]]:
    raw = [(t or "").encode("utf-8", "replace") if t and has_letter(t) else b"" for t in texts]
    sums = np.zeros((len(texts), len(model.langs)))
    group, size = [], 0

    def run() -> None:
        flat, lengths, owner = windows_of([raw[i] for i in group])
        part = np.zeros((len(group), len(model.langs)))
        for lo in range(0, len(flat), TOGETHER):
            np.add.at(part, owner[lo:lo + TOGETHER], model.probabilities(flat[lo:lo + TOGETHER], lengths[lo:lo + TOGETHER]).T)
        sums[group] = part

    for i, b in enumerate(raw):
        if b:
            group.append(i)
            size += len(b)
            if size >= 8 * TOGETHER * WINDOW:
                run()
                group, size = [], 0
    if group:
        run()
    best = sums.argmax(axis=1)
    sizes = np.array([max(1, len(b)) for b in raw])
    score = np.clip(sums[np.arange(len(texts)), best] / sizes, 0, 1)
    return [model.langs[k] if b else UNKNOWN for k, b in zip(best.tolist(), raw)], score.tolist()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> BiGru | None:
    """``docs``: the rows that may be learned from."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id IS NOT NULL AND lang IS NOT NULL AND text != ''")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        def some(text: str) -> list[bytes]:
            raw = text.encode("utf-8", "replace")
            n = -(-len(raw) // WINDOW)
            picks = sorted({k * (n - 1) // max(1, WINDOWS - 1) for k in range(WINDOWS)}) if n > WINDOWS else range(n)
            return [raw[k * WINDOW:(k + 1) * WINDOW] for k in picks]

        return pd.Series([some(t) for t in texts])

    found = hash_sample(rows, "id", counts, F.col("lang"), per_lang)
    # one text an id, so that a repeated id can't unbind the sample
    found = found.select("id", "lang", cut("text").alias("cut")).groupBy("id").agg(F.min(F.struct("lang", "cut")).alias("row"))
    found = found.select("id", "row.lang", F.explode("row.cut").alias("raw")).toPandas()
    if not len(found):
        return None
    found["raw"] = [bytes(b) for b in found["raw"]]
    found = found.sort_values(["lang", "id", "raw"])
    langs = sorted(found["lang"].unique())
    flat, lengths, owner = windows_of(found["raw"].tolist())
    labels = found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()[owner]
    return fit(flat, lengths, labels, langs)


def predict(docs: DataFrame, model: BiGru | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its pooled probability."""

    @F.pandas_udf("lang string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            if model is None:
                yield pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)})
            else:
                langs, scores = predict_texts(model, texts.tolist())
                yield pd.DataFrame({"lang": langs, "score": scores})

    return (docs.withColumn("__lang", language(text_or_empty(text_col)))
            .withColumn(lang_out, F.col("__lang.lang")).withColumn(score_out, F.col("__lang.score")).drop("__lang"))
