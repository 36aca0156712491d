"""Benchmark decontamination: BM25 index of the test items, block-max WAND, overlap check.

Items are documents of the index; every passage of every training text is a
query. A text's passages are windows of 2 L words, L apart, where L is the
longest item of the index (64 at least), so any run of L words lies whole in a
passage. An impact is the BM25 weight of a term in an item, as a share of the
item's weight for itself, so a score is 1 for the whole item and ``MIN_SCORE``
means the same for every item. All items at or above it are retrieved:

1. Terms whose impacts add up to less than half the threshold in every item
   (the frequent ones) can't carry an item alone. The other terms' block maxima
   are added per (passage, block of items), for all passages of a batch at
   once; a block whose bound stays below the threshold holds no result. That is
   the first test of block-max WAND, for all blocks together.
2. Passages with a block left run block-max WAND: cursors over the posting
   lists, a pivot by list maxima, block maxima before anything is scored.

A retrieved item counts when its question and its answer are both in the
passage: ``MIN_OVERLAP`` of the five-word shingles of each part (a part of
fewer than five words: its words in sequence). The question ends at the last
question mark that text follows, else at the last sentence end that text
follows, else a quarter of the words (one at least) is the answer.

Scale: document frequencies and lengths are Spark aggregates over all items;
the index goes to the tasks in shards of at most ``SHARD_CHARS`` characters of
items (their sum is checked first), one pass over the texts for each. Texts are
never shuffled, and tasks are independent.

Defined cases: a null or empty text has no passage; items that are null or have
no word are left out; a one-word item is all answer; a repeated item row counts
once, equal texts under different ids are all reported; repeated text rows are each
reported; with no items nothing is found; other columns pass through
``clean``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import text_or_empty, written

K1, B = 1.2, 0.75
MIN_SCORE = 0.5
MIN_OVERLAP = 0.8
SHINGLE = 5
#: Items that share a bound in step 1; postings that share one in step 2.
BLOCK_ITEMS = 2
BLOCK_POSTINGS = 16
SHORTEST_WINDOW = 64
SHARD_CHARS = 16_000_000
_WORD = re.compile(r"\w+")
_QUESTION = re.compile(r"\?(?=\s*\w)")
_SENTENCE = re.compile(r"[.!?](?=\s+\w)")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    for mark in (_QUESTION, _SENTENCE):
        ends = [m.end() for m in mark.finditer(text)]
        for end in reversed(ends):
            q, a = words_of(text[:end]), words_of(text[end:])
            if q and a:
                return q, a
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    size = min(SHINGLE, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the part's shingles that the passage holds; an empty part is held."""
    if not part:
        return 1.0
    size = min(SHINGLE, len(part))
    want = _shingles(part)
    have = {tuple(passage[i:i + size]) for i in range(len(passage) - size + 1)}
    return len(want & have) / len(want)


@dataclass
class Index:
    """Posting lists by term, their blocks, and what step 1 needs."""

    # lists, not arrays: block-max WAND reads them one by one
    term_ids: dict[str, int]
    starts: list[int]  # of each term's postings
    items: list[int]
    impacts: list[float]
    maxima: list[float]  # of each term
    block_starts: list[int]  # of each term's blocks of BLOCK_POSTINGS
    block_maxima: list[float]
    block_last: list[int]  # item
    heavy: dict[str, int]  # terms that step 1 adds up
    heavy_starts: np.ndarray
    heavy_blocks: np.ndarray
    heavy_maxima: np.ndarray
    rest: np.ndarray  # of each block of items: what the other terms may add
    ids: list
    parts: list[tuple[list[str], list[str]]]
    window: int

    @staticmethod
    def build(rows: list[tuple], doc_freq: dict[str, int], n_items: int, mean_words: float, min_score: float) -> "Index":
        """``rows``: (item id, text), each with a word at least."""
        term_ids: dict[str, int] = {}
        lists: list[list[tuple[int, float]]] = []
        longest = SHORTEST_WINDOW
        ids, parts = [], []
        for k, (item_id, text) in enumerate(rows):
            words = words_of(text)
            longest = max(longest, len(words))
            ids.append(item_id)
            parts.append(question_and_answer(text))
            tf: dict[str, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            weight = {w: math.log(1 + (n_items - doc_freq[w] + 0.5) / (doc_freq[w] + 0.5)) * n * (K1 + 1)
                      / (n + K1 * (1 - B + B * len(words) / mean_words)) for w, n in tf.items()}
            whole = sum(weight.values())
            for w, x in weight.items():
                t = term_ids.setdefault(w, len(lists))
                if t == len(lists):
                    lists.append([])
                lists[t].append((k, x / whole))
        starts = np.cumsum([0] + [len(x) for x in lists])
        items = np.array([k for x in lists for k, _ in x], np.int64)
        impacts = np.array([x for y in lists for _, x in y])
        maxima = np.array([max(x for _, x in y) for y in lists])
        light = np.zeros(len(rows))
        heavy: dict[str, int] = {}
        blocks: list[dict[int, float]] = []
        for w, t in sorted(term_ids.items(), key=lambda x: (-doc_freq[x[0]], x[0])):
            at = slice(starts[t], starts[t + 1])
            if (light[items[at]] + impacts[at] < min_score / 2).all():
                light[items[at]] += impacts[at]
                continue
            heavy[w] = len(blocks)
            most: dict[int, float] = {}
            for k, x in lists[t]:
                most[k // BLOCK_ITEMS] = max(x, most.get(k // BLOCK_ITEMS, 0.0))
            blocks.append(most)
        rest = np.zeros(len(rows) // BLOCK_ITEMS + 1)
        np.maximum.at(rest, np.arange(len(rows)) // BLOCK_ITEMS, light)
        block_starts, block_maxima, block_last = [0], [], []
        for postings in lists:
            for lo in range(0, len(postings), BLOCK_POSTINGS):
                part = postings[lo:lo + BLOCK_POSTINGS]
                block_maxima.append(max(x for _, x in part))
                block_last.append(part[-1][0])
            block_starts.append(len(block_maxima))
        return Index(term_ids, starts.tolist(), items.tolist(), impacts.tolist(), maxima.tolist(), block_starts, block_maxima, block_last, heavy, np.cumsum([0] + [len(b) for b in blocks]),
                     np.array([k for b in blocks for k in b], np.int64), np.array([x for b in blocks for x in b.values()]),
                     rest, ids, parts, longest)

    def candidates(self, passage: np.ndarray, term: np.ndarray, min_score: float) -> np.ndarray:
        """Passages with a block whose bound reaches the threshold; (passage, heavy term) pairs in, distinct."""
        sizes = self.heavy_starts[term + 1] - self.heavy_starts[term]
        total = int(sizes.sum())
        if not total:
            return np.zeros(0, np.int64)
        at = np.arange(total) + np.repeat(self.heavy_starts[term] - np.cumsum(sizes) + sizes, sizes)
        cell = np.repeat(passage, sizes) * len(self.rest) + self.heavy_blocks[at]
        cells, back = np.unique(cell, return_inverse=True)
        bound = np.bincount(back, weights=self.heavy_maxima[at]) + self.rest[cells % len(self.rest)]
        return np.unique(cells[bound >= min_score - 1e-9] // len(self.rest))

    def search(self, words: list[str], min_score: float) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score) of every item that scores ``min_score`` or more."""
        items, impacts, starts, maxima = self.items, self.impacts, self.starts, self.maxima
        cursors = []  # [item, position, end, term]
        for w in set(words):
            t = self.term_ids.get(w)
            if t is not None:
                cursors.append([items[starts[t]], starts[t], starts[t + 1], t])
        found, low = [], min_score - 1e-9

        def seek(c: list, item: int) -> None:
            c[1] = bisect_left(items, item, c[1], c[2])
            c[0] = items[c[1]] if c[1] < c[2] else -1

        def block(c: list, item: int) -> tuple[float, int]:
            """The bound of the list's block that may hold ``item``, and that block's last item."""
            at = bisect_left(items, item, c[1], c[2])
            if at == c[2]:
                return 0.0, len(self.ids)
            b = self.block_starts[c[3]] + (at - starts[c[3]]) // BLOCK_POSTINGS
            return self.block_maxima[b], self.block_last[b]

        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += maxima[c[3]]
                if total >= low:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bounds = [block(c, item) for c in cursors[:pivot + 1]]
            if sum(b for b, _ in bounds) >= low:
                score = 0.0
                for c in cursors[:pivot + 1]:
                    seek(c, item)
                    if c[0] == item:
                        score += impacts[c[1]]
                        seek(c, item + 1)
                if score >= low:
                    found.append((item, score))
            else:
                target = min([last for _, last in bounds] + [c[0] - 1 for c in cursors[pivot + 1:pivot + 2]]) + 1
                for c in cursors[:pivot + 1]:
                    seek(c, max(target, item + 1))
            cursors = [c for c in cursors if c[0] >= 0]
        return found


def matches(index: Index, texts: list[str], min_score: float, min_overlap: float) -> list[list[dict]]:
    """For each text the items it holds: item id, best score, passages and overlaps."""
    step = index.window
    heavy = index.heavy
    docs, found = [], [{} for _ in texts]
    passages, terms, base = [], [], [0]
    for t in texts:
        words = words_of(t)
        docs.append(words)
        n_windows = max(1, -(-len(words) // step) - 1)
        hit = [(k, h) for k, h in enumerate(map(heavy.get, words)) if h is not None]
        if hit:
            at, h = np.array(hit, np.int64).T
            own = at // step
            pairs = np.concatenate((own * len(heavy) + h, np.maximum(own - 1, 0) * len(heavy) + h))
            pairs = np.unique(pairs)
            own = np.minimum(pairs // len(heavy), n_windows - 1)
            passages.append(base[-1] + own)
            terms.append(pairs % len(heavy))
        base.append(base[-1] + n_windows)
    if not passages:
        return [[] for _ in texts]
    both = np.unique(np.concatenate(passages) * len(heavy) + np.concatenate(terms))
    for p in index.candidates(both // len(heavy), both % len(heavy), min_score).tolist():
        d = int(np.searchsorted(base, p, side="right")) - 1
        start = (p - base[d]) * step
        passage = docs[d][start:start + 2 * step]
        for item, score in index.search(passage, min_score):
            question, answer = index.parts[item]
            q, a = overlap(question, passage), overlap(answer, passage)
            if q >= min_overlap and a >= min_overlap:
                old = found[d].get(item)
                found[d][item] = {"item_id": index.ids[item], "score": max(score, old["score"] if old else 0.0),
                                  "n_passages": 1 + (old["n_passages"] if old else 0),
                                  "question_overlap": max(q, old["question_overlap"] if old else 0.0),
                                  "answer_overlap": max(a, old["answer_overlap"] if old else 0.0)}
    return [[x[k] for k in sorted(x)] for x in found]


def index_shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text", min_score: float = MIN_SCORE,
                 shard_chars: int = SHARD_CHARS) -> Iterator[Index]:
    """Indexes of the items, each of about ``shard_chars`` characters at most; statistics are those of all items."""
    clean = items.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).where(F.col("text").rlike(r"\S")).distinct()
    clean = written(clean.withColumn("words", _words_column(F.col("text"))).where(F.size("words") > 0), "items")
    size = clean.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.avg(F.size("words")).alias("mean")).first()
    if not size["n"]:
        return
    shards = max(1, -(-size["chars"] // shard_chars))
    freq = written(clean.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "item-terms")
    placed = clean.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
    for k in range(shards):
        own = placed.where(F.col("shard") == k)
        rows = sorted(((r["id"], r["text"]) for r in own.select("id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            used = own.select(F.explode(F.array_distinct("words")).alias("word")).distinct()
            doc_freq = {r["word"]: r["n"] for r in freq.join(used, "word", "left_semi").collect()}
            yield Index.build(rows, doc_freq, size["n"], size["mean"], min_score)


def _words_column(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([words_of(t) for t in texts])

    return words(text)


def found_in(docs: DataFrame, text: Column, index: Index, min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP,
             id_type: str = "bigint") -> Column:
    """Array of the index's items that a text column holds; ``id_type`` is the type of the items' ids."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf(f"array<struct<item_id:{id_type},score:double,n_passages:int,question_overlap:double,answer_overlap:double>>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for i in range(0, len(texts), 500):
                out += matches(shared.value, texts.iloc[i:i + 500].tolist(), min_score, min_overlap)
            yield pd.Series(out)

    return held(text)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", min_score: float = MIN_SCORE,
                 min_overlap: float = MIN_OVERLAP, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row per (document, item it holds): id, item_id, score, n_passages, question_overlap, answer_overlap."""
    out, id_type = None, items.schema[item_id_col].dataType.simpleString()
    for index in index_shards(items, item_id_col, item_text_col, min_score, shard_chars):
        rows = docs.select(F.col(id_col), found_in(docs, text_or_empty(text_col), index, min_score, min_overlap, id_type).alias("__held"))
        rows = rows.select(id_col, F.inline("__held"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = docs.select(F.col(id_col), F.lit(None).cast(id_type).alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).alias("n_passages"),
                          F.lit(0.0).alias("question_overlap"), F.lit(0.0).alias("answer_overlap")).where(F.lit(False))
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
          min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    kept, id_type = docs, items.schema[item_id_col].dataType.simpleString()
    for index in index_shards(items, item_id_col, item_text_col, min_score, shard_chars):
        kept = kept.where(F.size(found_in(docs, text_or_empty(text_col), index, min_score, min_overlap, id_type)) == 0)
    return kept
