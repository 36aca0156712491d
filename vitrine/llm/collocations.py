"""Collocations by top-order marginalisation.

Each word of a text opens one window: itself and the words that follow it in its
piece (its lead columns), padded with empty words where the piece ends. Only
these longest windows are counted: in numpy within stretches of a partition, then
by Spark. As every occurrence of a shorter phrase is the
beginning of exactly one window, ROLLUP over the counted windows gives the counts
of all shorter phrases by summing over what follows a prefix; no shorter n-gram
is ever spread out.

A candidate (2 to ``max_words`` words, ``min_count`` occurrences) is cut in two at
every place; the cut's score is floor(10^6 a^2 / (l r)) in exact decimals, and the
lowest-scoring cut (ties: the shortest first part) counts. A candidate goes if a
longer candidate that holds it has ``within`` percent of its occurrences or more.

Scale: a piece never leaves its row, so the one large shuffle is that of windows
whose numbers are summed on the map side; it brings windows that share all words
but the last together. There the places that no candidate needs (of phrases of
fewer than ``min_count`` occurrences) are padded too, which leaves the sums of
shorter prefixes as they are, so little is left for the ROLLUP. The ROLLUP leaves
the longest prefix out, as the counted windows are that already. The first ``top``
of each group are found by partial limits before the ranking's shuffle.

Defined cases: a null text is empty, a null group is ``und``; texts without words
and empty tables give no rows; the same row twice counts twice; the result has
its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import text_or_empty, written
from vitrine.llm.token_words import slices

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
#: Percent of a candidate's occurrences within one longer candidate at which it goes.
WITHIN = 50
#: Bytes of text whose windows are counted at a time, before the first shuffle.
SLICE_BYTES = 8_000_000
#: A padded place; no word is empty.
PAD = ""
_SPACE, _END = 32, 10
# What each byte stands for. A-Z are lower-cased, these characters end a piece, a tab parts words like a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[list(b".,;:!?\n\x0b\x0c\r")] = _END
_FOLD[9] = _SPACE


def _places(max_words: int) -> list[str]:
    return [f"w{i}" for i in range(1, max_words + 1)]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts (no nulls), the text of each, and whether the next word follows in the same piece."""
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = _FOLD[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]]]
    edges -= edges[0]
    inside = (data != _SPACE) & (data != _END)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = edges[:-1][np.diff(edges) > 0]
    starts[begins] = inside[begins]
    first = np.flatnonzero(starts)
    text = np.searchsorted(edges, first, "right") - 1
    kept = np.zeros(len(data) + 1, np.int32)  # bytes of words before a place
    np.cumsum(inside, dtype=np.int32, out=kept[1:])
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(kept[first], kept[-1])), pa.py_buffer(data[inside]))
    piece = np.cumsum(data == _END, dtype=np.int32)[first]
    same = np.zeros(len(first), bool)
    same[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    return words, text, same


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    """The value ``by`` places further on; zero beyond the end."""
    return np.append(values[by:], np.zeros(min(by, len(values)), values.dtype))


def count_windows(groups: pa.Array, texts: pa.Array, max_words: int) -> list[pa.Array]:
    """The distinct longest windows of the texts and their numbers, as (head, tails) of windows that differ in the last word only.

    The head is the other words and the group, joined by spaces; the tails are
    the last words, each with a tab and its number if that is more than one.
    """
    words, text, same = _words(texts)
    coded, named = words.dictionary_encode(), groups.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1  # 0: padded
    size = len(coded.dictionary) + 1
    key = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
    lasts, leads = np.ones(len(code), bool), []
    for k in range(max_words):
        if k:
            lasts = lasts & _ahead(same, k - 1)
        leads.append(np.where(lasts, _ahead(code, k), 0))
        if len(key) and int(key.max() + 1) * size >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * size + leads[k]
    key, where, number = np.unique(key, return_index=True, return_counts=True)
    spelled = pa.concat_arrays([pa.array([PAD]), coded.dictionary])
    tails = spelled.take(pa.array(leads[-1][where]))
    many = pc.binary_join_element_wise(tails, pc.cast(pa.array(number), pa.string()), "\t")
    tails = pc.if_else(pa.array(number > 1), many, tails)
    shared = key // size
    first = np.flatnonzero(np.append(True, shared[1:] != shared[:-1])) if len(key) else np.zeros(0, np.int64)
    head = pc.binary_join_element_wise(*[spelled.take(pa.array(x[where[first]])) for x in leads[:-1]], groups.take(pa.array(text[where[first]])), " ")
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), tails)
    return [head, pc.binary_join(lists, " ")]


def longest_windows(docs: DataFrame, text_col: str, group_col: str, max_words: int) -> DataFrame:
    """``(head, tails)``: the longest windows, counted within stretches of a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in slices(pc.binary_length(whole.column("text")).to_pylist(), SLICE_BYTES):
                part = whole.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(count_windows(part.column("grp"), part.column("text"), max_words), names=["head", "tails"])

    plain = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("grp"), text_or_empty(text_col).alias("text"))
    return plain.mapInArrow(run, "head string, tails string")


def phrase_counts(docs: DataFrame, text_col: str = "text", group_col: str = "lang", max_words: int = MAX_WORDS,
                  min_count: int = MIN_COUNT) -> DataFrame:
    """``(grp, phrase, k, f)``: phrases of k words with f >= min_count occurrences; k = 0 (null phrase): all words of the group."""
    places = _places(max_words)
    # windows that share all but their last word meet in one partition, so the sums over it need no other shuffle
    spread = (longest_windows(docs, text_col, group_col, max_words).repartition("head")
              .select("head", F.explode(F.split("tails", " ", -1)).alias("tail"))
              .select("head", F.substring_index("tail", "\t", 1).alias("last"),
                      F.when(F.contains("tail", F.lit("\t")), F.substring_index("tail", "\t", -1).cast("long")).otherwise(1).alias("f")))
    counted = spread.groupBy("head", "last").agg(F.sum("f").alias("f"))
    # rare last words, and the last of all other words if they are rare together, are padded: no candidate has them,
    # and shorter prefixes keep their sums
    parts = counted.withColumn("common", F.sum("f").over(Window.partitionBy("head")) >= min_count).withColumn("parts", F.split("head", " ", max_words))
    others = [F.get("parts", F.lit(i)).alias(c) for i, c in enumerate(places[:-1])]
    if max_words > 2:
        others[-1] = F.when(F.col("common"), F.get("parts", F.lit(max_words - 2))).otherwise(PAD).alias(places[-2])
    padded = parts.select(
        F.get("parts", F.lit(max_words - 1)).alias("grp"), *others,
        F.when(F.col("common") & (F.col("f") >= min_count), F.col("last")).otherwise(PAD).alias(places[-1]), "f")
    longest = written(padded.groupBy("grp", *places).agg(F.sum("f").alias("f")), "windows")
    shorter = (longest.rollup("grp", *places[:-1]).agg(F.sum("f").alias("f"), F.grouping_id().alias("summed"))
               .where(F.col("grp").isNotNull()))
    # of a rollup's n columns the last j are summed over: grouping_id = 2^j - 1
    kept = shorter.withColumn("k", (F.lit(max_words - 1) - F.bit_count("summed")).cast("int")).where(f"k = 0 OR f >= {int(min_count)}")
    prefix = [kept.where(F.col("k") == 0).select("grp", F.lit(None).cast("string").alias("phrase"), "k", "f")]
    for k in range(1, max_words):
        whole = kept.where((F.col("k") == k) & (F.col(places[k - 1]) != PAD))
        prefix.append(whole.select("grp", F.concat_ws(" ", *places[:k]).alias("phrase"), "k", "f"))
    prefix.append(longest.where((F.col("f") >= min_count) & (F.col(places[-1]) != PAD))
                  .select("grp", F.concat_ws(" ", *places).alias("phrase"), F.lit(max_words).alias("k"), "f"))
    return reduce(DataFrame.unionByName, prefix)


def _part(first: Column, count: Column) -> Column:
    return F.array_join(F.slice("words", first, count), " ")


def scored(counts: DataFrame) -> DataFrame:
    """``(grp, phrase, a, l, r, score)`` of every candidate, by its lowest-scoring cut."""
    known = counts.where("k >= 1")
    cuts = (known.where("k >= 2").withColumn("words", F.split("phrase", " ", -1))
            .select("grp", "phrase", "k", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
            .select("grp", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("head"),
                    _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail")))
    # both parts of a candidate occur at least as often as it does, so they are known
    heads = written(cuts.join(known.select("grp", F.col("phrase").alias("head"), F.col("f").alias("l")), ["grp", "head"]), "cut-heads")
    both = heads.join(known.select("grp", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["grp", "tail"])
    exact = [f"CAST({c} AS DECIMAL(15,0))" for c in ("a", "l", "r")]
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * {exact[0]} * {exact[0]}) div ({exact[1]} * {exact[2]})")
    return (both.withColumn("score", score).groupBy("grp", "phrase", "a")
            .agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
            .select("grp", "phrase", "a", "low.l", "low.r", "low.score"))


def _swallowed(counts: DataFrame, max_words: int) -> DataFrame:
    """``(grp, phrase, most)``: the most occurrences of a longer candidate that holds the phrase."""
    longer = counts.where("k >= 3").withColumn("words", F.split("phrase", " ", -1))
    inner = [longer.where(F.col("k") > size).select(
        "grp", "f", F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: _part(i, F.lit(size)))).alias("phrase"))
        for size in range(2, max_words)]
    return reduce(DataFrame.unionByName, inner).groupBy("grp", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, text_col: str = "text", group_col: str = "lang", max_words: int = MAX_WORDS,
                 min_count: int = MIN_COUNT, top: int = TOP, within: int = WITHIN) -> DataFrame:
    """The first ``top`` collocations of each group: ``(grp, rank, phrase, a, l, r, n, score)``; 2 words at least in a longest window."""
    counts = written(phrase_counts(docs, text_col, group_col, max_words, min_count), "phrases")
    found = scored(counts)
    if max_words > 2:
        found = (found.join(_swallowed(counts, max_words), ["grp", "phrase"], "left")
                 .where(F.col("most").isNull() | (100 * F.col("most") < within * F.col("a"))))
    order = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("k = 0").select("grp", F.col("f").alias("n"))
    return best.join(totals, "grp").select("grp", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
