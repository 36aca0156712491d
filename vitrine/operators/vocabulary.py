"""A15 for vocabularies of any length: all word-bounded hits of a list in a text.

A hit is an entry between word bounds; hits don't overlap, the leftmost comes
first and at one place the longest entry wins, as in a regex of the entries sorted
by length. Up to ``SHORT`` entries that regex is the plan (an expression, no Python).
Longer lists become an Aho-Corasick automaton, which passes over a text once
whatever the list's length. The list goes to every task, so it is refused beyond
``MOST_CHARS``.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.sqltext import X
from vitrine.functions.text import match_vocab, vocab_regex

try:  # ship the worker-side code by value: executors need not have the package
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

#: Entries up to which the list is a regex.
SHORT = 200
#: Characters of all entries together at most (some 20 bytes of automaton each).
MOST_CHARS = 20_000_000
# Categories of word characters in Unicode regexes, and the two joiners.
_WORD = frozenset(["Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Me", "Mc", "Pc"])
_JOINERS = frozenset(["\u200c", "\u200d"])


@lru_cache(maxsize=65536)
def _in_word(c: str) -> bool:
    return unicodedata.category(c) in _WORD or c in _JOINERS


def _bound(text: str, at: int) -> bool:
    """Whether a word begins or ends before place ``at``."""
    return (at > 0 and _in_word(text[at - 1])) != (at < len(text) and _in_word(text[at]))


def automaton(words: Iterable[str]):
    """The automaton of a list; a hit's value is the entry's length."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for w in words:
        if w:
            out.add_word(w, len(w))
    out.make_automaton()
    return out


def hits(text: str, found) -> list[str]:
    """Hits of an automaton in a text, in order."""
    longest: dict[int, int] = {}
    for last, size in found.iter(text):
        first = last + 1 - size
        if size > longest.get(first, 0) and _bound(text, first) and _bound(text, last + 1):
            longest[first] = size
    out, end = [], 0
    for first in sorted(longest):
        if first >= end:
            end = first + longest[first]
            out.append(text[first:end])
    return out


def match_words(text: Column | str, words: list[str]) -> Column:
    """ARRAY<STRING> of all hits of ``words`` in the upper-cased text; NULL for a NULL text."""
    upper = sorted({w.upper() for w in words if w})
    if sum(map(len, upper)) > MOST_CHARS:
        raise ValueError(f"a vocabulary of more than {MOST_CHARS} characters can't go to every task")
    col = F.col(text) if isinstance(text, str) else text
    if not upper:
        return F.when(col.isNotNull(), F.array().cast("array<string>"))
    if len(upper) <= SHORT and isinstance(text, str):
        return match_vocab(X(f"`{text}`"), vocab_regex(upper)).col

    @F.pandas_udf("array<string>")
    def all_hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = automaton(upper)
        for texts in batches:
            yield pd.Series([None if t is None else hits(t, found) if len(found) else [] for t in texts], dtype=object)

    return all_hits(F.upper(col))


def match_table(rows: DataFrame, text_col: str, words: DataFrame, word_col: str, out_col: str = "hits") -> DataFrame:
    """``rows`` with the hits of a vocabulary table, whose size is checked on Spark before it is read."""
    distinct = words.select(F.upper(F.col(word_col)).alias("w")).where("w != ''").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length("w")), F.lit(0)).alias("n")).first()["n"]
    if size > MOST_CHARS:
        raise ValueError(f"a vocabulary of {size} characters can't go to every task (at most {MOST_CHARS})")
    return rows.withColumn(out_col, match_words(text_col, [r["w"] for r in distinct.collect()]))
