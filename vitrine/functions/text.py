"""Text scalars (N1, N8-N12, N16-N18, N21) as Spark Column functions."""

from __future__ import annotations

import re

from vitrine.functions.sqltext import Column, F

from vitrine.functions import vocab

WS = vocab.WHITESPACE_CLASS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Null -> null; every whitespace run -> one space; strip.

    After collapsing, edge whitespace is a single ASCII space, which ``trim``
    removes.
    """
    return F.trim(F.regexp_replace(_c(c), WS + "+", " "))


def py_strip(c) -> Column:
    """Strip leading/trailing whitespace (Python ``str.strip()``)."""
    return F.regexp_replace(_c(c), f"^{WS}+|{WS}+$", "")


def nonempty(c) -> Column:
    """'' -> NULL (a falsy string is absent)."""
    return F.nullif(_c(c), F.lit(""))


def first_truthy(*cols) -> Column:
    """First non-null, non-empty string, by precedence."""
    return F.coalesce(*[nonempty(c) for c in cols])


def digits_only(c) -> Column:
    """Keep decimal digits; empty -> NULL; as LONG."""
    d = F.regexp_replace(_c(c), "(?U)\\D", "")
    return F.when(d != "", d.try_cast("bigint"))


def rating_fr(c) -> Column:
    """Text before ' sur ', comma -> dot, as DOUBLE; else NULL."""
    head = F.substring_index(clean_text(c), " sur ", 1)
    return F.replace(head, F.lit(","), F.lit(".")).try_cast("double")


def normalise_key(c) -> Column:
    """Keep letters and digits, lower-case."""
    return F.lower(F.regexp_replace(_c(c), "[^\\p{L}\\p{N}]", ""))


def strip_trailing(c, chars: str = ":") -> Column:
    """Remove trailing characters (``rstrip(chars)``)."""
    return F.regexp_replace(_c(c), "[" + re.escape(chars) + "]+$", "")


def strip_suffix(c, suffix: str = "_name") -> Column:
    """Lower-case, then drop the suffix once."""
    return F.regexp_replace(F.lower(_c(c)), re.escape(suffix) + "$", "")


def contains_any(c, words: list[str], lower: bool = True) -> Column:
    """Some keyword occurs in the (lower-cased) text."""
    t = F.lower(_c(c)) if lower else _c(c)
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))


def vocab_regex(words: list[str]) -> str:
    """Word-bounded alternation, longest entries first (stable)."""
    ordered = sorted(words, key=len, reverse=True)
    return "(?U)\\b(?:" + "|".join(re.escape(w) for w in ordered) + ")\\b"


SIZES_RX = vocab_regex(vocab.SIZES)
COLORS_RX = vocab_regex(vocab.COLORS)


def match_vocab(c, pattern: str) -> Column:
    """All hits of a vocabulary pattern in upper-cased text, in order."""
    return F.regexp_extract_all(F.upper(_c(c)), F.lit(pattern), F.lit(0))


def match_sizes(c) -> Column:
    """Ordered distinct size hits."""
    return F.array_distinct(match_vocab(c, SIZES_RX))


def match_colors(c) -> Column:
    """Ordered distinct colour hits."""
    return F.array_distinct(match_vocab(c, COLORS_RX))
