"""Price scalars: N2 parse_price, N3 currency_from_symbol, N7 discount_pct."""

from __future__ import annotations

from vitrine.functions.sqltext import Column, F

from vitrine.functions import vocab
from vitrine.functions.core import let


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_price(c) -> Column:
    """N2 on text.

    1. keep digits, '.' and ','; no digit -> NULL
    2. strip ',' and '.' at both ends
    3. both separators -> drop commas; only commas and a 2-char last group ->
       commas become dots
    4. the last ``\\d+[.,]\\d{2}`` occurrence wins, else the string
    """
    def normalise(stripped):
        has_comma = F.contains(stripped, F.lit(","))
        has_dot = F.contains(stripped, F.lit("."))
        return (F.when(has_comma & has_dot, F.replace(stripped, F.lit(","), F.lit("")))
                .when(has_comma & (F.length(F.substring_index(stripped, ",", -1)) == 2),
                      F.replace(stripped, F.lit(","), F.lit(".")))
                .otherwise(stripped))

    def last_group(n):
        groups = F.regexp_extract_all(n, F.lit("(?U)\\d+(?:[.,]\\d{2})"), F.lit(0))
        return F.coalesce(F.try_element_at(groups, F.lit(-1)), n)

    def steps(kept):
        stripped = F.regexp_replace(kept, "^[.,]+|[.,]+$", "")
        return F.when(F.regexp_like(kept, F.lit("(?U)\\d")),
                      let(let(stripped, normalise), last_group))

    return let(F.regexp_replace(_c(c).cast("string"), "(?U)[^\\d.,]", ""), steps)


def currency_from_symbol(c) -> Column:
    """First symbol of the fixed list present in the text (list order)."""
    t = _c(c)
    expr = None
    for sym, iso in vocab.CURRENCY_SYMBOLS:
        cond = F.contains(t, F.lit(sym))
        expr = F.when(cond, F.lit(iso)) if expr is None else expr.when(cond, F.lit(iso))
    return expr


def discount_pct(price, old_price) -> Column:
    """Both numeric and old > price -> '-NN%', NN rounded half to even."""
    p = _c(price).try_cast("double")
    o = _c(old_price).try_cast("double")
    pct = F.rint((o - p) / o * 100).cast("bigint")
    return F.when(o > p, F.concat(F.lit("-"), pct.cast("string"), F.lit("%")))
