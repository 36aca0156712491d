"""Order-sensitive folds over arrays (one page's candidates).

All are Column -> Column; none needs a shuffle because a page's candidates
live in one row. The other folds are single functions where they are used
(first: ``try_element_at``, ordered distinct: ``array_distinct``, shortest:
``array_min`` over (length, place), overwrite: ``when``); long forms
(``min_by``/``max_by`` grouped by a key) are the driver-table queries.
"""

from __future__ import annotations

from vitrine.functions.core import let
from vitrine.functions.sqltext import Column, F


def first_nonnull(arr: Column) -> Column:
    """A3: first element that is not NULL."""
    return F.try_element_at(F.filter(arr, lambda x: x.isNotNull()), F.lit(1))


def last_nonnull(arr: Column) -> Column:
    return F.try_element_at(F.filter(arr, lambda x: x.isNotNull()), F.lit(-1))


def last_wins_map(entries: Column) -> Column:
    """``MAP`` from ``ARRAY<STRUCT<k, v>>`` where a later value replaces an
    earlier one and keys keep their first-insertion order (dict semantics).

    O(n log n) and independent of ``spark.sql.mapKeyDedupPolicy``: sort by
    (key, position), take each key run's first position and last value, sort
    back by first position.
    """
    keyed = F.transform(F.filter(entries, lambda e: e["k"].isNotNull()),
                        lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v")))

    def runs(s):
        n = F.size(s)
        firsts = F.filter(s, lambda x, j: F.when(j == 0, F.lit(True))
                          .otherwise(F.element_at(s, j)["k"] != x["k"]))
        lasts = F.filter(s, lambda x, j: F.when(j == n - 1, F.lit(True))
                         .otherwise(F.element_at(s, j + 2)["k"] != x["k"]))
        return F.zip_with(firsts, lasts, lambda f, l: F.struct(
            f["i"].alias("i"), l["k"].alias("k"), l["v"].alias("v")))

    ordered = F.array_sort(let(F.array_sort(keyed), runs))
    return F.map_from_entries(F.transform(ordered, lambda r: F.struct(r["k"], r["v"])))


def minus_keep_dups(new: Column, old: Column) -> Column:
    """Values of ``new`` not already in ``old``; duplicates within ``new`` stay."""
    return F.filter(new, lambda o: ~F.coalesce(F.array_contains(old, o), F.lit(False)))


__all__ = ["first_nonnull", "last_nonnull", "last_wins_map", "minus_keep_dups"]
