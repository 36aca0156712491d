"""Expression helpers shared by the scalar modules."""

from __future__ import annotations

from typing import Callable

from vitrine.functions.sqltext import Column, F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times in ``fn``.

    Catalyst does not eliminate common sub-expressions inside higher-order
    lambdas, and a helper that mentions its argument in several CASE branches
    would otherwise copy (and re-evaluate) it in each. A one-element
    ``transform`` evaluates the value once and hands it to ``fn`` as a lambda
    variable.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)
