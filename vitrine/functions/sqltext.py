"""Spark SQL expression text with the ``pyspark.sql.functions`` surface.

Why: the extraction is a large expression (hundreds of higher-order lambdas).
Built through the classic Column API, every node is a py4j round trip and
the plan takes ~30 s to construct; emitted as SQL text it is one ``F.expr``
call per stage column, parsed by Spark in milliseconds. The resulting
logical plan is the same Catalyst expression tree.

``X`` wraps expression text and overloads the Column operators the library
uses; ``F`` mirrors the functions it uses. ``X.col`` converts to a real
``Column`` at the DataFrame boundary.
"""

from __future__ import annotations

import itertools
from types import SimpleNamespace
from typing import Any, Callable

from pyspark.sql import Column
from pyspark.sql import functions as _F

_ids = itertools.count(1)


def _lit_sql(v: Any) -> str:
    if isinstance(v, X):
        return v.sql
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    s = str(v)
    if "'" not in s and "\\" not in s:
        return "'" + s + "'"
    if "'" not in s:
        return "r'" + s + "'"  # raw literal: backslashes are not escapes
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql(v: Any) -> str:
    return v.sql if isinstance(v, X) else _lit_sql(v)


class X:
    """A Spark SQL expression as text."""

    __slots__ = ("sql",)

    def __init__(self, sql: str):
        self.sql = sql

    # conversion -----------------------------------------------------------
    @property
    def col(self) -> Column:
        return _F.expr(self.sql)

    def __repr__(self) -> str:
        return f"X<{self.sql[:200]}>"

    def __bool__(self):
        raise TypeError("an expression has no truth value; use & | ~")

    __hash__ = object.__hash__

    # operators --------------------------------------------------------------
    def _bin(self, op: str, other: Any) -> "X":
        return X(f"({self.sql} {op} {_sql(other)})")

    def __and__(self, o): return self._bin("AND", o)
    def __or__(self, o): return self._bin("OR", o)
    def __invert__(self): return X(f"(NOT {self.sql})")
    def __eq__(self, o): return self._bin("=", o)  # type: ignore[override]
    def __ne__(self, o): return self._bin("!=", o)  # type: ignore[override]
    def __lt__(self, o): return self._bin("<", o)
    def __le__(self, o): return self._bin("<=", o)
    def __gt__(self, o): return self._bin(">", o)
    def __ge__(self, o): return self._bin(">=", o)
    def __add__(self, o): return self._bin("+", o)
    def __sub__(self, o): return self._bin("-", o)
    def __mul__(self, o): return self._bin("*", o)
    def __truediv__(self, o): return self._bin("/", o)

    def __getitem__(self, key: Any) -> "X":
        return X(f"{self.sql}[{_lit_sql(key) if not isinstance(key, X) else key.sql}]")

    getItem = __getitem__

    def eqNullSafe(self, o): return self._bin("<=>", o)
    def isNull(self): return X(f"({self.sql} IS NULL)")
    def isNotNull(self): return X(f"({self.sql} IS NOT NULL)")
    def isin(self, *vals): return X(f"({self.sql} IN ({', '.join(_sql(v) for v in vals)}))")
    def startswith(self, s): return X(f"startswith({self.sql}, {_sql(s)})")
    def alias(self, name: str): return X(f"{self.sql} AS `{name}`")
    def cast(self, t: str): return X(f"CAST({self.sql} AS {t})")
    def try_cast(self, t: str): return X(f"try_cast({self.sql} AS {t})")


class _Case(X):
    __slots__ = ("branches", "default")

    def __init__(self, branches, default=None):
        self.branches = branches
        self.default = default
        body = " ".join(f"WHEN {_sql(c)} THEN {_sql(v)}" for c, v in branches)
        tail = f" ELSE {_sql(default)}" if default is not None else ""
        super().__init__(f"CASE {body}{tail} END")

    def when(self, cond, value):
        return _Case(self.branches + [(cond, value)])

    def otherwise(self, value):
        return _Case(self.branches, value if value is not None else X("NULL"))


def _lambda(fn: Callable) -> str:
    code = fn.__code__
    n = code.co_argcount - len(fn.__defaults__ or ())
    names = [f"v{next(_ids)}" for _ in range(n)]
    body = fn(*[X(v) for v in names])
    head = names[0] if n == 1 else "(" + ", ".join(names) + ")"
    return f"{head} -> {_sql(body)}"


def _call(name: str):
    def f(*args):
        return X(f"{name}({', '.join(_sql(a) for a in args)})")
    f.__name__ = name
    return f


def _hof(name: str):
    def f(arr, *rest):
        parts = [_sql(arr)]
        for r in rest:
            parts.append(_lambda(r) if callable(r) and not isinstance(r, X) else _sql(r))
        return X(f"{name}({', '.join(parts)})")
    f.__name__ = name
    return f


def _col(name: str) -> X:
    return X(".".join(f"`{p}`" for p in name.split(".")))


def _lit(v) -> X:
    return X(_lit_sql(v))


def _when(cond, value) -> _Case:
    return _Case([(cond, value)])


def _array(*args) -> X:
    return X(f"array({', '.join(_sql(a) for a in args)})")


def _struct(*args) -> X:
    return X(f"struct({', '.join(_sql(a) for a in args)})")


def _regexp_replace(c, pattern, replacement) -> X:
    return X(f"regexp_replace({_sql(c)}, {_lit_sql(pattern)}, {_lit_sql(replacement)})")


def _regexp_extract(c, pattern, idx) -> X:
    return X(f"regexp_extract({_sql(c)}, {_lit_sql(pattern)}, {int(idx)})")


def _split(c, pattern) -> X:
    return X(f"split({_sql(c)}, {_lit_sql(pattern)}, -1)")


def _substring_index(c, delim, count) -> X:
    return X(f"substring_index({_sql(c)}, {_lit_sql(delim)}, {int(count)})")


def _slice(arr, start, length) -> X:
    return X(f"slice({_sql(arr)}, {_sql(start)}, {_sql(length)})")


def _element_at(arr, idx) -> X:
    return X(f"element_at({_sql(arr)}, {_sql(idx)})")


def _array_join(arr, delim) -> X:
    return X(f"array_join({_sql(arr)}, {_lit_sql(delim)})")


def _try_variant_get(v, path, t) -> X:
    return X(f"try_variant_get({_sql(v)}, {_lit_sql(path)}, {_lit_sql(t)})")


F = SimpleNamespace(
    col=_col, lit=_lit, expr=X, when=_when, array=_array, struct=_struct,
    coalesce=_call("coalesce"), nullif=_call("nullif"), greatest=_call("greatest"),
    least=_call("least"), concat=_call("concat"), concat_ws=_call("concat_ws"),
    size=_call("size"), flatten=_call("flatten"), array_distinct=_call("array_distinct"),
    array_contains=_call("array_contains"), array_max=_call("array_max"),
    array_min=_call("array_min"), array_sort=_call("array_sort"),
    map_contains_key=_call("map_contains_key"), map_from_entries=_call("map_from_entries"),
    map_entries=_call("map_entries"),
    try_element_at=_call("try_element_at"), element_at=_element_at, slice=_slice,
    lower=_call("lower"), upper=_call("upper"), trim=_call("trim"), length=_call("length"),
    substring=_call("substring"), substring_index=_substring_index, replace=_call("replace"),
    contains=_call("contains"), regexp_like=_call("regexp_like"),
    regexp_replace=_regexp_replace, regexp_extract=_regexp_extract,
    regexp_extract_all=_call("regexp_extract_all"), split=_split, array_join=_array_join,
    rint=_call("rint"), try_parse_json=_call("try_parse_json"),
    schema_of_variant=_call("schema_of_variant"), try_variant_get=_try_variant_get,
    try_parse_url=_call("try_parse_url"),
    transform=_hof("transform"), filter=_hof("filter"), exists=_hof("exists"),
    forall=_hof("forall"), aggregate=_hof("aggregate"), zip_with=_hof("zip_with"),
)

Column = X  # type alias for annotations in expression modules

__all__ = ["F", "X", "Column"]
