"""J1-J5 in long form: joins between the rows of ``explode_nodes``.

In array form a page's elements are one row and the joins are expressions over
it. These are the same joins for ad-hoc selections over ``nodes_long``, where the
two sides are any filters:

* ``contained`` (J2, J3): descendants with their containing elements. Both sides
  meet once by page, sorted by document order, and one sweep with the stack of
  open elements pairs them, in memory bounded by the stack and not by the page.
* ``label_targets`` (J1): an equi left outer join with a partial minimum by place.
* ``leaves`` (J4): a test of the ``below`` mask, no join.
* ``with_match`` / ``without_match`` (J5, J4): left semi and left anti joins by page.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.nodes import is_leaf
from vitrine.functions.sqltext import X

try:  # ship the worker-side code by value: executors need not have the package
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

# Pairs after which those found so far are handed on.
FLUSH_PAIRS = 50_000
MODES = ("all", "nearest", "child")


class _Sweep:
    """The stack of open elements of one side while the other side's rows go by."""

    def __init__(self, mode: str):
        self.mode = mode
        self.page: tuple | None = None
        self.stack: list[tuple[int, int]] = []

    def row(self, page: tuple, place: int, end: int, parent: int, outer: bool, inner: bool) -> list[int]:
        """Places of the outer elements that contain this one."""
        if page != self.page:
            self.page, self.stack = page, []
        stack = self.stack
        while stack and stack[-1][1] < place:
            stack.pop()
        found: list[int] = []
        if inner and stack:
            if self.mode == "all":
                found = [p for p, _ in stack]
            elif self.mode == "nearest" or stack[-1][0] == parent:
                found = [stack[-1][0]]
        if outer:
            stack.append((place, end))
        return found


def _sweep_batches(batches: Iterable[pa.RecordBatch], keys: list[str], mode: str) -> Iterator[pa.RecordBatch]:
    sweep = _Sweep(mode)
    names = keys + ["outer_ord", "ord"]
    schema = None
    for batch in batches:
        schema = schema or pa.schema([batch.schema.field(k) for k in keys] + [("outer_ord", pa.int32()), ("ord", pa.int32())])
        ids = [batch.column(k) for k in keys]
        pages = list(zip(*[c.to_pylist() for c in ids]))
        cols = [batch.column(c).to_pylist() for c in ("ord", "end_ord", "parent", "outer", "inner")]
        at: list[int] = []
        outer: list[int] = []
        for i, (page, *rest) in enumerate(zip(pages, *cols)):
            found = sweep.row(page, *rest)
            at.extend([i] * len(found))
            outer.extend(found)
            if len(at) >= FLUSH_PAIRS:
                yield _pairs(ids, cols[0], at, outer, names)
                at, outer = [], []
        if at:
            yield _pairs(ids, cols[0], at, outer, names)


def _pairs(ids: list[pa.Array], places: list[int], at: list[int], outer: list[int], names: list[str]) -> pa.RecordBatch:
    take = pa.array(at, pa.int32())
    return pa.RecordBatch.from_arrays([c.take(take) for c in ids] + [pa.array(outer, pa.int32()),
                                      pa.array([places[i] for i in at], pa.int32())], names=names)


def contained(nodes_long: DataFrame, outer: Column, inner: Column, keys: tuple[str, ...] = ("page_id",),
              mode: str = "all") -> DataFrame:
    """``keys``, ``outer_ord``, ``ord`` of every element of ``inner`` within an element of ``outer``.

    ``mode``: every containing element, the nearest one, or only one that is its
    parent. ``keys`` name a page. Join the result to either side by the keys and
    the place for other columns.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}: one of {MODES}")
    sides = nodes_long.select(*keys, "ord", "end_ord", "parent", F.coalesce(outer, F.lit(False)).alias("outer"),
                              F.coalesce(inner, F.lit(False)).alias("inner")).where("outer OR inner")
    by_place = sides.repartition(*keys).sortWithinPartitions(*keys, "ord")
    schema = T.StructType([nodes_long.schema[k] for k in keys] + [T.StructField("outer_ord", T.IntegerType()), T.StructField("ord", T.IntegerType())])
    names = list(keys)
    return by_place.mapInArrow(lambda it: _sweep_batches(it, names, mode), schema)


def label_targets(nodes_long: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Every label with a ``for``: ``keys``, ``ord``, ``target_ord``, ``target_text`` of the first element with that id.

    The text is the target's value, else its aria-label, else its joined text;
    NULL where nothing has the id.
    """
    labels = nodes_long.where((F.col("tag") == "label") & (F.col("attrs")["for"] != "")).select(
        *keys, "ord", F.col("attrs")["for"].alias("id"))
    value = F.coalesce(*[F.nullif(c, F.lit("")) for c in (F.col("attrs")["value"], F.col("attrs")["aria-label"], F.col("text_joined"))])
    first = (nodes_long.where(F.col("attrs")["id"] != "")
             .groupBy(*keys, F.col("attrs")["id"].alias("id"))
             .agg(F.min(F.struct(F.col("ord").alias("target_ord"), value.alias("target_text"))).alias("first")))
    return (labels.join(first, [*keys, "id"], "left")
            .select(*keys, "ord", F.col("first.target_ord").alias("target_ord"), F.col("first.target_text").alias("target_text")))


def leaves(nodes_long: DataFrame, tags: list[str]) -> DataFrame:
    """Elements of the given names with none of them below. All names need a bit of the mask (``shred.TAG_BITS``)."""
    from vitrine.operators.shred import TAG_BITS

    unknown = [t for t in tags if t not in TAG_BITS]
    if unknown:
        raise ValueError(f"no bit for {unknown}")
    whole = X("struct(below)")
    return nodes_long.where(F.col("tag").isin(*tags) & is_leaf(whole, tags).col)


def with_match(rows: DataFrame, nodes_long: DataFrame, pred: Column, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The rows whose page has an element that ``pred`` accepts."""
    return rows.join(nodes_long.where(pred).select(*keys).distinct(), list(keys), "left_semi")


def without_match(rows: DataFrame, nodes_long: DataFrame, pred: Column, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The rows whose page has no element that ``pred`` accepts."""
    return rows.join(nodes_long.where(pred).select(*keys).distinct(), list(keys), "left_anti")
