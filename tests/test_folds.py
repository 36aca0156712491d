"""A-folds on arrays."""

from vitrine.functions.sqltext import F, X
from vitrine.functions.text import first_truthy
from vitrine.operators import folds


def _one(spark, expr):
    return spark.range(1).select(expr.alias("r").col).collect()[0]["r"]


def test_last_wins_map_keeps_first_insertion_order(spark):
    entries = X("array(struct('b' AS k, '1' AS v), struct('a' AS k, '2' AS v), struct('b' AS k, '3' AS v))")
    m = _one(spark, F.map_entries(folds.last_wins_map(entries)))
    assert [(e["key"], e["value"]) for e in m] == [("b", "3"), ("a", "2")]


def test_minus_keep_dups(spark):
    assert _one(spark, folds.minus_keep_dups(X("array('a','b','b','c')"), X("array('a')"))) == ["b", "b", "c"]


def test_first_and_last_nonnull(spark):
    assert _one(spark, folds.first_nonnull(X("array(NULL, 'x', 'y')"))) == "x"
    assert _one(spark, folds.last_nonnull(X("array('x', 'y', NULL)"))) == "y"
    assert _one(spark, F.coalesce(first_truthy(X("''"), X("NULL"), X("'z'")))) == "z"
