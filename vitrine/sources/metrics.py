"""Counts while running: how many requests, captures and answers of each kind a job has seen.

``observe`` adds the counts to a frame that is run anyway: no second pass, no
exchange, the same plan but for a node that counts. In a batch job the counts are
those of an ``Observation`` after the action, on a stream they come with each
micro-batch (``progress.observedMetrics[name]``), and a listener can add them up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vitrine.functions import vocab


def _counts(**conditions: Column) -> list[Column]:
    return [F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in conditions.items()]


def _all(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def request_counts(url_reason: str = "invalid url", strategy_reason: str = "invalid strategy") -> list[Column]:
    """Of ``check_requests``: requests, accepted ones, and those rejected for each reason."""
    reason = F.col("reject_reason")
    return [_all("n_requests"), *_counts(n_valid=reason.isNull(), n_invalid_url=reason == url_reason, n_invalid_strategy=reason == strategy_reason)]


def capture_counts() -> list[Column]:
    """Of extracted captures: all, failed in the capture, empty, failed in the shredder, usable, and usable with a title."""
    empty = ~F.coalesce(F.col("html_ok"), F.lit(True)) & F.col("error").isNull()
    usable = F.col("html_ok") & F.col("error").isNull() & F.col("shred_error").isNull()
    return [_all("n_captures"), *_counts(
        n_failed=F.col("error").isNotNull(), n_empty=empty, n_shred_errors=F.coalesce(F.col("html_ok"), F.lit(False)) & F.col("shred_error").isNotNull(),
        n_usable=usable, n_titled=usable & F.col("product.title").isNotNull())]


def answer_counts() -> list[Column]:
    """Of resolved requests: all, answered by each strategy, and failed."""
    return [_all("n_answers"), *_counts(n_failed=F.col("product").isNull(),
                                        **{f"n_{s.lower()}": F.col("strategy_used") == s for s in vocab.STRATEGIES})]


def observed(df: DataFrame, observation: Observation | str | None, counts: list[Column]) -> DataFrame:
    """``df`` with the counts observed under an ``Observation`` (batch) or a name (stream); as it is without one."""
    return df if observation is None else df.observe(observation, *counts)
