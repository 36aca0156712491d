"""S3 + S6: requests answered on a stream, from captures that arrive in any order.

Captures are extracted where they are read (narrow, as in the batch job) and meet
the requests by URL. The state of a URL is the best capture of each strategy so
far, one row each however many there were, and the requests that still wait.

A request that may use HTTPX is answered as soon as a usable HTTPX capture with a
title is known, one for PLAYWRIGHT as soon as a usable PLAYWRIGHT capture is.
Otherwise it waits ``wait_seconds`` (processing time, from the micro-batch that
brought it); a timer then gives what ``resolve_captures`` would give for the
captures known: PLAYWRIGHT, or the error. With ``at_once=False`` all requests wait,
so that the lowest page_id counts among all captures of that time.

Late captures: one that comes after the answer changes no answer, but serves later
requests, for ``keep_seconds`` from its arrival. Repeated requests: each row has an
answer of its own. Rejected requests (``validate_requests``) have none.

Scale: the state is keyed by URL and lives in RocksDB on the executors, with
timers; it is written to the checkpoint folder, so a restart or a lost executor
goes on where the last micro-batch ended and answers nothing twice in the sink.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vitrine import schemas
from vitrine.plans.extract import extract_products
from vitrine.sources.captures import validate_requests

try:  # ship the worker-side code by value: executors need not have the package
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"

_EVENT = {"request_id": "long", "requested": "string", "debug": "boolean",
          "page_id": "long", "strategy": "string", "usable": "boolean", "titled": "boolean", "failure": "string", "product": "string"}
_ANSWER = "request_id long, url string, debug boolean, strategy_requested string, strategy_used string, product string, error string"
#: What is known of a URL: usable HTTPX with a title, usable PLAYWRIGHT, PLAYWRIGHT failure (page and value), and whether PLAYWRIGHT came at all.
_KNOWN = "httpx_page long, httpx string, pw_page long, pw string, error_page long, error string, has_pw boolean"
_WAITING = "request_id long, requested string, debug boolean, deadline long"
_NOTHING = (None, None, None, None, None, None, False)


class Resolver(StatefulProcessor):
    """Answers of one URL's requests."""

    def __init__(self, wait_ms: int, keep_ms: int, at_once: bool):
        self.wait_ms, self.keep_ms, self.at_once = wait_ms, keep_ms, at_once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", _KNOWN, self.keep_ms)
        self.waiting = handle.getListState("waiting", _WAITING)

    # -- captures ----------------------------------------------------------
    @staticmethod
    def _lowest(page, value, new_page, new_value) -> tuple:
        return (new_page, new_value) if page is None or new_page < page else (page, value)

    def _learn(self, rows: list[dict]) -> tuple:
        known = tuple(self.known.get()) if self.known.exists() else _NOTHING
        hp, h, pp, p, ep, e, has = known
        for r in rows:
            if r["strategy"] == "HTTPX":
                if r["usable"] and r["titled"]:
                    hp, h = self._lowest(hp, h, r["page_id"], r["product"])
            elif r["strategy"] == "PLAYWRIGHT":
                has = True
                if r["usable"]:
                    pp, p = self._lowest(pp, p, r["page_id"], r["product"])
                if r["failure"] is not None:
                    ep, e = self._lowest(ep, e, r["page_id"], r["failure"])
        if rows:
            self.known.update((hp, h, pp, p, ep, e, has))
        return hp, h, pp, p, ep, e, has

    # -- answers -----------------------------------------------------------
    def _answer(self, url: str, request: tuple, known: tuple, due: bool) -> tuple | None:
        request_id, requested, debug, _ = request
        _, httpx, _, playwright, _, failure, has_pw = known
        if requested == "PLAYWRIGHT":
            httpx = None
        if httpx is not None and (due or self.at_once):
            return request_id, url, debug, requested, "HTTPX", httpx, None
        if not due and not (self.at_once and requested == "PLAYWRIGHT" and playwright is not None):
            return None
        if playwright is not None:
            return request_id, url, debug, requested, "PLAYWRIGHT", playwright, None
        error = failure if failure is not None else "PLAYWRIGHT capture unusable" if has_pw else "no PLAYWRIGHT capture"
        return request_id, url, debug, requested, None, None, error

    def _settle(self, url: str, waiting: list[tuple], known: tuple, now: int) -> tuple[pd.DataFrame, list[tuple]]:
        answers, left = [], []
        for request in waiting:
            answer = self._answer(url, request, known, request[3] <= now)
            if answer is None:
                left.append(request)
            else:
                answers.append(answer)
        return pd.DataFrame(answers, columns=[c.split()[0] for c in _ANSWER.split(", ")]), left

    def _keep(self, left: list[tuple], had: bool) -> None:
        if left:
            self.waiting.put(left)
        elif had:
            self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        events = [r for frame in rows for r in frame.astype(object).where(frame.notna(), None).to_dict("records")]
        known = self._learn([{**r, "page_id": int(r["page_id"])} for r in events if r["strategy"] is not None])
        new = [(int(r["request_id"]) if r["request_id"] is not None else None, r["requested"], bool(r["debug"]), now + self.wait_ms)
               for r in events if r["strategy"] is None]
        had = self.waiting.exists()
        waiting = ([tuple(w) for w in self.waiting.get()] if had else []) + new
        answers, left = self._settle(key[0], waiting, known, now)
        if new and any(w[3] == now + self.wait_ms for w in left):
            self.handle.registerTimer(now + self.wait_ms)
        self._keep(left, had)
        yield answers

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        known = tuple(self.known.get()) if self.known.exists() else _NOTHING
        answers, left = self._settle(key[0], waiting, known, expiredTimerInfo.getExpiryTimeInMs())
        self._keep(left, bool(waiting))
        yield answers

    def close(self) -> None:
        pass


def _events(captures: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests and extracted captures as rows of one kind, by URL; a row without a strategy is a request."""
    caps = captures.withColumn("html_ok", F.coalesce(F.col("html") != "", F.lit(False)))
    found = extract_products(caps).select(
        "url", "page_id", "strategy",
        (F.col("html_ok") & F.col("error").isNull() & F.col("shred_error").isNull()).alias("usable"),
        F.col("product.title").isNotNull().alias("titled"), F.coalesce("error", "shred_error").alias("failure"),
        F.to_json("product").alias("product"))
    valid, _ = validate_requests(requests)
    asked = valid.select("url", "request_id", F.col("strategy").alias("requested"), "debug")

    def shaped(df: DataFrame) -> DataFrame:
        return df.select("url", *[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in _EVENT.items()])

    return shaped(found.where("strategy IS NOT NULL AND page_id IS NOT NULL AND url IS NOT NULL")).unionByName(shaped(asked))


def resolve_stream(captures: DataFrame, requests: DataFrame, wait_seconds: float, keep_seconds: float | None = None,
                   at_once: bool = True) -> DataFrame:
    """The columns of ``resolve_captures`` for two streams (``schemas.CAPTURES`` and ``schemas.REQUESTS``).

    ``wait_seconds``: how long a request waits for a better capture.
    ``keep_seconds``: how long captures serve later requests (default: ten times the wait).
    """
    keep = 10 * wait_seconds if keep_seconds is None else keep_seconds
    if keep < wait_seconds:
        raise ValueError("captures must be kept as long as requests wait")
    answers = _events(captures, requests).groupBy("url").transformWithStateInPandas(
        Resolver(int(wait_seconds * 1000), int(keep * 1000), at_once), _ANSWER, "Append", "ProcessingTime")
    return answers.withColumn("product", F.from_json("product", schemas.PRODUCT))


def stream_resolved(captures: DataFrame, requests: DataFrame, out_dir: str, checkpoint_dir: str, wait_seconds: float,
                    keep_seconds: float | None = None, at_once: bool = True, name: str = "resolved", fmt: str = "parquet",
                    processing_time: str = "1 second") -> StreamingQuery:
    """Start ``resolve_stream`` into files. The trigger must go on without new input, as the timers need it."""
    spark = captures.sparkSession
    before = spark.conf.get(PROVIDER_KEY)
    spark.conf.set(PROVIDER_KEY, ROCKSDB)  # state with timers needs it; a query keeps the settings that it starts with
    try:
        return (resolve_stream(captures, requests, wait_seconds, keep_seconds, at_once).writeStream.format(fmt).outputMode("append")
                .option("path", out_dir).option("checkpointLocation", checkpoint_dir).queryName(name)
                .trigger(processingTime=processing_time).start())
    finally:
        spark.conf.set(PROVIDER_KEY, before)

