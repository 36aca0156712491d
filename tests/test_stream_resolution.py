"""Requests resolved on a stream: the rules one by one without Spark, then the stream against the batch job."""

import random
import tempfile
import time

import pandas as pd

from vitrine import schemas
from vitrine.sources import catalogue
from vitrine.sources.captures import resolve_captures
from vitrine.streaming.resolve import Resolver, stream_resolved


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return _Value()

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)


class _Now:
    def __init__(self, at):
        self.at = at

    def getCurrentProcessingTimeInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


COLUMNS = ["request_id", "requested", "debug", "page_id", "strategy", "usable", "titled", "failure", "product"]


def request(i, strategy="HTTPX"):
    return (i, strategy, False, None, None, None, None, None, None)


def capture(page, strategy, usable=True, titled=True, failure=None):
    return (None, None, None, page, strategy, usable, titled, failure, f"p{page}")


class Url:
    def __init__(self, at_once=True):
        self.handle = _Handle()
        self.work = Resolver(100, 1000, at_once)
        self.work.init(self.handle)

    def rows(self, frames):
        return [(r.request_id, r.strategy_used, r.product, r.error) for f in frames for r in f.itertuples()]

    def batch(self, at, *events):
        frame = pd.DataFrame(events, columns=COLUMNS)
        return self.rows(self.work.handleInputRows(("u",), iter([frame]), _Now(at)))

    def timer(self, at):
        return self.rows(self.work.handleExpiredTimer(("u",), _Now(at), _Now(at)))


def test_httpx_with_a_title_answers_at_once():
    u = Url()
    assert u.batch(0, request(1), capture(7, "HTTPX", titled=False), capture(5, "PLAYWRIGHT")) == []
    assert u.handle.timers == [100]
    assert u.batch(10, capture(9, "HTTPX")) == [(1, "HTTPX", "p9", None)]
    assert u.timer(100) == []
    # a later capture of a lower page serves later requests only; a repeated request has its own answer
    assert u.batch(200, capture(2, "HTTPX")) == []
    assert u.batch(210, request(1), request(1)) == [(1, "HTTPX", "p2", None)] * 2


def test_the_deadline_gives_playwright_or_the_error():
    u = Url()
    assert u.batch(0, request(1), request(2, "PLAYWRIGHT")) == []
    assert u.timer(100) == [(1, None, None, "no PLAYWRIGHT capture"), (2, None, None, "no PLAYWRIGHT capture")]
    assert u.batch(200, request(3), capture(4, "PLAYWRIGHT", usable=False)) == []
    assert u.timer(300) == [(3, None, None, "PLAYWRIGHT capture unusable")]
    assert u.batch(400, request(5), capture(9, "PLAYWRIGHT", False, False, "e9"), capture(8, "PLAYWRIGHT", False, False, "e8")) == []
    assert u.batch(450, request(6)) == []
    assert u.timer(500) == [(5, None, None, "e8")]  # the other waits on
    assert u.batch(510, capture(10, "PLAYWRIGHT", titled=False), request(7, "PLAYWRIGHT")) == [(7, "PLAYWRIGHT", "p10", None)]
    assert u.timer(550) == [(6, "PLAYWRIGHT", "p10", None)]


def test_waiting_for_all_takes_the_lowest_page():
    u = Url(at_once=False)
    assert u.batch(0, request(1), request(2, "PLAYWRIGHT"), capture(9, "HTTPX"), capture(8, "PLAYWRIGHT")) == []
    assert u.batch(50, capture(3, "HTTPX"), capture(4, "PLAYWRIGHT")) == []
    assert u.timer(100) == [(1, "HTTPX", "p3", None), (2, "PLAYWRIGHT", "p4", None)]


def test_stream_equals_batch_in_any_order_with_a_restart(spark):
    sf = "/root/testdata/sf0.001"
    caps = catalogue.captures(spark, sf).where("page_id < 80")
    # several captures of a URL
    caps = caps.unionByName(caps.selectExpr("page_id - 1000 AS page_id", "url", "strategy", "replace(html, 'e', 'E') AS html", "error"))
    reqs = catalogue.requests(spark, sf).where("request_id < 40")
    reqs = reqs.selectExpr("request_id", "url", "CASE WHEN request_id % 4 = 0 THEN 'PLAYWRIGHT' WHEN request_id % 7 = 0 THEN 'CURL' END AS strategy", "debug")
    reqs = reqs.unionByName(reqs.where("request_id % 5 = 0"))
    want = sorted(map(repr, resolve_captures(caps, reqs).select("request_id", "url", "debug", "strategy_requested", "strategy_used", "product", "error").collect()))

    rng = random.Random(3)
    parts = [("captures", r) for r in caps.collect()] + [("requests", r) for r in reqs.collect()]
    rng.shuffle(parts)
    src, out, ckpt = (tempfile.mkdtemp(prefix=f"vitrine-{x}-") for x in ("in", "out", "ckpt"))

    def deliver(rows):
        for kind, schema in (("captures", schemas.CAPTURES), ("requests", schemas.REQUESTS)):
            mine = [r for k, r in rows if k == kind]
            spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(f"{src}/{kind}")

    def start():
        read = [spark.readStream.schema(s).parquet(f"{src}/{k}") for k, s in (("captures", schemas.CAPTURES), ("requests", schemas.REQUESTS))]
        return stream_resolved(*read, out, ckpt, wait_seconds=90, keep_seconds=600, at_once=False)

    def arrived(query, rows):
        """Wait until that many rows were read (timers keep the query busy, so it never has nothing to do)."""
        until = time.time() + 60
        while time.time() < until and query.isActive and sum(p.numInputRows for p in query.recentProgress) < rows:
            time.sleep(0.5)

    half = len(parts) // 2
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        deliver(parts[:half])
        query = start()
        arrived(query, half)
        query.stop()  # midway
        deliver(parts[half:])
        query = start()
        until = time.time() + 300
        while time.time() < until and query.exception() is None:
            time.sleep(3)
            got = spark.read.parquet(out).collect() if spark._jvm.java.io.File(f"{out}/_spark_metadata").exists() else []
            if len(got) >= len(want):
                break
        query.stop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert query.exception() is None
    assert sorted(map(repr, got)) == want
