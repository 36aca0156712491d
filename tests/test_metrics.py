"""Counts while running: the same plan, and a stream's counts by micro-batch."""

import tempfile

from vitrine.sources import captures as K
from vitrine.sources import catalogue
from vitrine.streaming.stream import stream_products

SF = "/root/testdata/sf0.001"


def test_counting_adds_no_exchange_and_no_pass(spark):
    from pyspark.sql import Observation

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    caps, reqs = catalogue.captures(spark, SF), catalogue.requests(spark, SF)
    with_counts = plan(K.resolve_captures(caps, reqs, {k: Observation() for k in ("requests", "captures", "answers")}))
    without = plan(K.resolve_captures(caps, reqs))
    assert with_counts.count("CollectMetrics") == 3 and "CollectMetrics" not in without
    for node in ("Exchange", "MapInArrow", "SortMergeJoin", "Scan"):
        assert with_counts.count(node) == without.count(node)


def test_stream_counts_by_micro_batch(spark):
    src, out, ckpt = (tempfile.mkdtemp(prefix=f"vitrine-{x}-") for x in ("src", "out", "ckpt"))
    caps = catalogue.captures(spark, SF).where("page_id < 60")
    K.write_products(caps.repartition(2), src, "json", "append")
    query = stream_products(spark, src, out, ckpt, name="counted", src_fmt="json", max_files_per_trigger=1)
    query.awaitTermination(300)
    total = {}
    for p in query.recentProgress:
        for k, v in (p.observedMetrics["captures"].asDict() if "captures" in p.observedMetrics else {}).items():
            total[k] = total.get(k, 0) + (v or 0)
    assert total["n_captures"] == caps.count() and total["n_failed"] == caps.where("error IS NOT NULL").count()
    assert total["n_usable"] == total["n_captures"] - total["n_failed"]
