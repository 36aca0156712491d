"""The stream gives the same rows as the batch job, and a restart appends nothing twice."""

import tempfile

from vitrine.plans.extract import extract_products
from vitrine.sources import catalogue
from vitrine.sources.captures import write_products
from vitrine.streaming.stream import OUTPUT_COLUMNS, stream_products


def _rows(df):
    return sorted(map(repr, df.select("page_id", "product").collect()))


def test_batch_equals_stream_and_restart(spark):
    src, out, ckpt = (tempfile.mkdtemp(prefix=f"vitrine-{x}-") for x in ("src", "out", "ckpt"))
    caps = catalogue.captures(spark, "/root/testdata/sf0.001")
    first, second = caps.where("page_id % 3 < 2"), caps.where("page_id % 3 = 2")
    write_products(first.repartition(3), src, "json", "append")
    run = lambda: stream_products(spark, src, out, ckpt, name="test_products", src_fmt="json", max_files_per_trigger=2)
    run().awaitTermination(600)
    batch = extract_products(first).select(*OUTPUT_COLUMNS)
    assert _rows(spark.read.parquet(out)) == _rows(batch)
    write_products(second.repartition(2), src, "json", "append")
    run().awaitTermination(600)  # resumes from the checkpoint
    assert _rows(spark.read.parquet(out)) == _rows(extract_products(caps).select(*OUTPUT_COLUMNS))
