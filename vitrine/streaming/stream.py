"""The request loop re-aimed as Structured Streaming.

A folder of capture files is watched; every micro-batch runs the same narrow
extraction plan as the batch job (shred -> expressions, no shuffle, no state)
and appends product rows to the sink, one for each capture. Answering requests
from captures of both strategies (S3), which may arrive in different
micro-batches, needs state: see ``streaming.resolve``.

Progress is checkpointed under the folder that the caller names (shared by the
cluster, and the same after a restart), so a restarted query resumes where it
stopped and appends nothing twice; a lost executor only re-runs its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrine import schemas
from vitrine.plans.extract import extract_products
from vitrine.sources.metrics import capture_counts, observed

OUTPUT_COLUMNS = ["page_id", "url", "strategy", "error", "shred_error", "product", "declared_stock"]


def capture_stream(spark: SparkSession, src_dir: str, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.CAPTURES).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(src_dir)


def stream_products(spark: SparkSession, src_dir: str, out_dir: str, checkpoint_dir: str,
                    name: str = "products", src_fmt: str = "parquet", fmt: str = "parquet",
                    max_files_per_trigger: int | None = None,
                    processing_time: str | None = None) -> StreamingQuery:
    """Watch ``src_dir`` for capture files (``src_fmt``) and append extracted
    products to ``out_dir`` (``fmt``); without ``processing_time`` the query
    ends when all files that are there have been read."""
    caps = capture_stream(spark, src_dir, src_fmt, max_files_per_trigger).withColumn("html_ok", F.coalesce(F.col("html") != "", F.lit(False)))
    # the counts of each micro-batch are in progress.observedMetrics["captures"]
    out = observed(extract_products(caps), "captures", capture_counts()).select(*OUTPUT_COLUMNS)
    writer = (out.writeStream.format(fmt).outputMode("append").option("path", out_dir)
              .option("checkpointLocation", checkpoint_dir).queryName(name))
    return (writer.trigger(processingTime=processing_time) if processing_time
            else writer.trigger(availableNow=True)).start()
