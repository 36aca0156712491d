"""Captures in, responses out.

* S1 ``read_captures``: a table of captured pages with an explicit schema.
* S2 ``validate_requests``: defaults, URL and strategy checks -> (valid, rejected).
* S3 ``resolve_captures``: one capture per request, HTTPX first when it is
  usable and yields a title, else PLAYWRIGHT, else an error.
* S4 ``to_response``: success / data / error / strategy_used / debug.
* S5 ``write_products``: JSON or columnar sink.

Scale: extraction runs on every capture first (narrow); the product struct
crosses one exchange. One partial aggregate reduces all captures of a URL to a
row, so a URL captured millions of times cannot skew the join; each request row
then finds its row 1:1, and nothing is grouped after that, so AQE can split a URL
that is requested very often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.functions import vocab
from vitrine.functions.urls import is_http_url
from vitrine.plans.extract import extract_products
from vitrine.sources.metrics import answer_counts, capture_counts, observed, request_counts


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured pages (page_id, url, strategy, html, error); missing columns are NULL."""
    reader = spark.read.format(fmt)
    if fmt in ("json", "csv"):  # no columns of its own: nothing is inferred
        reader = reader.schema(schemas.CAPTURES)
    df = reader.load(path)
    cols = []
    for f in schemas.CAPTURES.fields:
        cols.append(F.col(f.name).cast(f.dataType) if f.name in df.columns
                    else F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def check_requests(requests: DataFrame) -> DataFrame:
    """The requests with their defaults (strategy HTTPX, debug false) and
    ``reject_reason``: NULL where the URL is HTTP(S) with a host and the strategy known."""
    df = requests.withColumn("strategy", F.coalesce(F.col("strategy"), F.lit(vocab.DEFAULT_STRATEGY))) \
                 .withColumn("debug", F.coalesce(F.col("debug"), F.lit(False)))
    url_ok = is_http_url("url").col
    strat_ok = F.col("strategy").isin(*vocab.STRATEGIES)
    reason = (F.when(~url_ok, F.lit("invalid url"))
              .when(~strat_ok, F.lit("invalid strategy")))
    return df.withColumn("reject_reason", reason)


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``check_requests`` parted into (valid, rejected+reason)."""
    checked = check_requests(requests)
    return (checked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            checked.where(F.col("reject_reason").isNotNull()))


def best_per_url(products: DataFrame) -> DataFrame:
    """One row per URL: the usable HTTPX product (with a title) and the usable
    PLAYWRIGHT product of lowest page_id, the PLAYWRIGHT error of lowest
    page_id, and whether there is a PLAYWRIGHT capture at all."""
    ok_html = F.col("html_ok") & F.col("error").isNull() & F.col("shred_error").isNull()
    httpx, playwright = F.col("strategy") == "HTTPX", F.col("strategy") == "PLAYWRIGHT"
    failure = F.coalesce("error", "shred_error")

    def lowest(value, where):
        return F.min_by(F.when(where, value), F.when(where, F.col("page_id")))

    return products.groupBy("url").agg(
        lowest(F.col("product"), httpx & ok_html & F.col("product.title").isNotNull()).alias("httpx"),
        lowest(F.col("product"), playwright & ok_html).alias("playwright"),
        lowest(failure, playwright & failure.isNotNull()).alias("pw_error"),
        F.max(playwright).alias("has_pw"))


def resolve_captures(captures: DataFrame, requests: DataFrame, observe: dict[str, Observation] | None = None) -> DataFrame:
    """S3: extract all captures, then pick one per request row.

    ``observe`` may name observations for ``requests``, ``captures`` and
    ``answers``: they hold the counts of ``sources.metrics`` after the action.

    Returns request_id, url, debug, strategy_requested, strategy_used,
    product (NULL when nothing usable) and error. The products are the probe
    side of a sort-merge join, never broadcast: their size grows with the data.
    """
    caps = captures.withColumn("html_ok", F.coalesce(F.col("html") != "", F.lit(False)))
    observe = observe or {}
    products = observed(extract_products(caps), observe.get("captures"), capture_counts())
    best = best_per_url(products)
    checked = observed(check_requests(requests), observe.get("requests"), request_counts())
    valid = checked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    joined = valid.withColumnRenamed("strategy", "requested").join(best.hint("merge"), "url", "left")
    # a PLAYWRIGHT request skips the HTTPX capture
    joined = joined.withColumn("httpx", F.when(F.col("requested") != "PLAYWRIGHT", F.col("httpx")))
    product = F.coalesce("httpx", "playwright")
    answers = joined.select(
        "request_id", "url", "debug", F.col("requested").alias("strategy_requested"),
        F.when(F.col("httpx").isNotNull(), F.lit("HTTPX"))
         .when(F.col("playwright").isNotNull(), F.lit("PLAYWRIGHT")).alias("strategy_used"),
        product.alias("product"),
        F.when(product.isNull(), F.coalesce(
            F.col("pw_error"),
            F.when(~F.coalesce("has_pw", F.lit(False)), F.lit("no PLAYWRIGHT capture")),
            F.lit("PLAYWRIGHT capture unusable"))).alias("error"))
    return observed(answers, observe.get("answers"), answer_counts())


def to_response(resolved: DataFrame) -> DataFrame:
    """The response envelope; a failed request has NULL data and the error."""
    ok = F.col("product").isNotNull()
    return resolved.select(
        "request_id",
        F.struct(ok.alias("success"), F.col("product").alias("data"),
                 F.when(~ok, F.col("error")).alias("error"),
                 F.when(ok, F.col("strategy_used")).alias("strategy_used"),
                 F.coalesce(F.col("debug"), F.lit(False)).alias("debug")).alias("response"))


def write_products(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Write records as JSON lines or a columnar format."""
    df.write.mode(mode).format(fmt).save(path)
