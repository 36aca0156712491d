"""Rendered pages are dealt over the tasks, shredded once a query, and only the fields asked for are extracted."""

import pytest

from vitrine.functions import vocab
from vitrine.plans.extract import extract_products
from vitrine.plans.queries import QUERIES
from vitrine.sources import catalogue, details, layouts


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A part table in a single file: odd names, a key that comes twice and one that is null."""
    folder = tmp_path_factory.mktemp("parts")
    keys = [*range(1, 241), 7, 18, None]
    rows = [(k, f"red widget {i}", f"Brand#{i % 5}", "SMALL TIN", i % 50 + 1, 900.0 + i) for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double") \
        .coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder), keys


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("source", [catalogue.captures, details.pages, layouts.pages])
def test_pages_of_one_file_are_dealt_over_the_tasks(spark, parts, source):
    pages = source(spark, parts[0]).select("page_id").rdd.glom().map(len).collect()
    assert len(pages) >= 2 * spark.sparkContext.defaultParallelism
    assert max(pages) <= 2 * sum(pages) / len(pages)


def test_dealing_keeps_every_page(spark, parts):
    folder, keys = parts
    count = lambda rows: sorted(rows, key=lambda r: (r is None, r))
    for source in (details.pages, layouts.pages):
        assert count([r["page_id"] for r in source(spark, folder).collect()]) == count(keys)
    caps = catalogue.captures(spark, folder).collect()
    assert count([r["page_id"] for r in caps if r["strategy"] == "HTTPX"]) == count([None if k is None else 2 * k for k in keys])
    again = [r for r in caps if r["strategy"] == "PLAYWRIGHT"]
    assert count([r["page_id"] for r in again]) == count([2 * k + 1 for k in keys if k is not None and k % 20 in (8, 9)])
    assert all(r["html"] and r["error"] is None for r in again)
    assert {r["page_id"] // 2 % 10 for r in caps if r["error"]} == {9} == {r["page_id"] // 2 % 10 for r in caps if r["html"] is None and r["page_id"]}


@pytest.mark.parametrize("name", ["label_targets", "table_rows", "list_children"])
def test_long_form_queries_parse_each_page_once(spark, parts, name):
    out = QUERIES[name](spark, parts[0])
    assert "part.parquet" not in _plan(out)  # every side reads the rows noted in one pass
    assert out.count() > 0


def test_fields_alone_equal_those_of_the_product(spark, parts):
    caps = catalogue.captures(spark, parts[0])
    whole = extract_products(caps).select("page_id", "product.stock", "product.price", "product.images", "declared_stock")
    alone = extract_products(caps, fields=["stock", "price", "images"]).select(*whole.columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, alone.collect()))


def test_jobs_of_other_fields_do_not_run(spark, parts):
    unseen = next(a for a in vocab.GALLERY_IMG_ATTRS if a not in str(catalogue.STYLES))  # no word of the pages themselves
    assert unseen not in _plan(QUERIES["product_stock"](spark, parts[0]))
    assert unseen in _plan(QUERIES["product_images"](spark, parts[0]))


def test_title_does_not_read_the_other_jsonld_values(spark, parts):
    assert "highPrice" not in _plan(QUERIES["product_title"](spark, parts[0]))  # no word of the pages themselves
    assert "highPrice" in _plan(QUERIES["product_price"](spark, parts[0]))


def test_jsonld_values_keep_their_products_order(spark):
    html = ('<script type="application/ld+json">[{"@type": "Product", "sku": "s", "offers": {"price": "1", "availability": "InStock"}},'
            '{"@type": "Product", "name": "n", "sku": "t", "offers": [{"price": "2"}, {"price": "3", "availability": "OutOfStock"}]}]</script>')
    caps = spark.createDataFrame([(1, "https://x.example/", html)], "page_id long, url string, html string")
    row = extract_products(caps, fields=["title", "sku", "price"]).first()
    assert (row.title, row.sku, row.price, row.declared_stock) == ("n", "s", "1", "OutOfStock")
