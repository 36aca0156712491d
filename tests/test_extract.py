"""Round trip on the rendered catalogue and the raw pages, against the SQL oracles."""

import duckdb
import pytest

from vitrine.plans.extract import extract_products
from vitrine.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["part", "pages", "documents", "lineitem", "supplier", "conversations"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    res = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})")
    assert sorted(d[0] for d in res.description) == cols
    assert _norm(got) == _norm(res.fetchall())


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_plans_without_a_job_and_without_an_exchange(spark):
    from vitrine.plans.extract import extract_products
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages = pages.repartition(2)  # under AQE a look at its partitions would run it
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    df = extract_products(pages)
    plan = _plan(df)
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert plan.count("Exchange") == 1  # only the test's own repartition
    assert "MapInArrow" in plan


def test_resolution_moves_products_once_and_never_broadcasts_them(spark):
    from vitrine.sources import captures as K
    from vitrine.sources import catalogue
    plan = _plan(K.resolve_captures(catalogue.captures(spark, SF), catalogue.requests(spark, SF)))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # products by url, requests by url


def test_jsonld_does_not_depend_on_the_session(spark):
    from vitrine.plans.extract import extract_products
    html = ('<script type="application/ld+json">{"@type":"Product","name":"Old","name":"Lamp","weight":NaN,'
            '"offers":{"price":"9.50"},"aggregateRating":{"ratingValue":"4,5","reviewCount":"1,234"}}</script>')
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false") == "false"
    p = extract_products(spark.createDataFrame([("https://x.example/", html)], "url string, html string")).first()["product"]
    assert (p["title"], p["price"]) == ("Lamp", "9.50")
    assert (p["reviews"]["rating_average"], p["reviews"]["review_count"]) == (4.5, 1234)


def test_errors_are_those_of_the_lowest_page(spark):
    from vitrine.sources import captures as K
    caps = spark.createDataFrame([(i, "https://x.example/", "PLAYWRIGHT", None, f"e{i}") for i in (5, 3, 9)],
                                 "page_id long, url string, strategy string, html string, error string").repartition(3)
    req = spark.createDataFrame([(1, "https://x.example/", None, None)] * 2, "request_id long, url string, strategy string, debug boolean")
    assert [r["error"] for r in K.resolve_captures(caps, req).collect()] == ["e3", "e3"]


def test_gallery_searches_a_pages_images_once(spark):
    from vitrine.operators import fields as P

    assert P.gallery_parts().sql.count("IN ('img')") == 1
    html = ('<img data-old-hires="/a.jpg"><img data-old-hires="data:x"><img gallery="" zoom="/b.jpg 1x, /c.jpg 2x"><img main="/a.jpg">'
            '<img data-old-hires="/d.jpg"><img data-old-hires="/e.jpg"><img data-old-hires="">')
    rows = spark.createDataFrame([(1, "https://x.example/p", html), (2, "https://x.example/p", "<p>none</p>"), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: (r.images, r.gallery) for r in extract_products(rows, fields=["images", "gallery"]).collect()}
    u = "https://x.example"
    assert got == {1: ([f"{u}/a.jpg", f"{u}/d.jpg"], [f"{u}/a.jpg", f"{u}/d.jpg", f"{u}/e.jpg", f"{u}/c.jpg"]), 2: ([], []), 3: (None, None)}


def test_variants_read_each_group_once(spark):
    from vitrine.operators import fields as P

    assert P.variants().sql.count("try_parse_json") == 1
    li = '<li data-asin="a"><b class="swatch-title-text-display">%s</b></li>'
    html = ("<ul data-a-button-group='{\"name\": \"size_name\"}'>" + li % "XL" + li % "XL" + "</ul><ul data-a-button-group='size'>" + li % "S" + "</ul>"
            "<ul data-a-button-group='Style_Name'>" + li % "Slim" + "</ul><ul data-a-button-group='{}'>" + li % "lost" + "</ul>"
            '<select id="size"><option value="1">M</option><option value="2">M</option><option value="3">S</option></select>'
            '<select name="color"><option value="1">Teal</option></select><button>xl red</button><button>L teal</button>')
    rows = spark.createDataFrame([(1, "https://x.example/p", html), (2, "https://x.example/p", "<p>none</p>"), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r.variants and tuple(r.variants) for r in extract_products(rows, fields=["variants"]).collect()}
    assert got == {1: (["XL", "S", "M", "M", "L"], ["Teal", "RED", "TEAL"], ["Slim"], []), 2: ([], [], [], []), 3: None}
