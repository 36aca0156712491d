"""What the shredder notes in its sweep, against plain searches on random nested pages; growth; the long-form joins."""

import random
import time

import duckdb
import pytest

from vitrine.operators import longform as L
from vitrine.operators.shred import OTHER_BIT, TAG_BITS, explode_nodes, parse_outline, shred_pages
from vitrine.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def random_page(rng, n):
    out, open_ = [], []
    for i in range(n):
        tag = rng.choice(["div", "p", "table", "tr", "td", "th", "span", "label", "custom-x", "img", "dl"])
        attrs = [a for a in (' itemscope itemtype="x/Product"', ' itemprop="name"', ' typeof="Product"', ' property="schema:name"', f' id="i{rng.randint(0, 9)}"',
                             f' for="i{rng.randint(0, 12)}"', ' id=""') if rng.random() < 0.25]
        out.append(f"<{tag}{''.join(attrs)}>{rng.choice(['', 't', ' 1 '])}")
        if tag != "img":
            open_.append(tag)
        while open_ and rng.random() < 0.45:
            out.append(f"</{open_.pop()}>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_outline_equals_plain_searches(seed):
    rows, _, outline = parse_outline(random_page(random.Random(seed), 120))
    within = {i: [a[0] for a in rows if a[0] < i <= a[1]] for i in range(len(rows))}  # ancestors, outermost first
    for syntax, scope, prop in (("microdata", "itemscope", "itemprop"), ("rdfa", "typeof", "property")):
        scopes = [r[0] for r in rows if scope in r[5]]
        want = {s: [] for s in scopes}
        for r in rows:
            around = [a for a in within[r[0]] if a in want]
            if prop in r[5] and scope not in r[5] and around:
                want[around[-1]].append(r[0])
        assert {x["ord"]: x["props"] for x in outline["scopes"] if x["syntax"] == syntax} == want
    trs = [r[0] for r in rows if r[4] == "tr"]
    cells = {t: [r[0] for r in rows if r[4] in ("td", "th") and t in within[r[0]]][:2] for t in trs}
    assert [x and [x["c1"], x["c2"]] for x in outline["rows"]] == [cells[t] if len(cells[t]) == 2 else None for t in trs]
    for t in outline["tables"]:
        assert trs[t["r0"]:t["r1"]] == [x for x in trs if t["ord"] in within[x]]
    assert [t["ord"] for t in outline["tables"]] == [r[0] for r in rows if r[4] == "table"]
    for r in rows:
        below = 0
        for d in rows:
            if r[0] in within[d[0]]:
                below |= 1 << TAG_BITS.get(d[4], OTHER_BIT)
        assert r[11] == below < 1 << 63
        named = r[5].get("for") if r[4] == "label" else None
        assert r[12] == next((x[0] for x in rows if named and x[5].get("id") == named), None)


def nested_scopes(n):
    return "<div itemscope itemtype='x/Product'><p itemprop=name>a</p>" * (n // 2) + "</div>" * (n // 2) + \
        "<div itemscope itemtype='x/Product'><p itemprop=name>b</p><p itemprop=sku>c</p></div>" * (n // 2)


def test_sweep_takes_linear_time():
    def seconds(html):
        t = time.perf_counter()
        parse_outline(html)
        return time.perf_counter() - t

    def rows(n):
        return "<table><tr><td>" * (n // 2) + "<label for=a></label>" * n + "<table>" + "<tr><td>k<td>v</tr>" * n + "</table>"

    for page in (nested_scopes, rows):
        seconds(page(500))
        assert min(seconds(page(8000)) for _ in range(3)) < 40 * min(seconds(page(500)) for _ in range(3))


def test_many_scopes_in_time(spark):
    from vitrine.plans.extract import with_structured

    def seconds(n):
        df = with_structured(shred_pages(spark.createDataFrame([("https://x.example/", nested_scopes(n))], "url string, html string"), num_partitions=None))
        t = time.perf_counter()
        row = df.selectExpr("size(md) AS n", "md[size(md) - 1] AS last").first()
        assert row["n"] == n and (row["last"]["name"], row["last"]["sku"]) == ("b", "c")
        return time.perf_counter() - t

    seconds(100)
    assert seconds(10_000) < 30


@pytest.mark.parametrize("mode", L.MODES)
def test_contained_equals_intervals(spark, mode):
    pages = [(i, random_page(random.Random(i), 80)) for i in range(12)] + [(100, None), (101, "")]
    nodes = explode_nodes(shred_pages(spark.createDataFrame(pages, "page_id long, html string").repartition(3)), "page_id", with_text=False)
    from pyspark.sql import functions as F

    found = L.contained(nodes, F.col("tag").isin("div", "table"), F.col("tag").isin("p", "td", "div"), mode=mode)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    want = []
    for page, html in pages:
        rows = parse_outline(html)[0] if html else []
        for d in rows:
            around = [a for a in rows if a[4] in ("div", "table") and a[0] < d[0] <= a[1]]
            if d[4] in ("p", "td", "div") and around:
                chosen = around if mode == "all" else around[-1:] if mode == "nearest" else [a for a in around if a[0] == d[2]]
                want += [(page, a[0], d[0]) for a in chosen]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_sweep_keeps_only_the_open_elements():
    sweep, most = L._Sweep("nearest"), 0
    for i in range(100_000):
        sweep.row((1,), i, i + (1 if i % 2 == 0 else 0), 0, True, True)
        most = max(most, len(sweep.stack))
    assert most <= 2


def test_semi_and_anti_joins_part_the_pages(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "<b>x</b>"), (2, "<i>x</i>"), (2, "<i>x</i>"), (3, None)], "page_id long, html string")
    nodes = explode_nodes(shred_pages(pages), "page_id")
    assert [r.page_id for r in L.with_match(pages, nodes, F.col("tag") == "b").collect()] == [1]
    assert sorted(r.page_id for r in L.without_match(pages, nodes, F.col("tag") == "b").collect()) == [2, 2, 3]
    with pytest.raises(ValueError):
        L.leaves(nodes, ["custom-x"])


def test_texts_are_cut_before_rows_are_spread(spark):
    df = explode_nodes(shred_pages(spark.createDataFrame([(1, "<p>a<b>é</b>c</p>")], "page_id long, html string")), "page_id")
    assert [(r.tag, r.text) for r in df.collect()] == [("p", "aéc"), ("b", "é")]
    generate = df._jdf.queryExecution().optimizedPlan().toString()
    assert "page_text" not in generate.split("Generate")[0]
