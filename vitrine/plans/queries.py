"""Registered queries (one per SURVEY section-2 operator) and their DuckDB oracles.

Every query reads the given tables (or pages Spark renders from ``part``) in
full. Results are flat columns; arrays are joined into strings so the value
hashes of Spark and DuckDB compare.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.functions import vocab
from vitrine.functions.price import currency_from_symbol, discount_pct, parse_price
from vitrine.functions.sqltext import X
from vitrine.functions.text import (clean_text, contains_any, digits_only, match_colors,
                                    match_sizes, normalise_key)
from vitrine.functions.urls import resolve_url
from vitrine.operators import longform as L
from vitrine.operators import nodes as N
from vitrine.operators import vocabulary as L_VOCAB
from vitrine.operators.shred import explode_nodes, node_text, shred_pages
from vitrine.plans.extract import extract_products
from vitrine.session import ensure_checkpoint_dir
from vitrine.sources import captures as K
from vitrine.sources import catalogue, details, layouts

Q = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _x(e: X) -> "F.Column":
    return e.col


# ----------------------------------------------------------------- pages (T)
def page_titles(spark, sf):
    """H1 + N1 + P2: title of every raw page (its h1 on this table)."""
    return extract_products(_t(spark, sf, "pages")).select("page_id", F.col("product.title").alias("title"))


def page_node_counts(spark, sf):
    """H1: elements per page."""
    return shred_pages(_t(spark, sf, "pages"), needed_attrs=()).select("page_id", F.size("nodes").alias("n_nodes"))


def tag_histogram(spark, sf):
    """H3: long form, element count per tag over all pages (partial aggregation)."""
    nodes = explode_nodes(shred_pages(_t(spark, sf, "pages"), needed_attrs=()), "page_id", with_text=False)
    return nodes.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def select_by_attr(spark, sf):
    """text of the first ``div.ad`` (class token) of every page."""
    sh = shred_pages(_t(spark, sf, "pages"))
    node = N.first_node(N.all_of(N.tag_in("div"), N.has_class("ad")))
    return sh.select("page_id", clean_text(node_text(node)).alias("ad_text").col)


def select_by_tag(spark, sf):
    """number of ``p`` elements per page."""
    sh = shred_pages(_t(spark, sf, "pages"))
    return sh.select("page_id", F.size(N.select_nodes(N.tag_in("p")).col).alias("n_p"))


def resolve_nav_links(spark, sf):
    """N4 + J2/J3: every nav link href resolved against the page URL, in order."""
    sh = shred_pages(_t(spark, sf, "pages"))
    links = N.select_nodes(N.all_of(N.tag_in("a"), N.has_attr("href")))
    from vitrine.functions.sqltext import F as SF
    resolved = SF.transform(links, lambda a: resolve_url(SF.col("url"), a["attrs"]["href"]))
    return sh.select("page_id", SF.array_join(resolved, " ").alias("links").col)


def page_products(spark, sf):
    """P21 on raw pages, flattened."""
    p = extract_products(_t(spark, sf, "pages"), fields=["title", "canonical_url", "price", "currency", "stock", "availability", "brand", "sku", "images"])
    return p.select("page_id", "title", "canonical_url", "price", "currency", "stock", "availability", "brand",
                    "sku", F.size("images").alias("n_images"))


def stock_status(spark, sf):
    """P8 (J5, F6, N18) on raw pages."""
    p = extract_products(_t(spark, sf, "pages"), fields=["stock", "availability"])
    return p.select("page_id", "stock", "availability")


def valid_requests(spark, sf):
    """S2 on page URLs as requests, some of them altered so that both outcomes occur."""
    url = F.expr("""CASE page_id % 10 WHEN 1 THEN concat('ftp', url) WHEN 2 THEN concat(url, '|a{b}') WHEN 3 THEN concat(url, '/a b')
        WHEN 4 THEN 'https://?no-host' WHEN 5 THEN 'https://my_shop.example.com:8080/p' WHEN 6 THEN NULL
        WHEN 7 THEN 'https://bad host/' WHEN 8 THEN '/relative' ELSE url END""")
    strategy = F.expr("CASE page_id % 20 WHEN 9 THEN 'CURL' WHEN 10 THEN 'PLAYWRIGHT' END")
    req = _t(spark, sf, "pages").select(F.col("page_id").alias("request_id"), url.alias("url"), strategy.alias("strategy"),
                                        F.expr("nullif(page_id % 3 = 0, false)").alias("debug"))
    valid, rejected = K.validate_requests(req)
    return valid.select("request_id", "strategy", "debug", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        rejected.select("request_id", "strategy", "debug", "reject_reason"))


# ----------------------------------------------------------------- scalars (T)
def clean_text_q(spark, sf):
    """N1 over whole documents."""
    return _t(spark, sf, "documents").select("doc_id", clean_text("text").alias("text").col)


def _price_inputs(spark, sf):
    li = _t(spark, sf, "lineitem")
    p = F.format_string("%.2f", F.col("l_extendedprice"))
    old = F.format_string("%.2f", F.col("l_extendedprice") + F.col("l_quantity"))
    txt = (F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("Was $"), old, F.lit(" Now $"), p))
           .when(F.col("l_linenumber") % 4 == 1, F.concat(F.regexp_replace(p, "\\.", ","), F.lit(" €")))
           .when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit("EUR "), p))
           .otherwise(F.concat(F.lit("£"), p, F.lit(" / ¥1"))))
    return li.select("l_orderkey", "l_linenumber", txt.alias("txt"))


def parse_price_q(spark, sf):
    """N2 over formatted lineitem prices."""
    return _price_inputs(spark, sf).select("l_orderkey", "l_linenumber",
                                           parse_price("txt").alias("price").col)


def currency_symbol(spark, sf):
    """N3 over the same texts (list order decides)."""
    return _price_inputs(spark, sf).select("l_orderkey", "l_linenumber",
                                           currency_from_symbol(X("txt")).alias("currency").col)


def discount_pct_q(spark, sf):
    """Discounted vs list price of every line item."""
    li = _t(spark, sf, "lineitem")
    p = F.format_string("%.2f", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    o = F.format_string("%.2f", F.col("l_extendedprice"))
    return li.select("l_orderkey", "l_linenumber", p.alias("p"), o.alias("o")).select(
        "l_orderkey", "l_linenumber", discount_pct(X("p"), X("o")).alias("discount").col)


def digits_only_q(spark, sf):
    """N8 on supplier names."""
    return _t(spark, sf, "supplier").select("s_suppkey", digits_only("s_name").alias("digits").col)


def normalise_key_q(spark, sf):
    """N10 on part brands."""
    return _t(spark, sf, "part").select("p_partkey", normalise_key("p_brand").alias("key").col)


def match_sizes_q(spark, sf):
    """N16 on part type and size."""
    part = _t(spark, sf, "part")
    txt = F.concat_ws(" ", "p_type", F.col("p_size").cast("string"))
    return part.select("p_partkey", txt.alias("txt")).select(
        "p_partkey", F.array_join(match_sizes("txt").col, ",").alias("sizes"))


def match_colors_q(spark, sf):
    """N17 on part names."""
    return _t(spark, sf, "part").select(
        "p_partkey", F.array_join(match_colors("p_name").col, ",").alias("colors"))


def contains_any_q(spark, sf):
    """N18 / A13 on whole documents."""
    d = _t(spark, sf, "documents")
    return d.select("doc_id", contains_any("text", vocab.BUY_KEYWORDS).alias("buy").col,
                    contains_any("text", vocab.OUT_OF_STOCK_KEYWORDS).alias("oos").col)


def short_text_filter(spark, sf):
    """F8 on cleaned documents."""
    d = _t(spark, sf, "documents").select("doc_id", clean_text("text").alias("t").col)
    return d.where(N.short_text(X("t")).col).select("doc_id", F.col("t").alias("text"))


# ----------------------------------------------------------------- folds (T)
def first_by_order(spark, sf):
    """A2 long form: text of each conversation's first turn (partial min_by)."""
    c = _t(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"))


def last_by_order(spark, sf):
    """A4 long form: text of each conversation's last turn."""
    c = _t(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_text"))


def shortest_by_length(spark, sf):
    """A5 long form: shortest document per language, ties to the lowest id.

    Lengths and ids are aggregated without the texts; the winners (one per
    language) fetch theirs afterwards."""
    d = _t(spark, sf, "documents")
    best = d.groupBy("lang").agg(F.min(F.struct(F.length("text").alias("n"), F.col("doc_id"))).alias("b")) \
        .select(F.col("b.doc_id").alias("winner"))
    return d.join(best, d["doc_id"] == best["winner"]).select("lang", "doc_id", "text")


def distinct_keep_order(spark, sf):
    """A7 long form: roles of each conversation in first-seen order.

    First turn per (conversation, role) is a partial aggregate; the per-
    conversation list then holds one entry per distinct role only."""
    c = _t(spark, sf, "conversations")
    first = c.groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    roles = first.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("t", "role"))).alias("r"))
    return roles.select("conv_id", F.array_join(F.col("r.role"), ",").alias("roles"))


def union_ranked(spark, sf):
    """<title> text then h1 text, one selection after the other."""
    sh = shred_pages(_t(spark, sf, "pages"))
    from vitrine.functions.sqltext import F as SF
    arr = SF.concat(N.select_nodes(N.tag_in("title")), N.select_nodes(N.tag_in("h1")))
    return sh.select("page_id", SF.array_join(
        SF.transform(arr, lambda n: clean_text(node_text(n))), " | ").alias("texts").col)


# ----------------------------------------------------------------- catalogue (C)
def _field_query(fields, *cols):
    """Catalogue extraction of some product fields (the jobs of the others don't
    run), and the columns made of them: names or zero-arg builders."""
    def q(spark, sf):
        return extract_products(catalogue.captures(spark, sf), fields=fields).select(
            "page_id", *[c if isinstance(c, str) else c() for c in cols or fields])
    return q


def _joined(c, sep=","):
    return F.coalesce(F.array_join(c, sep), F.lit(""))


def _chars():
    return F.coalesce(F.array_join(F.transform(F.map_entries(F.col("characteristics")),
                                               lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"),
                      F.lit(""))


def products(spark, sf):
    """P21 + S2-S4 flagship: resolved responses for every catalogue request."""
    caps = catalogue.captures(spark, sf)
    req = catalogue.requests(spark, sf)
    resp = K.to_response(K.resolve_captures(caps, req))
    return resp.select(
        "request_id", "response.success", "response.strategy_used", "response.error",
        F.col("response.data.title").alias("title"), F.col("response.data.price").alias("price"),
        F.col("response.data.currency").alias("currency"), F.col("response.data.stock").alias("stock"),
        F.col("response.data.brand").alias("brand"), F.col("response.data.sku").alias("sku"))


def product_json(spark, sf):
    """Responses written as JSON lines, read again as text and looked into."""
    caps = catalogue.captures(spark, sf)
    resp = K.to_response(K.resolve_captures(caps, catalogue.requests(spark, sf)))
    path = f"{ensure_checkpoint_dir(spark)}/vitrine-json-{uuid.uuid4().hex}"
    K.write_products(resp, path, "json")
    lines = spark.read.text(path)
    return lines.select(*[F.get_json_object("value", f"$.{k}").alias(a) for a, k in [
        ("request_id", "request_id"), ("success", "response.success"), ("error", "response.error"),
        ("strategy_used", "response.strategy_used"), ("title", "response.data.title"), ("price", "response.data.price"),
        ("characteristics", "response.data.characteristics.Size"), ("size", "response.data.variants.size[0]"),
        ("rating", "response.data.reviews.rating_average")]])


def captured_titles(spark, sf):
    """Captures stored as JSON without the error column, read with the schema of captures, then extracted."""
    path = f"{ensure_checkpoint_dir(spark)}/vitrine-captures-{uuid.uuid4().hex}"
    K.write_products(catalogue.captures(spark, sf).drop("error"), path, "json")
    caps = K.read_captures(spark, path, "json")
    return extract_products(caps).select("page_id", "strategy", "error", "shred_error", F.col("product.title").alias("title"))


def resolved_requests(spark, sf):
    """PLAYWRIGHT requests, repeated requests, and several captures of a URL (the lowest page_id counts)."""
    caps = catalogue.captures(spark, sf)
    again = caps.where("page_id % 6 = 0").withColumn("page_id", F.col("page_id") + 10_000_000) \
        .withColumn("html", F.regexp_replace("html", "<h1", "<p>later</p><h1")) \
        .withColumn("html", F.regexp_replace("html", "</title>", " (later)</title>"))
    req = catalogue.requests(spark, sf).withColumn("strategy", F.expr("CASE WHEN request_id % 4 = 0 THEN 'PLAYWRIGHT' WHEN request_id % 4 = 1 THEN 'HTTPX' END"))
    req = req.unionByName(req.where("request_id % 7 = 0"))
    found = K.resolve_captures(caps.unionByName(again), req)
    return found.select("request_id", "strategy_requested", "strategy_used", F.col("product.title").alias("title"), "error")


def _detail_products(spark, sf, *fields):
    return extract_products(details.pages(spark, sf), fields=list(fields))


def detail_fields(spark, sf):
    """P1-P9, P12-P14 and F12 on the detail pages."""
    fields = ("canonical_url", "title", "price", "old_price", "currency", "description", "brand", "sku", "category", "stock")
    return _detail_products(spark, sf, *fields).select("page_id", *fields, "declared_stock")


def detail_lists(spark, sf):
    """P10, P11, P15-P18 (A6, A12, F11, J1, J6, N5, N6) on the detail pages."""
    return _detail_products(spark, sf, "images", "gallery", "characteristics", "variants").select(
        "page_id", _joined(F.col("images"), " ").alias("images"), _joined(F.col("gallery"), " ").alias("gallery"),
        _chars().alias("characteristics"), _joined(F.col("variants.size")).alias("sizes"), _joined(F.col("variants.color")).alias("colors"),
        _joined(F.col("variants.style")).alias("styles"), _joined(F.col("variants.pattern")).alias("patterns"))


def detail_reviews(spark, sf):
    """P19, P20 and H2 on the detail pages: numbers, contents of the reviews, base URL."""
    from vitrine.plans.extract import product_columns, with_structured
    sh = with_structured(shred_pages(details.pages(spark, sf))).withColumn("base", F.col("base_url"))
    text = F.transform("reviews.list", lambda r: F.concat_ws("|", *[F.coalesce(r[k], F.lit("")) for k in ("author", "date", "rating", "text")]))
    return product_columns(sh, ["reviews"]).select("page_id", F.col("base").alias("base_url"), "reviews.rating_average", "reviews.review_count",
                                                   _joined(text, ";").alias("reviews"))


def _catalogue_structured(spark, sf):
    from vitrine.plans.extract import with_structured
    return with_structured(shred_pages(catalogue.captures(spark, sf)))


def base_url(spark, sf):
    """H2: base URL of every raw page (no <base> there: the page URL)."""
    from vitrine.operators.shred import base_url_expr
    return shred_pages(_t(spark, sf, "pages")).select("page_id", base_url_expr().alias("base_url").col)


def jsonld_products(spark, sf):
    """H4/H5: JSON-LD documents and product nodes per catalogue page."""
    from vitrine.operators.structured import jsonld_items
    st = _catalogue_structured(spark, sf)
    return st.select("page_id",
                     F.coalesce(F.size(jsonld_items().col), F.lit(0)).alias("n_items"),
                     F.coalesce(F.size("jl"), F.lit(0)).alias("n_products"))


def _scope_names(col):
    def q(spark, sf):
        st = _catalogue_structured(spark, sf)
        first = F.try_element_at(F.col(col), F.lit(1))
        return st.select("page_id", first["name"].alias("name"), first["price"].alias("price"))
    return q


def meta_tags(spark, sf):
    """H8: last-wins meta map per catalogue page."""
    st = _catalogue_structured(spark, sf)
    return st.select("page_id", F.col("meta")["og:title"].alias("og_title"),
                     F.col("meta")["product:price:currency"].alias("price_currency"),
                     F.coalesce(F.size("meta"), F.lit(0)).alias("n_meta"))


def enabled_buy_buttons(spark, sf):
    """Enabled buttons and submit inputs per catalogue page."""
    from vitrine.functions.sqltext import F as SF
    sh = shred_pages(catalogue.captures(spark, sf))
    buttons = SF.concat(N.select_nodes(N.tag_in("button")),
                        N.select_nodes(N.all_of(N.tag_in("input"), N.attr_is("type", "submit"))))
    return sh.select("page_id", SF.coalesce(SF.size(SF.filter(buttons, N.enabled())), SF.lit(0))
                     .alias("n_enabled").col,
                     SF.coalesce(SF.size(buttons), SF.lit(0)).alias("n_buttons").col)


def response_envelope(spark, sf):
    """The envelope fields of every catalogue request."""
    resp = K.to_response(K.resolve_captures(catalogue.captures(spark, sf), catalogue.requests(spark, sf)))
    return resp.select("request_id", "response.success", "response.error", "response.strategy_used",
                       "response.debug", F.col("response.data").isNull().alias("no_data"))


def _spread(df, e):
    """One row per element of an array expression of structs, beside page_id."""
    return df.select("page_id", F.inline(e.col))


def testid_prices(spark, sf):
    """Texts of the elements whose test id names a price, but no old one."""
    from vitrine.functions.sqltext import F as SF

    found = N.select_nodes(N.all_of(N.attr_rlike("data-testid", vocab.TESTID_PRICE_RX), N.not_old_price_marker()))
    return _spread(shred_pages(catalogue.captures(spark, sf)), SF.transform(found, lambda n: SF.struct(
        n["attrs"]["data-testid"].alias("testid"), clean_text(node_text(n)).alias("text"))))


def definition_lists(spark, sf):
    """I-th term with i-th value of each definition list, as far as both go."""
    from vitrine.functions.sqltext import F as SF

    lists = N.select_nodes(N.tag_in("dl"))
    pairs = SF.flatten(SF.transform(lists, lambda d: N.zip_pairs(N.select_in(d, N.tag_in("dt")), N.select_in(d, N.tag_in("dd")))))
    return _spread(shred_pages(layouts.pages(spark, sf), needed_attrs=()), SF.transform(pairs, lambda z: SF.struct(
        clean_text(node_text(z["a"])).alias("term"), clean_text(node_text(z["b"])).alias("value"))))


def select_options(spark, sf):
    """the real options of the selects of detail and layout pages (with a value, and no placeholder)."""
    from vitrine.functions.sqltext import F as SF

    def texts(pages):
        options = N.select_nodes(N.all_of(N.tag_in("option"), N.attr_truthy("value")))
        named = SF.transform(options, lambda o: SF.struct(o["attrs"]["value"].alias("value"), clean_text(node_text(o)).alias("text")))
        return _spread(shred_pages(pages), SF.filter(named, lambda o: N.real_option(o["text"])))

    return texts(details.pages(spark, sf)).unionByName(texts(layouts.pages(spark, sf)))


def srcset_pick(spark, sf):
    """What both rules pick from the image lists of the detail pages."""
    from vitrine.functions.sqltext import F as SF
    from vitrine.functions.urls import pick_srcset, pick_srcset_hires

    imgs = N.select_nodes(N.all_of(N.tag_in("img"), N.any_of(N.attr_truthy("data-old-hires"), N.attr_truthy("gallery"))))
    return _spread(shred_pages(details.pages(spark, sf)), SF.transform(imgs, lambda i: SF.struct(
        pick_srcset_hires(i["attrs"]["data-old-hires"]).alias("hires"), pick_srcset(i["attrs"]["gallery"]).alias("generic"))))


def variant_groups(spark, sf):
    """The dimension that each button group's JSON attribute names (NULL where it is no JSON)."""
    from vitrine.functions import variant as V
    from vitrine.functions.sqltext import F as SF

    groups = N.select_nodes(N.all_of(N.tag_in("ul"), N.has_attr("data-a-button-group")))
    return _spread(shred_pages(details.pages(spark, sf)), SF.transform(groups, lambda u: SF.struct(
        u["ord"].alias("ord"), V.variant_dimension(u["attrs"]["data-a-button-group"]).alias("dimension"))))


def run_counts(spark, sf):
    """S2/S4 counts while running: requests, captures and answers of one resolution, observed without another pass."""
    from pyspark.sql import Observation

    seen = {k: Observation(f"{k}_{uuid.uuid4().hex}") for k in ("requests", "captures", "answers")}
    reqs = catalogue.requests(spark, sf)
    reqs = reqs.withColumn("strategy", F.expr("CASE request_id % 7 WHEN 1 THEN 'CURL' WHEN 2 THEN 'PLAYWRIGHT' END")).withColumn(
        "url", F.expr("CASE WHEN request_id % 11 = 3 THEN 'ftp://x' ELSE url END"))
    K.resolve_captures(catalogue.captures(spark, sf), reqs, seen).write.format("noop").mode("overwrite").save()
    rows = [(k, n, int(v or 0)) for k, o in seen.items() for n, v in o.get.items()]
    return spark.createDataFrame(rows, "of string, count string, n long")


def vocabulary_hits(spark, sf):
    """A15 with a vocabulary read from a table: the names and types of all parts within texts about them."""
    part = _t(spark, sf, "part")
    texts = part.select("p_partkey", F.expr("concat(p_name, ' or ', p_type, '-x', p_name, ', (', lower(p_brand), ') un', p_type, ' ', p_type)").alias("text"))
    words = part.select(F.col("p_name").alias("w")).union(part.select("p_type")).union(part.select("p_brand"))
    return L_VOCAB.match_table(texts, "text", words, "w").select("p_partkey", F.array_join("hits", "|").alias("hits"))


# ----------------------------------------------------------------- long form (C)
def _layout_nodes(spark, sf, with_text=True):
    return explode_nodes(shred_pages(layouts.pages(spark, sf)), "page_id", with_text=with_text)


def _clean_node_text():
    return clean_text(X("text")).col


def element_texts(spark, sf):
    """H3: cleaned text of every title, heading and link, in long form."""
    nodes = explode_nodes(shred_pages(_t(spark, sf, "pages")), "page_id")
    return nodes.where(F.col("tag").isin("h1", "a", "title")).select("page_id", "tag", _clean_node_text().alias("text"))


def _noted(df, label):
    """The few rows that a query joins with each other, written once under the shared
    checkpoint folder: every side of the joins would parse all pages again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/vitrine-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def label_targets(spark, sf):
    """J1 in long form: labels with their targets' texts (repeated and missing ids), and the array form's text beside it."""
    from vitrine.functions.sqltext import F as SF

    is_label = N.all_of(N.tag_in("label"), N.attr_truthy("for"))
    parts = [f.name for f in schemas.NODE.fields]
    named = SF.transform(N.select_nodes(N.any_of(is_label, N.attr_truthy("id"))), lambda n: SF.struct(
        *[n[k].alias(k) for k in parts], SF.when(is_label(n), N.label_target_text(n)).alias("array_text")))
    nodes = _noted(_spread(shred_pages(layouts.pages(spark, sf)), named), "labels")
    same = nodes.where((F.col("tag") == "label") & (F.col("attrs")["for"] != "")).select("page_id", "ord", "array_text")
    found = L.label_targets(nodes.drop("array_text"))
    return found.join(same, ["page_id", "ord"]).select("page_id", "ord", "target_text", "array_text")


def table_rows(spark, sf):
    """J2 in long form: each table's rows (of nested tables too) with their first two cells, in order."""
    is_table, is_row, is_cell = F.col("tag") == "table", F.col("tag") == "tr", F.col("tag").isin("th", "td")
    nodes = _noted(_layout_nodes(spark, sf).where(is_table | is_row | is_cell), "tables")
    rows = L.contained(nodes, is_table, is_row).select("page_id", F.col("outer_ord").alias("table_ord"), F.col("ord").alias("row_ord"))
    cells = L.contained(nodes, is_row, is_cell).select("page_id", F.col("outer_ord").alias("row_ord"), F.col("ord").alias("cell_ord"))
    place = F.row_number().over(Window.partitionBy("page_id", "row_ord").orderBy("cell_ord"))
    first = cells.withColumn("place", place).where("place <= 2")
    texts = nodes.where(is_cell).select("page_id", F.col("ord").alias("cell_ord"), _clean_node_text().alias("cell"))
    named = nodes.where(is_table).select("page_id", F.col("ord").alias("table_ord"), F.col("attrs")["id"].alias("table_id"))
    pairs = (first.join(texts, ["page_id", "cell_ord"]).groupBy("page_id", "row_ord")
             .agg(F.max(F.when(F.col("place") == 1, F.col("cell"))).alias("key"), F.max(F.when(F.col("place") == 2, F.col("cell"))).alias("value"))
             .where("value IS NOT NULL"))
    return rows.join(pairs, ["page_id", "row_ord"]).join(named, ["page_id", "table_ord"]).select("page_id", "table_id", "key", "value")


def list_children(spark, sf):
    """J3 in long form: list items with the kind of the list that is their parent, and how many lists are around them."""
    is_list, is_item = F.col("tag").isin("ul", "ol"), F.col("tag") == "li"
    nodes = _noted(_layout_nodes(spark, sf).where(is_list | is_item), "lists")
    child = L.contained(nodes, is_list, is_item, mode="child")
    around = L.contained(nodes, is_list, is_item).groupBy("page_id", "ord").agg(F.count(F.lit(1)).alias("n_lists"))
    kinds = nodes.where(is_list).select("page_id", F.col("ord").alias("outer_ord"), F.col("tag").alias("list_tag"))
    texts = nodes.where(is_item).select("page_id", "ord", _clean_node_text().alias("text"))
    return (child.join(kinds, ["page_id", "outer_ord"]).join(texts, ["page_id", "ord"]).join(around, ["page_id", "ord"])
            .select("page_id", "list_tag", "n_lists", "text"))


def leaf_price_candidates(spark, sf):
    """Leaf elements whose text parses as a price (the mask test in long form)."""
    found = L.leaves(_layout_nodes(spark, sf), vocab.LEAF_TAGS)
    texts = found.select("page_id", "tag", _clean_node_text().alias("text"))
    return texts.select("page_id", "tag", "text", parse_price(X("text")).alias("price").col).where(
        "price IS NOT NULL AND length(text) <= 20")


def pages_with_select(spark, sf):
    """Pages that have (left semi) or lack (left anti) a real option."""
    nodes = _noted(_layout_nodes(spark, sf).where("tag = 'option'"), "options")
    pages = layouts.pages(spark, sf).select("page_id")
    real = (F.col("tag") == "option") & (F.col("attrs")["value"] != "") & (_clean_node_text() != "")
    return (L.with_match(pages, nodes, real).select("page_id", F.lit(True).alias("has_option"))
            .unionByName(L.without_match(pages, nodes, real).select("page_id", F.lit(False).alias("has_option"))))


QUERIES: dict[str, Q] = {
    "page_titles": page_titles,
    "page_node_counts": page_node_counts,
    "tag_histogram": tag_histogram,
    "select_by_attr": select_by_attr,
    "select_by_tag": select_by_tag,
    "resolve_url": resolve_nav_links,
    "page_products": page_products,
    "stock_status": stock_status,
    "valid_requests": valid_requests,
    "clean_text": clean_text_q,
    "parse_price": parse_price_q,
    "currency_symbol": currency_symbol,
    "discount_pct": discount_pct_q,
    "digits_only": digits_only_q,
    "normalise_key": normalise_key_q,
    "match_sizes": match_sizes_q,
    "match_colors": match_colors_q,
    "contains_any": contains_any_q,
    "short_text_filter": short_text_filter,
    "first_by_order": first_by_order,
    "last_by_order": last_by_order,
    "shortest_by_length": shortest_by_length,
    "distinct_keep_order": distinct_keep_order,
    "union_ranked": union_ranked,
    "base_url": base_url,
    "jsonld_products": jsonld_products,
    "microdata_products": _scope_names("md"),
    "rdfa_products": _scope_names("rd"),
    "meta_tags": meta_tags,
    "enabled_buy_buttons": enabled_buy_buttons,
    "response_envelope": response_envelope,
    "testid_prices": testid_prices,
    "definition_lists": definition_lists,
    "select_options": select_options,
    "srcset_pick": srcset_pick,
    "variant_groups": variant_groups,
    "run_counts": run_counts,
    "vocabulary_hits": vocabulary_hits,
    "element_texts": element_texts,
    "label_targets": label_targets,
    "table_rows": table_rows,
    "list_children": list_children,
    "leaf_price_candidates": leaf_price_candidates,
    "pages_with_select": pages_with_select,
    "products": products,
    "product_json": product_json,
    "captured_titles": captured_titles,
    "resolved_requests": resolved_requests,
    "detail_fields": detail_fields,
    "detail_lists": detail_lists,
    "detail_reviews": detail_reviews,
    "product_title": _field_query(["title"]),
    "product_description": _field_query(["description"]),
    "product_canonical_url": _field_query(["canonical_url"]),
    "product_price": _field_query(["price", "currency"]),
    "product_old_price": _field_query(["old_price", "discount"]),
    "product_stock": _field_query(["stock", "availability"], "stock", "availability", "declared_stock"),
    "product_brand": _field_query(["brand"]),
    "product_sku": _field_query(["sku"]),
    "product_category": _field_query(["category"]),
    "product_images": _field_query(["images", "gallery"], lambda: _joined(F.col("images"), " ").alias("images"),
                                   lambda: _joined(F.col("gallery"), " ").alias("gallery")),
    "product_characteristics": _field_query(["characteristics"], lambda: _chars().alias("characteristics")),
    "product_variants": _field_query(["variants"], lambda: _joined(F.col("variants.size")).alias("sizes"),
                                     lambda: _joined(F.col("variants.color")).alias("colors")),
    "product_reviews": _field_query(["reviews"], "reviews.rating_average", "reviews.review_count",
                                    lambda: F.coalesce(F.size("reviews.list"), F.lit(0))
                                    .alias("n_reviews")),
}


# ======================================================================= oracles
WS = vocab.WHITESPACE_CLASS


def _clean(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def _decode(x: str) -> str:
    return (f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&middot;', '·'), "
            f"'&copy;', '©'), '&amp;', '&')")


# The word lists of the rules, written out here so that the oracle does not
# share them with the implementation (fixed values; longer words first).
_SIZE_RX = (r"\b(?:ONE SIZE|XXXL|OSFA|(?:1[5-9]|[2-4][0-9]|5[0-2])\.5|XXL|XXS|2XS|2XL|3XL|4XL|5XL|XL|XS|"
            r"(?:1[5-9]|[2-4][0-9]|5[0-2])|S|M|L)\b")
_COLOR_RX = (r"\b(?:BLEU MARINE|MULTICOLORE|MULTICOLOR|TURQUOISE|SARCELLE|BORDEAUX|PATTERN|MARRON|VIOLET|ORANGE|ARGENT|YELLOW|"
             r"PURPLE|SILVER|MAROON|BLANC|ROUGE|JAUNE|BEIGE|OLIVE|CRÈME|IVOIRE|MOTIF|BLACK|WHITE|GREEN|BROWN|IVORY|CREAM|"
             r"NOIR|GRIS|BLEU|VERT|ROSE|GREY|GRAY|BLUE|PINK|GOLD|NAVY|TEAL|RED|OR)\b")
_BUY_WORDS = ["acheter", "ajouter au panier", "panier", "add to cart", "buy now", "sélectionner"]
_OUT_WORDS = ["rupture de stock", "épuisé", "out of stock"]
_LEAF_BANNED = ["sku", "stock", "review", "avis", "livraison", "retour"]


def _ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def _parse_price_sql(x: str) -> str:
    kept = f"regexp_replace({x}, '[^0-9.,]', '', 'g')"
    st = f"regexp_replace({kept}, '^[.,]+|[.,]+$', '', 'g')"
    norm = (f"CASE WHEN contains({st}, ',') AND contains({st}, '.') THEN replace({st}, ',', '') "
            f"WHEN contains({st}, ',') AND length(regexp_extract({st}, '[^,]*$')) = 2 "
            f"THEN replace({st}, ',', '.') ELSE {st} END")
    groups = f"regexp_extract_all({norm}, '[0-9]+(?:[.,][0-9]{{2}})')"
    return (f"CASE WHEN regexp_matches({kept}, '[0-9]') THEN "
            f"coalesce({groups}[-1], {norm}) END")


_PRICE_INPUTS = """(SELECT l_orderkey, l_linenumber,
  CASE l_linenumber % 4
    WHEN 0 THEN 'Was $' || printf('%.2f', l_extendedprice + l_quantity) || ' Now $' || printf('%.2f', l_extendedprice)
    WHEN 1 THEN replace(printf('%.2f', l_extendedprice), '.', ',') || ' €'
    WHEN 2 THEN 'EUR ' || printf('%.2f', l_extendedprice)
    ELSE '£' || printf('%.2f', l_extendedprice) || ' / ¥1' END AS txt
  FROM lineitem)"""


def _expected(page_id: str, es: str, notitle: str, dead: str) -> str:
    """Expected product fields per part, for an effective markup style ``es``."""
    P = "printf('%.2f', p_retailprice)"
    OLD = "printf('%.2f', p_retailprice + p_size)"
    url = "'https://shop.example.com/item/' || p_partkey || '?ref=x'"
    return f"""(SELECT {page_id} AS page_id, p_partkey AS k, {dead} AS dead,
  CASE WHEN {dead} OR {notitle} THEN NULL ELSE p_name END AS title,
  CASE WHEN {dead} THEN NULL WHEN {es} = 1 THEN CAST(p_retailprice AS VARCHAR) ELSE {P} END AS price,
  CASE WHEN {dead} THEN NULL ELSE CASE {es} WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD'
       WHEN 3 THEN 'USD' WHEN 4 THEN 'GBP' WHEN 5 THEN 'USD' WHEN 6 THEN 'EUR' WHEN 7 THEN 'EUR' END END AS currency,
  CASE WHEN NOT {dead} AND {es} IN (5, 6) THEN {OLD} END AS old_price,
  CASE WHEN NOT {dead} AND {es} IN (5, 6) THEN '-' || CAST(round_even((CAST({OLD} AS DOUBLE) - CAST({P} AS DOUBLE))
       / CAST({OLD} AS DOUBLE) * 100, 0) AS BIGINT) || '%' END AS discount,
  CASE WHEN {dead} THEN NULL WHEN {es} = 5 OR ({es} = 7 AND p_partkey % 20 != 17) THEN 'InStock'
       ELSE 'OutOfStock' END AS stock,
  CASE WHEN {dead} THEN NULL ELSE ({es} = 5 OR ({es} = 7 AND p_partkey % 20 != 17)) END AS availability,
  CASE WHEN NOT {dead} AND {es} = 0 THEN 'InStock' END AS declared_stock,
  CASE WHEN NOT {dead} AND {es} IN (0, 1, 4, 5, 6, 7) THEN p_brand END AS brand,
  CASE WHEN NOT {dead} AND {es} IN (0, 1, 2, 3, 7) THEN CAST(p_partkey AS VARCHAR) END AS sku,
  CASE WHEN NOT {dead} AND {es} = 7 THEN p_type END AS category,
  CASE WHEN {dead} THEN '' WHEN {es} = 4 THEN 'https://shop.example.com/img/' || p_partkey || '.jpg'
       WHEN {es} = 7 THEN 'https://m.media.example.com/' || p_partkey || '.jpg' ELSE '' END AS images,
  CASE WHEN NOT {dead} AND {es} = 7 THEN 'https://m.media.example.com/' || p_partkey || '.jpg' ELSE '' END AS gallery,
  CASE WHEN {dead} THEN '' WHEN {es} = 5 THEN 'Brand=' || p_brand || ';Size=' || p_size || ';Type=' || p_type
       WHEN {es} = 6 THEN 'Marque=' || p_brand || ';Taille=' || p_size ELSE '' END AS characteristics,
  CASE WHEN {dead} THEN '' WHEN {es} = 6 THEN 'S,M' WHEN {es} = 7 THEN 'XL,L' ELSE '' END AS sizes,
  CASE WHEN NOT {dead} AND {es} = 6 THEN 'Rouge,Bleu' ELSE '' END AS colors,
  CASE WHEN NOT {dead} AND {es} IN (1, 7) THEN CAST(4.5 AS DOUBLE) END AS rating_average,
  CAST(CASE WHEN {dead} THEN NULL WHEN {es} = 1 THEN p_size WHEN {es} = 7 THEN 1234 END AS BIGINT) AS review_count,
  CASE WHEN NOT {dead} AND {es} = 1 THEN 1 ELSE 0 END AS n_reviews,
  CASE WHEN {dead} THEN NULL WHEN {es} = 0 THEN 'https://shop.example.com/item/' || p_partkey ELSE {url} END
       AS canonical_url,
  CASE WHEN NOT {dead} AND {es} = 0 THEN p_name || ' description' END AS description
FROM part)"""


_HTTPX_EXP = _expected("p_partkey * 2", "p_partkey % 10", "(p_partkey % 10 = 8 AND p_partkey % 20 = 8)",
                       "(p_partkey % 10 = 9)")
_PLAYWRIGHT_EXP = _expected("p_partkey * 2 + 1", "CASE WHEN p_partkey % 20 = 9 THEN 0 ELSE 8 END", "false", "false")
_CAPTURE_EXP = f"(SELECT * FROM {_HTTPX_EXP} UNION ALL SELECT * FROM {_PLAYWRIGHT_EXP} WHERE k % 20 IN (8, 9))"
# page_id and markup style of every capture; style 9 has no page
_STYLED = """(SELECT p_partkey * 2 AS page_id, p_partkey % 10 AS s, * FROM part UNION ALL
    SELECT p_partkey * 2 + 1, CASE WHEN p_partkey % 20 = 9 THEN 0 ELSE 8 END, * FROM part WHERE p_partkey % 20 IN (8, 9))"""
_REQUEST_EXP = _expected("p_partkey", "CASE WHEN p_partkey % 10 = 9 THEN 0 ELSE p_partkey % 10 END",
                         "false", "(p_partkey % 20 = 19)")

_PAGE_H1 = _clean(_decode("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))


def _field_sql(*cols: str) -> str:
    return f"SELECT page_id, {', '.join(cols)} FROM {_CAPTURE_EXP} e"


ORACLES: dict[str, str] = {
    "page_titles": f"SELECT page_id, {_PAGE_H1} AS title FROM pages",
    "page_node_counts": "SELECT page_id, CAST(len(regexp_extract_all(html, '<[a-zA-Z]')) AS INTEGER) AS n_nodes FROM pages",
    "tag_histogram": """SELECT tag, count(*) AS n FROM (
        SELECT lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY tag""",
    "select_by_attr": f"""SELECT page_id, {_clean(_decode("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)"))}
        AS ad_text FROM pages""",
    "select_by_tag": "SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS n_p FROM pages",
    "resolve_url": """SELECT page_id, array_to_string(list_transform(
        regexp_extract_all(html, '<a href="([^"]*)"', 1),
        lambda x: regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || x), ' ') AS links FROM pages""",
    "page_products": f"""SELECT page_id, {_PAGE_H1} AS title, url AS canonical_url, CAST(NULL AS VARCHAR) AS price,
        CAST(NULL AS VARCHAR) AS currency, 'OutOfStock' AS stock, false AS availability,
        CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS VARCHAR) AS sku, CAST(0 AS INTEGER) AS n_images FROM pages""",
    "stock_status": "SELECT page_id, 'OutOfStock' AS stock, false AS availability FROM pages",
    "valid_requests": """SELECT page_id AS request_id,
        CASE page_id % 20 WHEN 9 THEN 'CURL' WHEN 10 THEN 'PLAYWRIGHT' ELSE 'HTTPX' END AS strategy, page_id % 3 = 0 AS debug,
        CASE WHEN page_id % 10 IN (1, 4, 6, 7, 8) THEN 'invalid url' WHEN page_id % 20 = 9 THEN 'invalid strategy' END
        AS reject_reason FROM pages""",
    "clean_text": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "parse_price": f"SELECT l_orderkey, l_linenumber, {_parse_price_sql('txt')} AS price FROM {_PRICE_INPUTS}",
    "currency_symbol": f"""SELECT l_orderkey, l_linenumber, CASE WHEN contains(txt, '€') THEN 'EUR'
        WHEN contains(txt, '$') THEN 'USD' WHEN contains(txt, '£') THEN 'GBP' WHEN contains(txt, '¥') THEN 'JPY'
        END AS currency FROM {_PRICE_INPUTS}""",
    "discount_pct": """SELECT l_orderkey, l_linenumber,
        CASE WHEN CAST(o AS DOUBLE) > CAST(p AS DOUBLE) THEN '-' || CAST(round_even((CAST(o AS DOUBLE) - CAST(p AS DOUBLE))
          / CAST(o AS DOUBLE) * 100, 0) AS BIGINT) || '%' END AS discount
        FROM (SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice * (1 - l_discount)) AS p,
              printf('%.2f', l_extendedprice) AS o FROM lineitem)""",
    "digits_only": """SELECT s_suppkey, CAST(nullif(regexp_replace(s_name, '[^0-9]', '', 'g'), '') AS BIGINT)
        AS digits FROM supplier""",
    "normalise_key": "SELECT p_partkey, lower(regexp_replace(p_brand, '[^\\p{L}\\p{N}]', '', 'g')) AS key FROM part",
    "match_sizes": f"""SELECT p_partkey, array_to_string({_ordered_distinct(
        f"regexp_extract_all(upper(p_type || ' ' || p_size), '{_SIZE_RX}')")}, ',')
        AS sizes FROM part""",
    "match_colors": f"""SELECT p_partkey, array_to_string({_ordered_distinct(
        f"regexp_extract_all(upper(p_name), '{_COLOR_RX}')")}, ',') AS colors FROM part""",
    "contains_any": "SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in _BUY_WORDS)
        + " AS buy, " + " OR ".join(f"contains(lower(text), '{w}')" for w in _OUT_WORDS)
        + " AS oos FROM documents",
    "short_text_filter": f"""SELECT doc_id, t AS text FROM (SELECT doc_id, {_clean('text')} AS t FROM documents)
        WHERE t != '' AND length(t) <= 20 AND NOT ("""
        + " OR ".join(f"contains(lower(t), '{w}')" for w in _LEAF_BANNED) + ")",
    "first_by_order": "SELECT conv_id, arg_min(text, turn) AS first_text FROM conversations GROUP BY conv_id",
    "last_by_order": "SELECT conv_id, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id",
    "shortest_by_length": """SELECT lang, doc_id, text FROM (SELECT lang, doc_id, text,
        row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) AS rn FROM documents) WHERE rn = 1""",
    "distinct_keep_order": """SELECT conv_id, string_agg(role, ',' ORDER BY t, role) AS roles FROM (
        SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role) GROUP BY conv_id""",
    "union_ranked": f"""SELECT page_id, {_clean(_decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))}
        || ' | ' || {_PAGE_H1} AS texts FROM pages""",
    "products": f"""SELECT e.k AS request_id, NOT e.dead AS success,
        CASE WHEN e.dead THEN NULL WHEN p_partkey % 10 = 9 OR (p_partkey % 10 = 8 AND p_partkey % 20 = 8)
             THEN 'PLAYWRIGHT' ELSE 'HTTPX' END AS strategy_used,
        CASE WHEN e.dead THEN 'no PLAYWRIGHT capture' END AS error,
        e.title, e.price, e.currency, e.stock, e.brand, e.sku
        FROM {_REQUEST_EXP} e JOIN part ON part.p_partkey = e.k""",
    "base_url": "SELECT page_id, url AS base_url FROM pages",
    "jsonld_products": f"""SELECT page_id, CAST(s IN (0, 1) AS INTEGER) AS n_items, CAST(s IN (0, 1) AS INTEGER) AS n_products
        FROM {_STYLED}""",
    "microdata_products": f"""SELECT page_id, CASE WHEN s = 2 THEN p_name END AS name,
        CASE WHEN s = 2 THEN printf('%.2f', p_retailprice) END AS price FROM {_STYLED}""",
    "rdfa_products": f"""SELECT page_id, CASE WHEN s = 3 THEN p_name END AS name,
        CASE WHEN s = 3 THEN printf('%.2f', p_retailprice) END AS price FROM {_STYLED}""",
    "meta_tags": f"""SELECT page_id, CASE WHEN s = 4 THEN p_name END AS og_title,
        CASE WHEN s = 4 THEN 'GBP' END AS price_currency,
        CAST(CASE s WHEN 4 THEN 5 WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS n_meta FROM {_STYLED}""",
    "enabled_buy_buttons": f"""SELECT page_id, CAST(s IN (5, 7) AS INTEGER) AS n_enabled,
        CAST(s IN (5, 6, 7) AS INTEGER) AS n_buttons FROM {_STYLED}""",
    "product_json": f"""SELECT CAST(e.k AS VARCHAR) AS request_id, CAST(NOT e.dead AS VARCHAR) AS success,
        CASE WHEN e.dead THEN 'no PLAYWRIGHT capture' END AS error,
        CASE WHEN e.dead THEN NULL WHEN k % 10 = 9 OR k % 20 = 8 THEN 'PLAYWRIGHT' ELSE 'HTTPX' END AS strategy_used,
        title, price, CASE WHEN k % 10 = 5 THEN regexp_extract(characteristics, 'Size=([0-9]+)', 1) END AS characteristics,
        nullif(split_part(sizes, ',', 1), '') AS size, CAST(rating_average AS VARCHAR) AS rating FROM {_REQUEST_EXP} e""",
    "captured_titles": f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'HTTPX' ELSE 'PLAYWRIGHT' END AS strategy,
        CAST(NULL AS VARCHAR) AS error, CASE WHEN dead THEN 'empty html' END AS shred_error, title FROM {_CAPTURE_EXP} e""",
    "resolved_requests": """WITH r AS (SELECT p_partkey AS k, p_name, p_partkey % 4 = 0 AS pw,
          p_partkey % 20 IN (8, 9) AS has_pw, p_partkey % 10 = 9 OR p_partkey % 20 = 8 AS no_httpx FROM part),
        a AS (SELECT *, NOT pw AND NOT no_httpx AS by_httpx FROM r)
        SELECT k AS request_id, CASE WHEN pw THEN 'PLAYWRIGHT' ELSE 'HTTPX' END AS strategy_requested,
          CASE WHEN by_httpx THEN 'HTTPX' WHEN has_pw THEN 'PLAYWRIGHT' END AS strategy_used,
          CASE WHEN by_httpx OR has_pw THEN p_name END AS title,
          CASE WHEN NOT by_httpx AND NOT has_pw THEN 'no PLAYWRIGHT capture' END AS error
        FROM a, range(0, CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END)""",
    "detail_fields": f"""SELECT page_id, canonical_url, title, price, old_price, currency, description, brand, sku, category, stock, declared_stock
        FROM {details.EXPECTED} e""",
    "detail_lists": f"SELECT page_id, images, gallery, characteristics, sizes, colors, styles, patterns FROM {details.EXPECTED} e",
    "detail_reviews": f"SELECT page_id, base_url, rating_average, review_count, reviews FROM {details.EXPECTED} e",
    "testid_prices": """SELECT p_partkey * 2 AS page_id, 'current-price' AS testid, '$' || printf('%.2f', p_retailprice) AS text
        FROM part WHERE p_partkey % 10 = 5""",
    "definition_lists": """SELECT p_partkey AS page_id, unnest(['A', 'B']) AS term, unnest([p_brand, CAST(p_size AS VARCHAR)]) AS value
        FROM part WHERE p_partkey % 4 = 3""",
    "select_options": """SELECT p_partkey AS page_id, unnest(['2', '3', '4', '5', '1']) AS value, unnest(['S', 'M', 'M', 'L', 'S']) AS text
        FROM part WHERE p_partkey % 9 = 8 UNION ALL SELECT p_partkey, '1', p_name FROM part WHERE p_partkey % 4 = 3""",
    "srcset_pick": """SELECT p_partkey AS page_id, unnest(['/h/' || p_partkey || '-b.jpg', '/h/' || p_partkey || '-c.jpg', '/h/' || p_partkey || '-d.jpg',
        'R0', NULL]) AS hires, unnest([NULL, NULL, NULL, NULL, '/g/' || p_partkey || '-2.jpg']) AS generic FROM part WHERE p_partkey % 9 = 2""",
    "variant_groups": """SELECT p_partkey AS page_id, unnest([5, 12, 15, 18])::INTEGER AS ord, unnest(['color', 'style', NULL, NULL]) AS dimension
        FROM part WHERE p_partkey % 9 = 4""",
    "run_counts": f"""WITH q AS (
          SELECT p_partkey AS k, p_partkey % 11 = 3 AS bad_url, p_partkey % 7 = 1 AS bad_strategy, p_partkey % 7 = 2 AS pw FROM part
        ), v AS (SELECT k, pw, k % 20 IN (8, 9) AS has_pw, NOT pw AND k % 10 <> 9 AND k % 20 <> 8 AS httpx FROM q WHERE NOT bad_url AND NOT bad_strategy)
        SELECT 'requests' AS of, unnest(['n_requests', 'n_valid', 'n_invalid_url', 'n_invalid_strategy']) AS count,
          unnest([count(*), count_if(NOT bad_url AND NOT bad_strategy), count_if(bad_url), count_if(NOT bad_url AND bad_strategy)])::BIGINT AS n FROM q
        UNION ALL SELECT 'captures', unnest(['n_captures', 'n_failed', 'n_empty', 'n_shred_errors', 'n_usable', 'n_titled']),
          unnest([count(*) + count_if(k % 20 IN (8, 9)), count_if(k % 10 = 9), 0, 0, count_if(k % 10 <> 9) + count_if(k % 20 IN (8, 9)),
                  count_if(k % 10 <> 9 AND k % 20 <> 8) + count_if(k % 20 IN (8, 9))])::BIGINT FROM q
        UNION ALL SELECT 'answers', unnest(['n_answers', 'n_failed', 'n_httpx', 'n_playwright']),
          unnest([count(*), count_if(NOT httpx AND NOT has_pw), count_if(httpx), count_if(NOT httpx AND has_pw)])::BIGINT FROM v""",
    "vocabulary_hits": """SELECT p_partkey, upper(p_name) || '|' || upper(p_type) || '|' || upper(p_brand) || '|' || upper(p_type) AS hits FROM part""",
    "element_texts": "SELECT page_id, tag, " + _clean(_decode("t")) + """ AS text FROM (
        SELECT page_id, tag, unnest(regexp_extract_all(html, '(?s)<' || tag || '(?: [^>]*)?>(.*?)</' || tag || '>', 1)) AS t
        FROM pages, (SELECT unnest(['title', 'h1', 'a']) AS tag))""",
    "label_targets": """SELECT p_partkey AS page_id, o::INTEGER AS ord, t AS target_text, t AS array_text FROM (
        SELECT p_partkey, unnest([5, 6, 8, 13]) AS o, unnest([p_name, NULL, p_brand || 'x', CAST(p_size AS VARCHAR)]) AS t
        FROM part WHERE p_partkey % 4 = 0)""",
    "table_rows": """SELECT p_partkey AS page_id, unnest(['t1', 't1', 't1', 't2']) AS table_id,
        unnest(['Outer ' || p_partkey, 'Inner', 'Size', 'Inner']) AS key,
        unnest([p_name || 'Inner' || p_brand || 'thirdalone', p_brand, CAST(p_size AS VARCHAR), p_brand]) AS value
        FROM part WHERE p_partkey % 4 = 1""",
    "list_children": """SELECT p_partkey AS page_id, unnest(['ul', 'ul', 'ol']) AS list_tag, unnest([1, 2, 1])::BIGINT AS n_lists,
        unnest(['onetwo ' || p_partkey, 'two ' || p_partkey, 'three']) AS text FROM part WHERE p_partkey % 4 = 3
        UNION ALL SELECT p_partkey, 'ul', 1::BIGINT, 'y' || p_partkey FROM part WHERE p_partkey % 4 = 2""",
    "leaf_price_candidates": "SELECT page_id, tag, text, " + _parse_price_sql("text") + """ AS price FROM (
        SELECT p_partkey AS page_id, unnest(['span', 'p', 'p', 'b']) AS tag, unnest([printf('%.2f', p_retailprice),
          printf('%.2f', p_retailprice + p_size), '12 ' || p_size, CAST(p_partkey AS VARCHAR)]) AS text FROM part WHERE p_partkey % 4 = 2
        UNION ALL SELECT p_partkey, 'td', unnest([p_brand, CAST(p_size AS VARCHAR)]) FROM part WHERE p_partkey % 4 = 1
        UNION ALL SELECT p_partkey, 'li', 'two ' || p_partkey FROM part WHERE p_partkey % 4 = 3)""",
    "pages_with_select": "SELECT p_partkey AS page_id, p_partkey % 4 = 3 AS has_option FROM part",
    "response_envelope": """SELECT p_partkey AS request_id, p_partkey % 20 != 19 AS success,
        CASE WHEN p_partkey % 20 = 19 THEN 'no PLAYWRIGHT capture' END AS error,
        CASE WHEN p_partkey % 20 = 19 THEN NULL WHEN p_partkey % 10 = 9 OR p_partkey % 20 = 8 THEN 'PLAYWRIGHT'
             ELSE 'HTTPX' END AS strategy_used, false AS debug, p_partkey % 20 = 19 AS no_data FROM part""",
    "product_title": _field_sql("title"),
    "product_description": _field_sql("description"),
    "product_canonical_url": _field_sql("canonical_url"),
    "product_price": _field_sql("price", "currency"),
    "product_old_price": _field_sql("old_price", "discount"),
    "product_stock": _field_sql("stock", "availability", "declared_stock"),
    "product_brand": _field_sql("brand"),
    "product_sku": _field_sql("sku"),
    "product_category": _field_sql("category"),
    "product_images": _field_sql("images", "gallery"),
    "product_characteristics": _field_sql("characteristics"),
    "product_variants": _field_sql("sizes", "colors"),
    "product_reviews": _field_sql("rating_average", "review_count", "n_reviews"),
}
