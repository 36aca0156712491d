"""Rendered detail pages: markup that the main catalogue does not have (test input only).

One page per ``part`` row, style ``p_partkey % 9``. As in ``catalogue``, the
renderer writes HTML with a Spark SQL string expression and computes no
extraction result; the expected values are SQL over ``part``.

style  markup
0      <base>, relative canonical link, JSON-LD with an image list, mpn, declared
       numbers with commas, reviews; a label whose text is its target's value
1      JSON-LD with a repeated key and NaN; sizes and colours in button, title and aria-label
2      srcset galleries of both rules, data URIs; a heading class
3      breadcrumb, sku selector, old price by class
4      swatches by image alt and text, style and bare pattern groups
5      every field empty
6      unequal dt/dd, repeated and overlong keys, an ASIN row, a price in a leaf only
7      generic review selectors, description meta
8      two selects with repeated options, a colour in a button, an enabled buy button
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.sources.catalogue import _HEAD, SHOP, dealt, sql_template

STYLES = {
    0: _HEAD + '<title>{name}</title><base href="https://cdn.example.com/shop/"><link rel="canonical" href="item/{key}">'
       '<script type="application/ld+json">{{"@type":"Product","name":"{name}","mpn":"M{key}",'
       '"image":["a/{key}.jpg",{{"url":"/b/{key}.jpg"}},"a/{key}.jpg"],'
       '"offers":[{{"price":"{P}","priceCurrency":"USD","availability":"https://schema.org/OutOfStock"}}],'
       '"aggregateRating":{{"ratingValue":"4,5","reviewCount":"1,234"}},'
       '"review":[{{"author":"Ann","datePublished":"2024-01-01","reviewBody":" Good  {name} ","reviewRating":{{"ratingValue":"4"}}}},'
       '{{"author":{{"name":"Bob"}},"description":"Bad {name}"}},{{"author":"No text"}}]}}</script></head>'
       '<body><h1>Other</h1><label for="qty"></label><input id="qty" value="XL red"></body></html>',
    1: _HEAD + '<script type="application/ld+json">{{"@type":"Product","name":"Old","name":"{name}","sku":"{key}","weight":NaN,'
       '"offers":{{"price":{RAW},"price":"{P}","priceCurrency":"EUR"}}}}</script></head>'
       '<body><h1>Other</h1><button>Taille M</button><button title="bleu marine"></button><input aria-label="42.5 / L"></body></html>',
    2: _HEAD + '<title>Shop</title></head><body><h2 class="Product-Name">{name}</h2>'
       '<img data-old-hires="/h/{key}-a.jpg 1x, /h/{key}-b.jpg 2x"><img data-old-hires="/h/{key}-c.jpg">'
       '<img data-old-hires="/h/{key}-d.jpg"><img data-old-hires="data:image/gif;base64,R0">'
       '<img gallery="/g/{key}-1.jpg 1x, /g/{key}-2.jpg 2x"><img zoom="data:image/png;base64,AA">'
       '<img main="/g/{key}-3.jpg"><img thumb="/g/{key}-3.jpg"><img src="/no.jpg"></body></html>',
    3: _HEAD + '<title>Shop</title></head><body><nav aria-label="breadcrumb"><a href="/">Home</a><a href="/c">{type}</a><a></a></nav>'
       '<h1>{name}</h1><h3 id="sku" content="S-{key}"></h3>'
       '<em class="sale-price">£{P}</em><em class="old-price">£{OLD}</em></body></html>',
    4: _HEAD + '<title>{name}</title></head><body>'
       "<ul data-a-button-group='{{\"name\":\"color_name\"}}'>"
       '<li data-asin="A-{key}"><img class="swatch-image" alt="{name}"></li>'
       '<li data-asin="b"><em class="swatch-title-text-display">Teal</em></li>'
       '<li><em class="swatch-title-text-display">No asin</em></li></ul>'
       "<ul data-a-button-group='{{\"name\":\"style_name\"}}'><li data-asin=\"c\"><em class=\"swatch-title-text-display\">Slim</em></li></ul>"
       '<ul data-a-button-group="pattern_name"><li data-asin="d"><em class="swatch-title-text-display">Dots</em></li></ul>'
       "<ul data-a-button-group='broken {{'><li data-asin=\"e\"><em class=\"swatch-title-text-display\">Lost</em></li></ul></body></html>",
    5: _HEAD + '<title></title><meta property="og:title" content=""><meta name="description" content="">'
       '<script type="application/ld+json">{{"@type":"Product","name":"","description":" ","brand":{{"name":""}},"category":"",'
       '"offers":{{"price":"","priceCurrency":""}}}}</script></head><body><h1> </h1><del> </del></body></html>',
    6: _HEAD + '<title>{name}</title></head><body><dl><dt>Marque :</dt><dd>{brand}</dd><dt>Taille</dt><dd>{size}</dd><dt>Orphan</dt></dl>'
       '<table><tr><th>ASIN</th><td>{key}</td></tr><tr><td>Only</td></tr><tr><th>{long}</th><td>x</td></tr>'
       '<tr><th>Taille</th><td>late</td></tr></table></body></html>',
    7: _HEAD + '<meta name="description" content="About  {name}"></head><body><h1>{name}</h1>'
       '<em itemprop="ratingValue" content="3.5"></em><em class="review-count">(1 234 avis)</em></body></html>',
    8: _HEAD + '<title>{name}</title></head><body><select id="taille"><option value="">Choisir</option><option value="1">S</option>'
       '<option value="2">S</option><option value="3">M</option></select>'
       '<select class="product-size"><option value="4">M</option><option value="5">L</option></select>'
       '<button>S rouge</button><button>Add to cart</button></body></html>',
}


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html of the detail pages."""
    part = dealt(spark.read.parquet(f"{sf_dir}/part.parquet"))
    cases = " ".join(f"WHEN {s} THEN {sql_template(t)}" for s, t in STYLES.items())
    return part.selectExpr("p_partkey AS page_id", f"concat('{SHOP}/d/', CAST(p_partkey AS STRING)) AS url",
                           f"CASE p_partkey % 9 {cases} END AS html")


_P = "printf('%.2f', p_retailprice)"
_OLD = "printf('%.2f', p_retailprice + p_size)"
_K = "CAST(p_partkey AS VARCHAR)"
_SHOP_SQL = "'https://shop.example.com"


def _by_style(column: str, cases: dict[int, str], default: str = "NULL") -> str:
    return "CASE p_partkey % 9 " + " ".join(f"WHEN {s} THEN {x}" for s, x in cases.items()) + f" ELSE {default} END AS {column}"


#: The values that the rules give for each style, as DuckDB SQL over ``part``.
EXPECTED = "(SELECT p_partkey AS page_id, " + ", ".join([
    _by_style("base_url", {0: "'https://cdn.example.com/shop/'"}, f"{_SHOP_SQL}/d/' || p_partkey"),
    _by_style("canonical_url", {0: "'https://cdn.example.com/shop/item/' || p_partkey"}, f"{_SHOP_SQL}/d/' || p_partkey"),
    _by_style("title", {5: "NULL"}, "p_name"),
    _by_style("price", {0: _P, 1: _P, 3: _P, 6: _K}),
    _by_style("old_price", {3: _OLD}),
    _by_style("currency", {0: "'USD'", 1: "'EUR'", 3: "'GBP'"}),
    _by_style("description", {7: "'About ' || p_name"}),
    _by_style("brand", {6: "p_brand"}),
    _by_style("sku", {0: "'M' || p_partkey", 1: _K, 3: "'S-' || p_partkey", 4: "'A-' || p_partkey", 6: _K}),
    _by_style("category", {3: "p_type"}),
    _by_style("stock", {8: "'InStock'"}, "'OutOfStock'"),
    _by_style("declared_stock", {0: "'OutOfStock'"}),
    _by_style("images", {0: "'https://cdn.example.com/shop/a/' || p_partkey || '.jpg https://cdn.example.com/b/' || p_partkey || '.jpg'",
                         2: f"{_SHOP_SQL}/h/' || p_partkey || '-b.jpg https://shop.example.com/h/' || p_partkey || '-c.jpg'"}, "''"),
    _by_style("gallery", {2: " || ' ' || ".join(f"{_SHOP_SQL}/{d}/' || p_partkey || '-{n}.jpg'" for d, n in
                                                 (("h", "b"), ("h", "c"), ("h", "d"), ("g", "2"), ("g", "3")))}, "''"),
    _by_style("characteristics", {6: "'Marque =' || p_brand || ';Taille=late;ASIN=' || p_partkey"}, "''"),
    _by_style("sizes", {0: "'XL'", 1: "'M,42.5,L'", 8: "'S,S,M,L'"}, "''"),
    _by_style("colors", {0: "'RED'", 1: "'BLEU MARINE'", 4: "p_name || ',Teal'", 8: "'ROUGE'"}, "''"),
    _by_style("styles", {4: "'Slim'"}, "''"),
    _by_style("patterns", {4: "'Dots'"}, "''"),
    _by_style("rating_average", {0: "4.5::DOUBLE", 7: "3.5::DOUBLE"}),
    _by_style("review_count", {0: "1234::BIGINT", 7: "1234::BIGINT"}),
    _by_style("reviews", {0: "'Ann|2024-01-01|4|Good ' || p_name || ';Bob|||Bad ' || p_name"}, "''"),
]) + " FROM part)"
