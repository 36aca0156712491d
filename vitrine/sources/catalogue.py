"""Rendered catalogue: product pages made from ``part`` rows (test input only).

One page per part, markup style ``p_partkey % 10`` (see FIXTURES.md). The
renderer only writes HTML with a Spark SQL string expression; it computes no
extraction result. The expected values are plain SQL over ``part`` (the
DuckDB oracles in ``plans.queries``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHOP = "https://shop.example.com"

# Template fields -> Spark SQL over part.
_FIELDS = {
    "key": "CAST(p_partkey AS STRING)",
    "name": "p_name",
    "brand": "p_brand",
    "type": "p_type",
    "size": "CAST(p_size AS STRING)",
    "P": "format_string('%.2f', p_retailprice)",
    "OLD": "format_string('%.2f', p_retailprice + p_size)",
    "PC": "replace(format_string('%.2f', p_retailprice), '.', ',')",
    "RAW": "CAST(p_retailprice AS STRING)",
    "long": "repeat('k', 81)",
    "oos": "CASE WHEN p_partkey % 20 = 17 THEN '<p>Rupture de stock</p>' ELSE '' END",
    "title_tag": "CASE WHEN p_partkey % 20 = 8 THEN '' ELSE concat('<title>', p_name, '</title>') END",
}

_HEAD = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8">'

STYLES = {
    0: _HEAD + '<title>{name}</title><link rel="canonical" href="/item/{key}">'
       '<script type="application/ld+json">{{"@context":"https://schema.org","@type":"Product",'
       '"name":"{name}","description":"  {name}\\n  description ","sku":"{key}",'
       '"brand":{{"@type":"Brand","name":"{brand}"}},"offers":{{"@type":"Offer","price":"{P}",'
       '"priceCurrency":"USD","availability":"https://schema.org/InStock"}}}}</script>'
       '</head><body><h1>{name}</h1><p>Item {key}</p></body></html>',
    1: _HEAD + '<title>Shop</title><script type="application/ld+json">{{"@context":"https://schema.org",'
       '"@graph":[{{"@type":"WebPage","name":"Shop"}},{{"@type":["Product","Thing"],"name":"{name}",'
       '"sku":"{key}","brand":"{brand}","offers":{{"@type":"AggregateOffer","lowPrice":{RAW},'
       '"priceCurrency":"EUR"}},"aggregateRating":{{"@type":"AggregateRating","ratingValue":"4.5",'
       '"reviewCount":"{size}"}},"review":[{{"@type":"Review","author":{{"@type":"Person","name":"Ann"}},'
       '"datePublished":"2024-01-01","reviewBody":"Great {name}","reviewRating":{{"ratingValue":"5"}}}},'
       '{{"@type":"Review","author":{{"@type":"Person","name":"Ann"}},"datePublished":"2024-01-01",'
       '"reviewBody":"Great {name}","reviewRating":{{"ratingValue":"5"}}}}]}}]}}</script>'
       '<script type="application/ld+json">{{"broken": </script></head><body><h1>Shop</h1></body></html>',
    2: _HEAD + '<title>Shop</title></head><body><div itemscope itemtype="https://schema.org/Product">'
       '<h1 itemprop="name">{name}</h1><span itemprop="sku">{key}</span>'
       '<div itemprop="offers" itemscope itemtype="https://schema.org/Offer">'
       '<span itemprop="name">Offer {key}</span></div>'
       '<span itemprop="price" content="{P}">${P}</span>'
       '<meta itemprop="priceCurrency" content="USD"></div></body></html>',
    3: _HEAD + '<title>Shop</title></head><body vocab="https://schema.org/"><div typeof="Product">'
       '<h1 property="name">{name}</h1><span property="sku">{key}</span>'
       '<span property="price" content="{P}">{P} $</span>'
       '<meta property="priceCurrency" content="USD"></div></body></html>',
    4: _HEAD + '<meta property="og:title" content="Old {name}"><meta property="og:title" content="{name}">'
       '<meta property="product:price:amount" content="{P}">'
       '<meta property="product:price:currency" content="GBP">'
       '<meta property="product:brand" content="{brand}">'
       '<meta property="og:image" content="/img/{key}.jpg"><title>Shop</title></head>'
       '<body><h1>Shop page</h1></body></html>',
    5: _HEAD + '<title>Shop</title></head><body><h1 class="product-title">{name}</h1>'
       '<div class="pricing"><span data-testid="original-price">${OLD}</span>'
       '<span data-testid="current-price">${P}</span><del>${OLD}</del></div>'
       '<button type="submit">Add to cart</button>'
       '<table><tr><th>Brand:</th><td>{brand}</td></tr><tr><th>Size</th><td>{size}</td></tr>'
       '<tr><td>Type</td><td>{type}</td></tr></table></body></html>',
    6: _HEAD + '<title>Shop</title></head><body><h1>{name}</h1>'
       '<span class="price-current">€{P}</span><s>€{OLD}</s>'
       '<button disabled>Ajouter au panier</button>'
       '<dl><dt>Marque</dt><dd>{brand}</dd><dt>Taille</dt><dd>{size}</dd></dl>'
       '<select id="size-select"><option value="">Choisir une taille</option>'
       '<option value="s">S</option><option value="m">M</option></select>'
       '<select name="couleur"><option value="">Sélectionner</option>'
       '<option value="r">Rouge</option><option value="b">Bleu</option></select></body></html>',
    7: _HEAD + '<title>Shop</title></head><body><div id="dp" data-asin="{key}">'
       '<h1><span id="productTitle">{name}</span></h1><a class="brand" href="/b">{brand}</a>'
       '<span class="a-price"><span class="a-offscreen">{PC}&nbsp;€</span></span>'
       '<div id="averageCustomerReviews"><span class="a-icon-alt">4,5 sur 5 étoiles</span>'
       '<span id="acrCustomerReviewText">1 234 évaluations</span></div>'
       '<img data-old-hires="https://m.media.example.com/{key}.jpg">'
       '<img data-old-hires="https://m.media.example.com/{key}.jpg">'
       "<ul data-a-button-group='{{\"name\":\"size_name\"}}'>"
       '<li data-asin="a1"><span class="swatch-title-text-display">XL</span></li>'
       '<li data-asin="a2"><span class="swatch-title-text-display">L</span></li></ul>'
       '<div data-category="x"><ul><li><a href="/c"><span class="nav-a-content">{type}</span></a>'
       '</li></ul></div><input type="submit" value="Ajouter au panier">{oos}</div></body></html>',
    8: _HEAD + '{title_tag}</head><body><div class="item"><span>{P}</span>'
       '<span>Ref 12345 lot 67890 abcde</span><label for="qty"></label></div></body></html>',
}
# Style 8 PLAYWRIGHT capture always has its title.
STYLE8_FULL = STYLES[8].replace("{title_tag}", "<title>{name}</title>")


def sql_template(tpl: str) -> str:
    """A str.format template -> Spark SQL concat(...) over part columns."""
    parts, pos = [], 0
    for m in re.finditer(r"(?<!\{)\{([A-Za-z_]+)\}(?!\})", tpl):
        parts.append(("lit", tpl[pos:m.start()]))
        parts.append(("col", m.group(1)))
        pos = m.end()
    parts.append(("lit", tpl[pos:]))
    out = []
    for kind, v in parts:
        if kind == "lit":
            v = v.replace("{{", "{").replace("}}", "}")
            if v:
                out.append("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'")
        else:
            out.append(_FIELDS[v])
    return "concat(" + ", ".join(out) + ")"


def _html_expr() -> str:
    cases = " ".join(f"WHEN {s} THEN {sql_template(t)}" for s, t in STYLES.items())
    return f"CASE p_partkey % 10 {cases} END"


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt out evenly before their pages are rendered.

    A row of ``part`` takes a few bytes and its page thousands, so a table of
    millions of pages has but a file split or two, and each was a single task.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(tasks, 2 * spark.sparkContext.defaultParallelism))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages of the catalogue: an HTTPX row for every part, plus
    PLAYWRIGHT rows where FIXTURES.md defines them."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    httpx = part.withColumn("strategy", F.lit("HTTPX"))
    playwright = part.where("p_partkey % 20 IN (8, 9)").withColumn("strategy", F.lit("PLAYWRIGHT"))
    full0 = sql_template(STYLES[0])
    full8 = sql_template(STYLE8_FULL)
    return dealt(httpx.unionByName(playwright)).selectExpr(
        "p_partkey * 2 + CASE WHEN strategy = 'HTTPX' THEN 0 ELSE 1 END AS page_id",
        f"concat('{SHOP}/item/', CAST(p_partkey AS STRING), '?ref=x') AS url", "strategy",
        f"CASE WHEN strategy = 'PLAYWRIGHT' THEN CASE WHEN p_partkey % 20 = 9 THEN {full0} ELSE {full8} END "
        f"WHEN p_partkey % 10 = 9 THEN NULL ELSE {_html_expr()} END AS html",
        "CASE WHEN strategy = 'HTTPX' AND p_partkey % 10 = 9 THEN 'HTTP 503 Service Unavailable' END AS error")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per part (default strategy and debug left NULL to exercise S2)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(
        F.col("p_partkey").alias("request_id"),
        F.concat(F.lit(f"{SHOP}/item/"), F.col("p_partkey").cast("string"), F.lit("?ref=x")).alias("url"),
        F.lit(None).cast("string").alias("strategy"),
        F.lit(None).cast("boolean").alias("debug"))
