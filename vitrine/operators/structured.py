"""H4-H8: structured data read from the shredded nodes, as Column expressions.

* JSON-LD: ``script[type=application/ld+json]`` bodies parsed to VARIANT;
  a list contributes its elements, an object itself; bad JSON is skipped.
* Product nodes: ``@graph`` (or the item) whose ``@type`` equals ``product``.
* Microdata / RDFa: product scopes and their flat properties (a property
  belongs to its innermost enclosing scope).
* Meta: ``property`` or ``name`` -> ``content``, non-empty only, last wins.
"""

from __future__ import annotations

from vitrine.functions.sqltext import Column, F

from vitrine.functions import variant as V
from vitrine.functions import vocab
from vitrine.functions.core import let
from vitrine.functions.text import clean_text, nonempty
from vitrine.functions.urls import resolve_parts
from vitrine.operators import nodes as N
from vitrine.operators.folds import last_wins_map
from vitrine.operators.shred import JSONLD_TYPE, node_text

# Microdata value rule (element -> attribute holding the value).
MICRODATA_SRC_TAGS = ["audio", "embed", "iframe", "img", "source", "track", "video"]
MICRODATA_HREF_TAGS = ["a", "area", "link"]
# Product properties read from microdata / RDFa scopes (flat only).
SCOPE_PROPS = ["name", "description", "sku", "price", "priceCurrency"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- H4, H5
def jsonld_items(nodes="nodes") -> Column:
    """H4: every parsed JSON-LD document; lists flattened one level."""
    scripts = F.filter(_col(nodes), lambda n: (n["tag"] == "script")
                       & F.coalesce(n["attrs"]["type"] == JSONLD_TYPE, F.lit(False))
                       & F.coalesce(n["raw"] != "", F.lit(False)))
    docs = F.transform(scripts, lambda s: F.try_parse_json(s["raw"]))
    return F.flatten(F.transform(docs, lambda v: F.coalesce(
        V.as_array(v),
        F.when(V.is_object(v), F.array(v)),
        F.array().cast("array<variant>"))))


def jsonld_product_nodes(items: Column) -> Column:
    """H5: ``@graph`` elements (or the item itself) typed ``product`` (case-insensitive)."""
    def graph_nodes(item):
        g = V.field(item, "@graph")
        return (F.when(g.isNull() | (V.kind(g) == "null"), F.array(item))
                .otherwise(F.coalesce(V.as_array(g), F.array(g))))

    expanded = F.flatten(F.transform(F.filter(items, V.is_object), graph_nodes))
    return F.filter(expanded, lambda n: V.is_object(n)
                    & V.type_matches(V.field(n, "@type"), "product", "equals"))


# ---------------------------------------------------------------- H6, H7
def _scope_value(n: Column, base_parts: Column, syntax: str) -> Column:
    a = n["attrs"]
    tag = n["tag"]
    if syntax == "microdata":
        link = (F.when(tag.isin(*MICRODATA_SRC_TAGS), F.coalesce(a["src"], F.lit("")))
                .when(tag.isin(*MICRODATA_HREF_TAGS), F.coalesce(a["href"], F.lit("")))
                .when(tag == "object", F.coalesce(a["data"], F.lit(""))))
        other = (F.when(tag == "meta", F.coalesce(a["content"], F.lit("")))
                 .when(tag.isin("data", "meter"), F.coalesce(a["value"], F.lit("")))
                 .when(tag == "time", F.coalesce(a["datetime"], F.lit("")))
                 .when(F.coalesce(a["content"], F.lit("")) != "", a["content"])
                 .otherwise(clean_text(node_text(n))))
        first = tag == "meta"
    else:  # RDFa: content wins, then link targets, then text
        link = (F.when(tag.isin(*MICRODATA_HREF_TAGS), a["href"])
                .when(tag.isin(*MICRODATA_SRC_TAGS), a["src"]))
        other = F.coalesce(a["content"], clean_text(node_text(n)))
        first = F.map_contains_key(a, F.lit("content"))
    return let(link, lambda u: F.when(~first & u.isNotNull(), resolve_parts(base_parts, u))
               .otherwise(other))


_SYNTAX = {
    "microdata": ("itemscope", "itemtype", "itemprop"),
    "rdfa": ("typeof", "typeof", "property"),
}


def scope_items(syntax: str, nodes="nodes", outline="outline", base_parts="bp") -> Column:
    """H6/H7: product scopes (type contains 'product') as STRUCT of the flat SCOPE_PROPS;
    for microdata only top-level scopes (no ``itemprop``) are items.

    The shredder has noted each scope with its own properties (those whose
    innermost strict ancestor with a scope it is), so every property is read once
    and the work is linear in the page.
    """
    _, type_attr, prop_attr = _SYNTAX[syntax]
    nodes = _col(nodes)

    def node(place: Column) -> Column:
        return F.element_at(nodes, place + 1)

    def is_product(s):
        return let(node(s["ord"]), lambda n: (
            (~F.map_contains_key(n["attrs"], F.lit("itemprop")) if syntax == "microdata" else F.lit(True))
            & F.coalesce(F.contains(F.lower(n["attrs"][type_attr]), F.lit("product")), F.lit(False))))

    def prop_names(p):
        names = F.split(F.trim(p["attrs"][prop_attr]), "\\s+")
        if syntax == "rdfa":  # short name: drop a prefix or vocabulary IRI
            names = F.transform(names, lambda x: F.regexp_extract(x, "([^:/#]*)$", 1))
        return names

    def named(k):
        return lambda x: F.array_contains(x["names"], k)

    def items(base):
        def prop(place):
            return let(node(place), lambda p: F.struct(
                prop_names(p).alias("names"), _scope_value(p, base, syntax).alias("value")))

        def item(s):
            return let(F.transform(s["props"], prop), lambda m: F.struct(*[
                F.try_element_at(F.filter(m, named(k)), F.lit(1))["value"].alias(k) for k in SCOPE_PROPS]))

        scopes = F.filter(_col(outline)["scopes"], lambda s: (s["syntax"] == syntax) & is_product(s))
        return F.transform(scopes, item)

    # the base is bound outside the lambdas: a staged column read in one place only is merged into it
    return let(_col(base_parts), items)


# ---------------------------------------------------------------- typed JSON-LD
REVIEW_TYPE = "array<struct<author:string,date:string,rating:string,text:string>>"


def jsonld_record(p: Column) -> dict[str, Column]:
    """The values the field jobs read from one JSON-LD product node, typed, by name.

    name / description / category: cleaned when truthy; sku: first truthy key
    of the fixed list; brand: string or ``{name}``; images: raw URLs (string or
    ``{url}``, list or single); offers: price (N13), currency, declared stock
    (N19); rating / count: aggregateRating values as text; reviews: author
    (string or ``{name}``), date, reviewRating.ratingValue, text.
    """
    def f(k):
        return V.field(p, k)

    def image_url(it):
        return V.with_info(it, lambda x: F.when(V._truthy(x), F.when(x["k"] == "string", V._str(x))
                                                .when(x["k"] == "object", V.str_if_truthy(V.field(x["v"], "url")))))

    images = F.filter(F.transform(
        F.when(V.truthy(f("image")), V.as_list(f("image"))).otherwise(F.array().cast("array<variant>")),
        image_url), lambda u: u.isNotNull())

    offers = F.filter(F.when(V.truthy(f("offers")), V.as_list(f("offers")))
                      .otherwise(F.array().cast("array<variant>")), V.is_object)
    offers = F.transform(offers, lambda o: F.struct(
        V.offer_price(o).alias("price"),
        nonempty(V.clean_value(V.field(o, "priceCurrency"))).alias("currency"),
        V.offer_stock(o).alias("stock")))

    def agg_get(k):
        return V.field(f("aggregateRating"), k)

    agg_ok = V.is_object(f("aggregateRating"))
    rating = F.when(agg_ok, V.str_if_truthy(agg_get("ratingValue")))
    count = F.when(agg_ok, F.coalesce(V.str_if_truthy(agg_get("reviewCount")),
                                      V.str_if_truthy(agg_get("ratingCount"))))

    def review(r):
        a = V.field(r, "author")
        author = V.with_info(a, lambda x: F.when(x["k"] == "object",
                                                 clean_text(V.to_str(V.field(x["v"], "name"))))
                             .otherwise(clean_text(V._str(x))))
        body = V.field(r, "reviewBody")
        txt = F.coalesce(V.str_if_truthy(body), V.to_str(V.field(r, "description")))
        rr = V.field(r, "reviewRating")
        return F.struct(author.alias("author"), V.to_str(V.field(r, "datePublished")).alias("date"),
                        F.when(V.is_object(rr), V.to_str(V.field(rr, "ratingValue"))).alias("rating"),
                        clean_text(txt).alias("text"))

    reviews = F.when(V.truthy(f("review")), F.transform(
        F.filter(V.as_list(f("review")), V.is_object), review)).otherwise(F.array().cast(REVIEW_TYPE))

    sku = F.coalesce(*[V.str_if_truthy(f(k)) for k in vocab.JSONLD_SKU_KEYS])
    return {
        "name": nonempty(V.clean_value(f("name"))),
        "description": nonempty(V.clean_value(f("description"))),
        "sku": nonempty(clean_text(sku)),
        "brand": nonempty(V.scalar_or_object(f("brand"), "name")),
        "category": nonempty(V.clean_value(f("category"))),
        "images": images, "offers": offers,
        "rating": rating, "count": count, "reviews": reviews}


JSONLD_VALUES = ["name", "description", "sku", "brand", "category", "images", "offers", "rating", "count", "reviews"]


def jsonld_values(products) -> dict[str, Column]:
    """Each value of ``jsonld_record`` as the array of it over the product nodes: a column
    for each, so that the values a query doesn't read are not computed."""
    return {k: F.transform(_col(products), lambda p: jsonld_record(p)[k]) for k in JSONLD_VALUES}


# ---------------------------------------------------------------- H8
def meta_entries(nodes="nodes") -> Column:
    """``<meta>`` key (property, else name) and content, both non-empty, in order."""
    def key(n):
        return F.coalesce(F.nullif(n["attrs"]["property"], F.lit("")), n["attrs"]["name"])

    metas = F.filter(_col(nodes), lambda n: (n["tag"] == "meta")
                     & F.coalesce(key(n) != "", F.lit(False))
                     & F.coalesce(n["attrs"]["content"] != "", F.lit(False)))
    return F.transform(metas, lambda n: F.struct(key(n).alias("k"), n["attrs"]["content"].alias("v")))


def meta_map(nodes="nodes") -> Column:
    """H8: MAP<key, content>, later tags replace earlier ones."""
    return last_wins_map(meta_entries(nodes))


def meta_first(meta: Column, keys: list[str]) -> Column:
    """First key of the list present in the meta map (values are non-empty)."""
    return F.coalesce(*[meta[k] for k in keys])


__all__ = ["jsonld_items", "jsonld_product_nodes", "scope_items",
           "meta_entries", "meta_map", "meta_first", "N"]
