"""The extraction plan, captures -> product records.

    captures --scan/filter--> shred_pages (mapInArrow, the only Python)
             --> structured columns (JSON-LD, microdata, RDFa, meta)
             --> field candidates --> product STRUCT

Every step after the shredder is a projection, so the plan has no exchange:
it is one stage per input split, in batch and in streaming alike.
Intermediate columns are materialised in separate projections; Catalyst does
not collapse a projection whose non-trivial expressions are used more than
once, so each candidate is computed once per page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from vitrine.functions.sqltext import F as SF
from vitrine.functions.sqltext import X

from vitrine.functions.text import nonempty
from vitrine.operators import fields as P
from vitrine.operators.shred import base_url_expr, shred_pages
from vitrine.functions.urls import url_parts
from vitrine.operators.structured import (JSONLD_VALUES, jsonld_items, jsonld_product_nodes,
                                          jsonld_values, meta_map, scope_items)

# Fields emptied to NULL at the end.
NULLABLE_FIELDS = ["title", "price", "old_price", "discount", "currency", "description",
                   "brand", "sku", "stock", "category"]

_WORK = ["base_url", "bp", "jl", *[f"jl_{k}" for k in JSONLD_VALUES], "md", "rd", "meta", "pc", "gp",
         "pairs", "rn", "f_price", "f_old", "f_in_stock"]


def with_structured(df: DataFrame) -> DataFrame:
    """H2, H4-H8 on a shredded frame (two projections)."""
    df = df.select("*", base_url_expr().alias("base_url").col)
    df = df.select("*", *[e.alias(n).col for n, e in [
        ("bp", url_parts("base_url")),
        ("jl", jsonld_product_nodes(jsonld_items())),
        ("meta", meta_map())]])
    return df.select("*", *[e.alias(n).col for n, e in [
        *[(f"jl_{k}", v) for k, v in jsonld_values("jl").items()],
        ("md", scope_items("microdata")),
        ("rd", scope_items("rdfa"))]])


def product_columns(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """All field jobs over a frame that has the structured columns.

    With ``fields`` (top-level fields of the product) they are columns of these names
    in place of ``product``, and only their jobs run: of a struct of which
    two fields are read Catalyst keeps every field.
    """
    stage = df.select("*", *[e.alias(n).col for n, e in [
        ("pc", P.price_candidates()),
        ("gp", P.gallery_parts()),
        ("pairs", P.char_pairs()),
        ("rn", P.review_numbers()),
        ("f_in_stock", P.in_stock())]])
    stage = stage.select("*", P.price(X("pc")).alias("f_price").col)
    stage = stage.select("*", P.old_price(X("f_price")).alias("f_old").col)
    c = X
    values = {
        "product_url": c("url"),
        "canonical_url": P.canonical_url(),
        "title": nonempty(P.title()),
        "price": nonempty(c("f_price")),
        "old_price": nonempty(c("f_old")),
        "discount": nonempty(P.discount(c("f_price"), c("f_old"))),
        "currency": nonempty(P.currency(c("pc"))),
        "description": nonempty(P.description()),
        "images": P.images(c("gp")),
        "gallery": c("gp")["all"],
        "brand": nonempty(P.brand(c("pairs"))),
        "sku": nonempty(P.sku(c("pairs"))),
        "availability": c("f_in_stock"),
        "stock": SF.when(c("f_in_stock"), SF.lit("InStock")).otherwise(SF.lit("OutOfStock")),
        "category": nonempty(P.category()),
        "variants": P.variants(),
        "characteristics": P.characteristics(c("pairs")),
        "reviews": SF.struct(c("rn")["rating_average"].alias("rating_average"),
                             c("rn")["review_count"].alias("review_count"),
                             P.review_list().alias("list")),
    }
    if fields is None:
        wanted = {"product": SF.struct(*[v.alias(k) for k, v in values.items()])}
    else:
        wanted = {k: values[k] for k in dict.fromkeys(fields)}
    keep = [k for k in df.columns if k not in set(_WORK) | {"nodes", "page_text", "outline"}]
    return stage.select(
        *keep,
        *[SF.when(c("nodes").isNotNull(), v).alias(k).col for k, v in wanted.items()],
        SF.when(c("nodes").isNotNull(), P.declared_stock()).alias("declared_stock").col)


def products_from_shredded(shredded: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return product_columns(with_structured(shredded), fields)


def extract_products(captures: DataFrame, html_col: str = "html", fields: list[str] | None = None) -> DataFrame:
    """Captures (url, html, ...) -> same rows + ``product`` STRUCT (or its ``fields``
    as columns), ``declared_stock`` and ``shred_error``."""
    return products_from_shredded(shred_pages(captures, html_col), fields)
