"""JSON (VARIANT) scalars: N13 offer_price, N14 scalar_or_object, N15 type_matches,
N19 offer_stock, N20 variant_dimension, plus JSON truthiness and rendering.

JSON-LD is polymorphic (string / object / list at the same key), so values
stay VARIANT and every accessor branches on the variant's kind. The kind is
computed once per value (``info``) and bound with ``let``.
"""

from __future__ import annotations

from vitrine.functions.sqltext import Column, F

from vitrine.functions.core import let
from vitrine.functions.price import parse_price
from vitrine.functions.text import clean_text, strip_suffix

_INTS = ("BIGINT", "INT", "SMALLINT", "TINYINT")


def field(v: Column, key: str) -> Column:
    """Object member as VARIANT (NULL when absent or ``v`` is not an object)."""
    return F.try_variant_get(v, "$['" + key.replace("'", "\\'") + "']", "variant")


def info(v: Column) -> Column:
    """STRUCT<v VARIANT, k kind, e empty-object> -- the value with its kind, computed once.

    kind: 'object' | 'array' | 'string' | 'int' | 'float' | 'bool' | 'null',
    SQL NULL when the value is absent.
    """
    def build(x, s):
        k = (F.when(s.startswith("OBJECT"), F.lit("object"))
             .when(s.startswith("ARRAY"), F.lit("array"))
             .when(s == "STRING", F.lit("string"))
             .when(s.isin(*_INTS), F.lit("int"))
             .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), F.lit("float"))
             .when(s == "BOOLEAN", F.lit("bool"))
             .when(s.isNotNull(), F.lit("null")))
        return F.struct(x.alias("v"), k.alias("k"), (s == "OBJECT<>").alias("e"))

    return let(v, lambda x: let(F.schema_of_variant(x), lambda s: build(x, s)))


def with_info(v: Column, fn) -> Column:
    return let(info(v), fn)


# ---- functions of an ``info`` struct x ------------------------------------
def _str(x: Column) -> Column:
    k, v = x["k"], x["v"]
    s = F.try_variant_get(v, "$", "string")
    float_txt = F.when(F.regexp_like(s, F.lit("[.eE]")), s).otherwise(F.concat(s, F.lit(".0")))
    return (F.when(k.isin("string", "int"), s)
            .when(k == "float", float_txt)
            .when(k == "bool", F.when(F.try_variant_get(v, "$", "boolean"), F.lit("True"))
                  .otherwise(F.lit("False"))))


def _truthy(x: Column) -> Column:
    k, v = x["k"], x["v"]
    return F.coalesce(
        F.when(k == "string", F.try_variant_get(v, "$", "string") != "")
        .when(k.isin("int", "float"), F.try_variant_get(v, "$", "double") != 0)
        .when(k == "bool", F.try_variant_get(v, "$", "boolean"))
        .when(k == "array", F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
        .when(k == "object", ~x["e"])
        .otherwise(F.lit(False)),
        F.lit(False))


# ---- public, on a VARIANT -------------------------------------------------
def kind(v: Column) -> Column:
    return info(v)["k"]


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_list(v: Column) -> Column:
    """``v if isinstance(v, list) else [v]`` (empty when absent)."""
    return (F.when(v.isNull(), F.array().cast("array<variant>"))
            .otherwise(F.coalesce(as_array(v), F.array(v))))


def to_str(v: Column) -> Column:
    """``str(value)`` for JSON scalars: strings as is, numbers as Python prints
    them (a JSON float keeps its ``.0`` although VARIANT normalises ``29.0`` to
    ``29``). Objects and arrays give NULL."""
    return with_info(v, _str)


def truthy(v: Column) -> Column:
    """Python truthiness of a JSON value (absent/null/''/0/false/[]/{} are falsy)."""
    return with_info(v, _truthy)


def clean_value(v: Column) -> Column:
    """``clean_text(value)`` when the value is truthy, else NULL."""
    return with_info(v, lambda x: F.when(_truthy(x), clean_text(_str(x))))


def str_if_truthy(v: Column) -> Column:
    return with_info(v, lambda x: F.when(_truthy(x), _str(x)))


def price_value(v: Column) -> Column:
    """``parse_price(value)`` of a truthy value: a number gives its own text,
    a string is parsed."""
    return with_info(v, lambda x: F.when(_truthy(x), F.when(
        x["k"].isin("int", "float"), _str(x))
        .when(x["k"] == "string", parse_price(F.try_variant_get(x["v"], "$", "string")))))


def type_matches(v: Column, name: str = "product", mode: str = "equals") -> Column:
    """``@type`` as string or list; any string entry equal to (or containing) ``name``."""
    def test(t):
        s = F.when(F.schema_of_variant(t) == "STRING", F.lower(F.try_variant_get(t, "$", "string")))
        hit = (s == name) if mode == "equals" else F.contains(s, F.lit(name))
        return F.coalesce(hit, F.lit(False))
    return F.exists(as_list(v), test)


def scalar_or_object(v: Column, key: str) -> Column:
    """A string as is, or an object's ``key`` member; cleaned."""
    return with_info(v, lambda x: F.when(x["k"] == "object", clean_value(field(x["v"], key)))
                     .when(x["k"] == "string", clean_text(_str(x))))


def offer_price(offer: Column) -> Column:
    """AggregateOffer -> lowPrice, else highPrice, else price; otherwise price."""
    t = F.when(F.schema_of_variant(field(offer, "@type")) == "STRING",
               F.try_variant_get(field(offer, "@type"), "$", "string"))
    is_agg = F.coalesce(t == "AggregateOffer", F.lit(False))
    agg = F.coalesce(*[F.when(truthy(field(offer, k)), field(offer, k))
                       for k in ("lowPrice", "highPrice", "price")])
    return price_value(F.when(is_agg, agg).otherwise(field(offer, "price")))


def offer_stock(offer: Column) -> Column:
    """Availability text containing InStock / OutOfStock -> label."""
    a = field(offer, "availability")
    s = F.when(F.schema_of_variant(a) == "STRING", F.try_variant_get(a, "$", "string"))
    return (F.when(F.contains(s, F.lit("InStock")), F.lit("InStock"))
            .when(F.contains(s, F.lit("OutOfStock")), F.lit("OutOfStock")))


def variant_dimension(attr: Column) -> Column:
    """JSON attribute -> its ``name`` lower-cased without ``_name``; bad JSON -> NULL."""
    name = let(F.try_parse_json(attr), lambda v: F.when(
        F.schema_of_variant(field(v, "name")) == "STRING", F.try_variant_get(v, "$.name", "string")))
    return strip_suffix(name, "_name")
