"""Spark schemas of the data model (requests, captures, nodes, product, response)."""

from pyspark.sql import types as T

S = T.StringType()

REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("url", S),
    T.StructField("strategy", S),
    T.StructField("debug", T.BooleanType()),
])

CAPTURES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", S),
    T.StructField("strategy", S),
    T.StructField("html", S),
    T.StructField("error", S),
])

# One element of a shredded page. ``ord`` is document (pre-)order, so the
# descendants of a node are exactly nodes[ord+1 .. end_ord] -- a contiguous
# slice. ``t0``/``t1`` are byte offsets of the node's visible text inside the
# page's UTF-8 ``page_text`` (binary), so text is sliced, never copied per
# ancestor. ``text_joined`` (pieces stripped and joined) is only filled for
# button/label/input and label targets; ``raw`` only for JSON-LD scripts.
# ``below`` has a bit for each element name among the descendants; ``target`` is
# the place of the first element whose id a label names.
NODE = T.StructType([
    T.StructField("ord", T.IntegerType()),
    T.StructField("end_ord", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("tag", S),
    T.StructField("attrs", T.MapType(S, S)),
    T.StructField("classes", T.ArrayType(S)),
    T.StructField("t0", T.IntegerType()),
    T.StructField("t1", T.IntegerType()),
    T.StructField("text_joined", S),
    T.StructField("raw", S),
    T.StructField("below", T.LongType()),
    T.StructField("target", T.IntegerType()),
])

NODES = T.ArrayType(NODE)

# What the shredder notes of a page in its one sweep: each scope with the places
# of its own properties, each table with its range of ``rows``, each row with the
# places of its first two cells (NULL with fewer).
OUTLINE = T.StructType([
    T.StructField("scopes", T.ArrayType(T.StructType([
        T.StructField("syntax", S), T.StructField("ord", T.IntegerType()),
        T.StructField("props", T.ArrayType(T.IntegerType()))]))),
    T.StructField("tables", T.ArrayType(T.StructType([
        T.StructField("ord", T.IntegerType()), T.StructField("r0", T.IntegerType()), T.StructField("r1", T.IntegerType())]))),
    T.StructField("rows", T.ArrayType(T.StructType([
        T.StructField("c1", T.IntegerType()), T.StructField("c2", T.IntegerType())]))),
])

VARIANTS = T.StructType([
    T.StructField("size", T.ArrayType(S)),
    T.StructField("color", T.ArrayType(S)),
    T.StructField("style", T.ArrayType(S)),
    T.StructField("pattern", T.ArrayType(S)),
])

REVIEW = T.StructType([
    T.StructField("author", S),
    T.StructField("date", S),
    T.StructField("rating", S),
    T.StructField("text", S),
])

REVIEWS = T.StructType([
    T.StructField("rating_average", T.DoubleType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("list", T.ArrayType(REVIEW)),
])

PRODUCT = T.StructType([
    T.StructField("product_url", S),
    T.StructField("canonical_url", S),
    T.StructField("title", S),
    T.StructField("price", S),
    T.StructField("old_price", S),
    T.StructField("discount", S),
    T.StructField("currency", S),
    T.StructField("description", S),
    T.StructField("images", T.ArrayType(S)),
    T.StructField("gallery", T.ArrayType(S)),
    T.StructField("brand", S),
    T.StructField("sku", S),
    T.StructField("availability", T.BooleanType()),
    T.StructField("stock", S),
    T.StructField("category", S),
    T.StructField("variants", VARIANTS),
    T.StructField("characteristics", T.MapType(S, S)),
    T.StructField("reviews", REVIEWS),
])

RESPONSE = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("data", PRODUCT),
    T.StructField("error", S),
    T.StructField("strategy_used", S),
    T.StructField("debug", T.BooleanType()),
])
