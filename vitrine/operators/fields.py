"""One Column job per product field, over a shredded page row.

Expected columns: ``url``, ``bp`` (the base URL split by ``url_parts``),
``nodes``, ``page_text`` and the structured columns ``jl_name`` and so on (a typed
value of each JSON-LD product), ``md`` / ``rd`` (microdata / RDFa items) and ``meta``
(meta map) -- see ``plans.extract``.

Each field is written as precedence over candidates, in the order the
sources are consulted: JSON-LD, microdata, RDFa, meta, marketplace rules,
generic rules. ``x = x or candidate`` becomes ``coalesce(nullif(..., ''))``;
the few places where a later source replaces an earlier one even with an
empty value (category, review numbers, stock) are written as overwrites.
"""

from __future__ import annotations

from vitrine.functions.sqltext import Column, F

from vitrine.functions import variant as V
from vitrine.functions import vocab
from vitrine.functions.core import let
from vitrine.functions.price import currency_from_symbol, discount_pct, parse_price
from vitrine.functions.text import (clean_text, contains_any, digits_only, match_vocab,
                                    nonempty, normalise_key, py_strip, rating_fr,
                                    strip_suffix, strip_trailing, COLORS_RX, SIZES_RX)
from vitrine.functions.urls import pick_srcset, pick_srcset_hires, resolve_parts
from vitrine.operators import nodes as N
from vitrine.operators.folds import first_nonnull, last_nonnull, last_wins_map, minus_keep_dups
from vitrine.operators.shred import node_text, page_text_str
from vitrine.operators.structured import meta_first



def _resolve(ref: Column) -> Column:
    return resolve_parts(F.col("bp"), ref)


def _ctext(n: Column) -> Column:
    return clean_text(node_text(n))


def _first_ctext(node: Column) -> Column:
    """Cleaned text of a node found by a search (the search runs once)."""
    return let(node, _ctext)


def _jl_first(key: str) -> Column:
    """First non-null value of ``key`` across the JSON-LD product records."""
    return first_nonnull(F.col(f"jl_{key}"))


def _scope_first(key: str, f=None) -> Column:
    """Microdata first, then RDFa: first item with a truthy ``key``."""
    def cand(arr):
        return first_nonnull(F.transform(
            arr, lambda i: F.when(F.coalesce(i[key], F.lit("")) != "",
                                  f(i[key]) if f else nonempty(clean_text(i[key])))))
    return F.coalesce(cand(F.col("md")), cand(F.col("rd")))


def _meta(field: str, parse=None) -> Column:
    raw = meta_first(F.col("meta"), vocab.META_KEYS[field])
    return parse(raw) if parse else nonempty(clean_text(raw))


def _all_offers() -> Column:
    return F.flatten(F.col("jl_offers"))


# ---------------------------------------------------------------- P1
def canonical_url() -> Column:
    """First ``link[rel=canonical]``; its href resolved, else the page URL."""
    link = N.first_node(N.all_of(N.tag_in("link"), N.has_token("rel", "canonical")))
    return let(nonempty(link["attrs"]["href"]),
               lambda h: F.when(h.isNotNull(), _resolve(h)).otherwise(F.col("url")))


# ---------------------------------------------------------------- P2, P3
def title_generic() -> Column:
    """Generic title rule: h1/h2 with a title-like class, else first h1, else <title>."""
    heads = N.select_nodes(N.tag_in("h1", "h2"))
    by_class = first_nonnull(F.transform(
        heads, lambda n: F.when(N.class_contains(*vocab.TITLE_CLASS_KEYWORDS)(n),
                                nonempty(_ctext(n)))))
    first_h1 = nonempty(_first_ctext(N.first_node(N.tag_in("h1"))))
    title_tag = nonempty(_first_ctext(N.first_node(N.tag_in("title"))))
    return F.coalesce(by_class, first_h1, title_tag)


def title() -> Column:
    """JSON-LD name, microdata/RDFa name, meta, then the generic rule."""
    return F.coalesce(
        _jl_first("name"),
        _scope_first("name"),
        _meta("title"),
        title_generic())


def description() -> Column:
    """JSON-LD, microdata/RDFa, meta."""
    return F.coalesce(
        _jl_first("description"),
        _scope_first("description"),
        _meta("description"))


# ---------------------------------------------------------------- P4, P5
def _priced(elems: Column) -> Column:
    """(parsed, text) of the first element whose cleaned text parses as a price."""
    texts = F.transform(elems, _ctext)
    cands = F.transform(texts, lambda t: F.struct(parse_price(t).alias("p"), t.alias("t")))
    return F.try_element_at(F.filter(cands, lambda c: c["p"].isNotNull()), F.lit(1))


def price_candidates() -> Column:
    """P4/P5 candidates as one STRUCT (kept together so each is computed once)."""
    structured = F.coalesce(
        first_nonnull(F.transform(_all_offers(), lambda o: o["price"])),
        _scope_first("price", parse_price),
        _meta("price", parse_price))
    testid = F.concat(
        N.select_nodes(N.attr_rlike("data-testid", vocab.TESTID_PRICE_RX)),
        N.select_nodes(N.attr_rlike("data-lu-target", vocab.LU_TARGET_PRICE_RX)))
    by_testid = _priced(F.filter(testid, N.not_old_price_marker()))
    by_class = _priced(N.select_nodes(N.class_rlike(vocab.PRICE_CLASS_RX)))
    # a later source is searched only where the earlier ones gave no price
    leaves = N.select_nodes(lambda n: n["tag"].isin(*vocab.LEAF_TAGS)
                            & N.is_leaf(n, vocab.LEAF_TAGS))
    short = F.filter(F.transform(leaves, _ctext), lambda t: N.short_text(t))
    parsed = F.filter(F.transform(short, lambda t: F.struct(t.alias("t"), parse_price(t).alias("p"))),
                      lambda c: c["p"].isNotNull())
    # A5: shortest text wins, ties to the earliest; carry the parsed value along
    leaf_price = F.array_min(F.transform(parsed, lambda c, i: F.struct(
        F.length(c["t"]).alias("len"), i.alias("i"), c["p"].alias("p"))))["p"]
    return let(structured, lambda s: let(
        F.when(s.isNull(), by_testid), lambda t: let(
            F.when(s.isNull() & t.isNull(), by_class), lambda c: F.struct(
                s.alias("structured"), t.alias("testid"), c.alias("cls"),
                F.when(s.isNull() & t.isNull() & c.isNull(), leaf_price).alias("leaf")))))


def price(pc: Column) -> Column:
    """Structured sources, test-id elements, class elements, shortest leaf."""
    return F.coalesce(pc["structured"], pc["testid"]["p"], pc["cls"]["p"], pc["leaf"])


def currency(pc: Column) -> Column:
    """P5: JSON-LD, microdata/RDFa, meta, then the symbol of the price element."""
    structured = F.coalesce(
        first_nonnull(F.transform(_all_offers(), lambda o: o["currency"])),
        _scope_first("priceCurrency"),
        _meta("currency"))
    symbol = F.when(pc["structured"].isNull(),
                    F.when(pc["testid"]["p"].isNotNull(), currency_from_symbol(pc["testid"]["t"]))
                    .when(pc["cls"]["p"].isNotNull(), currency_from_symbol(pc["cls"]["t"])))
    return F.coalesce(structured, symbol)


# ---------------------------------------------------------------- P6, P7
def old_price(price_col: Column) -> Column:
    """del/s elements (class regex only when none exist); first parsed value
    that differs, as a string, from the price."""
    dels = N.select_nodes(N.tag_in(*vocab.OLD_PRICE_TAGS))
    olds = F.when(F.size(dels) > 0, dels).otherwise(
        N.select_nodes(N.class_rlike(vocab.OLD_PRICE_CLASS_RX)))
    parsed = F.transform(olds, lambda n: parse_price(node_text(n)))
    return let(price_col, lambda current: F.try_element_at(
        F.filter(parsed, lambda p: p.isNotNull() & ~p.eqNullSafe(current)), F.lit(1)))


def discount(price_col: Column, old_col: Column) -> Column:
    """P7."""
    return discount_pct(price_col, old_col)


# ---------------------------------------------------------------- P8, P9
def in_stock() -> Column:
    """An enabled buy button and no out-of-stock phrase in the page text."""
    buttons = F.concat(N.select_nodes(N.tag_in("button")),
                       N.select_nodes(N.all_of(N.tag_in("input"), N.attr_is("type", "submit"))))

    def buy(b):
        raw = node_text(b)
        label = clean_text(F.when(raw != "", raw).otherwise(F.coalesce(b["attrs"]["value"], F.lit(""))))
        return N.enabled()(b) & contains_any(label, vocab.BUY_KEYWORDS)

    has_buy = F.exists(buttons, buy)
    out = contains_any(clean_text(page_text_str()), vocab.OUT_OF_STOCK_KEYWORDS)
    return F.coalesce(has_buy & ~out, F.lit(False))


def declared_stock() -> Column:
    """The JSON-LD offer availability (last offer that declares one)."""
    return last_nonnull(F.transform(_all_offers(), lambda o: o["stock"]))


# ---------------------------------------------------------------- P10, P11
def gallery_parts() -> Column:
    """P10: STRUCT<marketplace, generic> gallery lists (resolved, ordered distinct)."""
    def hires(i):
        s = i["attrs"]["data-old-hires"]
        return F.when(F.coalesce(s != "", F.lit(False)) & ~s.startswith("data:"),
                      _resolve(pick_srcset_hires(s)))

    def generic(i):
        return let(F.coalesce(*[nonempty(i["attrs"][a]) for a in vocab.GALLERY_IMG_ATTRS]), lambda s: F.when(
            s.isNotNull() & ~s.startswith("data:"), _resolve(pick_srcset(s))))

    def parts(imgs):
        amz = F.array_distinct(F.filter(F.transform(imgs, hires), lambda u: u.isNotNull() & N.not_data_uri(u)))
        gen = F.filter(F.transform(imgs, generic), lambda u: u.isNotNull())
        return let(amz, lambda a: F.struct(a.alias("amz"), F.array_distinct(F.concat(a, gen)).alias("all")))

    return let(N.select_nodes(N.tag_in("img")), parts)


def images(gp: Column) -> Column:
    """JSON-LD images, then meta images; if none, the first two of the gallery."""
    jl_imgs = F.transform(F.flatten(F.col("jl_images")), _resolve)
    meta_imgs = F.filter(F.array(*[F.when(F.col("meta")[k].isNotNull(), _resolve(F.col("meta")[k]))
                                   for k in vocab.META_IMAGE_KEYS]),
                         lambda u: u.isNotNull())
    base = F.array_distinct(F.concat(jl_imgs, meta_imgs))
    return let(base, lambda found: F.when(F.size(found) > 0, found)
               .when(F.size(gp["amz"]) > 0, F.slice(gp["amz"], 1, 2))
               .otherwise(F.slice(gp["all"], 1, 2)))


# ---------------------------------------------------------------- P15
def char_pairs() -> Column:
    """P15 input: (key, value) pairs of every table row and definition list, in order.

    The shredder has noted each row's first two cells and each table's rows
    (those of nested tables too), so a row's texts are cut once and a table is a
    slice of the rows.
    """
    nodes, outline = F.col("nodes"), F.col("outline")

    def pair(r):
        return F.when(r.isNotNull(), F.struct(_ctext(F.element_at(nodes, r["c1"] + 1)).alias("k"),
                                              _ctext(F.element_at(nodes, r["c2"] + 1)).alias("v")))

    def dl_pairs(d):
        zipped = N.zip_pairs(N.select_in(d, N.tag_in("dt")), N.select_in(d, N.tag_in("dd")))
        return F.transform(zipped, lambda z: F.struct(_ctext(z["a"]).alias("k"),
                                                      _ctext(z["b"]).alias("v")))

    tables = let(F.transform(outline["rows"], pair), lambda rows: F.transform(outline["tables"], lambda t: F.struct(
        t["ord"].alias("ord"), F.slice(rows, t["r0"] + 1, t["r1"] - t["r0"]).alias("pairs"))))
    lists = F.transform(N.select_nodes(N.tag_in("dl")), lambda d: F.struct(d["ord"].alias("ord"), dl_pairs(d).alias("pairs")))
    pairs = F.flatten(F.transform(F.array_sort(F.concat(tables, lists)), lambda c: c["pairs"]))
    return F.filter(pairs, lambda p: F.coalesce(N.valid_pair(p["k"], p["v"]), F.lit(False)))


def characteristics(pairs: Column) -> Column:
    """Key without trailing colons -> value, later rows replace earlier ones."""
    return last_wins_map(F.transform(pairs, lambda p: F.struct(strip_trailing(p["k"], ":").alias("k"),
                                                              p["v"].alias("v"))))


def char_sku(pairs: Column) -> Column:
    return first_nonnull(F.transform(pairs, lambda p: F.when(normalise_key(p["k"]) == "asin", p["v"])))


def char_brand(pairs: Column) -> Column:
    def cand(p):
        key = normalise_key(p["k"])
        return F.when((key != "asin") & (F.length(p["v"]) < vocab.CHAR_BRAND_VALUE_MAX)
                      & (F.contains(key, F.lit("brand")) | F.contains(key, F.lit("mar"))), p["v"])
    return first_nonnull(F.transform(pairs, cand))


# ---------------------------------------------------------------- P12, P13
def brand(pairs: Column) -> Column:
    """JSON-LD, meta, characteristics, then brand selectors (text)."""
    selectors = F.coalesce(*[nonempty(_first_ctext(N.first_node(N.simple_selector(s))))
                             for s in vocab.BRAND_SELECTORS])
    return F.coalesce(
        _jl_first("brand"),
        _meta("brand"),
        char_brand(pairs),
        selectors)


def sku(pairs: Column) -> Column:
    """JSON-LD keys, microdata/RDFa, meta, first data-asin, characteristics
    ``asin``, sku selectors, then meta itemprop/name sku."""
    asin = nonempty(N.first_node(N.has_attr("data-asin"))["attrs"]["data-asin"])

    def sel_value(s):
        return let(N.first_node(N.simple_selector(s)), lambda node: F.when(
            node.isNotNull(), F.coalesce(nonempty(node["attrs"]["data-sku"]),
                                         nonempty(node["attrs"]["data-asin"]),
                                         nonempty(node["attrs"]["content"]))))

    selected = F.coalesce(*[sel_value(s) for s in vocab.SKU_SELECTORS])
    meta_sku = first_nonnull(F.transform(
        N.select_nodes(lambda n: (n["tag"] == "meta") & (N.attr_is("itemprop", "sku")(n)
                                                         | N.attr_is("name", "sku")(n))),
        lambda m: nonempty(m["attrs"]["content"])))
    generic = let(selected, lambda v: F.when(v.isNotNull(), clean_text(v))
                  .otherwise(clean_text(meta_sku)))
    return F.coalesce(_jl_first("sku"), _scope_first("sku"), _meta("sku"), asin,
                      char_sku(pairs), nonempty(generic))


# ---------------------------------------------------------------- P14
def category() -> Column:
    """Marketplace block overwrites JSON-LD; else last breadcrumb entry."""
    jl_cat = _jl_first("category")
    block = N.first_node(N.all_of(N.tag_in("div"), N.has_attr("data-category")))

    def in_first_li(b):
        li = N.first_in(b, N.child_of("ul", "li"))
        return let(li, lambda x: N.first_in(x, lambda n: F.array_contains(n["classes"], "nav-a-content")
                                            & N.has_ancestor(n, N.tag_in("a"))))

    crumb = N.first_node(N.selector_group(vocab.BREADCRUMB_SELECTORS))
    crumb_last = let(crumb, lambda c: last_nonnull(F.transform(
        N.select_in(c, N.tag_in("a", "li")), lambda n: nonempty(_ctext(n)))))

    def decide(el):
        found = el.isNotNull()
        return let(nonempty(_ctext(el)), lambda amz: F.when(found & amz.isNotNull(), amz)
                   .when(~found & jl_cat.isNotNull(), jl_cat)
                   .otherwise(crumb_last))

    return let(let(block, in_first_li), decide)


# ---------------------------------------------------------------- P16-P18
def _named_groups() -> Column:
    """The button groups with the dimension that each rule reads: the marketplace's from the
    JSON attribute, the generic one from the bare attribute."""
    groups = N.select_nodes(N.all_of(N.tag_in("ul"), N.has_attr("data-a-button-group")))
    return F.transform(groups, lambda u: F.struct(
        u["ord"].alias("ord"), u["end_ord"].alias("end_ord"),
        V.variant_dimension(u["attrs"]["data-a-button-group"]).alias("amz"),
        strip_suffix(F.coalesce(u["attrs"]["data-a-button-group"], F.lit("")), "_name").alias("gen")))


def _group_values(groups: Column, rule: str, dimension: str, colour_alt: bool) -> Column:
    def li_value(li):
        text = nonempty(_first_ctext(N.first_in(li, N.has_class("swatch-title-text-display"))))
        if colour_alt:
            img = N.first_in(li, N.all_of(N.tag_in("img"), N.has_class("swatch-image"),
                                          N.has_attr("alt")))
            return F.coalesce(nonempty(clean_text(img["attrs"]["alt"])), text)
        return text

    chosen = F.filter(groups, lambda u: F.coalesce(u[rule] == dimension, F.lit(False)))
    return F.flatten(F.transform(chosen, lambda u: F.filter(
        F.transform(N.select_in(u, N.all_of(N.tag_in("li"), N.has_attr("data-asin"))), li_value),
        lambda v: v.isNotNull())))


def _button_groups(groups: Column, dimension: str) -> Column:
    """Marketplace (JSON attribute) then generic (bare attribute) groups."""
    amz = _group_values(groups, "amz", dimension, colour_alt=(dimension == "color"))
    gen = _group_values(groups, "gen", dimension, colour_alt=False)
    return F.array_distinct(F.concat(amz, gen))


def _select_lists(keywords_test) -> Column:
    """Option texts of each matching ``select`` (placeholders dropped)."""
    selects = N.select_nodes(N.tag_in("select"))

    def props(s):
        a = s["attrs"]
        return [F.lower(F.coalesce(a["id"], F.lit(""))), F.lower(F.coalesce(a["name"], F.lit(""))),
                F.lower(F.array_join(s["classes"], " "))]

    def options(s):
        opts = N.select_in(s, lambda o: (o["tag"] == "option")
                           & F.coalesce(o["attrs"]["value"] != "", F.lit(False))
                           & (py_strip(node_text(o)) != ""))
        return F.filter(F.transform(opts, _ctext), N.real_option)

    return F.transform(F.filter(selects, lambda s: keywords_test(props(s))), options)


def _any_kw(fields: list[Column], words: list[str]) -> Column:
    out = None
    for f in fields:
        t = contains_any(f, words, lower=False)
        out = t if out is None else out | t
    return out


def variants() -> Column:
    """STRUCT<size, color, style, pattern>.

    Groups, texts and the values so far are bound: read within a lambda they would
    be computed again for every element."""
    size_lists = _select_lists(lambda p: _any_kw(p, vocab.SELECT_SIZE_KEYWORDS))
    color_lists = _select_lists(lambda p: ~_any_kw(p, vocab.SELECT_SIZE_KEYWORDS)
                                & _any_kw(p, vocab.SELECT_COLOR_KEYWORDS))

    def with_lists(values, lists):
        return F.aggregate(lists, values, lambda acc, o: F.concat(acc, minus_keep_dups(o, acc)))

    els = N.select_nodes(N.tag_in("button", "label", "input"))

    def el_text(e):
        a = e["attrs"]
        return F.coalesce(nonempty(e["text_joined"]), nonempty(a["title"]), nonempty(a["aria-label"]),
                          F.when(e["tag"] == "label", nonempty(N.label_target_text(e))))

    texts = F.filter(F.transform(els, el_text), lambda t: t.isNotNull())

    def add_hits(values, texts, rx):
        hits = F.array_distinct(F.flatten(F.transform(texts, lambda t: match_vocab(t, rx))))
        return let(values, lambda current: F.concat(current, minus_keep_dups(hits, current)))

    return let(_named_groups(), lambda g: let(texts, lambda t: F.struct(
        add_hits(with_lists(_button_groups(g, "size"), size_lists), t, SIZES_RX).alias("size"),
        add_hits(with_lists(_button_groups(g, "color"), color_lists), t, COLORS_RX).alias("color"),
        _button_groups(g, "style").alias("style"),
        _button_groups(g, "pattern").alias("pattern"))))


# ---------------------------------------------------------------- P19, P20
def review_numbers() -> Column:
    """STRUCT<rating_average DOUBLE, review_count LONG>.

    JSON-LD aggregateRating first; a marketplace ``#averageCustomerReviews``
    block replaces both values (even with NULL); generic selectors then fill
    whatever is still falsy.
    """
    # a decimal comma and separators of thousands occur in declared numbers
    jl_rating = F.replace(_jl_first("rating"), F.lit(","), F.lit(".")).try_cast("double").cast("string")
    jl_count = let(_jl_first("count"), lambda c: F.coalesce(
        c.try_cast("bigint"), digits_only(c))).cast("string")

    block = N.first_node(N.id_is("averageCustomerReviews"))
    amz = let(block, lambda b: F.struct(
        b.isNotNull().alias("found"),
        let(N.first_in(b, N.has_class("a-icon-alt")),
            lambda a: F.when(a.isNotNull(), rating_fr(node_text(a)))).alias("rating"),
        let(N.first_in(b, N.id_is("acrCustomerReviewText")),
            lambda c: F.when(c.isNotNull(), digits_only(node_text(c)))).alias("count")))
    return let(amz, lambda a: _review_numbers(a, jl_rating, jl_count))


def _review_numbers(amz: Column, jl_rating: Column, jl_count: Column) -> Column:
    has_block = amz["found"]
    amz_rating = amz["rating"]
    amz_count = amz["count"]

    r1 = F.when(has_block, amz_rating.cast("string")).otherwise(jl_rating)
    r1_ok = F.when(has_block, F.coalesce(amz_rating != 0, F.lit(False))).otherwise(jl_rating.isNotNull())
    c1 = F.when(has_block, amz_count.cast("string")).otherwise(jl_count)
    c1_ok = F.when(has_block, F.coalesce(amz_count != 0, F.lit(False))).otherwise(jl_count.isNotNull())

    def tag_value(sels, data_attr):
        def value(node):
            a = node["attrs"]
            v = F.coalesce(nonempty(a["content"]), nonempty(a[data_attr]), node_text(node))
            return F.when(node.isNotNull() & (v != ""), v)
        return let(N.first_node(N.selector_group(sels)), value)

    rating_val = tag_value(vocab.RATING_SELECTORS, "data-rating-value")
    count_val = tag_value(vocab.REVIEW_COUNT_SELECTORS, "data-review-count")
    skip = r1_ok & c1_ok
    rating = F.when(skip | r1_ok, r1).otherwise(F.coalesce(let(rating_val, parse_price), r1))
    count = F.when(skip | c1_ok, c1).otherwise(F.coalesce(digits_only(count_val).cast("string"), c1))
    return F.struct(rating.try_cast("double").alias("rating_average"),
                    count.try_cast("bigint").alias("review_count"))


def review_list() -> Column:
    """P20: JSON-LD reviews with text, equal ones once."""
    revs = F.flatten(F.col("jl_reviews"))
    return F.array_distinct(F.filter(revs, lambda x: F.coalesce(x["text"] != "", F.lit(False))))
