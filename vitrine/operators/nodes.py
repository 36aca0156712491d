"""F1-F11 node predicates and J1-J6 node joins, as Column builders.

A predicate is a function ``node Column -> boolean Column`` used inside
``filter(nodes, pred)``. In array form a page's nodes are one row, so every
"join" between elements of a page is an expression over that row: no shuffle.
Containment (J2) is a contiguous slice because nodes are in document order.
"""

from __future__ import annotations

import re
from typing import Callable

from vitrine.functions.sqltext import Column, F

from vitrine.functions import vocab
from vitrine.functions.core import let
from vitrine.functions.text import clean_text, contains_any
from vitrine.operators.shred import OTHER_BIT, TAG_BITS, descendants, node_text

Pred = Callable[[Column], Column]


def _safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def attr(n: Column, key: str) -> Column:
    return n["attrs"][key]


# ---------------------------------------------------------------- F1-F5
def tag_in(*tags: str) -> Pred:
    """element name in a set."""
    return lambda n: n["tag"].isin(*tags)


def has_attr(key: str) -> Pred:
    """attribute present (any value)."""
    return lambda n: F.map_contains_key(n["attrs"], F.lit(key))


def attr_is(key: str, value: str) -> Pred:
    """attribute equals a value."""
    return lambda n: _safe(attr(n, key) == value)


def attr_truthy(key: str) -> Pred:
    return lambda n: _safe(attr(n, key) != "")


def attr_rlike(key: str, rx: str) -> Pred:
    """attribute value matches a regex (search semantics)."""
    return lambda n: _safe(F.regexp_like(attr(n, key), F.lit(rx)))


def has_token(key: str, token: str) -> Pred:
    """Multi-valued attribute (``rel``) holds a token, or equals it whole."""
    return lambda n: _safe(F.array_contains(F.split(F.trim(attr(n, key)), "\\s+"), token)
                           | (attr(n, key) == token))


def has_class(c: str) -> Pred:
    """class token."""
    return lambda n: F.array_contains(n["classes"], c)


def class_string(n: Column) -> Column:
    return F.array_join(n["classes"], " ")


def class_rlike(rx: str) -> Pred:
    """a class token, or the joined class list, matches the regex."""
    return lambda n: (F.size(n["classes"]) > 0) & F.regexp_like(class_string(n), F.lit(rx))


def class_contains(*words: str) -> Pred:
    """the lower-cased joined class list contains a word."""
    return lambda n: contains_any(class_string(n), list(words))


def id_is(v: str) -> Pred:
    """id selector."""
    return attr_is("id", v)


def any_of(*preds: Pred) -> Pred:
    """selector alternatives."""
    def p(n):
        out = preds[0](n)
        for q in preds[1:]:
            out = out | q(n)
        return out
    return p


def all_of(*preds: Pred) -> Pred:
    def p(n):
        out = preds[0](n)
        for q in preds[1:]:
            out = out & q(n)
        return out
    return p


_SIMPLE = re.compile(
    r"([a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[([\w:-]+)(=)?['\"]?([^'\"\]]*)['\"]?\]")


def simple_selector(sel: str) -> Pred:
    """Predicate for one compound selector made of tag, ``.class``, ``#id``,
    ``[attr]`` and ``[attr=value]`` parts (the only forms the rules use)."""
    preds: list[Pred] = []
    for tag, cls, ident, key, eq, val in _SIMPLE.findall(sel):
        if tag:
            preds.append(tag_in(tag.lower()))
        elif cls:
            preds.append(has_class(cls))
        elif ident:
            preds.append(id_is(ident))
        elif eq:
            preds.append(attr_is(key, val))
        else:
            preds.append(has_attr(key))
    return all_of(*preds)


def selector_group(sels: list[str]) -> Pred:
    """``a, b, c``: any of the compound selectors (document order is kept)."""
    return any_of(*[simple_selector(s) for s in sels])


# ---------------------------------------------------------------- F6-F11
def enabled() -> Pred:
    """not disabled, not aria-disabled=true, not tabindex=-1."""
    return lambda n: (~F.map_contains_key(n["attrs"], F.lit("disabled"))
                      & ~_safe(attr(n, "aria-disabled") == "true")
                      & ~_safe(attr(n, "tabindex") == "-1"))


def not_old_price_marker() -> Pred:
    """test-id / lu-target marker not naming an old price."""
    def p(n):
        marker = F.concat(F.coalesce(attr(n, "data-testid"), F.lit("")), F.lit(" "),
                          F.coalesce(attr(n, "data-lu-target"), F.lit("")))
        return ~F.regexp_like(marker, F.lit(vocab.OLD_PRICE_MARKER_RX))
    return p


def short_text(text: Column, max_chars: int = vocab.LEAF_MAX_CHARS,
               banned: list[str] = vocab.LEAF_EXCLUDED_TOKENS) -> Column:
    """F8: non-empty, at most ``max_chars`` characters, no banned token."""
    return ((text != "") & (F.length(text) <= max_chars) & ~contains_any(text, banned))


def real_option(text: Column) -> Column:
    """F9 (text part): non-empty and not a placeholder."""
    return (text != "") & ~contains_any(text, vocab.OPTION_PLACEHOLDERS)


def valid_pair(k: Column, v: Column, key_max: int = vocab.CHAR_KEY_MAX) -> Column:
    """both non-empty, key at most ``key_max`` characters."""
    return (k != "") & (v != "") & (F.length(k) <= key_max)


def not_data_uri(c: Column) -> Column:
    """drop inline images."""
    return ~c.startswith("data:")


# ---------------------------------------------------------------- selections
def select_nodes(pred: Pred, nodes: str | Column = "nodes") -> Column:
    arr = F.col(nodes) if isinstance(nodes, str) else nodes
    return F.filter(arr, pred)


def first_node(pred: Pred, nodes: str | Column = "nodes") -> Column:
    """A2 on nodes: first element in document order matching ``pred``."""
    return F.try_element_at(select_nodes(pred, nodes), F.lit(1))


def select_in(n: Column, pred: Pred, nodes: str | Column = "nodes") -> Column:
    """Descendants of ``n`` matching ``pred``."""
    return F.filter(descendants(n, nodes), pred)


def first_in(n: Column, pred: Pred, nodes: str | Column = "nodes") -> Column:
    return F.try_element_at(select_in(n, pred, nodes), F.lit(1))


def child_of(parent_tag: str, tag: str, nodes: str | Column = "nodes") -> Pred:
    """An element whose parent (one lookup by its place) has the given name."""
    arr = F.col(nodes) if isinstance(nodes, str) else nodes
    return lambda n: (n["tag"] == tag) & _safe(F.try_element_at(arr, n["parent"] + 1)["tag"] == parent_tag)


def has_ancestor(n: Column, pred: Pred, nodes: str | Column = "nodes") -> Column:
    """Some ancestor of ``n`` matches (walks the containing intervals)."""
    arr = F.col(nodes) if isinstance(nodes, str) else nodes
    return F.exists(F.slice(arr, 1, F.greatest(n["ord"], F.lit(1))),
                    lambda a: (a["ord"] < n["ord"]) & (a["end_ord"] >= n["ord"]) & pred(a))


def is_leaf(n: Column, tags: list[str], nodes: str | Column = "nodes") -> Column:
    """J4 anti join: no descendant in the tag set.

    One test of the node's ``below`` mask; only for names without a bit of their
    own, and only where some such element is below, the subtree is searched.
    """
    mask = sum(1 << TAG_BITS[t] for t in tags if t in TAG_BITS)
    rest = [t for t in tags if t not in TAG_BITS]
    leaf = Column(f"(({n['below'].sql} & {mask}L) = 0)")
    if rest:
        other = Column(f"(({n['below'].sql} & {1 << OTHER_BIT}L) != 0)")
        leaf = leaf & ~(other & F.exists(descendants(n, nodes), lambda d: d["tag"].isin(*rest)))
    return leaf


def text_of(n: Column) -> Column:
    return node_text(n)


def clean_text_of(n: Column) -> Column:
    return clean_text(node_text(n))


def label_target_text(label: Column, nodes: str | Column = "nodes") -> Column:
    """A text-less label reads the first element whose id equals its ``for``.

    The target's value, else aria-label, else its stripped-joined text. The
    shredder has looked the id up, so this reads one place.
    """
    arr = F.col(nodes) if isinstance(nodes, str) else nodes
    return let(F.try_element_at(arr, label["target"] + 1), lambda target: F.coalesce(
        F.nullif(attr(target, "value"), F.lit("")),
        F.nullif(attr(target, "aria-label"), F.lit("")),
        F.nullif(target["text_joined"], F.lit(""))))


def zip_pairs(a: Column, b: Column) -> Column:
    """I-th of ``a`` with i-th of ``b`` as STRUCT<a, b>, truncated to the shorter."""
    zipped = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.slice(zipped, 1, F.least(F.size(a), F.size(b)))
