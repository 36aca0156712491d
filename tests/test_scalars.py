"""Golden vectors for the scalar functions."""

from urllib.parse import urljoin

from conftest import evaluate
from vitrine.functions import price, text, urls

PARSE_PRICE = [
    ("29,99 €", "29.99"), ("$1,299.00", "1299.00"), ("1 299,00 €", "1299.00"),
    ("Was $59.99 Now $39.99", "39.99"), ("1299", "1299"), ("19.9", "19.9"), ("1,5", "1,5"),
    ("EUR 12", "12"), ("-5.00", "5.00"), ("abc", None), ("..", None), (None, None),
    # surprising, kept for parity
    ("$1,299", "1,29"), ("1.299,00 €", "1.29"), ("1.299", "1.29"), ("12.345", "12.34"),
    ("1,234,56", "4.56"), ("3 for 10.00", "310.00"), ("4.5 out of 5", "4.55"),
]


def test_parse_price(spark):
    got = evaluate(spark, price.parse_price, [i for i, _ in PARSE_PRICE])
    assert got == [e for _, e in PARSE_PRICE]


def test_clean_text(spark):
    vals = ["  a \n b ", None, " x \ty　", "\x1cz\x1f", "", "   "]
    assert evaluate(spark, text.clean_text, vals) == ["a b", None, "x y", "z", "", ""]


def test_clean_text_idempotent(spark):
    vals = ["  a \n b ", " x \ty", "plain"]
    once = evaluate(spark, text.clean_text, vals)
    assert evaluate(spark, text.clean_text, once) == once


def test_rating_digits_key(spark):
    assert evaluate(spark, text.rating_fr, ["4,5 sur 5 étoiles", "4.5 out of 5 stars"]) == [4.5, None]
    assert evaluate(spark, text.digits_only, ["1 234 évaluations", "none"]) == [1234, None]
    assert evaluate(spark, text.normalise_key, ["Brand Name:", "Marque"]) == ["brandname", "marque"]
    assert evaluate(spark, lambda c: text.strip_trailing(c, ":"), ["Brand::", "a:b"]) == ["Brand", "a:b"]
    assert evaluate(spark, lambda c: text.strip_suffix(c, "_name"), ["SIZE_NAME", "color"]) == ["size", "color"]


def test_srcset(spark):
    assert evaluate(spark, urls.pick_srcset, ["a.jpg 1x, b.jpg 2x", ",", "c.jpg"]) == ["b.jpg", ",", "c.jpg"]
    assert evaluate(spark, urls.pick_srcset_hires, ["a.jpg 1x, b.jpg 2x", "c.jpg"]) == ["b.jpg", "c.jpg"]


def test_discount_and_currency(spark):
    got = evaluate(spark, price.discount_pct, [("39.99", "59.99"), ("35", "40"), ("1,29", "2.00"),
                                               ("10", "5")], "p string, o string")
    assert got == ["-33%", "-12%", None, None]
    assert evaluate(spark, price.currency_from_symbol, ["$10 or €9", "£3", "x"]) == ["EUR", "GBP", None]


def test_vocab(spark):
    assert evaluate(spark, text.match_sizes, ["xl / 15.5 / 60 / xl"]) == [["XL", "15.5"]]
    assert evaluate(spark, text.match_colors, ["bleu marine", "gold or silver"]) == [
        ["BLEU MARINE"], ["GOLD", "OR", "SILVER"]]


URL_CASES = [
    ("https://a.example/x/y?z=1", "../i.jpg"), ("https://a.example/x/y", "//cdn.example/i.jpg"),
    ("https://a.example/x/y", "/abs/p.png"), ("https://a.example/x/y?q=1#f", "?k=2"),
    ("https://a.example/x/y?q=1", "#frag"), ("https://a.example/x/y/", "z"),
    ("https://a.example", "z.jpg"), ("https://a.example/a/b/c", "../../../../d"),
    ("https://a.example/a/b/c", "./"), ("https://a.example/a/b/c", ".."),
    ("https://a.example/a", "http://other.example/p"), ("https://a.example/a", ""),
    ("http://h.example/a/b", "g;x?y#s"), ("http://h.example/a//b/c", "d/./e/../f"),
]


def test_resolve_url_matches_urljoin(spark):
    got = evaluate(spark, urls.resolve_url, URL_CASES, "b string, r string")
    assert got == [urljoin(b, r) for b, r in URL_CASES]


def test_resolve_url_idempotent_on_absolute(spark):
    absolute = [urljoin(b, r) for b, r in URL_CASES]
    got = evaluate(spark, urls.resolve_url, [("https://x.example/q", a) for a in absolute],
                   "b string, r string")
    assert got == absolute
