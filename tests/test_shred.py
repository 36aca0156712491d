"""H1 tree rule and text offsets."""

import random
from html.parser import HTMLParser

from vitrine.operators import shred
from vitrine.operators.shred import parse_page
from vitrine.plans import queries

TRAPS = ('<html><head><title>T &amp; U</title><script>var t="</p>";</script>'
         '<style>p{}</style></head><body><p><b>Bold<br><p>x &copy; y</p></b>'
         '</span><img src="a.png"/><!-- c --><div>tail</div></body></html>')


def test_tree_rule_and_text():
    rows, text = parse_page(TRAPS)
    tags = [r[4] for r in rows]
    assert tags == ["html", "head", "title", "script", "style", "body", "p", "b", "br", "p",
                    "img", "div"]
    by = {i: r for i, r in enumerate(rows)}
    # every descendant lies inside its ancestor's interval
    for r in rows:
        ordv, end, parent = r[0], r[1], r[2]
        assert ordv <= end
        if parent >= 0:
            assert by[parent][0] < ordv <= by[parent][1]
    page = text.decode()
    # script/style text is invisible; entities decoded; </p> inside a script ignored
    assert page == "T & UBoldx © ytail"
    p_outer = rows[6]
    assert text[p_outer[7]:p_outer[8]].decode() == "Boldx © ytail"  # unclosed <p><b> nest
    assert rows[3][10] is None  # plain script: no raw body kept


def test_jsonld_raw_and_joined():
    rows, _ = parse_page('<script type="application/ld+json">{"a": "&amp;"}</script>'
                         '<button> Add <b>to</b>  cart </button><label for="x"></label>'
                         '<input id="x" value="v">')
    assert rows[0][10] == '{"a": "&amp;"}'
    button = rows[1]
    assert button[9] == "Addtocart"
    assert rows[4][9] == ""  # input (label target): no text


def test_bad_html_never_raises():
    for html in ["<", "</x>", "<a b='", "<!--", "<![CDATA[x", "\x00"]:
        parse_page(html)


def test_jsonld_is_strict_json():
    raw = lambda body: parse_page(f'<script type="application/ld+json">{body}</script>')[0][0][10]
    assert raw('{"a": 1, "a": "\u00e9", "b": [NaN, -Infinity, 1.50]}') == '{"a": "é", "b": [null, null, 1.5]}'
    assert raw("{broken") is None and raw("[" * 100_000) is None
    assert raw('{"a": "\ud800"}') == '{"a": "?"}'


def test_needed_attributes_only():
    rows, _ = parse_page('<p class="a b" id="x"><i lang="en"></i></p>', frozenset(["id"]))
    assert [(r[5], r[6]) for r in rows] == [({"id": "x"}, []), ({}, [])]


def test_end_tags_take_linear_time():
    import time

    def seconds(n):
        html = "<div><img src=a><br></div>" * n
        t = time.perf_counter()
        rows, _ = parse_page(html)
        assert len(rows) == 3 * n
        return time.perf_counter() - t

    seconds(1000)
    assert min(seconds(8000) for _ in range(3)) < 16 * min(seconds(1000) for _ in range(3))


def test_output_is_cut_by_size():
    from vitrine.operators.shred import _slices
    assert list(_slices([3, 3, 3, 9, 0, 1], 5)) == [(0, 2), (2, 4), (4, 6)]
    assert list(_slices([], 5)) == []


ODD = ["<p>", "</p>", "<DIV Class=\"Q&amp;A\" id='x'>", "</DIV>", "</div >", "<br>", "<br/>", "<img src=a/>", "<input disabled value=\"v\" disabled>",
       "<script type=\"application/ld+json\">", "{\"a\": 1}", "</script>", "<style>", "</style>", "<!-- c -->", "<!--", "-->", "<!DOCTYPE html>", "<![CDATA[ x ]]>",
       "<?pi ?>", "<?", "<", ">", "&", "&amp;", "&notit;", " a < b ", "\xe9", "\xa0", "<a\xa0b>", "<a b=\"x>y\">", "<a b=\"x", "'", "<a b = 'c'>", "<a b='1'c='2'>",
       "<label for=\"x\">", "</label>", "<button id=\"x\">", "<table>", "<tr>", "<td>", "</td>", "</tr>", "</table>", "<div itemscope>", "<i itemprop='n'>", "</", "</>",
       "</1>", "<1>", "<a/b>", "<x:y z>", "<script/>", "</br>", "<a \x00=\"1\">", "<p a=''b>", "<title>", "</title>"]


def test_plain_tags_read_at_once_give_the_standard_parsers_nodes(monkeypatch):
    def parsed(html):
        try:
            return shred.parse_outline(html)
        except Exception as exc:  # a bad page is an error either way
            return repr(exc)

    rand = random.Random(3)
    pages = ["".join(rand.choices(ODD, k=rand.randrange(1, 30))) for _ in range(1500)]
    quick = [parsed(p) for p in pages]
    monkeypatch.setattr(shred._TreeBuilder, "_plain", lambda self: 0)  # the standard loop alone
    assert quick == [parsed(p) for p in pages]


def test_plain_tags_do_not_pass_through_the_standard_parser(monkeypatch):
    seen = []
    read = HTMLParser.parse_starttag
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i: seen.append(i) or read(self, i))
    rows, text = parse_page("<html><script>if (a < b) {}</script>" + "<p class='a' id=\"b\">x &amp; y</p><br/>" * 500 + "<p x=y></p>")
    assert len(rows) == 1003 and text == b"x & y" * 500
    assert len(seen) == 2  # the script and the bare value


def test_definition_lists_serialise_no_attributes(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(3, "a", "Brand#1", "t", 7, 1.0), (7, "b", None, "t", 8, 1.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double") \
        .write.parquet(f"{tmp_path}/part.parquet")
    asked = []
    monkeypatch.setattr(queries, "shred_pages", lambda df, **kw: asked.append(kw) or shred.shred_pages(df, **kw))
    rows = queries.QUERIES["definition_lists"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [(3, "A", "Brand#1"), (3, "B", "7")]  # a page with a null value is null
    assert asked == [{"needed_attrs": ()}]
