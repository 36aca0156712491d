"""H1-H3: shred captured pages into ordered DOM nodes.

This is the only Python in the extraction plan. Each Arrow batch of pages is
parsed with the standard library's ``html.parser`` and returned as columnar
Arrow arrays (``mapInArrow``): one row per page, the nodes as an
``ARRAY<STRUCT>`` in document order. Everything downstream is Catalyst.

Tree rule (our definition, close to a lenient tree builder on top of
``html.parser``): void elements never open; an end tag closes up to the
nearest open element of that name; unmatched end tags are ignored; nothing is
implicitly closed; open elements end with the document. Text inside script,
style and template, and comments, is not visible text.

A page that fails to parse becomes a row with NULL nodes and an error message;
it never fails the job.
"""

from __future__ import annotations

import json
import re
import sys
from html import unescape
from html.parser import HTMLParser
from typing import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine import schemas
from vitrine.functions.sqltext import F as SF
from vitrine.functions.sqltext import X

try:  # ship the worker-side code by value: executors need not have the package
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

# HTML void elements (WHATWG list plus legacy names).
VOID_TAGS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
    "link", "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid",
    "spacer",
])
# Elements whose text is not part of the visible page text.
HIDDEN_TAGS = frozenset(["script", "style", "template"])
# Elements whose stripped-and-joined text is kept (the variant rule reads it).
JOINED_TAGS = frozenset(["button", "label", "input"])
# Script type whose body is structured data.
JSONLD_TYPE = "application/ld+json"
# Scope and property attributes of the two attribute syntaxes.
SCOPE_ATTRS = {"microdata": ("itemscope", "itemprop"), "rdfa": ("typeof", "property")}
# Bits of a node's ``below`` mask: one a name, the last for every other element.
TAG_BITS = {t: i for i, t in enumerate([
    "a", "abbr", "article", "aside", "b", "blockquote", "body", "br", "button", "caption", "cite", "code", "dd", "del", "div", "dl", "dt", "em",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "i", "img", "input", "ins", "label", "li", "link", "main", "meta",
    "nav", "ol", "option", "p", "picture", "pre", "s", "script", "section", "select", "small", "source", "span", "strong", "style", "sub", "sup",
    "table", "tbody", "td", "th", "tr", "ul", "video"])}
OTHER_BIT = len(TAG_BITS)


# Elements whose places are noted: tables and their parts, labels, and those whose joined text is kept.
NOTED_TAGS = JOINED_TAGS | {"td", "th", "tr", "table"}
# Elements whose content the standard parser reads in another mode.
_MODE_TAGS = frozenset([*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext"])
# Plain tags: names and attributes of common characters, values in quotes. All others are left to the standard parser.
_PLAIN_START = re.compile(r"""<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][-a-zA-Z0-9_:.]*(?:="[^"]*"|='[^']*')?)*)[ \t\n\r\f]*(/?)>""")
_PLAIN_ATTR = re.compile(r"""([a-zA-Z][-a-zA-Z0-9_:.]*)(?:="([^"]*)"|='([^']*)')?""")
_PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")


class _TreeBuilder(HTMLParser):
    """Collects one page's nodes into flat column lists."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.end: list[int] = []
        self.attrs: list[dict] = []
        self.t0: list[int] = []
        self.t1: list[int] = []
        self.p0: list[int] = []
        self.p1: list[int] = []
        self.raw: dict[int, list[str]] = {}
        self.stack: list[int] = []
        self.pieces: list[str] = []
        self.nbytes = 0
        self.hidden = 0
        self.pending: list[str] = []
        self.closed_void: dict[str, int] = {}
        self.below: list[int] = []
        #: First element of each id.
        self.ids: dict[str, int] = {}
        #: Labels, and the elements whose joined text is kept.
        self.labels: list[int] = []
        self.joined: list[int] = []
        #: Scopes as (syntax, node, nodes of its own properties), and the open ones of each syntax.
        self.scopes: list[tuple[str, int, list[int]]] = []
        self.open_scopes: dict[str, list[tuple[int, list[int]]]] = {s: [] for s in SCOPE_ATTRS}
        #: Tables as [node, first row, row after the last], rows as the nodes of their first cells (two at most).
        self.tables: list[list[int]] = []
        self.open_tables: list[list[int]] = []
        self.rows: list[list[int]] = []
        self.short_rows: list[tuple[int, list[int]]] = []

    # -- places that others refer to: each element is looked at once --------
    def _note_attrs(self, i: int, amap: dict) -> None:
        for syntax, (scope, prop) in SCOPE_ATTRS.items():
            if scope in amap:
                found = (i, [])
                self.open_scopes[syntax].append(found)
                self.scopes.append((syntax, *found))
            elif prop in amap and self.open_scopes[syntax]:
                self.open_scopes[syntax][-1][1].append(i)
        if amap.get("id"):
            self.ids.setdefault(amap["id"], i)

    def _note_tag(self, i: int, tag: str) -> None:
        if tag in ("td", "th"):
            # a row leaves the list with its second cell, so this is linear in the page
            for _, cells in self.short_rows:
                cells.append(i)
            self.short_rows = [r for r in self.short_rows if len(r[1]) < 2]
        elif tag == "tr":
            self.rows.append([])
            self.short_rows.append((i, self.rows[-1]))
        elif tag == "table":
            table = [i, len(self.rows), len(self.rows)]
            self.tables.append(table)
            self.open_tables.append(table)
        else:
            self.joined.append(i)
            if tag == "label":
                self.labels.append(i)

    def _forget(self, i: int, tag: str) -> None:
        if self.scopes:
            for opened in self.open_scopes.values():
                if opened and opened[-1][0] == i:
                    opened.pop()
        if tag == "tr" and self.short_rows and self.short_rows[-1][0] == i:
            self.short_rows.pop()
        elif tag == "table" and self.open_tables and self.open_tables[-1][0] == i:
            self.open_tables.pop()[2] = len(self.rows)

    # -- tokens -----------------------------------------------------------
    def updatepos(self, i: int, j: int) -> int:
        return j  # lines and columns are not read

    def goahead(self, end) -> None:
        if not end:
            self.rawdata = self.rawdata[self._plain():]
        super().goahead(end)

    def _plain(self) -> int:
        """Reads the page's plain tags and the texts between them; any other markup is
        read by the standard parser's own method for it. Returns the place from which
        the standard loop goes on: a last text, or markup that does not end."""
        raw, i = self.rawdata, 0
        while True:
            if self.cdata_elem is not None:
                close = None if getattr(self, "_escapable", False) else self.interesting.search(raw, i)
                if close is None:
                    return i
                j = close.start()
                if i < j:
                    self.handle_data(raw[i:j])
            else:
                j = raw.find("<", i)
                if j < 0:
                    return i
                if i < j:
                    text = raw[i:j]
                    self.handle_data(unescape(text) if "&" in text else text)
                if m := _PLAIN_END.match(raw, j):
                    self.handle_endtag(m[1].lower())
                    i = m.end()
                    continue
                if (m := _PLAIN_START.match(raw, j)) and (tag := m[1].lower()) not in _MODE_TAGS:
                    amap = {}
                    if m[2]:
                        for name, double, single in _PLAIN_ATTR.findall(m[2]):
                            value = double or single
                            amap[name.lower()] = unescape(value) if "&" in value else value
                    self._start(tag, amap, bool(m[3]))
                    i = m.end()
                    continue
            i = self._markup(raw, j)
            if i < 0:
                return j

    def _markup(self, raw: str, i: int) -> int:
        """The place after the markup at ``i``, handled by the standard parser; -1 where its loop has to go on."""
        if raw.startswith("</", i):
            return self.parse_endtag(i)
        if raw.startswith("<!--", i):
            return self.parse_comment(i)
        if raw.startswith("<?", i):
            return self.parse_pi(i)
        if raw.startswith("<!", i):
            return self.parse_html_declaration(i)
        return self.parse_starttag(i) if "a" <= raw[i + 1:i + 2].lower() <= "z" and raw[i + 1].isascii() else -1

    # -- text -------------------------------------------------------------
    def _flush(self) -> None:
        if self.pending:
            piece = "".join(self.pending)
            self.pending = []
            self.pieces.append(piece)
            self.nbytes += len(piece) if piece.isascii() else len(piece.encode("utf-8"))

    def handle_data(self, data: str) -> None:
        if self.hidden:
            if self.stack:
                buf = self.raw.get(self.stack[-1])
                if buf is not None:
                    buf.append(data)
            return
        self.pending.append(data)

    # -- structure --------------------------------------------------------
    def _open(self, tag: str, amap: dict) -> int:
        if self.pending:
            self._flush()
        i, stack, nbytes, npieces = len(self.tag), self.stack, self.nbytes, len(self.pieces)
        self.tag.append(tag)
        self.parent.append(stack[-1] if stack else -1)
        self.depth.append(len(stack))
        self.end.append(i)
        self.attrs.append(amap)
        self.t0.append(nbytes)
        self.t1.append(nbytes)
        self.p0.append(npieces)
        self.p1.append(npieces)
        stack.append(i)
        self.below.append(0)
        if amap:
            self._note_attrs(i, amap)
        if tag in NOTED_TAGS:
            self._note_tag(i, tag)
        elif tag in HIDDEN_TAGS:
            self.hidden += 1
            if tag == "script" and amap.get("type") == JSONLD_TYPE:
                self.raw[i] = []
        return i

    def _pop(self) -> None:
        i = self.stack.pop()
        tag = self.tag[i]
        self.end[i] = len(self.tag) - 1
        self.t1[i] = self.nbytes
        self.p1[i] = len(self.pieces)
        if self.stack:
            self.below[self.stack[-1]] |= self.below[i] | 1 << TAG_BITS.get(tag, OTHER_BIT)
        if self.scopes or tag in NOTED_TAGS:
            self._forget(i, tag)
        if tag in HIDDEN_TAGS:
            self.hidden -= 1

    def _start(self, tag: str, amap: dict, ended: bool) -> None:
        self._open(tag, amap)
        if ended:
            self._pop()
        elif tag in VOID_TAGS:
            self._pop()
            self.closed_void[tag] = self.closed_void.get(tag, 0) + 1

    def handle_starttag(self, tag, attrs):
        self._start(tag, {k: "" if v is None else v for k, v in attrs}, False)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, {k: "" if v is None else v for k, v in attrs}, True)

    def handle_endtag(self, tag):
        if self.pending:
            self._flush()
        if self.closed_void and self.closed_void.get(tag):
            self.closed_void[tag] -= 1
            return
        stack, tags = self.stack, self.tag
        if stack and tags[stack[-1]] == tag:
            self._pop()
            return
        for pos in range(len(stack) - 1, -1, -1):
            if tags[stack[pos]] == tag:
                while len(stack) > pos:
                    self._pop()
                return
        # unmatched end tag: ignored

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()

    def finish(self) -> None:
        self.close()
        self._flush()
        while self.stack:
            self._pop()


def _joined(pieces: list[str], p0: int, p1: int) -> str:
    return "".join(s for s in (p.strip() for p in pieces[p0:p1]) if s)


def _plain_json(raw: str) -> str | None:
    """A JSON-LD body as strict JSON: of a repeated key the last value stays,
    NaN and infinities become null; NULL when the body is no JSON."""
    try:
        text = json.dumps(json.loads(raw, parse_constant=lambda _: None), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None
    return text.encode("utf-8", "replace").decode("utf-8")


def _page_columns(html: str, needed_attrs: frozenset[str] | None = None) -> tuple[list[list], bytes, dict]:
    """One page as a list of values for each field of a node, its UTF-8 text and its outline."""
    b = _TreeBuilder()
    b.feed(html)
    b.finish()
    n, attrs = len(b.tag), b.attrs
    joined, raws, targets = [None] * n, [None] * n, [None] * n
    for i in b.joined:
        joined[i] = _joined(b.pieces, b.p0[i], b.p1[i])
    named = set()
    for i in b.labels:
        if name := attrs[i].get("for"):
            named.add(name)
            targets[i] = b.ids.get(name)
    if named:
        for i, a in enumerate(attrs):
            if a.get("id") in named:
                joined[i] = _joined(b.pieces, b.p0[i], b.p1[i])
    for i, raw in b.raw.items():
        raws[i] = _plain_json("".join(raw))
    if needed_attrs is not None:
        attrs = [{k: v for k, v in a.items() if k in needed_attrs} if a else a for a in attrs]
    classes = [a["class"].split() if "class" in a else [] for a in attrs]
    outline = {"scopes": [{"syntax": s, "ord": i, "props": props} for s, i, props in b.scopes],
               "tables": [{"ord": i, "r0": r0, "r1": r1} for i, r0, r1 in b.tables],
               "rows": [{"c1": c[0], "c2": c[1]} if len(c) == 2 else None for c in b.rows]}
    return ([range(n), b.end, b.parent, b.depth, b.tag, attrs, classes, b.t0, b.t1, joined, raws, b.below, targets],
            "".join(b.pieces).encode("utf-8"), outline)


def parse_outline(html: str, needed_attrs: frozenset[str] | None = None) -> tuple[list[tuple], bytes, dict]:
    """Parse one page: (node tuples in document order, UTF-8 page text, outline).

    ``needed_attrs``: keep these attributes only (``class`` also fills the
    token list); all by default. The outline has ``scopes`` (syntax, node, nodes
    of the properties whose innermost scope it is), ``rows`` (their first two
    cells, or null) and ``tables`` (node, and the range of ``rows`` below it).
    """
    columns, text, outline = _page_columns(html, needed_attrs)
    return list(zip(*columns)), text, outline


def parse_page(html: str, needed_attrs: frozenset[str] | None = None) -> tuple[list[tuple], bytes]:
    """The nodes and the text of ``parse_outline``."""
    return parse_outline(html, needed_attrs)[:2]


_ARROW_NODE = pa.struct([
    ("ord", pa.int32()), ("end_ord", pa.int32()), ("parent", pa.int32()),
    ("depth", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())),
    ("classes", pa.list_(pa.string())), ("t0", pa.int32()), ("t1", pa.int32()),
    ("text_joined", pa.string()), ("raw", pa.string()),
    ("below", pa.int64()), ("target", pa.int32()),
])
_ARROW_OUTLINE = pa.struct([
    ("scopes", pa.list_(pa.struct([("syntax", pa.string()), ("ord", pa.int32()), ("props", pa.list_(pa.int32()))]))),
    ("tables", pa.list_(pa.struct([("ord", pa.int32()), ("r0", pa.int32()), ("r1", pa.int32())]))),
    ("rows", pa.list_(pa.struct([("c1", pa.int32()), ("c2", pa.int32())]))),
])


def _nodes_array(pages: list) -> pa.Array:
    """Columnar Arrow build of ARRAY<node> for a batch of ``_page_columns`` (None = null row)."""
    cols = [[] for _ in range(13)]
    akeys, avals, aoff = [], [], [0]
    cvals, coff = [], [0]
    poff, mask = [0], []
    for columns in pages:
        if columns is None:
            mask.append(True)
            poff.append(poff[-1])
            continue
        mask.append(False)
        for j in (0, 1, 2, 3, 4, 7, 8, 9, 10, 11, 12):
            cols[j].extend(columns[j])
        for a in columns[5]:
            if a:
                akeys.extend(a)
                avals.extend(a.values())
            aoff.append(len(akeys))
        for c in columns[6]:
            if c:
                cvals.extend(c)
            coff.append(len(cvals))
        poff.append(len(cols[0]))
    i32 = pa.int32()
    attrs = pa.MapArray.from_arrays(pa.array(aoff, i32), pa.array(akeys, pa.string()),
                                    pa.array(avals, pa.string()))
    classes = pa.ListArray.from_arrays(pa.array(coff, i32), pa.array(cvals, pa.string()))
    struct = pa.StructArray.from_arrays(
        [pa.array(cols[0], i32), pa.array(cols[1], i32), pa.array(cols[2], i32),
         pa.array(cols[3], i32), pa.array(cols[4], pa.string()), attrs, classes,
         pa.array(cols[7], i32), pa.array(cols[8], i32),
         pa.array(cols[9], pa.string()), pa.array(cols[10], pa.string()),
         pa.array(cols[11], pa.int64()), pa.array(cols[12], i32)],
        fields=list(_ARROW_NODE))
    return pa.ListArray.from_arrays(pa.array(poff, i32), struct,
                                    mask=pa.array(mask, pa.bool_()))


# Characters of HTML after which the shredded pages so far are handed on.
FLUSH_CHARS = 4_000_000


def _slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` in total size, one row at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _shred_batches(batches: Iterable[pa.RecordBatch], html_col: str, keep: list[str],
                   needed_attrs: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        sizes = [len(v) if (v := x.as_py()) else 0 for x in whole.column(html_col)]
        for lo, hi in _slices(sizes, FLUSH_CHARS):
            rb = whole.slice(lo, hi - lo)
            pages, texts, outlines, errors = [], [], [], []
            for html in rb.column(html_col).to_pylist():
                if html is None or html == "":
                    pages.append(None)
                    texts.append(None)
                    outlines.append(None)
                    errors.append("empty html")
                    continue
                try:
                    columns, text, outline = _page_columns(html, needed_attrs)
                    pages.append(columns)
                    texts.append(text)
                    outlines.append(outline)
                    errors.append(None)
                except Exception as exc:  # a bad page is a row, not a failed job
                    pages.append(None)
                    texts.append(None)
                    outlines.append(None)
                    errors.append(f"shred: {type(exc).__name__}: {exc}")
            arrays = [rb.column(c) for c in keep]
            arrays += [_nodes_array(pages), pa.array(texts, pa.binary()),
                       pa.array(outlines, _ARROW_OUTLINE), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=keep + ["nodes", "page_text", "outline", "shred_error"])


def shred_pages(df: DataFrame, html_col: str = "html", needed_attrs: Iterable[str] | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """H1: one parse per page -> ``nodes ARRAY<node>``, ``page_text`` BINARY, ``outline``, ``shred_error``.

    All other input columns pass through; the HTML column is dropped (it is
    not needed after shredding). Filters on the captures must be applied
    before this call: Catalyst cannot push predicates through ``mapInArrow``.
    ``needed_attrs`` names the attributes that the caller reads; the others are
    not serialised. The input's own splits are used as they are
    (``spark.sql.files.maxPartitionBytes`` sizes them); ``num_partitions``
    round-robins the raw pages first, for an input of few splits.
    """
    if num_partitions:
        df = df.repartition(num_partitions)
    keep = [f.name for f in df.schema.fields if f.name != html_col]
    needed = None if needed_attrs is None else frozenset(needed_attrs)
    out_schema = T.StructType(
        [f for f in df.schema.fields if f.name != html_col]
        + [T.StructField("nodes", schemas.NODES),
           T.StructField("page_text", T.BinaryType()),
           T.StructField("outline", schemas.OUTLINE),
           T.StructField("shred_error", T.StringType())])
    return df.mapInArrow(lambda it: _shred_batches(it, html_col, keep, needed), out_schema)


# ---------------------------------------------------------------------------
# Node accessors (expression builders, see functions.sqltext)
# ---------------------------------------------------------------------------

def node_text(n: X, page_text: str = "page_text") -> X:
    """Visible text of node ``n`` (its ``get_text()``): an O(1) byte slice."""
    return SF.substring(SF.col(page_text), n["t0"] + 1, n["t1"] - n["t0"]).cast("string")


def page_text_str(page_text: str = "page_text") -> X:
    return SF.col(page_text).cast("string")


def descendants(n: X, nodes: str | X = "nodes") -> X:
    """J2 containment: the descendants of ``n`` are a contiguous slice."""
    arr = SF.col(nodes) if isinstance(nodes, str) else nodes
    return SF.slice(arr, n["ord"] + 2, n["end_ord"] - n["ord"])


def base_url_expr(url_col: str = "url") -> X:
    """H2: first ``<base href>`` resolved against the page URL, else the page URL."""
    from vitrine.functions.core import let
    from vitrine.functions.urls import resolve_url

    base = SF.try_element_at(
        SF.filter(SF.col("nodes"), lambda n: (n["tag"] == "base")
                  & (SF.coalesce(n["attrs"]["href"], SF.lit("")) != "")), SF.lit(1))
    return let(base, lambda b: SF.when(b.isNotNull(), resolve_url(SF.col(url_col), b["attrs"]["href"]))
               .otherwise(SF.col(url_col)))


def explode_nodes(df: DataFrame, *keep: str, with_text: bool = True) -> DataFrame:
    """H3: long form, one row per element: the kept columns, the node's fields and its ``text``.

    Texts are cut from the page before its rows are spread, so a row carries its
    own text and never the page. Without ``with_text`` no text is cut.
    """
    nodes = F.col("nodes")
    if with_text:
        nodes = F.transform(nodes, lambda n: F.struct(
            *[n[f.name].alias(f.name) for f in schemas.NODE.fields],
            F.col("page_text").substr(n["t0"] + 1, n["t1"] - n["t0"]).cast("string").alias("text")))
    return df.select(*[F.col(c) for c in keep], F.inline(nodes))
