"""URL scalars: N4 resolve_url, N5 pick_srcset, N6 pick_srcset_hires, URL checks.

``resolve_url`` follows the RFC 3986 merge as done by the standard
``urljoin``: a reference with its own scheme and authority is returned as is,
``//`` borrows the base scheme, an empty path keeps the base path (and its
query when the reference has none), a ``/`` path replaces the base path,
anything else is merged with the base directory; dot segments are then
removed with a left fold over the path segments.
"""

from __future__ import annotations

from vitrine.functions.sqltext import Column, F

from vitrine.functions import vocab
from vitrine.functions.core import let
from vitrine.functions.text import py_strip

# RFC 3986 appendix B split: scheme, authority, path, query, fragment.
_URI_RX = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_parts(c) -> Column:
    """STRUCT<scheme (lower-cased), has_net, net, path, query, frag> of a URL."""
    c = _c(c)
    return F.struct(
        F.lower(F.regexp_extract(c, _URI_RX, 1)).alias("scheme"),
        F.regexp_like(c, F.lit(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//")).alias("has_net"),
        F.regexp_extract(c, _URI_RX, 2).alias("net"),
        F.regexp_extract(c, _URI_RX, 3).alias("path"),
        F.regexp_extract(c, _URI_RX, 4).alias("query"),
        F.regexp_extract(c, _URI_RX, 5).alias("frag"),
        c.alias("url"))


def _remove_dot_segments(segments: Column) -> Column:
    folded = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))))
    last = F.try_element_at(segments, F.lit(-1))
    return F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)


def _unparse(scheme, net, path, query, frag) -> Column:
    # urlunsplit: an authority (or a netloc scheme) gets '//' and a rooted path
    authority = (net != "") | scheme.isin("http", "https")
    path = F.when(authority & (path != "") & ~path.startswith("/"),
                  F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(authority, F.concat(F.lit("//"), net)).otherwise(F.lit("")),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")))


def _resolve(b: Column, r: Column) -> Column:
    """Resolve parts ``r`` against base parts ``b`` (both from ``url_parts``)."""
    def merged_path():
        bsegs = F.split(b["path"], "/")
        base_dir = F.slice(bsegs, 1, F.greatest(F.size(bsegs) - 1, F.lit(0)))
        merged = F.concat(base_dir, F.split(r["path"], "/"))
        return let(merged, lambda m: F.filter(
            m, lambda s, i: (i == 0) | (i == F.size(m) - 1) | (s != "")))

    segments = F.when(r["path"].startswith("/"), F.split(r["path"], "/")).otherwise(merged_path())
    resolved = let(F.array_join(_remove_dot_segments(segments), "/"),
                   lambda p: F.when(p == "", F.lit("/")).otherwise(p))
    same_path = _unparse(b["scheme"], b["net"], b["path"],
                         F.when(r["query"] != "", r["query"]).otherwise(b["query"]), r["frag"])
    relative = _unparse(b["scheme"], b["net"], resolved, r["query"], r["frag"])
    ref = r["url"]
    return (
        F.when(b["url"].isNull() | (b["url"] == ""), ref)
        .when(ref.isNull(), F.lit(None))
        .when(ref == "", b["url"])
        .when((r["scheme"] != "") & ((r["scheme"] != b["scheme"])
                                     | ~r["scheme"].isin("http", "https")), ref)
        .when(r["has_net"] & (r["scheme"] != ""), ref)
        .when(r["has_net"], F.concat(b["scheme"], F.lit(":"), ref))
        .when(r["path"] == "", same_path)
        .otherwise(relative))


def resolve_parts(base_parts: Column, ref) -> Column:
    """N4 with the base already split by ``url_parts`` (a page-level column)."""
    return let(url_parts(_c(ref)), lambda r: _resolve(base_parts, r))


def resolve_url(base, ref) -> Column:
    """Absolute URL of ``ref`` against ``base``."""
    return let(F.struct(url_parts(_c(base)).alias("b"), url_parts(_c(ref)).alias("r")),
               lambda x: _resolve(x["b"], x["r"]))


def pick_srcset(c) -> Column:
    """N5 (generic rule): with a comma, last non-empty first token of the parts."""
    c = _c(c)
    parts = F.transform(F.split(c, ","), lambda p: F.substring_index(py_strip(p), " ", 1))
    picked = F.try_element_at(F.filter(parts, lambda x: x != ""), F.lit(-1))
    return F.when(F.contains(c, F.lit(",")), F.coalesce(picked, c)).otherwise(c)


def pick_srcset_hires(c) -> Column:
    """N6 (marketplace rule): with a comma, last part, stripped, first token."""
    c = _c(c)
    last = F.substring_index(py_strip(F.substring_index(c, ",", -1)), " ", 1)
    return F.when(F.contains(c, F.lit(",")), last).otherwise(c)


# An absolute http(s) URL: user info, a host without characters that no host
# may hold, a port; whatever follows is not restricted.
_HTTP_RX = (r"(?is)^[\x00-\x20]*https?:[/\\]+(?:[^/?#\\]*@)?"
            r"(?:\[[0-9a-f:.]+\]|[^\s/?#\\@:\[\]<>^|%]+)(?::[0-9]{0,5})?(?:[/?#\\].*)?$")
# Longest accepted URL (fixed value).
MAX_URL_CHARS = 2083


def is_http_url(c) -> Column:
    """Absolute http(s) URL with a host (request validation)."""
    c = _c(c)
    return F.coalesce(F.regexp_like(c, F.lit(_HTTP_RX)) & (F.length(c) <= MAX_URL_CHARS), F.lit(False))


__all__ = ["resolve_url", "pick_srcset", "pick_srcset_hires", "is_http_url", "vocab"]
