"""URL rules against plain parsing, and mining and matching against every subset."""

from itertools import combinations
from urllib.parse import urlsplit

from vitrine.llm.url_rules import HOST_RULES, MIN_CONFIDENCE, MIN_SUPPORT, filter_urls, tokens_of

SF = "/root/testdata/sf0.01"
ODD = [None, "", "no scheme", "http://", "HTTP://WWW.EXAMPLE.NET", "http://a.net/x", "http://net/", "http://net", "http://anet/", "https://x.example.net/en/1", "https://example.net/en",
       "https://ÄExample.NET/EN/", "http://a.example.com/de/1?x=1#y", "http://b.org/fr/9", "http://b.org?u=://c.net/", "x://y://z.net/", "http://a.net#/f", "http://h.org/fr/" + "p" * 100_000]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def mined(baskets):
    """Rules by counting every subset of every basket."""
    n, count, with_label = len(baskets), {}, {}
    for tokens, label in baskets:
        for size in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), size):
                count[c] = count.get(c, 0) + 1
                with_label[c, label] = with_label.get((c, label), 0) + 1
    rules = {(c, v): (k / count[c], k / n) for (c, v), k in with_label.items() if k / n >= MIN_SUPPORT and k / count[c] >= MIN_CONFIDENCE}
    return {r: x for r, x in rules.items() if not any(set(o[0]) < set(r[0]) and o[1] == r[1] and y[0] >= x[0] for o, y in rules.items())}


def check(spark, urls):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, label string")
    tokens = {r["url"]: r["t"] for r in df.select("url", tokens_of(df["url"]).alias("t")).collect()}
    facts = {u: plain(u) for u in urls}
    rules = mined([(tokens[u], facts[u][3]) for u in {u for u in urls if u is not None} if facts[u][3]])
    want = []
    for i, u in enumerate(urls):
        host, path, rule, verdict = facts[u]
        if verdict is None:
            fired = sorted((-x[0], -x[1], r[1] != "block", r[0], r[1]) for r, x in rules.items() if u is not None and set(r[0]) <= set(tokens[u]))
            verdict = fired[0][4] if fired else "allow"
        want.append((i, host, path, rule, verdict))
    got = filter_urls(df)
    assert got.columns == ["page_id", "url", "label", "host", "path", "rule", "verdict"]
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()) == want
    return rules, want


def test_odd_urls(spark):
    check(spark, ODD + ODD[3:9])


def test_mined_verdicts_on_pages(spark):
    urls = [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    rules, want = check(spark, urls)
    assert rules and {v for *_, r, v in want if r is None} == {"allow", "block"}
    assert all(urlsplit(u).hostname for u in urls)


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    assert [r["verdict"] for r in filter_urls(df).collect()] == ["allow", "allow"]
    assert filter_urls(df.limit(0)).count() == 0


def test_deep_parts_and_file_endings(spark):
    """What tells the URLs apart stands in the third or fourth path part, or is the file ending alone."""
    rows = []
    for k in range(40):
        rows += [(f"http://h{k}.ads.net/a{k}/b/{'x/' * (k % 2)}banner", "block"), (f"http://h{k}.x.example.net/en/b/{k}/text", "allow"),
                 (f"http://h{k}.ads.net/f{k}/g{k}.SWF", "block"),
                 (f"http://o{k}.info/a/b/{'y/' * (k % 2)}banner", "block"), (f"http://o{k}.info/q{k}/r/s/movie{k}x{k}.swf", "block"), (f"http://o{k}.info/q/text", "allow")]
    df = spark.createDataFrame(rows, "url string, want string")
    wrong = [(r["url"], r["verdict"]) for r in filter_urls(df).collect() if r["verdict"] != r["want"]]
    assert wrong == []
    got = spark.createDataFrame([("http://a.b/c/d/e12/f.x.PHP?q=1.js",), ("http://a.b/c.d/",), ("http://a.b",)], "url string")
    assert [sorted(x for x in r["t"] if not x.startswith(("host", "scheme"))) for r in got.select(tokens_of(got["url"]).alias("t")).collect()] == [
        ["ending=php", "path0=c", "path1=d", "path=e0", "path=f.x.PHP", "query=q"], ["path0=c.d"], []]
