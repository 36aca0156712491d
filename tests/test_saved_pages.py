"""Saved pages as a data source: equal to the table form, broken files, partitions, filters before the read."""

import json
import os
import tempfile

from vitrine.plans.extract import extract_products
from vitrine.sources import catalogue, saved_pages
from vitrine.sources.saved_pages import Pages, FilteringReader, read_saved_pages

SF = "/root/testdata/sf0.001"


def save(rows):
    folder = tempfile.mkdtemp(prefix="vitrine-saved-")
    for r in rows:
        at = os.path.join(folder, f"{r['page_id'] % 3}")
        os.makedirs(at, exist_ok=True)
        with open(f"{at}/{r['page_id']}.json", "w") as f:
            json.dump({k: r[k] for k in ("page_id", "url", "strategy", "error") if r[k] is not None}, f)
        if r["html"] is not None:
            with open(f"{at}/{r['page_id']}.html", "w") as f:
                f.write(r["html"])
    return folder


def test_titles_equal_those_of_the_table(spark):
    table = catalogue.captures(spark, SF).where("page_id < 120")
    pages = read_saved_pages(spark, save(table.collect()), pages_per_partition=16)
    assert pages.rdd.getNumPartitions() == -(-table.count() // 16)
    titles = lambda df: sorted(map(repr, extract_products(df).select("page_id", "url", "strategy", "error", "product.title").collect()))
    assert titles(pages) == titles(table)


def test_broken_files(spark):
    folder = save([{"page_id": 1, "url": "https://x.example/", "strategy": "HTTPX", "html": "<p>ok", "error": None}])
    for name, text in (("a.html", "<p>alone"), ("b.json", "{broken"), ("c.json", "[1]"), ("d.json", '{"page_id": "seven"}'), ("e.txt", "ignored"),
                       ("f.json", '{"page_id": 6, "error": "HTTP 503"}')):
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    with open(os.path.join(folder, "g.html"), "wb") as f:
        f.write(b"caf\xe9")
    with open(os.path.join(folder, "g.json"), "w") as f:
        f.write('{"page_id": 7}')
    got = sorted((r["page_id"] or 0, r["html"], r["error"]) for r in read_saved_pages(spark, folder).collect())
    assert got[4:] == [(1, "<p>ok", None), (6, None, "HTTP 503"), (7, "caf�", None)]
    assert [e.split(":")[0] for _, _, e in got[:4]] == ["sidecar"] * 4
    assert read_saved_pages(spark, tempfile.mkdtemp(prefix="vitrine-saved-")).count() == 0


def test_unwanted_pages_are_not_opened(spark, monkeypatch):
    from pyspark.sql.datasource import EqualTo, In

    rows = [{"page_id": i, "url": f"https://x.example/{i}", "strategy": "HTTPX" if i % 2 else "PLAYWRIGHT", "html": "<p>", "error": None} for i in range(10)]
    folder = save(rows)
    reader = FilteringReader(folder, 4)
    assert [len(p.names) for p in reader.partitions()] == [4, 4, 2]
    list(reader.pushFilters([EqualTo(("strategy",), "HTTPX"), In(("url",), ("https://x.example/1", "https://x.example/2"))]))
    opened = []

    class Files:
        def open_input_stream(self, path):
            opened.append(os.path.basename(path))
            return open(path, "rb")

    monkeypatch.setattr(saved_pages, "_open", lambda f: (Files(), f))
    names = [(f"{folder}/{i % 3}/{i}", True) for i in range(10)]
    assert [r[0] for r in reader.read(Pages(names))] == [1]
    assert [x for x in opened if x.endswith(".html")] == ["1.html"]
    monkeypatch.undo()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = read_saved_pages(spark, folder)
        assert sorted(r["page_id"] for r in df.where("strategy = 'HTTPX' AND page_id > 2").collect()) == [3, 5, 7, 9]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
