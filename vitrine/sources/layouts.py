"""Rendered layout pages: element structure that the other rendered pages do not have (test input only).

One page per ``part`` row, style ``p_partkey % 4``; no extraction result is
computed here, the expected values are SQL over ``part``.

style  markup
0      labels whose target has a value, an aria-label or a text, whose id occurs twice, or is missing
1      a table within a cell, rows of one and of three cells, a table without rows
2      price candidates: leaves and elements that have others below
3      lists within lists with unequal terms and values, selects, and a child list among descendants
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.sources.catalogue import _HEAD, SHOP, dealt, sql_template

STYLES = {
    0: _HEAD + '<title>{name}</title></head><body><label for="a{key}"></label><label for="gone"></label><label>no id</label>'
       '<label for="b{key}">own text</label><input id="a{key}" value="{name}"><input id="a{key}" value="second">'
       '<button id="b{key}" value=""> {brand} <b>x</b></button><label for="c"></label><p id="c" aria-label="{size}">t</p><i id="c"></i></body></html>',
    1: _HEAD + '<title>{name}</title></head><body><table id="t1"><tr><th>Outer {key}</th><td>{name}'
       '<table id="t2"><tr><td>Inner</td><td>{brand}</td><td>third</td></tr><tr><td>alone</td></tr></table></td></tr>'
       '<tr><th>Size</th><td>{size}</td></tr></table><table id="t3"></table></body></html>',
    2: _HEAD + '<title>{name}</title></head><body><div>{brand} <span>{P}</span></div><p><em>{OLD}</em></p>'
       '<section><p>12 {size}</p><div><i>x</i></div></section><ul><li>y<b>{key}</b></li></ul></body></html>',
    3: _HEAD + '<title>{name}</title></head><body><dl><dt>A</dt><dd>{brand}</dd><dt>B</dt><dd>{size}</dd><dt>C</dt></dl>'
       '<select id="s{key}"><option value="">Choisir</option><option value="1">{name}</option><option value="2"> </option></select>'
       '<ul><li>one<ul><li>two {key}</li></ul></li></ul><ol><li>three</li></ol></body></html>',
}


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html of the layout pages."""
    part = dealt(spark.read.parquet(f"{sf_dir}/part.parquet"))
    cases = " ".join(f"WHEN {s} THEN {sql_template(t)}" for s, t in STYLES.items())
    return part.selectExpr("p_partkey AS page_id", f"concat('{SHOP}/l/', CAST(p_partkey AS STRING)) AS url",
                           f"CASE p_partkey % 4 {cases} END AS html")
