"""Registered queries against their SQL on the small tables, and their column contracts."""

import duckdb
import pytest

from vitrine.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    res = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})")
    assert got == sorted(repr(r) for r in res.fetchall())
