import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vitrine.session import get_session
    s = get_session("local[4]", app="vitrine-tests", shuffle_partitions=8)
    yield s
    s.stop()


def evaluate(spark, fn, values, schema="s string"):
    """Apply an expression builder to a column of input values, in order."""
    from vitrine.functions.sqltext import X
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    names = [f.split()[0] for f in schema.split(",")]
    out = df.select("i", fn(*[X(n) for n in names]).alias("r").col).orderBy("i").collect()
    return [r["r"] for r in out]
