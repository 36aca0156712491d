"""The driver contract, with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(repo):
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    return [set(line.split()) for line in out.stdout.splitlines()[-2:]]


def test_queries_without_llm(tmp_path):
    bare = tmp_path / "repo"
    shutil.copytree(REPO, bare, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "tests"))
    queries, oracles = _names(bare)
    assert oracles <= queries and "products" in queries
    assert not any(q.startswith("op") or q == "pipeline" for q in queries)


def test_entry_runs(spark):
    sys.path.insert(0, REPO)
    import __spark_entry__
    df = __spark_entry__.entry(spark)
    assert df.count() == 200 and df.columns == df.schema.names
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
