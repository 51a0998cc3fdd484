"""Driver contract and the SQL oracle gate (every query vs DuckDB)."""

import pytest

import __spark_entry__ as entry_mod
from conftest import SF_SMALL
from ledgerlens.oracle_sql import SQL
from ledgerlens.plans.registry import QUERIES
from oracle_harness import compare, duck


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "unique_users" in df.columns


def test_every_query_has_oracle_sql():
    assert set(SQL) == set(QUERIES)
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, SF_SMALL, QUERIES, SQL)
    assert r["status"] == "exact", r


@pytest.mark.parametrize("gone,kept", [(["ledgerlens/llm", "corpus_pipeline.py"], 0), (["ledgerlens/llm"], 0), (["corpus_pipeline.py"], 1)])
def test_entry_without_the_corpus_operators(tmp_path, gone, kept):
    """Left out of a copy, they leave the other queries; a missing library is an error."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(entry_mod.__file__))
    copy = str(tmp_path / "copy")
    shutil.copytree(root, copy, ignore=lambda d, names: [n for n in names if n in (".git", "tests", "__pycache__") or
                                                         os.path.relpath(os.path.join(d, n), root) in gone])
    ask = "import __spark_entry__ as e; print(len(e.queries()), sum(q[:2] == 'op' and q[2:3].isdigit() for q in e.queries()))"
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    has = os.path.isdir(os.path.join(root, "ledgerlens", "llm"))
    out = run(ask).stdout.split()
    assert int(out[0]) >= len(QUERIES) and (int(out[1]) > 0) == bool(kept and has)
    if kept and has:
        broken = run("import sys; sys.modules['zstandard'] = None; " + ask)
        assert broken.returncode and "zstandard" in broken.stderr
