import numpy as np
import pytest

import ledgerlens.llm.topk_search as tk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=tk.TOP_K, every=tk.QUERY_EVERY):
    """All products with Python integers."""
    codes = [(i, v, [int(tk.quantise(np.array([x]))[0]) for x in e]) for i, (v, e) in enumerate(rows)
             if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, q, a in codes:
        if q is None or q % every:
            continue
        found = [(-max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), -2**63 + 1), v is None, v or 0, v)
                 for j, v, b in codes if j != i]
        out += [(q, n, v, -s) for n, (s, _, _, v) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, parts=3, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    return sorted((tuple(r) for r in tk.op11_query(df).collect()), key=str)


def test_random_vectors_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 5) / 8]) for i in rng.permutation(700)]
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [inf, 1.0]), (80, [None, 1.0]), (None, [3.0, 1.0]),
            (None, [3.0, 1.0]), (0, [1.0, 2.0]), (1, []), (100, []), (2, [0.5]), (3, [1.0, 1.0, 1.0]), (-20, [-1.0, 0.0]),
            (4, [1e300, -1e300]), (120, [1e300, 1e300]), (5, [1e9, 7.0]), (140, [2e9, 1.0])]
    assert run(spark, rows) == brute(rows)


def test_empty_table_one_row_and_no_query(spark):
    assert run(spark, []) == []
    assert run(spark, [(20, [1.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_extra_columns(spark):
    rows = [(i, [float(i)], 7, "s", 1) for i in range(45)]
    got = run(spark, rows, schema=SCHEMA + ", row int, kind string, n int")
    assert got == brute([r[:2] for r in rows])


def test_many_tiles_and_merge_levels(spark, monkeypatch):
    """Small shards, pieces, blocks and strips: the grid has several blocks and three levels."""
    for name, value in (("SHARD_ROWS", 16), ("PIECE_ROWS", 3), ("BLOCK_ROWS", 5), ("STRIP_CELLS", 64), ("FAN_IN", 3)):
        monkeypatch.setattr(tk, name, value)
    rng = np.random.default_rng(2)
    rows = [(int(i % 380), [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    # a third of all rows are the same vector
    rows = [(v, [0.5] * 6) if n % 3 == 0 else (v, e) for n, (v, e) in enumerate(rows)]
    assert run(spark, rows, 4) == brute(rows)


@pytest.mark.parametrize("top,dtype", [(100, np.float32), (30_000, np.float64), (2**20, np.int64)])
def test_products_are_exact(top, dtype):
    rng = np.random.default_rng(3)
    d = 64 if top < 2**20 else 9000
    a, b = (rng.integers(-top, top + 1, (4, d)).astype(np.int32) for _ in range(2))
    a[0, 0] = b[0, 0] = top
    got = tk._product(a, b)
    assert got.dtype == dtype
    assert (got.astype(object) == a.astype(object) @ b.T.astype(object)).all()


def test_matches_sql(spark):
    import duckdb
    from llm_cases import SF_SMALL
    from ledgerlens.llm.registry import QUERIES
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF_SMALL}/embeddings.parquet'")
    want = sorted(duckdb.sql(tk.OP11_SQL).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op11_topk_search"](spark, SF_SMALL).collect())
    assert got == want and got
