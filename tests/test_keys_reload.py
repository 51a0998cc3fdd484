"""Keys that stay the same across loads."""

import random

from ledgerlens.operators.keys import extend_keys, surrogate_key
from ledgerlens.session import cut_lineage


def as_map(df, keys):
    got = {tuple(r[k] for k in keys): r["n"] for r in df.collect()}
    return got


def test_known_keep_their_keys_new_follow(spark):
    rng = random.Random(3)
    value = lambda: (rng.choice([None, "a", "b", "c", "d", "e"]), rng.choice([None, 1, 2, 3, 4]))
    schema, keys = "x string, y int", ["x", "y"]
    held, known = {}, None
    for load in range(4):
        rows = [value() for _ in range(6)]
        if load == 3:
            rows = []                                    # nothing arrives
        df = spark.createDataFrame(rows, schema).repartition(3)
        known = cut_lineage(extend_keys(known, df, keys, "n", num_partitions=3), "reload")
        now = as_map(known, keys)
        assert known.count() == len(now) and sorted(now.values()) == list(range(1, len(now) + 1))
        assert all(now[k] == n for k, n in held.items())
        fresh = sorted((set(rows) - set(held)), key=lambda r: tuple((v is not None, v) for v in r))
        assert [now[k] for k in fresh] == list(range(len(held) + 1, len(held) + len(fresh) + 1))
        held = now


def test_nothing_new_and_gaps(spark):
    known = spark.createDataFrame([("a", 10), (None, 3)], "x string, n long")
    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert as_map(extend_keys(known, df, ["x"], "n"), ["x"]) == {("a",): 10, (None,): 3}
    more = spark.createDataFrame([("z",), ("b",), ("a",), ("b",)], "x string")
    assert as_map(extend_keys(known, more, ["x"], "n"), ["x"]) == {("a",): 10, (None,): 3, ("b",): 11, ("z",): 12}
    empty = spark.createDataFrame([], "x string, n long")
    assert as_map(extend_keys(empty, more, ["x"], "n"), ["x"]) == as_map(surrogate_key(more, ["x"], "n"), ["x"])


def test_no_window_over_keys(spark):
    df = spark.range(0, 5000, 1, 6).selectExpr("CAST(id AS STRING) AS x")
    known = cut_lineage(surrogate_key(df.where("id < 2500"), ["x"], "n"), "known")
    out = extend_keys(known, df, ["x"], "n", num_partitions=5)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "SinglePartition" not in text.split("BroadcastExchange")[0]
    assert out.count() == 5000 and out.agg({"n": "max"}).first()[0] == 5000
