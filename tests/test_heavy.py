"""Frequent values by a bounded sketch: equal to the full count, little shuffled."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.categories import collapse_rare, frequent_values
from ledgerlens.operators.heavy import candidates, frequent_values_bounded, heavy_buckets


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(0, 60_000, 1, 6).select(
        F.when(i % 3 == 0, "hot").when(i % 20 == 1, "edge").when(i % 21 == 2, "below").when(i % 10 == 5, None)
        .otherwise(i.cast("string")).alias("many"),
        F.when(i % 2 == 0, "x").otherwise("y").alias("few"), (i % 19).alias("n")).cache()


@pytest.mark.parametrize("threshold", [0.5, 0.2, 0.05, 0.047, 0.01])
@pytest.mark.parametrize("width", [16_384, 64])
def test_equals_the_full_count(rows, threshold, width):
    """Also with a sketch so narrow that many rare values are candidates."""
    columns = ["many", "few", "n"]
    want = sorted(map(tuple, frequent_values(rows, columns, threshold).select("column", "value", "n", "share").collect()), key=str)
    got = sorted(map(tuple, frequent_values_bounded(rows, columns, threshold, width).select("column", "value", "n", "share").collect()), key=str)
    assert got == want and (want or threshold == 0.5)


def test_collapse_is_the_same(rows):
    a = collapse_rare(rows, ["many", "few", "n", "absent"])
    b = collapse_rare(rows, ["many", "few", "n", "absent"], many_values=True)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_only_candidates_are_counted(rows):
    """37,000 distinct values: the exact count sees the frequent ones and next to no other."""
    found = candidates(rows, ["many"], 0.05)
    distinct = {r.value for r in found.distinct().collect()}
    assert {"hot", None} <= distinct and len(distinct) <= 5
    assert heavy_buckets(rows, ["many", "few"], 0.05).count() <= 2 * 2 * 20


def exchange_rows(df):
    """Rows written by each exchange of the executed plan."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def visit(node):
        if node.metrics().contains("shuffleRecordsWritten"):
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        kids = node.children()
        for i in range(kids.size()):
            visit(kids.apply(i))
        for name in ("finalPhysicalPlan", "plan"):
            if name == "plan" and "QueryStage" not in node.nodeName():
                continue
            try:
                visit(getattr(node, name)())
            except Exception:
                pass
    visit(plan)
    return out


def test_shuffles_are_bounded(spark, monkeypatch):
    import ledgerlens.operators.heavy as hv
    df = spark.range(0, 400_000, 1, 4).select(F.when(F.col("id") % 4 == 0, "hot").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("v"))
    full = exchange_rows(frequent_values(df, ["v"]))
    sketch = []
    # every part that is written, run here for its shuffles
    monkeypatch.setattr(hv, "cut_lineage", lambda part, name: sketch.extend(exchange_rows(part)) or part)
    assert [r.value for r in frequent_values_bounded(df, ["v"], 0.05).collect()] == ["hot"]
    assert max(full) >= 300_000
    assert sketch and max(sketch) <= 4 * 2 * 16_385          # tasks * functions * buckets


def test_empty_and_null_only(spark):
    none = spark.createDataFrame([], "v string")
    assert frequent_values_bounded(none, ["v"], 0.05).count() == 0
    nulls = spark.createDataFrame([(None,), (None,)], "v string")
    assert [tuple(r) for r in frequent_values_bounded(nulls, ["v"], 0.05).collect()] == [("v", None, 2, 1.0)]
