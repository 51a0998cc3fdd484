"""Mergeable distinct counts and the incremental cube."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, plan_text
from ledgerlens.operators.aggregates import n_unique
from ledgerlens.operators.distinct import count_bitmaps, distinct_bitmaps, merge_bitmaps
from ledgerlens.plans import cube as cb
from ledgerlens.plans import cube_store as cs
from ledgerlens.sources import testdata as td


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(1)
    values = [None, 0, -1, 1, 32767, 32768, 32769, 65536, -40000, 2**62, 10**12]
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([1, 2, None]), rng.choice(values)) for _ in range(400)]
    rows += [("hot", 3, i % 50_000) for i in range(60_000)]            # over a third of all rows
    return spark.createDataFrame(rows, "state string, year int, user long").repartition(6)


def counted(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("by", [["state"], ["year"], ["year", "state"], []])
def test_counts_of_any_grouping(people, by):
    bitmaps = distinct_bitmaps(people, ["state", "year"], "user")
    want = people.groupBy(*by).agg(n_unique("user").cast("bigint").alias("n"))
    assert counted(count_bitmaps(bitmaps, by, "n")) == counted(want)


def test_merging_loads(people):
    halves = [people.where(F.pmod(F.hash("user", "state"), F.lit(3)) == i) for i in range(3)]
    loads = [distinct_bitmaps(h, ["state", "year"], "user") for h in [*halves, halves[0]]]     # one twice
    merged = merge_bitmaps(loads[0].union(loads[1]).union(loads[2]).union(loads[3]), ["state"])
    want = people.groupBy("state").agg(n_unique("user").cast("bigint").alias("n"))
    assert counted(count_bitmaps(merged, ["state"], "n")) == counted(want)


def test_bitmaps_of_nothing(spark):
    none = spark.createDataFrame([], "state string, user long")
    bitmaps = distinct_bitmaps(none, ["state"], "user")
    assert count_bitmaps(bitmaps, ["state"], "n").count() == 0
    assert count_bitmaps(bitmaps, [], "n").first()[0] == 0


def test_bitmaps_are_built_without_shuffling_them(people):
    df = distinct_bitmaps(people, ["state", "year"], "user")
    df.collect()
    plan = plan_text(df)
    assert plan.count("Exchange hashpartitioning") == 2
    # the bitmap aggregate starts and ends in one stage, above the last exchange
    assert "bitmap_construct_agg" not in plan.split("Exchange hashpartitioning")[1]


# ------------------------------------------------------------ incremental
RAW = "User long, Year int, Month int, `Merchant State` string, `Use Chip` string, MCC int, amount_clean decimal(18,2), is_fraud boolean, has_error boolean"


def rows(seed, n, months):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(40)]), *rng.choice(months), rng.choice([None, "CA", "TX"]), rng.choice(["Chip", None]),
             rng.choice([5411, None]), rng.choice([None, "1.25", "-7.00", "1000.10"]), rng.choice([True, False, None]),
             rng.random() < 0.2) for _ in range(n)]


def frame(spark, data):
    from decimal import Decimal
    return spark.createDataFrame([(*r[:6], None if r[6] is None else Decimal(r[6]), *r[7:]) for r in data], RAW)


def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f))
            for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_two_batches_equal_one_build(spark, tmp_path):
    a = rows(1, 500, [(2019, 1), (2019, 2), (None, 3)])
    b = rows(2, 300, [(2019, 2), (2020, 1), (None, 3)])
    store = cs.CubeStore(spark, str(tmp_path / "cube"))
    assert sorted(store.load(frame(spark, a)), key=str) == sorted([(2019, 1), (2019, 2), (None, 3)], key=str)
    before = files_of(store.path)
    assert sorted(store.load(frame(spark, b)), key=str) == sorted([(2019, 2), (2020, 1), (None, 3)], key=str)
    want = cb.build_cube(frame(spark, a + b))
    got = store.cube()
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert counted(got) == counted(want)
    after = files_of(store.path)
    kept = {f for f, t in before.items() if after.get(f) == t}
    assert {f for f in before if "Year=2019/Month=1/" in f} == kept and kept     # untouched months keep their files


def test_third_load_and_empty_batch(spark, tmp_path):
    store = cs.CubeStore(spark, str(tmp_path / "cube"))
    with pytest.raises(FileNotFoundError):
        store.cube()
    parts = [rows(s, 80, [(2019, m) for m in (1, 2, 3)]) for s in (3, 4, 5)]
    for p in [*parts, []]:
        store.load(frame(spark, p))
    assert store.load(frame(spark, [])) == []
    every = frame(spark, sum(parts, []))
    assert counted(store.cube()) == counted(cb.build_cube(every))
    for by in (["Merchant State"], ["Year", "Month"], ["is_fraud"], []):
        want = every.groupBy(*[F.col(f"`{k}`") for k in by]).agg(n_unique("User").cast("bigint").alias("unique_users"))
        assert counted(store.unique_users(by)) == counted(want)
    sliced = every.where(F.col("Merchant State").isin("CA") & F.col("Year").isin(2019))
    want = sliced.agg(n_unique("User").cast("bigint").alias("unique_users"))
    assert counted(store.unique_users(years=[2019], states=["CA"])) == counted(want)
    assert store.unique_users(states=[]).first()[0] == 0


def test_unique_users_read_only_the_stored_bitmaps(spark, tmp_path):
    clean = cb.clean_transactions(td.transactions(spark, SF_SMALL))
    store = cs.CubeStore(spark, str(tmp_path / "cube"))
    store.load(clean)
    df = store.unique_users(["Merchant State"], years=[1995])
    df.collect()
    plan = plan_text(df)
    assert plan.count("FileScan") == 1
    scan = [line for line in plan.split("\n") if "FileScan" in line][0]
    assert "bitmap:binary" in scan and "Year" in scan.split("PartitionFilters: ")[1].split("]")[0]
    assert all(f"{store.path}/users/" in f for f in df.inputFiles())


def test_csv_batches_and_dashboard(spark, tmp_path):
    """Two CSV files loaded one after the other, the second with a broken line, equal one build."""
    header = ",".join(cb.RAW_COLUMNS) + "\n"
    line = lambda u, m, s: f'{u},1,2019,{m},3,"$1,000.50",Chip,X,{s},5411,,No\n'
    (tmp_path / "a.csv").write_text(header + line(1, 1, "CA") + line(2, 1, "TX"))
    (tmp_path / "b.csv").write_text(header + line(2, 1, "CA") + "7,broken\n" + line(3, 2, "CA"))
    store = cs.CubeStore(spark, str(tmp_path / "cube"))
    assert store.load_csv(str(tmp_path / "a.csv"), cb.RAW_COLUMNS) == [(2019, 1)]
    assert sorted(store.load_csv(str(tmp_path / "b.csv"))) == [(2019, 1), (2019, 2)]
    whole = cb.build_cube(cb.clean_transactions(cb.read_transactions_csv(spark, [str(tmp_path / f) for f in ("a.csv", "b.csv")], cb.RAW_COLUMNS)))
    assert counted(store.cube()) == counted(whole)
    figures = store.dashboard(states=["CA"])
    assert figures["unique_users"].first()[0] == 3 and figures["kpis"].first().total_transactions == 3


def test_sparse_values_take_few_bytes(spark):
    """Bitmaps of values far apart grow with their number, whatever the range they lie in."""
    far = spark.range(400).selectExpr("CAST(id % 2 AS STRING) AS state", "(id - 200) * 100003 AS user")
    bitmaps = distinct_bitmaps(far, ["state"], "user")
    assert bitmaps.agg(F.sum(F.octet_length("bitmap"))).first()[0] <= 16 * 400
    assert counted(count_bitmaps(bitmaps, ["state"], "n")) == [("0", 200), ("1", 200)]


def test_counts_neither_sort_nor_widen(spark, tmp_path):
    """Selections are counted in hash aggregates of words."""
    store = cs.CubeStore(spark, str(tmp_path / "cube"))
    store.load(frame(spark, rows(1, 200, [(1995, 1), (1996, 2)])))
    df = store.unique_users(["Use Chip"], [1995], ["CA"])
    df.collect()
    assert "SortAggregate" not in plan_text(df) and "bitmap_or_agg" not in plan_text(df)


def test_known_bitmaps_are_merged_while_building(people):
    halves = [people.where(F.pmod(F.hash("user", "state"), F.lit(2)) == i) for i in range(2)]
    keys = ["state", "year"]
    known = distinct_bitmaps(halves[0], keys, "user")
    both = distinct_bitmaps(people.where("user > 0").unionByName(halves[1]), keys, "user", known, ["year"])
    assert counted(both) == counted(distinct_bitmaps(people, keys, "user"))
    plan = plan_text(both)
    assert "SortAggregate" not in plan and plan.count("Exchange REBALANCE") + plan.count("REBALANCE_PARTITIONS_BY_COL") >= 1
