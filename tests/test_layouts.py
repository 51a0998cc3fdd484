"""Shards of different schemas, clustered tables, days split by size."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from ledgerlens.sources import clustered as cl
from ledgerlens.sources import shards as sh
from ledgerlens.sources.files import read_sharded
from ledgerlens.sources.sinks import BY_SIZE, write_date_shards, write_parquet


def shard(spark, base, suffix, rows, schema, prefix="table_suffix="):
    write_parquet(spark.createDataFrame(rows, schema), f"{base}/{prefix}{suffix}")


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# ----------------------------------------------------------------- shards
def test_layouts_are_reconciled(spark, tmp_path):
    base = str(tmp_path / "t")
    shard(spark, base, "20210101", [(1, "a", "gone")], "id int, name string, old string")
    shard(spark, base, "20210102", [(2, "b", (1, None), [(5,)])],
          "id int, name string, geo struct<zone:int,country:string>, tags array<struct<k:int>>")
    shard(spark, base, "20210103", [(2**40, "c", ("MX", 2**40), [(6, "v")], Decimal("1.50"))],
          "id long, name string, geo struct<country:string,zone:long>, tags array<struct<k:long,v:string>>, amount decimal(9,2)")
    df = sh.read_evolved_shards(spark, base)
    assert df.columns == ["id", "name", "geo", "tags", "amount", "table_suffix"]
    assert dict(df.dtypes)["id"] == "bigint" and dict(df.dtypes)["geo"] == "struct<country:string,zone:bigint>"
    assert got(df, "id", "name", "geo.country", "geo.zone", "amount", "table_suffix") == sorted([
        (1, "a", None, None, None, "20210101"), (2, "b", None, 1, None, "20210102"),
        (2**40, "c", "MX", 2**40, Decimal("1.50"), "20210103")], key=str)
    assert {r.id: r.geo for r in df.collect()}[1] is None            # a missing struct is null, not a struct of nulls
    assert [r.v for r in df.where("id = 2").select(F.col("tags")[0]["v"].alias("v")).collect()] == [None]
    # the range decides which shard is the newest
    assert sh.read_evolved_shards(spark, base, ("20210101", "20210101")).columns == ["id", "name", "old", "table_suffix"]
    with pytest.raises(FileNotFoundError):
        sh.read_evolved_shards(spark, base, ("20220101", "20220102"))


@pytest.mark.parametrize("old,new", [("long", "int"), ("string", "int"), ("int", "string"), ("double", "float"), ("long", "double"),
                                     ("decimal(10,4)", "decimal(10,2)"), ("struct<a:long>", "struct<a:int>"), ("int", "struct<a:int>")])
def test_narrowing_names_the_shard(spark, tmp_path, old, new):
    base = str(tmp_path / "t")
    for suffix, kind in (("1", old), ("2", new)):
        write_parquet(spark.range(1).select(F.lit(None).cast(kind).alias("v")), f"{base}/table_suffix={suffix}")
    with pytest.raises(TypeError, match="shard 1, v"):
        sh.read_evolved_shards(spark, base)


def test_widening_table(spark):
    def kind(text):
        return spark.range(0).select(F.lit(None).cast(text).alias("v")).schema[0].dataType
    table = [("tinyint", "int", True), ("int", "decimal(12,2)", True), ("int", "decimal(10,2)", False), ("bigint", "int", False),
             ("decimal(8,2)", "decimal(10,4)", True), ("decimal(8,2)", "decimal(8,4)", False), ("float", "double", True),
             ("int", "double", True), ("bigint", "double", False), ("date", "timestamp_ntz", True), ("string", "string", True)]
    for old, new, ok in table:
        assert sh.widens(kind(old), kind(new)) == ok, (old, new)


def test_other_prefix_and_pruned_columns(spark, tmp_path):
    base = str(tmp_path / "t")
    shard(spark, base, "1", [(1, "x")], "id int, wide string", "events_")
    shard(spark, base, "2", [(2, "y", 3)], "id long, wide string, more int", "events_")
    df = sh.read_evolved_shards(spark, base, prefix="events_").where("id = 2").select("id", "table_suffix")
    assert got(df, "id", "table_suffix") == [(2, "2")]
    scans = [s for s in plan_text(df).split("\n") if "FileScan" in s]
    assert len(scans) == 2 and all("wide" not in s.split("ReadSchema")[1] for s in scans)


# ------------------------------------------------------------- clustering
def scan_metrics(df):
    """(files, rows) that the executed plan's scan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves, files, rows = plan.collectLeaves(), 0, 0
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numFiles"):
            files += metrics.apply("numFiles").value()
            rows += metrics.apply("numOutputRows").value()
    return files, rows


@pytest.fixture(scope="module")
def table(spark):
    rows = [(2000 + i % 20, None if i % 11 == 0 else f"S{i % 50}", i, "hot" if i % 3 else None) for i in range(20_000)]
    return spark.createDataFrame(rows, "year int, `the state` string, n int, note string").repartition(7)


@pytest.mark.parametrize("allowed", [{"year": [2003]}, {"year": [2003, 2019], "the state": ["S3", "S44"]}, {"the state": ["S1"]},
                                     {"year": [1990]}, {"year": []}, {"year": None}, {"year": [2001], "n": [41, 61]}, {"year": [None]}])
def test_selection_equals_plain_filter(spark, table, tmp_path, allowed):
    path = cl.write_clustered(table, str(tmp_path / "c"), ["year", "the state"], bloom=["the state"], rows_per_file=500)
    want = cl.in_lists(table, **allowed)
    assert got(cl.read_selected(spark, path, **allowed), *table.columns) == got(want, *table.columns)


def test_files_are_skipped(spark, table, tmp_path):
    path = cl.write_clustered(table, str(tmp_path / "c"), ["year", "the state"], rows_per_file=100)
    every = len([f for f in os.listdir(path) if f.endswith(".parquet")])
    assert every >= 200
    files, rows = scan_metrics(cl.read_selected(spark, path, year=[2003]))
    assert files <= 13 and rows <= 1300                    # 1,000 rows of that year
    fewer, _ = scan_metrics(cl.read_selected(spark, path, **{"year": [2003], "the state": ["S3"]}))
    assert 1 <= fewer < files
    assert scan_metrics(spark.read.parquet(path).where("year = 2003"))[0] == every


def test_row_groups_are_skipped_by_bloom_filters(spark, tmp_path):
    """An absent value inside every range: only the filter can tell."""
    df = spark.range(0, 400_000).select(F.lit(1).alias("k"), (F.xxhash64("id").bitwiseAND(F.lit(-2))).alias("v"))
    plain = cl.write_clustered(df, str(tmp_path / "p"), ["k"])
    bloom = cl.write_clustered(df, str(tmp_path / "b"), ["k"], bloom=["v"], bloom_values=400_000)
    present = df.first().v
    assert scan_metrics(cl.read_selected(spark, plain, v=[12345]))[1] > 0
    assert scan_metrics(cl.read_selected(spark, bloom, v=[12345]))[1] == 0
    assert cl.read_selected(spark, bloom, v=[present]).count() == 1


def test_hot_value_spans_files(spark, tmp_path):
    df = spark.range(0, 9000, 1, 5).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    path = cl.write_clustered(df, str(tmp_path / "h and 50%"), ["k"], rows_per_file=400)
    hot = cl.read_selected(spark, path, k=["hot"])
    assert hot.count() == 3000 and len(cl.selected_files(spark, path, k=["hot"])) >= 8


# -------------------------------------------------------------------- days
def test_hot_day_is_split_by_size(spark, tmp_path):
    rows = spark.range(0, 60_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit("2021-01-01")).otherwise(F.date_add(F.lit("2021-01-02").cast("date"), (F.col("id") % 20).cast("int")).cast("string"))
        .cast("timestamp").alias("ts"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    base = str(tmp_path / "d")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300000")
    try:
        write_date_shards(rows, base, "ts", files_per_shard=BY_SIZE)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = {d: len([f for f in os.listdir(f"{base}/{d}") if f.endswith(".parquet")]) for d in os.listdir(base) if "=" in d}
    assert files["table_suffix=20210101"] >= 3
    assert sum(files.values()) < 126 and sorted(files.values())[len(files) // 2] <= 3        # six tasks times 21 days without it
    assert read_sharded(spark, base).count() == 60_000
    write_date_shards(rows.limit(10).withColumn("ts", F.lit(dt.datetime(2022, 5, 5))), base, "ts", mode="append")
    assert read_sharded(spark, base).count() == 60_010
