"""Warehouse patterns: full outer (F6), growth (F7), wildcard shards (F9),
CTAS, JDBC options, catalog reuse."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from ledgerlens.plans import warehouse as wh
from ledgerlens.sources import catalog
from ledgerlens.sources.files import read_glob_shards, read_sharded
from ledgerlens.sources.sinks import jdbc_options, write_date_shards, write_parquet


# F6
def test_f6_full_outer(spark):
    names = spark.createDataFrame(
        [("TX", "James", 200000), ("TX", "Mary", 150000), ("TX", "Bob", 100000),
         ("PA", "Mary", 170000), ("PA", "Zoe", 120000)],
        "state string, name string, number long")
    out = wh.compare_states(names, "TX", "PA", 100000)
    assert out.columns == ["name", "total_tx", "total_pa"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == [("James", 200000.0, None), ("Mary", 150000.0, 170000.0),
                   ("Zoe", None, 120000.0)]


def test_having_floor_as_share_and_one_scan(spark, tmp_path):
    rows = [(s, f"n{i}", 10 * (i + 1)) for s in ("TX", "PA", "CA") for i in range(10)]
    path = write_parquet(spark.createDataFrame(rows, "state string, name string, number long"), str(tmp_path / "n"))
    names = spark.read.parquet(path)
    top = wh.popular_names(names, ["TX", "PA"], min_share=0.1)
    got = sorted((r.state, r.name, r.total) for r in top.collect())
    assert got == sorted((s, f"n{i}", 10.0 * (i + 1)) for s in ("PA", "TX") for i in range(5, 10))    # over 55 of 550
    assert plan_text(top).count("FileScan") == 1
    plan = plan_text(wh.compare_states(names, "TX", "PA", min_share=0.1))
    assert "BroadcastExchange" not in plan and "popular_names" in plan


def test_wildcard_with_given_schema(spark, shards):
    schema = spark.read.parquet(shards).drop("table_suffix").schema
    out = wh.events_by_suffix(spark, shards, "20210101", "20210131", data_schema=schema)
    assert out.count() == 2


def test_reload_order_drops_dependants_first(spark, tmp_path, monkeypatch):
    from ledgerlens.plans import star as st
    from ledgerlens.sources import sinks
    from ledgerlens.sources import testdata as td
    steps = []
    monkeypatch.setattr(sinks, "write_jdbc", lambda df, url, table, **kw: steps.append(("write", table, kw)))
    st.run_survey_etl(spark, td.sme_survey(spark, "/root/testdata/sf0.001"), str(tmp_path), "jdbc:test:db",
                      {"num_partitions": 4}, execute_sql=lambda q: steps.append(("sql", q, None)))
    names = [s[1] for s in steps]
    assert names[:2] == [f"DROP TABLE IF EXISTS {v}" for v in st.SUMMARY_VIEWS]
    assert names[2:7] == ["dim_emprendedor", "dim_geografia_h3", "dim_negocio", "dim_deseo", "fact_sme_metrics"]
    assert names[7:] == list(st.SUMMARY_VIEWS)
    assert all(kw == {"num_partitions": 4} for kind, _, kw in steps if kind == "write")
    assert jdbc_options("jdbc:x", "t", num_partitions=4)["numPartitions"] == "4"


def test_state_totals_sql(spark):
    names = spark.createDataFrame([("A", "x", 5), ("B", "y", 7), ("A", "z", 3)],
                                  "state string, name string, number long")
    got = [tuple(r) for r in wh.state_totals(spark, names, k=1).collect()]
    assert got == [("A", 8.0)]


# F7
def test_f7_growth(spark):
    ts = lambda m: dt.datetime(2021, m, 3, 10, 0)
    taxis = spark.createDataFrame(
        [(ts(1), 1.0, 60.0), (ts(1), 2.0, 40.0), (ts(3), 1.0, 150.0), (ts(4), 0.0, 0.0),
         (ts(5), 5.0, 10.0)],
        "trip_start_timestamp timestamp, trip_miles double, trip_total double")
    out = wh.monthly_growth(taxis).orderBy("mes").collect()
    assert [r.num_mes_historia for r in out] == [1, 2, 3, 4]
    assert [r.pct_crecimiento_dinero for r in out] == [None, 0.5, -1.0, None]
    assert [r.total_km for r in out] == [5.0, 2.0, 0.0, 8.0]
    assert out[0].mes == dt.date(2021, 1, 1) and "mes_original" not in out[0].asDict()


def test_round_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(F.round("x", 0)).collect()] == [3.0, -3.0]


# F9
@pytest.fixture
def shards(spark, tmp_path):
    days = ["2020-12-31", "2021-01-01", "2021-01-31", "2021-02-01"]
    rows = [(dt.datetime.fromisoformat(d + " 12:00:00"), "page_view", (None if i % 2 else "MX",))
            for i, d in enumerate(days)]
    ev = spark.createDataFrame(rows, "ts timestamp, event_name string, geo struct<country:string>")
    base = str(tmp_path / "events")
    write_date_shards(ev, base, "ts")
    return base


def test_f9_wildcard(spark, shards):
    out = wh.events_by_suffix(spark, shards, "20210101", "20210131")
    got = sorted(tuple(r) for r in out.collect())
    assert got == [("20210101", 1, "PAGE_VIEW", "Desconocido"), ("20210131", 1, "PAGE_VIEW", "MX")]


def test_wildcard_partition_pruning(spark, shards):
    df = read_sharded(spark, shards, between=("20210101", "20210131"))
    assert dict(df.dtypes)["table_suffix"] == "string"
    plan = df._jdf.queryExecution().executedPlan().toString()
    pf = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "table_suffix" in pf and "20210101" in pf and "20210131" in pf
    assert sorted(r.table_suffix for r in df.collect()) == ["20210101", "20210131"]


def test_glob_shards(spark, tmp_path):
    for d in ["20201231", "20210101", "20210102"]:
        write_parquet(spark.createDataFrame([(d,)], "v string"), str(tmp_path / f"events_{d}"))
    df = read_glob_shards(spark, str(tmp_path / "events_*"), between=("20210101", "20210131"))
    assert sorted(r.v for r in df.collect()) == ["20210101", "20210102"]


def test_ctas_overwrites_and_pushes_filter(spark, tmp_path):
    trips = spark.createDataFrame(
        [(7, dt.datetime(2021, 1, 1), 1.0, 2.0), (8, dt.datetime(2021, 1, 1), 3.0, 4.0)],
        "taxi_id long, trip_start_timestamp timestamp, trip_miles double, trip_total double")
    src = write_parquet(trips, str(tmp_path / "trips"))
    trips = spark.read.parquet(src)
    path = str(tmp_path / "taxis")
    t1 = wh.taxi_subset(spark, trips, 7, "prueba.taxis_t", path)
    assert t1.count() == 1
    t2 = wh.taxi_subset(spark, trips, 8, "prueba.taxis_t", path)   # replace
    assert [r.trip_miles for r in t2.collect()] == [3.0]
    sel = trips.where(F.col("taxi_id") == 7)
    sel.collect()
    assert "PushedFilters: [IsNotNull(taxi_id), EqualTo(taxi_id,7)]" in plan_text(sel)


def test_jdbc_options():
    o = jdbc_options("jdbc:postgresql://db:5432/x", "dim_deseo", user="u", password="p")
    assert o["dbtable"] == "dim_deseo" and o["user"] == "u" and o["truncate"] == "false"
    with pytest.raises(ValueError):
        jdbc_options("postgresql://db", "t")


def test_reuse_context(spark):
    df = spark.range(10)
    with catalog.reused(df) as d:
        assert d.is_cached and d.count() == 10
    assert not df.is_cached


def test_date_shards_bounded_files(spark, tmp_path):
    import os
    rows = [(dt.datetime(2021, 1, 1 + i % 3, 12, 0), f"e{i}") for i in range(600)]
    ev = spark.createDataFrame(rows, "ts timestamp, event_name string").repartition(12)
    base = str(tmp_path / "shards")
    write_date_shards(ev, base, "ts", files_per_shard=2)
    for d in os.listdir(base):
        if d.startswith("table_suffix="):
            files = [f for f in os.listdir(os.path.join(base, d)) if f.endswith(".parquet")]
            assert 1 <= len(files) <= 2
    assert read_sharded(spark, base).count() == 600
