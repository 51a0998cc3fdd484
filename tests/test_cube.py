"""Card cube (F1), dashboard slice (F2), CSV scan, Parquet sink, plans."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, plan_text
from ledgerlens.plans import cube as cb
from ledgerlens.sources import testdata as td
from ledgerlens.sources.sinks import write_csv, write_parquet

RAW = ["User", "Card", "Year", "Month", "Day", "Amount", "Use Chip", "Merchant City",
       "Merchant State", "MCC", "Errors?", "Is Fraud?"]
F1 = [
    ("0", "1", "2019", "1", "1", "$1,234.50", "Chip", "X", "CA", "5411", None, "No"),
    ("0", "1", "2019", "1", "1", "$-77.00", "Chip", "X", "CA", "5411", None, "No"),
    ("1", "1", "2019", "1", "1", "$10.25", "Chip", "X", "CA", "5411", "Bad PIN", "No"),
    (None, "1", "2019", "1", "1", "$1.00", "Chip", "X", "CA", "5411", None, "NO"),
    ("2", "1", "2019", "1", "1", "$99.99", "Online", "X", None, "5411", None, "YES"),
    ("2", "1", "2019", "2", "1", None, "Swipe", "X", "TX", "5812", "Insufficient Balance", "Yes"),
    ("3", "1", "2020", "11", "1", "$5.00", "Swipe", "X", "TX", "5812", None, None),
]


@pytest.fixture(scope="module")
def f1_cube(spark):
    raw = spark.createDataFrame(F1, ", ".join(f"`{c}` string" for c in RAW))
    return cb.build_cube(cb.clean_transactions(raw)).cache()


def test_f1_cube(f1_cube):
    rows = {(r.Year, r.Month, r["Merchant State"], r["Use Chip"], r.MCC, r.is_fraud):
            (r.total_transactions, r.total_amount, r.avg_amount, r.error_count, r.unique_users)
            for r in f1_cube.collect()}
    assert rows == {
        (2019, 1, "CA", "Chip", 5411, False): (4, 1168.75, 292.1875, 1, 3),
        (2019, 1, None, "Online", 5411, True): (1, 99.99, 99.99, 0, 1),
        (2019, 2, "TX", "Swipe", 5812, True): (1, 0.0, None, 1, 1),
        (2020, 11, "TX", "Swipe", 5812, None): (1, 5.0, 5.0, 0, 1),
    }


def test_f2_dashboard(f1_cube):
    s = cb.slice_cube(f1_cube, years=[2019, 2020], states=["CA", "TX"])
    k = cb.kpis(s).first()
    assert (k.total_transactions, k.total_amount, k.fraud_cases) == (6, 1173.75, 1)
    assert math.isclose(k.fraud_rate, 100 / 6) and math.isclose(k.error_rate, 200 / 6)
    assert [(r.period, r.total_amount) for r in cb.monthly_amount(s).collect()] == \
        [("2019-1", 1168.75), ("2019-2", 0.0), ("2020-11", 5.0)]
    assert sorted(tuple(r) for r in cb.amount_by_channel(s).collect()) == \
        [("Chip", 1168.75), ("Swipe", 5.0)]
    assert [r.MCC for r in cb.top_mcc(s).collect()] == [5411, 5812]
    assert [tuple(r) for r in cb.fraud_by_state(s).collect()] == [("TX", 1)]
    assert [r[0] for r in cb.slicer_states(f1_cube).collect()] == ["CA", "TX"]
    assert cb.preview(s).count() == 3


def test_f2_empty_selection(f1_cube):
    k = cb.kpis(cb.slice_cube(f1_cube, years=[2019], states=[])).first()
    assert (k.total_transactions, k.total_amount, k.fraud_rate, k.error_rate) == (0, 0.0, 0.0, 0.0)


def test_no_selection_keeps_every_row(spark, f1_cube):
    assert cb.slice_cube(f1_cube).count() == 4                   # the null state included
    assert cb.kpis(cb.slice_cube(f1_cube)).first().total_transactions == 7
    assert {r[0] for r in cb.amount_by_channel(cb.slice_cube(f1_cube)).collect()} == {"Chip", "Online", "Swipe"}


def test_opening_selection_first_five_states(spark):
    cube = cb.build_cube(cb.clean_transactions(td.transactions(spark, SF_MID)))
    out = cb.slice_cube(cube, states=cb.first_states(cube, 5))
    states = sorted({r[0] for r in out.select("Merchant State").distinct().collect()})
    assert states == sorted(r[0] for r in cb.slicer_states(cube).limit(5).collect())
    assert len(states) == 5


def test_strict_casts_raise_without_ansi(spark):
    bad = [("x", "1", "2019", "1", "1", "$1.00", "Chip", "X", "CA", "5411", None, "No"),
           ("1", "1", "2019", "1", "1", "junk", "Chip", "X", "CA", "5411", None, "No"),
           ("1", "1", "2019", "2", "30", "$1.00", "Chip", "X", "CA", "5411", None, "No")]
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        for row in bad:
            raw = spark.createDataFrame([row], ", ".join(f"`{c}` string" for c in RAW))
            with pytest.raises(Exception, match="cannot read as"):
                cb.clean_transactions(raw).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_csv_rfc4180(spark, tmp_path):
    from ledgerlens.sources.files import read_csv_text
    rows = [("1", 'Quiero ""crecer"", "mucho"'), ("2", "  lead trail  "), ("3", 'say "hi"'), ("4", "a,b"), ("5", "x\\y\\"),
            ("6", None), ("7", '"')]
    df = spark.createDataFrame(rows, "id string, txt string")
    path = write_csv(df, str(tmp_path / "q"))
    assert sorted(map(tuple, read_csv_text(spark, path).collect())) == rows
    p = tmp_path / "doubled.csv"
    p.write_text('id,txt,cat\n1,"Quiero ""crecer"", mucho",A\n')
    assert tuple(read_csv_text(spark, str(p)).first()) == ("1", 'Quiero "crecer", mucho', "A")


def test_csv_newlines_inside_quotes(spark, tmp_path):
    from ledgerlens.sources.files import read_csv_text
    p = tmp_path / "nl.csv"
    p.write_text('id,txt\n1,"linea uno\nlinea dos"\n2,z\n')
    with pytest.raises(ValueError, match="multi_line"):
        read_csv_text(spark, str(p))
    assert [tuple(r) for r in read_csv_text(spark, str(p), multi_line=True).collect()] == \
        [("1", "linea uno\nlinea dos"), ("2", "z")]


def test_cube_invariants_sf001(spark):
    txn = td.transactions(spark, SF_MID)
    cube = cb.build_cube(cb.clean_transactions(txn))
    assert cube.agg(F.sum("total_transactions")).first()[0] == txn.count() == 60000
    assert cube.count() == 32405
    fraud = {r.is_fraud: r.n for r in cube.groupBy("is_fraud")
             .agg(F.sum("total_transactions").alias("n")).collect()}
    assert fraud == {True: 3217, False: 48185, None: 8598}


def test_tolerant_csv_scan(spark, tmp_path):
    p = tmp_path / "cc.csv"
    p.write_text(
        "User,Card,Year,Month,Day,Time,Amount,Use Chip,Merchant Name,Merchant City,"
        "Merchant State,Zip,MCC,Errors?,Is Fraud?\n"
        '7,0,2019,3,4,10:00,"$1,000.00",Chip,1,Austin,TX,1,5411,,No\n'
        'oops,0,2019,3,4,10:00,$2.00,Chip,1,Austin,TX,1,5411,,Yes\n'
        '8,0,2019,3,4,10:00,$3.00,Chip,1,Austin,,1,5411,Bad PIN,""\n')
    df = cb.read_transactions_csv(spark, str(p))
    assert df.columns == cb.RAW_COLUMNS
    users = [r.User for r in df.collect()]
    assert users == [7, None, 8]                 # junk number -> null at the scan
    cube = cb.build_cube(cb.clean_transactions(df))
    assert cube.agg(F.sum("total_transactions")).first()[0] == 3
    assert cube.where(F.col("Merchant State").isNull()).first().error_count == 1


def test_csv_roundtrip_matches(spark, tmp_path):
    txn = td.transactions(spark, "/root/testdata/sf0.001")
    path = write_csv(txn, str(tmp_path / "csv"))
    a = cb.build_cube(cb.clean_transactions(cb.read_transactions_csv(spark, path)))
    b = cb.build_cube(cb.clean_transactions(txn))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_parquet_sink_codec_and_missing(spark, tmp_path, f1_cube):
    with pytest.raises(ValueError):
        write_parquet(f1_cube, str(tmp_path / "x"), compression="gzip")
    p = write_parquet(f1_cube, str(tmp_path / "cube"), compression="snappy")
    assert cb.load_cube(spark, p).count() == 4
    with pytest.raises(FileNotFoundError):
        cb.load_cube(spark, str(tmp_path / "nope"))


@pytest.mark.parametrize("declared", [False, True])
def test_build_cube_from_csv_end_to_end(spark, tmp_path, declared):
    raw = spark.createDataFrame(F1, ", ".join(f"`{c}` string" for c in RAW))
    csv = write_csv(raw, str(tmp_path / "in"))
    out = cb.build_cube_from_csv(spark, csv, str(tmp_path / "cube"), compression="zstd",
                                 file_columns=RAW if declared else None)
    got = cb.load_cube(spark, out)
    assert got.count() == 4
    assert got.agg(F.sum("total_transactions")).first()[0] == 7


def test_declared_csv_header_is_checked(spark, tmp_path):
    raw = spark.createDataFrame(F1, ", ".join(f"`{c}` string" for c in RAW))
    csv = write_csv(raw, str(tmp_path / "in"))
    wrong = RAW[1:] + RAW[:1]
    with pytest.raises(Exception):
        cb.read_transactions_csv(spark, csv, file_columns=wrong).collect()


def test_plan_no_python_and_pruned(spark):
    cube = cb.build_cube(cb.clean_transactions(td.transactions(spark, SF_MID)))
    top = cb.top_mcc(cb.slice_cube(cube))
    top.collect()
    plan = plan_text(top)
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
    assert "TakeOrderedAndProject" in plan
    # unused raw columns never reach the scans
    scans = cube._jdf.queryExecution().executedPlan().toString()
    assert "c_name" not in scans and "l_linenumber" in scans


def test_hot_cell_exact_and_two_level(spark):
    """One cell holds a third of all rows: totals and distinct users stay
    exact and the plan reduces it in two partially aggregated levels."""
    rows = []
    for i in range(3000):
        hot = i % 3 == 0
        rows.append((str(i % 500 if hot else i), "1", "2019", "1" if hot else str(1 + i % 12), "1",
                     f"${1 + i % 7}.25", "Chip", "X", "CA" if hot else "TX", "5411", None, "No"))
    raw = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in RAW)).repartition(6)
    cube = cb.build_cube(cb.clean_transactions(raw))
    hot = cube.where(F.col("Merchant State") == "CA").collect()
    assert len(hot) == 1 and hot[0].total_transactions == 1000 and hot[0].unique_users == 500
    want = sum(1 + i % 7 + 0.25 for i in range(0, 3000, 3))
    assert math.isclose(hot[0].total_amount, want)
    plan = plan_text(cube)
    assert plan.count("partial_count(distinct") + plan.count("partial_count") >= 2
    assert plan.count("Exchange hashpartitioning") == 2


def test_cube_dashboard_bundle(f1_cube):
    d = cb.cube_dashboard(f1_cube, years=[2019, 2020], states=["CA", "TX"])
    assert d["kpis"].first().total_transactions == 6
    assert [r[0] for r in d["states"].collect()] == ["CA", "TX"]
    assert d["preview"].count() == 3
