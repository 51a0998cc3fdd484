"""Line-wise CSV: one scan, quarantine, inferred types."""

import csv
import datetime as dt
import io
import random

import pytest

from conftest import plan_text
from ledgerlens.sources import csv_lines as cl
from ledgerlens.sources.files import read_csv_tolerant

BROKEN = ['1,2,3', '1,2', '1,2,3,4', '1,2,"abc', '1,"x,y",3', '1,5" pipe,3', '1,"a"b,3', '"""q""",2,""', '1,"open,2,3',
          '1,2,"he said ""hi"""', '1,"a""', '', '   ', ',,', '1,x"y"z,3', '"","",""', '"""",1,2', '1,"a,""b"",c",3', 'a,b,c']


def write(tmp_path, lines, name="x.csv"):
    p = tmp_path / name
    p.write_text("a,b,c\n" + "\n".join(lines) + "\n")
    return str(p)


def test_kept_and_refused(spark, tmp_path):
    found = cl.CsvQuarantine(spark, write(tmp_path, BROKEN))
    kept = [tuple(r) for r in found.kept.collect()]
    assert kept == [("1", "2", "3"), ("1", "x,y", "3"), ("1", '5" pipe', "3"), ('"q"', "2", None), ("1", "2", 'he said "hi"'),
                    (None, None, None), ("1", 'x"y"z', "3"), (None, None, None), ('"', "1", "2"), ("1", 'a,"b",c', "3")]
    refused = sorted((r.line, r.reason, r.text) for r in found.refused.collect())
    assert refused == [(3, "short", "1,2"), (4, "long", "1,2,3,4"), (5, "quote", '1,2,"abc'), (8, "quote", '1,"a"b,3'),
                       (10, "quote", '1,"open,2,3'), (12, "quote", '1,"a""')]
    assert {r.file.rsplit("/", 1)[1] for r in found.refused.collect()} == {"x.csv"}
    counts = {(r.kind, r.reason): r.rows for r in found.counts().collect()}
    assert counts[("row", None)] == 10 and counts[("header", None)] == 2 and counts[("blank", None)] == 2
    lazy = cl.kept_rows(spark, write(tmp_path, BROKEN), ["c", "a"])
    assert [tuple(r) for r in lazy.collect()] == [(k[2], k[0]) for k in kept]


def test_well_formed_lines_agree_with_python(spark, tmp_path):
    """Whatever Python's writer makes of random fields is kept and read back."""
    rng = random.Random(1)
    fields = ["", "x", '"', '""', "a,b", 'say "hi", you', ",", " lead", "é", "$1,234.50", "'", "\\", '5" pipe', "a\tb"]
    rows = [[rng.choice(fields) for _ in range(5)] for _ in range(800)]
    out = io.StringIO()
    for quoting in (csv.QUOTE_MINIMAL, csv.QUOTE_ALL):
        csv.writer(out, quoting=quoting, lineterminator="\n").writerows(rows)
    p = tmp_path / "w.csv"
    p.write_text("p,q,r,s,t\n" + out.getvalue())
    found = cl.CsvQuarantine(spark, str(p))
    want = sorted([tuple(v or None for v in r) for r in rows * 2], key=str)
    assert sorted([tuple(r) for r in found.kept.collect()], key=str) == want
    assert found.refused.count() == 0


def test_line_numbers_over_splits_and_files(spark, tmp_path):
    for name in ("one.csv", "two.csv"):
        write(tmp_path, [f"{i},{i}" if i % 500 == 7 else f"{i},{i},{i}" for i in range(4000)], name)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        found = cl.CsvQuarantine(spark, str(tmp_path))
        assert found.table.select("__block").distinct().count() > 3
        got = sorted((r.file.rsplit("/", 1)[1], r.line, r.text) for r in found.refused.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((n, i + 2, f"{i},{i}") for n in ("one.csv", "two.csv") for i in range(7, 4000, 500))


def test_long_fields_and_many_quotes(spark, tmp_path):
    text = 'z' * 200_000 + '""' * 50_000
    found = cl.CsvQuarantine(spark, write(tmp_path, [f'1,"{text}",3', f'1,"{text},3']))
    assert [len(r.b) for r in found.kept.collect()] == [250_000]
    assert [r.reason for r in found.refused.collect()] == ["quote"]


def test_moved_header_raises(spark, tmp_path):
    write(tmp_path, ["1,2,3"], "a.csv")
    (tmp_path / "b.csv").write_text("b,a,c\n1,2,3\n")
    with pytest.raises(Exception, match="another order"):
        cl.kept_rows(spark, str(tmp_path), file_columns=["a", "b", "c"]).collect()


def test_one_text_scan(spark, tmp_path):
    path = write(tmp_path, BROKEN)
    df = read_csv_tolerant(spark, path, ["a", "b"], {"a": "bigint"}, file_columns=["a", "b", "c"])
    df.collect()
    plan = plan_text(df)
    assert plan.count("FileScan text") == 1 and plan.count("from_csv") == 1
    assert [r.a for r in df.collect()][:2] == [1, 1]
    found = cl.CsvQuarantine(spark, path)
    for part in (found.kept, found.refused):
        assert "FileScan text" not in part._jdf.queryExecution().executedPlan().toString()


def test_empty_file(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text("a,b\n")
    assert cl.CsvQuarantine(spark, str(p)).kept.count() == 0
    p.write_text("")
    with pytest.raises(ValueError, match="no header"):
        cl.kept_rows(spark, str(p))


def test_inferred_types(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("i,d,b,t,s,n,big,w\n"
                 "1,1.5,True,2020-01-31,x,NA,9223372036854775807,7\n"
                 " 2 ,1e3,FALSE,2020-02-29,1,null,99999999999999999999,08:30\n"
                 "NA,-inf,n/a,None,2,,1,7\n")
    df = cl.read_csv_inferred(spark, str(p))
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "t": "date", "s": "string", "n": "double",
                               "big": "double", "w": "string"}
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, dt.date(2020, 1, 31), "x", None, 9223372036854775807.0, "7"),
        (2, 1000.0, False, dt.date(2020, 2, 29), "1", None, 1e20, "08:30"),
        (None, float("-inf"), None, None, "2", None, 1.0, "7")]


def test_near_dates_stay_text(spark):
    df = spark.createDataFrame([("2020-02-30", "1"), ("2020-01-01", "true")], "a string, b string")
    assert cl.inferred_types(df) == {"a": "string", "b": "string"}
    assert cl.inferred_types(spark.range(3)) == {}
