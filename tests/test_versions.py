"""Tables replaced without a gap."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import versions as vs
from ledgerlens.sources.sinks import create_table_as, drop_view, materialize


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_reader_sees_old_or_new(spark, tmp_path):
    root = str(tmp_path / "t")
    old = vs.replace_table(spark, spark.createDataFrame([(1, "a")], "k int, v string"), "swap_t", root)
    planned = spark.table("swap_t")
    assert rows(old) == [(1, "a")]
    vs.replace_table(spark, spark.createDataFrame([(2.5,)], "other double"), "swap_t", root)     # another schema
    assert rows(planned) == [(1, "a")]                   # resolved before: finishes on its files
    assert rows(spark.table("swap_t")) == [(2.5,)]
    assert not [t for t in spark.catalog.listTables() if t.name == "swap_t" and t.isTemporary]


def test_failing_write_leaves_the_old_table(spark, tmp_path):
    root = str(tmp_path / "t")
    vs.replace_table(spark, spark.range(5).toDF("n"), "swap_f", root)
    shown = vs.current(spark, "swap_f")
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken row")).cast("long"))
                                           .otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="broken row"):
        vs.replace_table(spark, bad, "swap_f", root)
    assert vs.current(spark, "swap_f") == shown and spark.table("swap_f").count() == 5
    vs.replace_table(spark, spark.range(7).toDF("n"), "swap_f", root)
    assert spark.table("swap_f").count() == 7
    left = vs.versions(spark, root)                      # the current and the one before; the failed folder is gone
    assert left == [shown, vs.current(spark, "swap_f")]


def test_table_may_read_itself_and_go_back(spark, tmp_path):
    root = str(tmp_path / "t")
    vs.replace_table(spark, spark.range(3).toDF("n"), "swap_s", root, keep=3)
    for _ in range(3):
        again = spark.table("swap_s")
        vs.replace_table(spark, again.union(again), "swap_s", root, keep=3)
    assert spark.table("swap_s").count() == 24
    kept = vs.versions(spark, root)
    assert len(kept) == 3 and kept[-1] == vs.current(spark, "swap_s")
    assert vs.point_to(spark, "swap_s", kept[0]).count() == 6
    with pytest.raises(ValueError):
        vs.replace_table(spark, spark.range(1).toDF("n"), "swap_s", root, keep=0)


def test_returning_to_an_old_version_keeps_it(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in (1, 2):
        vs.replace_table(spark, spark.range(n).toDF("n"), "swap_b", root)
    first = vs.versions(spark, root)[0]
    planned = vs.point_to(spark, "swap_b", first)
    vs.replace_table(spark, spark.table("swap_b").union(spark.range(10).toDF("n")), "swap_b", root)
    assert spark.table("swap_b").count() == 11 and planned.count() == 1       # what was shown stays for its readers


def test_paths_with_odd_characters(spark, tmp_path):
    root = str(tmp_path / "it's a `table`")
    assert vs.replace_table(spark, spark.range(3).toDF("n"), "swap_o", root).count() == 3
    assert vs.current(spark, "swap_o") == vs.versions(spark, root)[0]


def test_create_table_as_and_materialize_use_versions(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS swap_old")
    spark.range(2).write.option("path", str(tmp_path / "plain")).saveAsTable("swap_old")     # a plain table before
    assert create_table_as(spark, spark.range(4), "swap_old", str(tmp_path / "c")).count() == 4
    assert materialize(spark, spark.range(6), "swap_old", str(tmp_path / "c")).count() == 6
    assert len([d for d in os.listdir(tmp_path / "c") if d.startswith("v-")]) == 2
    drop_view(spark, "swap_old")
    assert not spark.catalog.tableExists("swap_old")
    drop_view(spark, "swap_old")                         # again: no error
