"""Shared scratch space: required off local masters, released, reused by input state."""

import os

import pytest

from ledgerlens import session as ss


def test_cluster_needs_a_shared_folder():
    for master in ("local", "local[4]", "local[*]"):
        ss.require_local(master)
    for master in ("yarn", "spark://h:7077", "k8s://x", "local-cluster[2,1,1024]", "remote"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ss.require_local(master)


def local(path):
    return path.removeprefix("file:")


def test_scope_removes_what_it_wrote(spark):
    keep = ss.scratch_path(spark, "kept")
    spark.range(3).write.parquet(keep)
    with ss.scratch_scope(spark) as paths:
        assert ss.cut_lineage(spark.range(5), "inner").count() == 5
        assert len(paths) == 1 and os.path.isdir(local(paths[0]))
    assert not os.path.exists(local(paths[0])) and os.path.isdir(local(keep))
    assert ss.release(spark, keep) and not os.path.exists(local(keep))
    with pytest.raises(ValueError):
        ss.release(spark, "/somewhere/else")


def test_written_once_follows_the_files(spark, tmp_path):
    data, built = str(tmp_path / "in"), []

    def build():
        path = ss.scratch_path(spark, "copy")
        spark.read.parquet(data).write.parquet(path)
        built.append(path)
        return path

    spark.range(5).write.parquet(data)
    first = ss.written_once(spark, "copy", [data], build)
    assert ss.written_once(spark, "copy", [data], build) == first and len(built) == 1
    spark.range(7).write.mode("append").parquet(data)
    with ss.scratch_scope(spark):
        second = ss.written_once(spark, "copy", [data], build)
    assert second != first and spark.read.parquet(second).count() == 12      # not the scope's
    ss.release(spark, second)
    assert ss.written_once(spark, "copy", [data], build) not in (first, second)


def test_library_leaves_the_session_settings_alone(spark):
    from ledgerlens.plans.registry import QUERIES
    before = {k: spark.conf.get(k) for k in ("spark.sql.ansi.enabled", "spark.sql.session.timeZone")}
    spark.conf.set("spark.sql.session.timeZone", "America/Mexico_City")
    try:
        QUERIES["cube_kpis"](spark, "/root/testdata/sf0.001").collect()
        assert spark.conf.get("spark.sql.session.timeZone") == "America/Mexico_City"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
