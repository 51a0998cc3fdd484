"""Survey cleaning, rare-category collapse (F4), null-safe joins (F5),
hex cells (F10), star invariants and plans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, plan_text
from ledgerlens.functions.hexgrid import grid_constants, hex_centroid, with_hex_cell
from ledgerlens.operators import collapse_rare, null_safe_join, surrogate_key
from ledgerlens.plans import star as st
from ledgerlens.sources import testdata as td


# F4
@pytest.mark.parametrize("n_a,expect", [
    (18, {"A": 18, "B": 1, "DESCONOCIDO": 1}),
    (19, {"A": 19, "OTROS": 2}),
])
def test_f4_collapse(spark, n_a, expect):
    vals = ["A"] * n_a + ["B", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, c string")
    out = collapse_rare(df, ["c", "absent"])
    got = {r.c: r["count"] for r in out.groupBy("c").count().collect()}
    assert got == expect


def test_collapse_existing_otros_merges(spark):
    vals = ["A"] * 19 + ["OTROS", "Z"]          # 1/21 < 5 %: both collapse
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    got = {r.c: r["count"] for r in collapse_rare(df, ["c"]).groupBy("c").count().collect()}
    assert got == {"A": 19, "OTROS": 2}


def test_collapse_invariant_on_table(spark):
    part = td.table(spark, SF_MID, "part").select("p_brand", "p_type")
    out = collapse_rare(part, ["p_brand", "p_type"])
    n = out.count()
    for c in ["p_brand", "p_type"]:
        shares = out.groupBy(c).count().collect()
        assert all(r["count"] / n >= 0.05 for r in shares if r[c] != "OTROS")
    assert {r.p_brand for r in out.select("p_brand").distinct().collect()} == {"OTROS"}


# F5
def test_f5_null_safe_join(spark):
    facts = spark.createDataFrame([(None, "x", 10), ("a", "x", 20)], "k1 string, k2 string, v int")
    dim = spark.createDataFrame([(None, "x", 1), ("a", "x", 2)], "d1 string, d2 string, key int")
    out = null_safe_join(facts, dim, ["k1", "k2"], ["d1", "d2"], how="left")
    got = sorted((r.v, r.key) for r in out.collect())
    assert got == [(10, 1), (20, 2)]


def test_surrogate_keys_dense_ordered_many_partitions(spark):
    df = spark.range(0, 5000).select((F.col("id") % 997).alias("k"),
                                     F.when(F.col("id") % 10 == 0, None)
                                     .otherwise(F.col("id") % 3).alias("j"))
    keys = surrogate_key(df, ["j", "k"], "sk", num_partitions=7).collect()
    assert sorted(r.sk for r in keys) == list(range(1, len(keys) + 1))
    order = sorted(keys, key=lambda r: (r.j is not None, r.j or 0, r.k))
    assert [r.sk for r in order] == list(range(1, len(keys) + 1))


# F10
@pytest.mark.parametrize("lat,lon,qr,cen", [
    (19.4326, -99.1332, (-12659, 2713), (19.433454, -99.132707)),
    (19.4330, -99.1330, (-12659, 2713), (19.433454, -99.132707)),
    (19.4500, -99.1332, (-12660, 2715), (19.447780, -99.132707)),
    (0.0, 0.0, (0, 0), (0.0, 0.0)),
])
def test_f10_hex(spark, lat, lon, qr, cen):
    df = with_hex_cell(spark.createDataFrame([(lat, lon)], "lat double, lon double"), "lat", "lon", "h")
    r = df.select("h", hex_centroid("h").alias("c")).first()
    assert r.h == f"hx531_{qr[0]}_{qr[1]}"
    assert (r.c.lat, r.c.lon) == cen


def test_f10_invalid_points(spark):
    df = spark.createDataFrame([(float("nan"), 0.0), (91.0, 0.0), (None, 0.0)], "lat double, lon double")
    assert [r.h for r in with_hex_cell(df, "lat", "lon", "h").collect()] == [None, None, None]


def test_hex_point_within_edge_of_centroid(spark):
    rnd = random.Random(7)
    pts = [(19.2 + rnd.random() * 0.5, -99.4 + rnd.random() * 0.5) for _ in range(3000)]
    df = with_hex_cell(spark.createDataFrame(pts, "lat double, lon double"), "lat", "lon", "h")
    k = grid_constants()
    worst = 0.0
    for r in df.select("lat", "lon", hex_centroid("h", digits=None).alias("c")).collect():
        dx = (r.lon - r.c.lon) * k["kx"]
        dy = (r.lat - r.c.lat) * k["ky"]
        worst = max(worst, math.hypot(dx, dy) / 531.0)
    assert worst <= 1.0


@pytest.fixture(scope="module")
def star(spark):
    return st.build_star(td.sme_survey(spark, SF_MID))


def test_star_invariants(star):
    clean_n = star.clean.count()
    fact = star.fact()
    assert clean_n == 1337 and fact.count() == clean_n
    for k in ["id_negocio_dim", "id_geografia_dim", "id_deseo_dim"]:
        assert fact.where(F.col(k).isNull()).count() == 0
    for dim, k in [(star.dim_geografia, "id_geografia_dim"), (star.dim_negocio, "id_negocio_dim"),
                   (star.dim_deseo, "id_deseo_dim")]:
        ids = sorted(r[0] for r in dim.select(k).collect())
        assert ids == list(range(1, len(ids) + 1))
    assert star.flat().count() == clean_n and len(star.flat().columns) == 22


def test_star_collapse_and_nulls(star):
    c = star.clean
    esc = {r[0] for r in c.select("escolaridadEmprendedor").distinct().collect()}
    assert "OTROS" in esc and "Doctorado" not in esc
    # nullable business flags survive the null-safe joins
    assert star.dim_negocio.where(F.col("alta_sat").isNull()).count() > 0


def test_enriched_rows_are_written_and_reused(star):
    fact = star.fact()
    plan = plan_text(fact)
    # the joins ran once; fact, flat table and summaries scan the written rows
    assert "Join" not in plan and "FileScan parquet" in plan and "PythonUDF" not in plan
    assert "Join" not in plan_text(star.flat())


def test_joins_carry_no_row_count_hint(spark, star):
    from ledgerlens.operators import join_on
    x = join_on(star.clean, star.dim_geografia, [("h3_hex_id", "h3_hex_id")], null_safe=True)
    assert "ResolvedHint" not in x._jdf.queryExecution().analyzed().toString()
    y = join_on(star.clean, star.dim_deseo, [("Categoría", "categoria_deseo")], bounded=True)
    assert "broadcast" in y._jdf.queryExecution().analyzed().toString().lower()


def test_hot_cell_through_a_shuffle_join(spark):
    """A cell with a third of all rows, and null cells, keep every row and key."""
    from ledgerlens.operators import join_on
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, None)
                                    .otherwise(F.concat(F.lit("c"), F.col("id"))).alias("cell"))
    dim = surrogate_key(rows, ["cell"], "key")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = join_on(rows, dim, [("cell", "cell")], how="left", null_safe=True)
        got = out.collect()
        assert "BroadcastHashJoin" not in plan_text(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 3000 and all(r.key is not None for r in got)
    assert len({r.key for r in got if r.cell == "hot"}) == 1


def test_unusable_required_values_are_dropped(spark):
    base = dict(id=1, edadEmprendedor="30", ventasPromedioDiarias="10.006", latitud="19.4", longitud="-99.1",
                horaApertura="9", horaCierre="18", numEmpleados="2", antiguedadNegocio="3")
    bad = [("ventasPromedioDiarias", "abc"), ("latitud", "x"), ("ventasPromedioDiarias", " NaN "), ("latitud", "91"),
           ("numEmpleados", "1f"), ("numEmpleados", "NA"), ("longitud", "inf")]
    rows = [base] + [{**base, "id": 2 + i, k: v} for i, (k, v) in enumerate(bad)]
    raw = spark.createDataFrame([tuple(str(r[c]) for c in base) for r in rows], ", ".join(f"{c} string" for c in base))
    got = st.prepare_sme(raw).collect()
    assert [r.id for r in got] == ["1"] and got[0].h3_hex_id is not None


def test_means_are_not_rounded(spark, star):
    one = spark.createDataFrame([(1, 10.006, 1, 1.0)], "id_emprendedor int, ventas_promedio_diarias double, "
                                                      "num_empleados int, antiguedad_negocio double")
    assert st.sme_kpis(one).first().ventas_promedio == 10.006
    for r in st.goal_profitability(star).collect():
        assert r.promedio_ventas <= r.max_ventas


def test_collapse_broadcast_reused(spark):
    raw = td.sme_survey(spark, SF_MID)
    c = st.clean_sme(raw)
    c.collect()
    plan = plan_text(c)
    # one probe per collapsed column, the key table broadcast once, reused
    assert plan.count("BroadcastHashJoin") >= len(st.COLLAPSE_COLUMNS)
    assert plan.count("ReusedExchange") >= len(st.COLLAPSE_COLUMNS) - 1


def test_summaries(star):
    kpi = st.sme_kpis(star.fact()).first()
    assert kpi.total_pymes == 1337
    cells = st.cell_density_class(st.sales_by_sector_cell(star))
    assert {r[0] for r in cells.select("opacidad").distinct().collect()} <= {0.4, 0.8}
    sec = st.sector_summary(star).collect()
    assert [r.ventas for r in sec] == sorted((r.ventas for r in sec), reverse=True)
    b = st.cell_boundaries(star.dim_geografia.limit(3))
    assert b.count() == 18


def test_export_star_csv(spark, star, tmp_path):
    from ledgerlens.sources.sinks import export_tables
    out = export_tables({"dim_deseo": star.dim_deseo, "fact_sme_metrics": star.fact()},
                        str(tmp_path))
    back = spark.read.option("header", True).csv(out["fact_sme_metrics"])
    assert back.count() == 1337


def test_surrogate_keys_never_meet_in_one_task(spark):
    df = spark.range(0, 3000).select((F.col("id") % 101).alias("k"),
                                     F.when(F.col("id") % 7 == 0, None)
                                     .otherwise(F.col("id") % 4).alias("j"))
    a, b = surrogate_key(df, ["j", "k"], "sk", num_partitions=5), surrogate_key(df, ["j", "k"], "sk")
    assert "SinglePartition" not in plan_text(a) and "SinglePartition" not in plan_text(b)
    norm = lambda rows: sorted((r.sk, r.j or -1, r.k) for r in rows)
    assert norm(a.collect()) == norm(b.collect())


def test_survey_etl_writes_each_table_once(spark, tmp_path, monkeypatch):
    import ledgerlens.session as session
    written = []
    real = session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda sp, name: written.append(name) or real(sp, name))
    st.run_survey_etl(spark, td.sme_survey(spark, "/root/testdata/sf0.001"), str(tmp_path))
    keys = [f"sk_id_{d}_dim" for d in ("geografia", "negocio", "deseo")]
    assert sorted(written) == sorted(["sme_clean", "sme_enriched", *keys, *(f"{k}_tagged" for k in keys)])


def test_export_reads_back_equal(spark, star, tmp_path):
    from ledgerlens.sources.files import read_csv_text
    from ledgerlens.sources.sinks import export_tables
    out = export_tables({"dim_negocio": star.dim_negocio}, str(tmp_path))
    back = read_csv_text(spark, out["dim_negocio"])
    text = star.dim_negocio.select(*[F.col(c).cast("string") for c in star.dim_negocio.columns])
    assert sorted(map(str, back.collect())) == sorted(map(str, text.collect()))


def test_category_share_counts_null_and_sums_to_one(spark):
    from ledgerlens.operators import category_share
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "c string")
    got = {r.value: (r.n, r.share) for r in category_share(df, "c").collect()}
    assert got == {"a": (2, 0.5), None: (1, 0.25), "b": (1, 0.25)}


def test_collapse_hot_value(spark):
    """A value with a third of all rows is kept; the rest collapse."""
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id").cast("string")))
        .alias("c")).repartition(7)
    got = {r.c: r["count"] for r in collapse_rare(df, ["c"]).groupBy("c").count().collect()}
    assert got == {"hot": 1000, "OTROS": 2000}


def test_run_survey_etl_without_database(spark, tmp_path):
    raw = td.sme_survey(spark, "/root/testdata/sf0.001")
    out = st.run_survey_etl(spark, raw, str(tmp_path))
    assert set(out) == {"sme_molap_flat", "dim_emprendedor", "dim_geografia_h3", "dim_negocio",
                        "dim_deseo", "fact_sme_metrics", "mv_ventas_por_giro_h3",
                        "mv_deseos_rentabilidad"}
    flat = spark.read.option("header", True).csv(out["sme_molap_flat"])
    fact = spark.read.option("header", True).csv(out["fact_sme_metrics"])
    assert flat.count() == fact.count() > 0 and len(flat.columns) == 22
    mv = spark.table("mv_deseos_rentabilidad")          # a catalog table, not a session view
    assert not any(t.isTemporary for t in spark.catalog.listTables() if t.name == "mv_deseos_rentabilidad")
    assert mv.agg(F.sum("cantidad_pymes")).first()[0] == fact.count()


def test_sme_dashboard_bundle(star):
    d = st.sme_dashboard(star)
    assert d["kpis"].first().total_pymes == 1337
    assert d["map_polygons"].count() == 6 * d["map_cells"].select("h3_hex_id").distinct().count()
    assert d["sectors"].count() == 5


def _py_cell(lat, lon, edge=531.0):
    """Plain-Python statement of the grid (same literals, same order)."""
    k = grid_constants()
    if lat is None or lon is None or math.isnan(lat) or math.isnan(lon) or abs(lat) > 90 or abs(lon) > 180:
        return None
    x, y = lon * k["kx"], lat * k["ky"]
    qf = (x * (math.sqrt(3.0) / 3.0) - y / 3.0) / edge
    rf = (y * (2.0 / 3.0)) / edge
    sf = -qf - rf
    rnd = lambda v: math.copysign(math.floor(abs(v) + 0.5), v) if v else 0.0
    q, r, s = rnd(qf), rnd(rf), rnd(sf)
    dq, dr, ds = abs(q - qf), abs(r - rf), abs(s - sf)
    fq = dq > dr and dq > ds
    fr = not fq and dr > ds
    return f"hx531_{int(-r - s if fq else q)}_{int(-q - s if fr else r)}"


def test_hex_cell_agrees_with_python(spark):
    rnd = random.Random(5)
    pts = [(rnd.uniform(-95, 95), rnd.uniform(-185, 185)) for _ in range(4000)]
    pts += [(19.2 + rnd.random() * 0.6, -99.4 + rnd.random() * 0.6) for _ in range(1000)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pts)], "i int, lat double, lon double")
    for r in with_hex_cell(df, "lat", "lon", "a").collect():
        assert r.a == _py_cell(*pts[r.i]), pts[r.i]


def test_survey_texts_are_read_once(spark):
    """No condition repeats the reading of a text below the step that reads it."""
    from conftest import optimized_text
    raw = spark.range(0, 40, 1, 2).selectExpr(
        "id", "20 + id AS edadEmprendedor", "CASE WHEN id % 5 = 1 THEN ' x' ELSE concat(' ', id) END AS ventasPromedioDiarias",
        "CASE id WHEN 3 THEN 91D WHEN 4 THEN double('NaN') ELSE 19.4D END AS latitud",
        "CASE id WHEN 5 THEN -180.5D WHEN 7 THEN NULL WHEN 8 THEN 180D ELSE -99.1D END AS longitud",
        "CASE WHEN id % 10 = 2 THEN '08:30' ELSE '22' END AS horaApertura", "CAST(6 + id % 1 AS STRING) AS horaCierre",
        "CASE WHEN id % 10 = 9 THEN 'NA' ELSE '2' END AS numEmpleados", "id % 7 AS antiguedadNegocio")
    out = st.prepare_sme(raw)
    assert optimized_text(out).count("RLIKE") == 4               # sales, employees, opening, closing
    got = {r.id: r for r in out.collect()}
    assert set(got) == {i for i in range(40) if i % 5 != 1 and i % 10 not in (2, 9) and i not in (3, 4, 5, 7)}
    assert all(r.horas_operacion_diarias == 8 and r.ventasPromedioDiarias == i and r.h3_hex_id for i, r in got.items())
    assert out.columns[:9] == raw.columns


def test_collapse_of_written_prepared_rows(spark):
    from ledgerlens.session import cut_lineage
    raw = td.sme_survey(spark, SF_MID)
    written = st.collapse_sme(cut_lineage(st.prepare_sme(raw), "prepared"))
    assert sorted(map(str, written.collect())) == sorted(map(str, st.clean_sme(raw).collect()))
