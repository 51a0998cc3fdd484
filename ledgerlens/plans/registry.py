"""Named queries over the driver tables: ``(spark, sf_dir) -> DataFrame``.

Each entry runs one operator or composite of the inventory over whole
tables (or views Spark derives from them).  ``ledgerlens.oracle_sql``
holds the matching SQL for an independent engine.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hexgrid import hex_centroid, with_hex_cell
from ..functions.icogrid import with_ico_cell, with_ico_centre
from ..operators.aggregates import category_share
from ..operators.categories import collapse_rare
from ..session import cut_lineage, scratch_path, scratch_scope, still_written, written_once
from ..sources.catalog import reused
from ..sources.csv_lines import CsvQuarantine, read_csv_inferred
from ..sources.files import read_csv_text, read_csv_tolerant, read_glob_shards, tolerant_types
from ..sources.clustered import read_selected, write_clustered
from ..sources.shards import read_evolved_shards
from ..sources.sinks import BY_SIZE, materialize, write_csv, write_date_shards, write_parquet
from ..sources import testdata as td
from ..sources.versions import replace_table
from . import cube as cb
from . import cube_store as cs
from . import star as st
from . import warehouse as wh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ cube
def _clean(spark, sf_dir):
    return cb.clean_transactions(td.transactions(spark, sf_dir))


def _once(spark, sf_dir, name, tables, build):
    """The table ``build`` gives, written once per state of its input tables."""
    def write():
        path = scratch_path(spark, name)
        write_parquet(build(), path)
        return path
    return spark.read.parquet(written_once(spark, name, td.paths(sf_dir, tables), write))


def _cube(spark, sf_dir):
    """The dashboards' input: the cube is built once and written (as the ETL
    does); every figure reads those files."""
    return _once(spark, sf_dir, "bi_cube", td.TRANSACTION_TABLES,
                 lambda: cb.build_cube(_clean(spark, sf_dir)))


# Parameters of the registered selections.
OPENING_STATES = 5
SELECTED_YEARS, SELECTED_STATES = [1993, 1995, 1996], ["NATION_3", "NATION_7", "NATION_11"]


@query("clean_transactions")
def q_clean_transactions(spark, sf_dir):
    """Typed, cleaned transactions (money exposed as double)."""
    return _clean(spark, sf_dir).withColumn("amount_clean", F.col("amount_clean").cast("double"))


@query("bi_cube")
def q_bi_cube(spark, sf_dir):
    """The six-key transaction cube, built."""
    return cb.build_cube(_clean(spark, sf_dir))


@query("cube_slice")
def q_cube_slice(spark, sf_dir):
    """The dashboard's opening selection: all years, the first five states."""
    cube = _cube(spark, sf_dir)
    return cb.slice_cube(cube, states=cb.first_states(cube, OPENING_STATES))


@query("cube_slice_selected")
def q_cube_slice_selected(spark, sf_dir):
    """A user's selection: lists of years and states."""
    return cb.slice_cube(_cube(spark, sf_dir), years=SELECTED_YEARS, states=SELECTED_STATES)


@query("cube_kpis")
def q_cube_kpis(spark, sf_dir):
    return cb.kpis(_cube(spark, sf_dir))


@query("monthly_amount")
def q_monthly_amount(spark, sf_dir):
    return cb.monthly_amount(_cube(spark, sf_dir))


@query("amount_by_channel")
def q_amount_by_channel(spark, sf_dir):
    return cb.amount_by_channel(_cube(spark, sf_dir))


@query("top_mcc")
def q_top_mcc(spark, sf_dir):
    return cb.top_mcc(_cube(spark, sf_dir))


@query("fraud_by_state")
def q_fraud_by_state(spark, sf_dir):
    return cb.fraud_by_state(_cube(spark, sf_dir))


@query("slicer_states")
def q_slicer_states(spark, sf_dir):
    return cb.slicer_states(_cube(spark, sf_dir))


@query("slicer_years")
def q_slicer_years(spark, sf_dir):
    return cb.slicer_years(_cube(spark, sf_dir))


@query("cube_preview")
def q_cube_preview(spark, sf_dir):
    return cb.preview(_cube(spark, sf_dir))


@query("slice_figures_reused")
def q_slice_figures_reused(spark, sf_dir):
    """Three figures of one selection that is kept while they are computed, then released."""
    with reused(cb.slice_cube(_cube(spark, sf_dir), years=SELECTED_YEARS, states=SELECTED_STATES)) as s:
        figure = lambda df, name, key: df.select(F.lit(name).alias("figure"), key.cast("string").alias("key"), "total_amount")
        parts = (figure(cb.amount_by_channel(s), "channel", F.col("`Use Chip`"))
                 .unionByName(figure(cb.monthly_amount(s), "month", F.col("period")))
                 .unionByName(figure(cb.top_mcc(s), "category", F.col("MCC"))))
        return cut_lineage(parts, "slice_figures")


# The clustered cube's files and a selection on three keys of it.
CUBE_ROWS_PER_FILE = 20_000
SKIPPING = {"Year": [1996, 1998], "Merchant State": ["NATION_3", "NATION_12"], "MCC": [5001, 5004, 5999]}


@query("cube_slice_skipping")
def q_cube_slice_skipping(spark, sf_dir):
    """A selection from the cube clustered by year and state: other files are not opened."""
    def write():
        return write_clustered(_cube(spark, sf_dir), scratch_path(spark, "clustered_cube"), ["Year", "Merchant State"],
                               bloom=["Merchant State", "MCC"], rows_per_file=CUBE_ROWS_PER_FILE)
    path = written_once(spark, "clustered_cube", td.paths(sf_dir, td.TRANSACTION_TABLES), write)
    return read_selected(spark, path, **SKIPPING)


# The first batch ends in the middle of a month, which the second one completes.
FIRST_BATCH_ENDS = "1997-06-15"


def _store(spark, sf_dir) -> cs.CubeStore:
    """The stored cube after two loads, written once per state of the input tables."""
    def write():
        store = cs.CubeStore(spark, scratch_path(spark, "cube_store"))
        first = F.col("date") <= F.lit(FIRST_BATCH_ENDS).cast("date")
        with scratch_scope(spark):
            # the joins run once; both batches read the written rows
            clean = cut_lineage(_clean(spark, sf_dir).select(
                *[cb.col(k) for k in cb.CUBE_KEYS], *cs.BATCH_COLUMNS, "date"), "transactions")
            store.load(clean.where(first))
            store.load(clean.where(~first))
        return store.path
    return cs.CubeStore(spark, written_once(spark, "cube_store", td.paths(sf_dir, td.TRANSACTION_TABLES), write))


@query("cube_incremental")
def q_cube_incremental(spark, sf_dir):
    """The cube after two batches: only the second one's months were rebuilt."""
    return _store(spark, sf_dir).cube()


@query("cube_unique_users")
def q_cube_unique_users(spark, sf_dir):
    """Unique users by state, by year and overall, from the stored bitmaps alone."""
    store = _store(spark, sf_dir)
    part = lambda df, kind, value: df.select(F.lit(kind).alias("per"), value.alias("value"), "unique_users")
    return (part(store.unique_users(["Merchant State"]), "state", F.col("`Merchant State`"))
            .unionByName(part(store.unique_users(["Year"]), "year", F.col("Year").cast("string")))
            .unionByName(part(store.unique_users(), "all", F.lit(None).cast("string"))))


@query("cube_unique_users_selected")
def q_cube_unique_users_selected(spark, sf_dir):
    """Unique users by channel of a user's selection of years and states."""
    return _store(spark, sf_dir).unique_users(["Use Chip"], SELECTED_YEARS, SELECTED_STATES)


# ---------------------------------------------------------------- survey
def _survey(spark, sf_dir):
    return td.sme_survey(spark, sf_dir)


_stars: dict[str, st.Star] = {}


def _star(spark, sf_dir) -> st.Star:
    """The star of the survey: clean rows, keys and enriched rows are written once
    per state of the input tables."""
    def write():
        path = scratch_path(spark, "sme_clean")
        with scratch_scope(spark):               # prepared once, read by both passes of the collapse
            prepared = cut_lineage(st.prepare_sme(_survey(spark, sf_dir)), "sme_prepared")
            return write_parquet(st.collapse_sme(prepared), path)
    path = written_once(spark, "sme_clean", td.paths(sf_dir, td.SURVEY_TABLES), write)
    for gone in [p for p in _stars if not still_written(p)]:
        del _stars[gone]
    if path not in _stars:
        _stars[path] = st.Star(spark.read.parquet(path))
    return _stars[path]


@query("rare_category_collapse")
def q_rare_category_collapse(spark, sf_dir):
    """5 % collapse of part brands (all rare) and types (none rare)."""
    part = td.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return collapse_rare(part, ["p_brand", "p_type"])


@query("rare_category_frequent")
def q_rare_category_frequent(spark, sf_dir):
    """5 % collapse of a column with nearly as many values as rows (a few of them frequent)
    beside one with few: rare values are never shuffled."""
    lines = td.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "CASE WHEN l_quantity <= 20 THEN concat('Q', CAST(l_quantity % 7 AS INT)) WHEN l_linenumber = 6 THEN NULL "
        "ELSE concat(l_orderkey, '-', l_linenumber) END AS reference", "l_returnflag AS flag")
    return collapse_rare(lines, ["reference", "flag"], many_values=True)


@query("category_share")
def q_category_share(spark, sf_dir):
    """Share of each document source (value_counts(normalize=True))."""
    return category_share(td.table(spark, sf_dir, "documents").select("source"), "source")


@query("operating_hours")
def q_operating_hours(spark, sf_dir):
    raw = _survey(spark, sf_dir).select("id", "horaApertura", "horaCierre")
    return st.operating_hours(raw)


@query("clean_sme")
def q_clean_sme(spark, sf_dir):
    """Clean survey rows (lazy: nothing is written)."""
    return st.clean_sme(_survey(spark, sf_dir))


@query("hex_bin")
def q_hex_bin(spark, sf_dir):
    pts = _survey(spark, sf_dir).select("id", "latitud", "longitud")
    return with_hex_cell(pts, "latitud", "longitud")


@query("hex_centroid")
def q_hex_centroid(spark, sf_dir):
    pts = with_hex_cell(_survey(spark, sf_dir).select("latitud", "longitud"), "latitud", "longitud")
    cells = pts.select("h3_hex_id").where(F.col("h3_hex_id").isNotNull()).distinct()
    c = hex_centroid("h3_hex_id")
    return cells.select("h3_hex_id", c["lat"].alias("lat"), c["lon"].alias("lon"))


@query("hex_boundary")
def q_hex_boundary(spark, sf_dir):
    pts = with_hex_cell(_survey(spark, sf_dir).select("latitud", "longitud"), "latitud", "longitud")
    cells = pts.select("h3_hex_id").distinct()
    return st.cell_boundaries(cells)


def _world_points(spark, sf_dir):
    """One point of the globe per customer, all latitudes and longitudes."""
    return td.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "-89.93D + (c_custkey * 37 % 1799) / 10.0D AS lat", "-179.97D + (c_custkey * 91 % 3599) / 10.0D AS lon")


@query("hex_bin_global")
def q_hex_bin_global(spark, sf_dir):
    """Global hexagonal cells (near-equal areas at every latitude) of points all over the world."""
    return with_ico_cell(_world_points(spark, sf_dir), "lat", "lon", "cell")


@query("hex_centroid_global")
def q_hex_centroid_global(spark, sf_dir):
    """Centres of the distinct global cells, at a coarse grid where cells hold several points."""
    cells = with_ico_cell(_world_points(spark, sf_dir), "lat", "lon", "cell", n=7).select("cell").distinct()
    return with_ico_centre(cells, "cell")


@query("dim_emprendedor")
def q_dim_emprendedor(spark, sf_dir):
    """A projection of the written clean rows."""
    return _star(spark, sf_dir).dim_emprendedor


@query("dim_geografia")
def q_dim_geografia(spark, sf_dir):
    return _star(spark, sf_dir).dim_geografia


@query("dim_negocio")
def q_dim_negocio(spark, sf_dir):
    return _star(spark, sf_dir).dim_negocio


@query("dim_negocio_reload")
def q_dim_negocio_reload(spark, sf_dir):
    """The business dimension after two loads: the first sees every third business, the
    second all of them, and keeps the first one's keys."""
    clean = _star(spark, sf_dir).clean
    store = scratch_path(spark, "dim_negocio_keys")
    replace_table(spark, st.reload_dim_negocio(None, clean.where("id % 3 = 0")), "dim_negocio_keys", store)
    return replace_table(spark, st.reload_dim_negocio(spark.table("dim_negocio_keys"), clean), "dim_negocio_keys", store)


@query("dim_deseo")
def q_dim_deseo(spark, sf_dir):
    return _star(spark, sf_dir).dim_deseo


@query("fact_sme")
def q_fact_sme(spark, sf_dir):
    return _star(spark, sf_dir).fact()


@query("molap_flat")
def q_molap_flat(spark, sf_dir):
    return _star(spark, sf_dir).flat()


@query("mv_sales_by_sector_cell")
def q_mv_sales_by_sector_cell(spark, sf_dir):
    """Materialized (written, re-read) sales per cell and sector."""
    df = st.sales_by_sector_cell(_star(spark, sf_dir))
    return materialize(spark, df, "mv_ventas_por_giro_h3", scratch_path(spark, "mv_ventas_por_giro_h3"))


@query("mv_goal_profitability")
def q_mv_goal_profitability(spark, sf_dir):
    df = st.goal_profitability(_star(spark, sf_dir))
    return materialize(spark, df, "mv_deseos_rentabilidad", scratch_path(spark, "mv_deseos_rentabilidad"))


@query("materialized_replace")
def q_materialized_replace(spark, sf_dir):
    """A materialized view of a few sectors, replaced by one that reads it and adds the others."""
    sales = st.sales_by_sector_cell(_star(spark, sf_dir))
    early = F.coalesce(F.col("giro_negocio") < "G", F.lit(False))
    root = scratch_path(spark, "mv_ventas_ampliada")
    first = materialize(spark, sales.where(early), "mv_ventas_ampliada", root)
    return materialize(spark, first.unionByName(sales.where(~early)), "mv_ventas_ampliada", root)


@query("sector_summary")
def q_sector_summary(spark, sf_dir):
    return st.sector_summary(_star(spark, sf_dir))


@query("sme_kpis")
def q_sme_kpis(spark, sf_dir):
    return st.sme_kpis(_star(spark, sf_dir).fact())


@query("cell_density_class")
def q_cell_density_class(spark, sf_dir):
    """Map classes over the materialized sales view (as the map page reads it)."""
    df = st.sales_by_sector_cell(_star(spark, sf_dir))
    mv = materialize(spark, df, "mv_ventas_por_giro_h3", scratch_path(spark, "mv_ventas_por_giro_h3"))
    return st.cell_density_class(mv)


# ------------------------------------------------------------- warehouse
# Parameters of the registered runs: two states compared, the HAVING floor as
# a share of a state's total (15 names a state: it cuts about half at every scale),
# the shard range, the taxi.
STATE_A, STATE_B, MIN_SHARE = "NATION_1", "NATION_2", 0.067
SHARDS = ("20240108", "20240121")
TAXI_ID = 7


@query("names_top50")
def q_names_top50(spark, sf_dir):
    return wh.state_totals(spark, td.names(spark, sf_dir))


@query("customers_top50")
def q_customers_top50(spark, sf_dir):
    """The 50 largest totals of a key with many more values."""
    orders = td.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer"), F.col("o_totalprice").cast("decimal(18,2)").alias("number"))
    return wh.state_totals(spark, orders, view="customer_orders", key="customer")


@query("names_full_outer")
def q_names_full_outer(spark, sf_dir):
    return wh.compare_states(td.names(spark, sf_dir), STATE_A, STATE_B, min_share=MIN_SHARE)


def _shards(spark, sf_dir) -> str:
    """The load step: events laid out as one shard per day, files by its size,
    once per state of the events table."""
    def write():
        events = td.ga_events(spark, sf_dir).drop("event_date")
        return write_date_shards(events, scratch_path(spark, "events_shards"), "ts", files_per_shard=BY_SIZE)
    return written_once(spark, "events_shards", td.paths(sf_dir, ["events"]), write)


@query("wildcard_events")
def q_wildcard_events(spark, sf_dir):
    """Range of daily shards by partition filter; the schema is given, not inferred."""
    schema = td.ga_events(spark, sf_dir).drop("event_date").schema
    return wh.events_by_suffix(spark, _shards(spark, sf_dir), *SHARDS, data_schema=schema)


@query("glob_events")
def q_glob_events(spark, sf_dir):
    """The same range over separate daily folders named by a glob."""
    shards = read_glob_shards(spark, f"{_shards(spark, sf_dir)}/table_suffix=*", SHARDS, prefix="table_suffix=")
    return wh.shard_report(shards)


# The day on which the events' layout changed.
NEW_LAYOUT = "2024-01-15"


def _evolved_shards(spark, sf_dir) -> str:
    """Daily shards of two layouts: the older one has narrower ids, no ``geo`` and a column
    that was given up."""
    def write():
        base = scratch_path(spark, "evolved_shards")
        events = td.ga_events(spark, sf_dir).drop("event_date")
        is_new = F.col("ts") >= F.lit(NEW_LAYOUT).cast("timestamp")
        old = events.where(~is_new).select(F.col("event_id").cast("int").alias("event_id"), "ts", "event_name",
                                           F.lit("web").alias("channel"))
        new = events.where(is_new).withColumn("event_id", F.col("event_id").cast("bigint"))
        write_date_shards(old, base, "ts", files_per_shard=BY_SIZE)
        return write_date_shards(new, base, "ts", files_per_shard=BY_SIZE, mode="append")
    return written_once(spark, "evolved_shards", td.paths(sf_dir, ["events"]), write)


@query("wildcard_evolved")
def q_wildcard_evolved(spark, sf_dir):
    """A range over shards of both layouts, in the newest one's schema."""
    shards = read_evolved_shards(spark, _evolved_shards(spark, sf_dir), SHARDS)
    return wh.shard_report(shards, "event_id")


def _taxis(spark, sf_dir):
    return wh.taxi_subset(spark, td.taxi_trips(spark, sf_dir), TAXI_ID, "prueba.taxis",
                          scratch_path(spark, "prueba_taxis"))


@query("ctas_taxis")
def q_ctas_taxis(spark, sf_dir):
    return _taxis(spark, sf_dir)


@query("monthly_growth")
def q_monthly_growth(spark, sf_dir):
    return wh.monthly_growth(_taxis(spark, sf_dir))


# ------------------------------------------------------------ round trips
@query("parquet_roundtrip")
def q_parquet_roundtrip(spark, sf_dir):
    """Cube written as zstd Parquet, read back through the cube loader."""
    path = write_parquet(cb.build_cube(_clean(spark, sf_dir)), scratch_path(spark, "bi_cube"), "zstd")
    return cb.load_cube(spark, path)


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    """Raw transactions written as CSV text, then the full ETL from CSV:
    tolerant scan -> clean -> cube."""
    path = write_csv(td.transactions(spark, sf_dir), scratch_path(spark, "credit_card_csv"))
    return cb.build_cube(cb.clean_transactions(
        cb.read_transactions_csv(spark, path, file_columns=cb.RAW_COLUMNS)))


@query("csv_quoted_roundtrip")
def q_csv_quoted_roundtrip(spark, sf_dir):
    """Whole texts with quotes, commas, newlines and outer blanks through CSV and back."""
    docs = td.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit('  "'), F.col("lang"), F.lit('", '), F.col("text"), F.lit(' ""  ')).alias("quoted"))
    path = write_csv(docs, scratch_path(spark, "quoted_csv"))
    back = read_csv_text(spark, path, file_columns=["doc_id", "quoted"], multi_line=True)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "quoted")


@query("csv_tolerant_scan")
def q_csv_tolerant_scan(spark, sf_dir):
    """Numbers of which every tenth is junk and every seventh is empty, written as CSV and scanned
    tolerantly: null where they do not parse."""
    orders = td.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 10 = 0 THEN 'n/k' WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END AS cust",
        "CASE WHEN o_orderkey % 13 = 0 THEN concat(CAST(o_totalprice AS STRING), ' EUR') "
        "ELSE CAST(o_totalprice AS STRING) END AS price")
    path = write_csv(orders, scratch_path(spark, "tolerant_csv"))
    return read_csv_tolerant(spark, path, orders.columns,
                             {"o_orderkey": "bigint", "cust": "bigint", "price": "double"},
                             file_columns=orders.columns)


def _order_lines(spark, sf_dir):
    """Orders as CSV lines by hand: every 17th too short, 19th too long, 23rd with an open quote, 29th
    with text after one; bare and doubled quotes among the good ones."""
    key, head = "o_orderkey", "concat_ws(',', o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)))"
    return td.table(spark, sf_dir, "orders").selectExpr(
        f"CASE WHEN {key} % 17 = 0 THEN concat_ws(',', o_orderkey, o_custkey) "
        f"WHEN {key} % 19 = 0 THEN concat({head}, ',x,\"y\"') "
        f"WHEN {key} % 23 = 0 THEN concat({head}, ',\"open, ', o_orderstatus) "
        f"WHEN {key} % 29 = 0 THEN concat({head}, ',\"', o_orderstatus, '\"b') "
        f"WHEN {key} % 31 = 0 THEN concat({head}, ',5\" ', o_orderstatus) "
        f"WHEN {key} % 37 = 0 THEN concat({head}, ',\"says \"\"', o_orderstatus, '\"\"\"') "
        f"ELSE concat({head}, ',\"status, ', o_orderstatus, '\"') END AS `o_orderkey,cust,price,note`")


@query("csv_quarantine")
def q_csv_quarantine(spark, sf_dir):
    """Kept and refused rows of a CSV with broken lines, from one text scan."""
    path = scratch_path(spark, "broken_csv")
    (_order_lines(spark, sf_dir).write.option("header", True).option("sep", "\u0001").option("quote", "\u0000").csv(path))
    found = CsvQuarantine(spark, path, file_columns=["o_orderkey", "cust", "price", "note"])
    kept = tolerant_types(found.kept, {"o_orderkey": "bigint", "cust": "bigint", "price": "double"})
    refused = found.refused.select("reason", F.col("text").alias("refused"))
    return kept.unionByName(refused, allowMissingColumns=True)


@query("csv_inferred_types")
def q_csv_inferred_types(spark, sf_dir):
    """Customers written as CSV with NA tokens; every type is inferred on reading."""
    k = "c_custkey"
    rows = td.table(spark, sf_dir, "customer").selectExpr(
        f"{k} AS id",
        f"CASE WHEN {k} % 43 = 0 THEN 'NA' WHEN {k} % 47 = 0 THEN '-inf' ELSE CAST(c_acctbal AS STRING) END AS balance",
        f"CASE WHEN {k} % 5 = 0 THEN 'n/a' ELSE concat('  ', {k} % 30) END AS padded",
        f"CASE WHEN {k} % 7 = 0 THEN 'null' WHEN {k} % 2 = 0 THEN 'True' ELSE 'false' END AS flag",
        f"CASE WHEN {k} % 11 = 0 THEN NULL ELSE CAST(date_add(DATE'2020-01-01', CAST({k} % 800 AS INT)) AS STRING) END AS since",
        f"CASE WHEN {k} % 997 = 0 THEN '12a' ELSE CAST({k} % 100 AS STRING) END AS mixed",
        "'None' AS nothing", "c_mktsegment AS sector")
    return read_csv_inferred(spark, write_csv(rows, scratch_path(spark, "untyped_csv")), file_columns=rows.columns)
