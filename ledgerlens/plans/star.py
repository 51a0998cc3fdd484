"""Small-business survey -> star schema, flat table and summaries.

    raw survey ──prepare_sme──> prepared rows (written to the shared folder)
               ──collapse────> clean rows (written to the shared folder)
        ├─ dim_emprendedor   projection, one row per survey row
        ├─ dim_geografia     distinct hex cells + key + centroid
        ├─ dim_negocio       distinct 6 business columns + key
        ├─ dim_deseo         distinct (wish, category) + key
        └─ enriched = clean ⋈ dims (left, null-safe keys)
             ├─ fact_sme_metrics   4 keys + 4 measures
             └─ sme_molap_flat     22 denormalized columns

Only ``dim_deseo`` is broadcast by hint (two collapsed columns: at most
``(1/threshold + 1)**2`` rows, whatever the data); the other joins are left to
the planner's byte threshold and AQE.  The clean rows, the key tables and the
enriched rows are written once; the fact, the flat table and the summaries read them.
The fact keeps every clean row (left joins on keys drawn from the same rows never miss).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, daily_hours, density_class, exact_avg, lenient_number
from ..functions.hexgrid import DEFAULT_EDGE_M, hex_boundary, hex_centroid, with_hex_cell
from ..operators.categories import CATEGORY_THRESHOLD, collapse_rare
from ..operators.keys import extend_keys, surrogate_key
from ..operators.relational import drop_incomplete, join_on, null_safe_join, select_renamed
from ..session import cut_lineage
from ..sources.files import na_to_null

# Fixed values of the survey model.
REQUIRED_COLUMNS = ["id", "edadEmprendedor", "ventasPromedioDiarias", "latitud", "longitud",
                    "horaApertura", "horaCierre", "numEmpleados", "antiguedadNegocio"]
COLLAPSE_COLUMNS = ["escolaridadEmprendedor", "estadoCivil", "giroNegocio", "registroVentas",
                    "registroContabilidad", "tiempoCreditoProveedores", "Categoría",
                    "Respuesta Original"]
NEGOCIO_COLUMNS = ["giroNegocio", "registroVentas", "registroContabilidad", "altaSAT",
                   "usaCredito", "tiempoCreditoProveedores"]
NEGOCIO_NAMES = ["giro_negocio", "registro_ventas", "registro_contabilidad", "alta_sat",
                 "usa_credito", "tiempo_credito_proveedores"]
DESEO_COLUMNS = ["Respuesta Original", "Categoría"]
DESEO_NAMES = ["deseo_original", "categoria_deseo"]
NUMERIC_COLUMNS = ["edadEmprendedor", "ventasPromedioDiarias", "latitud", "longitud",
                   "numEmpleados", "antiguedadNegocio"]

EMPRENDEDOR_MAP = [
    ("id", "id_emprendedor"), ("edadEmprendedor", "edad_emprendedor"),
    ("sexoEmprendedor", "sexo_emprendedor"), ("escolaridadEmprendedor", "escolaridad_emprendedor"),
    ("estadoCivil", "estado_civil"), ("dependientesEconomicos", "dependientes_economicos"),
    ("familiaAyuda", "familia_ayuda"),
]
FACT_MAP = [
    ("id", "id_emprendedor"), ("id_negocio_dim", "id_negocio_dim"),
    ("id_geografia_dim", "id_geografia_dim"), ("id_deseo_dim", "id_deseo_dim"),
    ("ventasPromedioDiarias", "ventas_promedio_diarias"), ("numEmpleados", "num_empleados"),
    ("antiguedadNegocio", "antiguedad_negocio"),
    ("horas_operacion_diarias", "horas_operacion_diarias"),
]
FLAT_MAP = [
    ("id", "id_emprendedor"), ("edadEmprendedor", "edad"), ("sexoEmprendedor", "sexo"),
    ("escolaridadEmprendedor", "escolaridad"), ("estadoCivil", "estado_civil"),
    ("dependientesEconomicos", "dependientes_economicos"), ("familiaAyuda", "familia_ayuda"),
    ("giro_negocio", "giro_negocio"), ("registro_ventas", "registro_ventas"),
    ("registro_contabilidad", "registro_contabilidad"), ("alta_sat", "alta_sat"),
    ("usa_credito", "usa_credito"), ("tiempo_credito_proveedores", "tiempo_credito_proveedores"),
    ("deseo_original", "deseo_negocio"), ("categoria_deseo", "categoria_deseo"),
    ("h3_hex_id", "h3_hex_id"), ("latitud_centroide", "latitud_centroide"),
    ("longitud_centroide", "longitud_centroide"),
    ("ventasPromedioDiarias", "ventas_promedio_diarias"), ("numEmpleados", "num_empleados"),
    ("antiguedadNegocio", "antiguedad_negocio"),
    ("horas_operacion_diarias", "horas_operacion_diarias"),
]
# names of the tables as loaded into a database
TABLE_NAMES = {"dim_emprendedor": "dim_emprendedor", "dim_geografia": "dim_geografia_h3",
               "dim_negocio": "dim_negocio", "dim_deseo": "dim_deseo",
               "fact": "fact_sme_metrics", "flat": "sme_molap_flat"}


# ------------------------------------------------------------------ clean
def _read_numbers(df: DataFrame, numbers: dict) -> DataFrame:
    """``df`` with columns of the numbers read from its text.  They pass through a one-row
    ``inline``: conditions on them stay above it and every text is read once, where
    the optimizer would otherwise repeat the reading in each condition down to the scan."""
    read = F.inline(F.array(F.struct(*[c.alias(f"__n{i}") for i, c in enumerate(numbers.values())])))
    got = {name: F.col(f"__n{i}").alias(name) for i, name in enumerate(numbers)}
    return df.select("*", read).select(*[got.pop(c, col(c)) for c in df.columns], *got.values())


def operating_hours(raw: DataFrame) -> DataFrame:
    """Parse opening / closing hours leniently, drop rows where either does
    not parse (or is NaN), add daily hours with overnight wrap."""
    df = _read_numbers(raw, {"horaAperturaNum": lenient_number("horaApertura"), "horaCierreNum": lenient_number("horaCierre")})
    df = drop_incomplete(df, ["horaAperturaNum", "horaCierreNum"])
    return df.withColumn("horas_operacion_diarias", daily_hours("horaAperturaNum", "horaCierreNum"))


def prepare_sme(raw: DataFrame, edge_m: float = DEFAULT_EDGE_M) -> DataFrame:
    """Row-local cleaning: NA tokens -> null, numbers read leniently, rows
    without a usable value in a required field dropped (missing, not a number,
    NaN, or coordinates outside the globe), daily hours, hexagonal cell."""
    df = na_to_null(raw)
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    read = lambda c: lenient_number(c) if c in text else col(c).cast("double")
    df = _read_numbers(df, {c: read(c) for c in NUMERIC_COLUMNS})
    df = operating_hours(drop_incomplete(df, REQUIRED_COLUMNS))
    # known coordinates on the globe are what has a cell
    df = df.where((F.abs("latitud") <= 90) & (F.abs("longitud") <= 180))
    return with_hex_cell(df, "latitud", "longitud", "h3_hex_id", edge_m)


def collapse_sme(prepared: DataFrame, threshold: float = CATEGORY_THRESHOLD) -> DataFrame:
    """The 5 % rare-category collapse of eight columns (a counting pass over a pruned scan, and the rows)."""
    return collapse_rare(prepared, COLLAPSE_COLUMNS, threshold)


def clean_sme(raw: DataFrame, threshold: float = CATEGORY_THRESHOLD,
              edge_m: float = DEFAULT_EDGE_M) -> DataFrame:
    """Survey cleaning: :func:`prepare_sme`, then :func:`collapse_sme` (lazy: both passes prepare)."""
    return collapse_sme(prepare_sme(raw, edge_m), threshold)


# ------------------------------------------------------------ dimensions
def dim_emprendedor(clean: DataFrame) -> DataFrame:
    """Owner dimension: a projection (not deduplicated)."""
    return select_renamed(clean, EMPRENDEDOR_MAP)


def dim_geografia(clean: DataFrame) -> DataFrame:
    """Distinct cells, key 1..n in cell-id order, centroid of each cell
    (computed once per distinct cell)."""
    keys = surrogate_key(clean, ["h3_hex_id"], "id_geografia_dim")
    c = hex_centroid("h3_hex_id")
    return keys.select("h3_hex_id", "id_geografia_dim",
                       c["lat"].alias("latitud_centroide"), c["lon"].alias("longitud_centroide"))


def dim_negocio(clean: DataFrame) -> DataFrame:
    keys = surrogate_key(clean, NEGOCIO_COLUMNS, "id_negocio_dim")
    return select_renamed(keys, list(zip(NEGOCIO_COLUMNS, NEGOCIO_NAMES))
                          + [("id_negocio_dim", "id_negocio_dim")])


def reload_dim_negocio(known: DataFrame | None, clean: DataFrame) -> DataFrame:
    """The business dimension of a further load: known attributes keep their keys,
    new ones are numbered after the greatest (``known``: the stored dimension, None at first)."""
    if known is not None:
        known = select_renamed(known, list(zip(NEGOCIO_NAMES, NEGOCIO_COLUMNS)) + [("id_negocio_dim", "id_negocio_dim")])
    keys = extend_keys(known, clean, NEGOCIO_COLUMNS, "id_negocio_dim")
    return select_renamed(keys, list(zip(NEGOCIO_COLUMNS, NEGOCIO_NAMES)) + [("id_negocio_dim", "id_negocio_dim")])


def dim_deseo(clean: DataFrame) -> DataFrame:
    keys = surrogate_key(clean, DESEO_COLUMNS, "id_deseo_dim")
    return select_renamed(keys, list(zip(DESEO_COLUMNS, DESEO_NAMES))
                          + [("id_deseo_dim", "id_deseo_dim")])


@dataclass
class Star:
    """The written clean rows, and what is built from them on first use."""
    clean: DataFrame

    @property
    def dim_emprendedor(self) -> DataFrame:
        return dim_emprendedor(self.clean)

    @cached_property
    def dim_geografia(self) -> DataFrame:
        return dim_geografia(self.clean)

    @cached_property
    def dim_negocio(self) -> DataFrame:
        return dim_negocio(self.clean)

    @cached_property
    def dim_deseo(self) -> DataFrame:
        return dim_deseo(self.clean)

    @cached_property
    def enriched(self) -> DataFrame:
        """Clean rows with the three dimension keys and attributes, written once."""
        x = join_on(self.clean, self.dim_geografia, [("h3_hex_id", "h3_hex_id")], how="left", null_safe=True)
        x = null_safe_join(x, self.dim_negocio, NEGOCIO_COLUMNS, NEGOCIO_NAMES, how="left")
        x = null_safe_join(x, self.dim_deseo, DESEO_COLUMNS, DESEO_NAMES, how="left", bounded=True)
        return cut_lineage(x, "sme_enriched")

    def fact(self) -> DataFrame:
        return select_renamed(self.enriched, FACT_MAP)

    def flat(self) -> DataFrame:
        return select_renamed(self.enriched, FLAT_MAP)


def build_star(raw: DataFrame, threshold: float = CATEGORY_THRESHOLD,
               edge_m: float = DEFAULT_EDGE_M) -> Star:
    """Write the clean rows once; everything else follows on first use."""
    return Star(cut_lineage(clean_sme(raw, threshold, edge_m), "sme_clean"))


# ------------------------------------------------------- summaries (views)
def sales_by_sector_cell(star: Star) -> DataFrame:
    """Businesses, mean sales and employees per (cell, sector)."""
    x = join_on(star.fact(), star.dim_geografia, [("id_geografia_dim", "id_geografia_dim")])
    x = join_on(x, star.dim_negocio, [("id_negocio_dim", "id_negocio_dim")])
    return x.groupBy("h3_hex_id", "giro_negocio").agg(
        F.count("id_emprendedor").alias("cantidad_pymes"),
        exact_avg("ventas_promedio_diarias").alias("promedio_ventas"),
        F.sum("num_empleados").alias("suma_empleados"))


def goal_profitability(star: Star) -> DataFrame:
    """Businesses, mean / max sales and mean age per wish category."""
    x = join_on(star.fact(), star.dim_deseo, [("id_deseo_dim", "id_deseo_dim")], bounded=True)
    return x.groupBy("categoria_deseo").agg(
        F.count("id_emprendedor").alias("cantidad_pymes"),
        exact_avg("ventas_promedio_diarias").alias("promedio_ventas"),
        F.max("ventas_promedio_diarias").alias("max_ventas"),
        F.avg("antiguedad_negocio").alias("antiguedad_promedio"))


def sector_summary(star: Star) -> DataFrame:
    """Mean sales, employees and businesses per sector, best sector first."""
    x = join_on(star.fact(), star.dim_negocio, [("id_negocio_dim", "id_negocio_dim")])
    return (x.groupBy("giro_negocio").agg(
        exact_avg("ventas_promedio_diarias").alias("ventas"),
        F.sum("num_empleados").alias("empleados"),
        F.count(F.lit(1)).alias("pymes"))
        .orderBy(F.desc_nulls_first("ventas"), F.asc_nulls_first("giro_negocio")))


def sme_kpis(fact: DataFrame) -> DataFrame:
    """One row: businesses, mean daily sales, employees, mean age."""
    return fact.agg(
        F.count(F.lit(1)).alias("total_pymes"),
        exact_avg("ventas_promedio_diarias").alias("ventas_promedio"),
        F.sum("num_empleados").alias("total_empleados"),
        F.avg("antiguedad_negocio").alias("antiguedad_promedio"))


def cell_density_class(sales_cells: DataFrame) -> DataFrame:
    """Map cells with their opacity class (relative to the maximum mean
    sales over all rows, a one-row broadcast)."""
    vmax = sales_cells.agg(F.max("promedio_ventas").alias("__vmax"))
    return (sales_cells.crossJoin(F.broadcast(vmax))
            .withColumn("opacidad", density_class("promedio_ventas", "__vmax"))
            .drop("__vmax"))


def cell_boundaries(cells: DataFrame, cell_col: str = "h3_hex_id") -> DataFrame:
    """One row per (cell, corner 0..5) with the corner's lat / lon."""
    b = cells.select(col(cell_col), F.posexplode(hex_boundary(cell_col)).alias("corner", "p"))
    return b.select(col(cell_col), F.col("corner").cast("int").alias("corner"),
                    F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


SUMMARY_VIEWS = {"mv_ventas_por_giro_h3": sales_by_sector_cell,
                 "mv_deseos_rentabilidad": goal_profitability}


def run_survey_etl(spark, raw: DataFrame, out_dir: str, jdbc_url: str | None = None,
                   jdbc_options: dict | None = None, threshold: float = CATEGORY_THRESHOLD,
                   execute_sql=None) -> dict:
    """The survey ETL end to end.

    The flat table is always exported as CSV.  With ``jdbc_url`` the five
    star tables and the two summaries are then loaded into the database
    (tables replaced, the geography dimension named ``dim_geografia_h3``);
    without one, the star tables are exported as CSV and the summaries are
    materialized as Parquet tables under ``out_dir``.  In a database, what depends on base
    tables is dropped before they are replaced (``execute_sql`` runs the
    DROP statements there) and built after them; materialized tables are
    replaced in one step each and stay readable.  Every table is
    written by the executors in parallel.  Returns the written locations by
    table name.
    """
    from ..sources.sinks import materialize, reload_steps, write_csv, write_jdbc

    star = build_star(raw, threshold)
    base = out_dir.rstrip("/")
    out = {TABLE_NAMES["flat"]: write_csv(star.flat(), f"{base}/{TABLE_NAMES['flat']}")}
    tables = {TABLE_NAMES["dim_emprendedor"]: star.dim_emprendedor,
              TABLE_NAMES["dim_geografia"]: star.dim_geografia,
              TABLE_NAMES["dim_negocio"]: star.dim_negocio,
              TABLE_NAMES["dim_deseo"]: star.dim_deseo,
              TABLE_NAMES["fact"]: star.fact()}
    summaries = {name: build(star) for name, build in SUMMARY_VIEWS.items()}
    for step, name, df in reload_steps(tables, summaries):
        if jdbc_url and step == "drop":
            if execute_sql is not None:
                execute_sql(f"DROP TABLE IF EXISTS {name}")
        elif jdbc_url:
            write_jdbc(df, jdbc_url, name, **(jdbc_options or {}))
            out[name] = f"{jdbc_url}#{name}"
        elif step == "drop":
            continue
        elif step == "table":
            out[name] = write_csv(df, f"{base}/{name}")
        else:
            materialize(spark, df, name, f"{base}/{name}")
            out[name] = f"{base}/{name}"
    return out


def sme_dashboard(star: Star) -> dict[str, DataFrame]:
    """Every figure of the survey dashboard as lazy frames: KPIs, map cells
    (summary rows with opacity class and cell polygons), sector summary,
    goal profitability."""
    cells = cell_density_class(sales_by_sector_cell(star))
    return {"kpis": sme_kpis(star.fact()), "map_cells": cells,
            "map_polygons": cell_boundaries(cells.select("h3_hex_id").distinct()),
            "sectors": sector_summary(star), "goals": goal_profitability(star)}
