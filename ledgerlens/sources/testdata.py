"""Input views derived from the driver's TPC-H-like tables.

The reference reads a card-transaction CSV, a survey CSV and warehouse
tables that are not available here; these views stand in for them and
are derived from ``/root/testdata/sf*/<table>.parquet`` by Spark, so
their size grows with the tables.  ``ledgerlens/oracle_sql.py`` holds the
same derivations in SQL for the independent DuckDB check; keep the two in
step.

Joins: nation (25 rows, fixed by the TPC-H schema) is broadcast; every
other join is left to the planner, which broadcasts by statistics only
below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles
(with AQE skew splitting).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSACTION_TABLES = ["lineitem", "orders", "customer", "nation", "part"]
SURVEY_TABLES = ["customer", "nation"]


def paths(sf_dir: str, names: list[str]) -> list[str]:
    return [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(*paths(sf_dir, [name]))


def _case_sql(k: str, m: int, values: list[str]) -> str:
    """``values[k % m]`` as an SQL CASE (m == len(values))."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {k} % {m} {whens} END"


def _case(k: Column, modulus: int, values: list[str]) -> Column:
    """``values[k % modulus]`` as a CASE chain (modulus == len(values))."""
    m = k % modulus
    expr = F.when(m == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        expr = expr.when(m == i, F.lit(v))
    return expr


# ------------------------------------------------------------ transactions
CHANNELS = {"A": "Chip", "N": "Swipe", "R": "Online Transaction"}
ONLINE = "Online Transaction"


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card transactions: one row per lineitem, in the raw CSV's shape.

    ``User`` = customer (null for every 97th), ``Year/Month/Day`` from the
    order date, ``Amount`` as currency text (``$68,423.46``), channel from
    the return flag, state = nation (null online), MCC from the part size,
    error = high discount, fraud = high tax (text, null on line 7).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")

    cust_n = cust.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    ord_c = orders.join(cust_n, F.col("o_custkey") == F.col("c_custkey"))
    # Customers join orders first, so lineitem-sized shuffles are two (order
    # key, part key); how each join runs is the planner's and AQE's choice.
    t = (li.join(ord_c, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(part, F.col("l_partkey") == F.col("p_partkey")))
    return _select_txn(t)


def _select_txn(t: DataFrame) -> DataFrame:
    return t.selectExpr(
        "CAST(CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE o_custkey END AS BIGINT) AS `User`",
        "l_linenumber AS `Card`",
        "year(o_orderdate) AS `Year`",
        "month(o_orderdate) AS `Month`",
        "dayofmonth(o_orderdate) AS `Day`",
        "concat('$', format_number(l_extendedprice, 2)) AS `Amount`",
        f"CASE l_returnflag WHEN 'A' THEN '{CHANNELS['A']}' WHEN 'N' THEN '{CHANNELS['N']}' "
        f"ELSE '{ONLINE}' END AS `Use Chip`",
        "c_name AS `Merchant City`",
        "CASE WHEN l_returnflag IN ('A', 'N') THEN n_name END AS `Merchant State`",
        "5000 + p_size % 12 AS `MCC`",
        "CASE WHEN l_discount >= 0.09D THEN 'Bad PIN' END AS `Errors?`",
        "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_tax >= 0.08D THEN 'YES' ELSE 'No' END "
        "AS `Is Fraud?`",
    )


# ------------------------------------------------------------------ survey
def sme_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small-business survey: one row per customer, in the raw CSV's shape.

    Numbers come from small moduli of the customer key; sales and employees
    are text with NA tokens, junk and a blank-padded NaN among them; opening hours are
    text with an unparseable ``08:30`` every 41st row; coordinates fall in
    a ~5 km square so cells hold several businesses; ``altaSAT`` and
    ``usaCredito`` have nulls (null-safe joins); the wish answer is the
    region code for 60 % of rows and the nation name (each ~1.6 %, so it
    collapses) otherwise.
    """
    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    t = cust.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    k = "c_custkey"
    return t.selectExpr(
        f"{k} AS id",
        f"18 + {k} % 60 AS edadEmprendedor",
        f"CASE WHEN {k} % 19 = 0 THEN NULL ELSE {_case_sql(k, 2, ['H', 'M'])} END AS sexoEmprendedor",
        f"CASE WHEN {k} % 31 = 0 THEN NULL WHEN {k} % 53 = 0 THEN 'Doctorado' ELSE "
        f"{_case_sql(k, 4, ['Primaria', 'Secundaria', 'Preparatoria', 'Licenciatura'])} END "
        "AS escolaridadEmprendedor",
        f"CASE WHEN {k} % 23 = 0 THEN NULL ELSE "
        f"{_case_sql(k, 3, ['Casado', 'Soltero', 'Union libre'])} END AS estadoCivil",
        f"CAST({k} % 4 AS STRING) AS dependientesEconomicos",
        f"{_case_sql(k, 3, ['Si', 'No', 'No'])} AS familiaAyuda",
        f"CASE WHEN {k} % 43 = 0 THEN 'NA' WHEN {k} % 59 = 0 THEN 'abc' WHEN {k} % 61 = 0 THEN ' NaN ' "
        f"WHEN {k} % 67 = 0 THEN '1d' ELSE CAST(c_acctbal + 0.006D AS STRING) END AS ventasPromedioDiarias",
        f"19.4D + ({k} * 37 % 1000) / 20000.0D AS latitud",
        f"-99.15D + ({k} * 91 % 1000) / 20000.0D AS longitud",
        f"CASE WHEN {k} % 41 = 0 THEN '08:30' ELSE CAST({k} % 24 AS STRING) END AS horaApertura",
        f"CAST({k} * 7 % 24 AS STRING) AS horaCierre",
        f"CASE WHEN {k} % 71 = 0 THEN 'null' ELSE concat(' ', CAST({k} % 12 AS STRING)) END AS numEmpleados",
        f"{k} % 30 AS antiguedadNegocio",
        "c_mktsegment AS giroNegocio",
        f"{_case_sql(k, 3, ['Cuaderno', 'Sistema', 'Ninguno'])} AS registroVentas",
        f"{_case_sql(k, 2, ['Si', 'No'])} AS registroContabilidad",
        f"CASE WHEN {k} % 5 = 0 THEN 'n/a' ELSE {_case_sql(k, 2, ['Si', 'No'])} END AS altaSAT",
        f"CASE WHEN {k} % 7 = 0 THEN NULL ELSE {_case_sql(k, 3, ['Si', 'No', 'No'])} END "
        "AS usaCredito",
        f"CASE WHEN {k} % 47 = 0 THEN '120 dias' ELSE "
        f"{_case_sql(k, 4, ['Contado', '30 dias', '60 dias', '90 dias'])} END "
        "AS tiempoCreditoProveedores",
        f"CASE WHEN {k} % 10 < 6 THEN concat('R', CAST(n_regionkey AS STRING)) ELSE n_name END "
        "AS `Respuesta Original`",
        "CAST(n_regionkey AS STRING) AS `Categoría`",
    )


# --------------------------------------------------------------- warehouse
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name counts by state: state = nation, name = segment_status,
    number = order total (exact money)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    t = (orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
         .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")))
    return t.select(
        F.col("n_name").alias("state"),
        F.concat(F.col("c_mktsegment"), F.lit("_"), F.col("o_orderstatus")).alias("name"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("number"))


COUNTRIES = ["Mexico", "Chile", "Peru"]


def ga_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web analytics events with a nested ``geo`` struct (country null for
    every 4th user) and the event day as ``event_date`` text."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    u = F.col("user_id")
    country = F.when(u % 4 == 0, F.lit(None).cast("string")).otherwise(_case(u, 3, COUNTRIES))
    return ev.select(
        "event_id", "ts",
        F.date_format("ts", "yyyyMMdd").alias("event_date"),
        F.col("event_type").alias("event_name"),
        F.struct(country.alias("country")).alias("geo"))


def taxi_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxi trips: one per lineitem, the supplier is the taxi."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    return li.select(
        F.col("l_suppkey").alias("taxi_id"),
        F.col("l_shipdate").alias("trip_start_timestamp"),
        F.col("l_quantity").alias("trip_miles"),
        F.col("l_extendedprice").alias("trip_total"))
