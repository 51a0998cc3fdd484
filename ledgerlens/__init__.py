"""ledgerlens: card-transaction and small-business analytics on Spark.

Three independent pieces, all written as DataFrame / Spark SQL plans:

* ``plans.cube``      – tolerant CSV scan -> cleaned transactions -> six-key
                        transaction cube in Parquet, plus the dashboard queries
                        that slice it.
* ``plans.star``      – survey cleaning (NA tokens, lenient hours, rare-category
                        collapse, hexagonal cells) -> star schema with surrogate
                        keys, a flat table, materialized summaries.
* ``plans.warehouse`` – five warehouse SQL patterns (top-k, CTE + full outer
                        join, date-sharded wildcard scan, CTAS, monthly growth
                        with window functions).

Building blocks live in ``functions`` (Column -> Column), ``operators``
(DataFrame -> DataFrame), ``sources`` (readers, writers, catalog).
"""

__version__ = "0.1.0"
