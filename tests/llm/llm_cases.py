"""Helpers of the corpus operator tests (the session fixture is the suite's)."""

import pytest

SF_SMALL = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


@pytest.fixture(scope="session")
def small_docs():
    """The documents of the smallest table, as plain Python rows."""
    import duckdb
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF_SMALL}/documents.parquet' ORDER BY 1").fetchall()
