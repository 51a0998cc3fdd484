"""Sources and sinks: files, catalog, derived test views."""

from .files import (  # noqa: F401
    NA_TOKENS, read_csv_text, tolerant_types, read_csv_tolerant, na_to_null, read_csv_na,
    load_parquet, read_sharded, read_glob_shards, SUFFIX_COLUMN,
)
from .sinks import (  # noqa: F401
    PARQUET_CODECS, check_codec, write_parquet, write_csv, export_tables, jdbc_options,
    write_jdbc, create_table_as, materialize, reload_steps, write_date_shards,
)
from .catalog import register, table, query, reused  # noqa: F401
