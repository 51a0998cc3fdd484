"""Tables that are replaced without a gap: versioned folders and one pointer.

``replace_table`` writes a new folder below the table's root and then points the
catalog at it in one statement (a persistent view over the folder).  A reader that
resolves the name sees the old version or the new one, never none and never a mix,
whatever the schemas.  A write that fails leaves the pointer and the old folder as they
were; its own folder is removed with the next replacement.

The last ``keep`` versions stay on disk, so readers that resolved the name before a
replacement finish on the files they planned.  ``versions`` lists them, ``point_to`` goes
back to one.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

VERSION = "ledgerlens.version"       # table property that holds the current folder
KEEP = 2


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, root: str) -> list[str]:
    """Folders of the table's versions, oldest first (complete or not)."""
    fs, target = _folder(spark, root)
    if not fs.exists(target):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    return [f"{root.rstrip('/')}/{n}" for n in sorted(names) if re.fullmatch(r"v-\d{20}-[0-9a-f]{8}", n)]


def current(spark: SparkSession, name: str) -> str | None:
    """Folder that ``name`` points to; None where it is no versioned table."""
    if not spark.catalog.tableExists(name):
        return None
    rows = spark.sql(f"SHOW TBLPROPERTIES {_quoted(name)}").collect()
    return next((r["value"] for r in rows if r["key"] == VERSION), None)


def point_to(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """Make ``folder`` the version that ``name`` shows: the one atomic step."""
    if spark.catalog.tableExists(name) and current(spark, name) is None:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")       # a plain table of older layout, once
    text, path = folder.replace("\\", "\\\\").replace("'", "\\'"), folder.replace("`", "``")
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(name)} TBLPROPERTIES ('{VERSION}' = '{text}') AS SELECT * FROM parquet.`{path}`")
    return spark.table(name)


def replace_table(spark: SparkSession, df: DataFrame, name: str, root: str,
                  compression: str = "zstd", keep: int = KEEP) -> DataFrame:
    """``CREATE OR REPLACE TABLE name AS`` the rows of ``df``, without a gap.

    ``df`` may read the table it replaces."""
    if keep < 1:
        raise ValueError("at least the current version is kept")
    before = versions(spark, root)
    shown = current(spark, name)
    folder = f"{root.rstrip('/')}/v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").option("compression", compression).parquet(folder)
    table = point_to(spark, name, folder)
    # what is older than the kept versions, and folders of writes that failed; the version shown until
    # now counts as the latest before this one
    whole = sorted((v for v in before if v == shown or _committed(spark, v)), key=lambda v: (v == shown, v))
    kept = {folder, *whole[max(0, len(whole) - (keep - 1)):]} if keep > 1 else {folder}
    for old in before:
        if old not in kept and old < folder:
            fs, target = _folder(spark, old)
            fs.delete(target, True)
    return table


def _committed(spark: SparkSession, folder: str) -> bool:
    fs, target = _folder(spark, f"{folder}/_SUCCESS")
    return fs.exists(target)


def drop_table(spark: SparkSession, name: str) -> None:
    """Forget a table or versioned table (files stay until the next replacement)."""
    if spark.catalog.tableExists(name):
        kind = "VIEW" if current(spark, name) is not None else "TABLE"
        spark.sql(f"DROP {kind} IF EXISTS {_quoted(name)}")
