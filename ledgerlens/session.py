"""Session construction and shared scratch space.

Library code never creates its own session; it takes the caller's.  The
builder here is for tests, ``bench.py`` and command-line use.

Scratch space (lineage cuts, tables written by the queries) always lives under
the cluster's ``spark.checkpoint.dir``, so it is shared by all executors and
survives executor loss.  Only a ``local[...]`` master without that setting gets a
temporary folder of this machine; any other master without it is an error.

Scratch tables stay until released: :func:`scratch_scope` removes what was
written inside it, :func:`release` one table.  :func:`written_once` keeps one
written table per state of its input files.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings of sessions built here.  Library code does not depend on them
# (strict casts raise by themselves) and never changes a caller's session.
SESSION_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Scale knobs.  AQE coalesces small shuffle partitions, splits skewed join
# partitions and turns sort-merge joins into broadcast joins when the
# runtime size of one side proves small.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(master: str = "local[8]", app: str = "ledgerlens",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """A session for tests and benchmarks (the UI stays off)."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in {**SESSION_CONF, **SCALE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only where unset.

    Order: the directory already set on the SparkContext, then the
    ``spark.checkpoint.dir`` setting of the session, then (``local[...]``
    masters only) a fresh temporary folder of this machine.
    """
    try:
        sc = spark.sparkContext
    except Exception:           # a remote (Connect) session has no context
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        require_local(sc.master if sc is not None else "remote")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def require_local(master: str) -> None:
    """Only one process with one disk may do without a shared folder."""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"master {master!r}: set spark.checkpoint.dir to a folder that the driver "
                           "and all executors share")


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder; it stays
    until released (see :func:`release`, :func:`scratch_scope`)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        # the context appends its own uuid folder; write next to it
        root = os.path.dirname(ensure_checkpoint_dir(spark).rstrip("/"))
    path = f"{root.rstrip('/')}/ledgerlens/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def release(spark: SparkSession, path: str) -> bool:
    """Remove a scratch table; paths outside the scratch folders are refused."""
    if "/ledgerlens/" not in path:
        raise ValueError(f"not a scratch path: {path}")
    for key in [k for k, p in _written.items() if p == path]:
        del _written[key]
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Remove at the end whatever scratch tables were written inside.

    Use the results before the scope ends: lazy frames read those tables."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes.remove(paths)
        for path in paths:
            release(spark, path)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    return a fresh scan of it.

    One distributed columnar write; readers get column pruning, filter
    pushdown and row counts from the file footers.  A lost executor costs a
    re-read of the files, never a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


_written: dict[tuple, str] = {}


def input_state(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """A fingerprint of the files below ``paths``: names, sizes and times
    (file contents are not read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
             .select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h")))
    return tuple(files.agg(F.count("h"), F.sum("h")).first())


def written_once(spark: SparkSession, name: str, paths: Sequence[str], build: Callable[[], str]) -> str:
    """The path that ``build()`` wrote for the present state of the input
    files; built again only when they change."""
    key = (spark.sparkContext.applicationId, name, tuple(paths), input_state(spark, paths))
    if key not in _written:
        kept, _scopes[:] = list(_scopes), []          # it outlives any scope
        try:
            _written[key] = build()
        finally:
            _scopes[:] = kept
        for other in [k for k in _written if k[:3] == key[:3] and k != key]:
            del _written[other]
    return _written[key]


def still_written(path: str) -> bool:
    """Whether a path of :func:`written_once` is still the one in use."""
    return path in _written.values()
