"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Plans here are built from thousands of column calls; recording a call site for each doubles the time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.dataFrameQueryContext.enabled": "false",
}

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_fallback: dict[str, str] = {}
_run_roots: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A session for tests and local runs; on a cluster the submitter owns these settings."""
    builder = (
        SparkSession.builder.master(master)
        .appName("equiscan")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    for key, value in {**SESSION_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) does a local temporary folder stand in for it.
    """
    configured = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(_CHECKPOINT_DIR)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {_CHECKPOINT_DIR} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_fallback:
        _local_fallback[app] = tempfile.mkdtemp(prefix="equiscan-")
    return _local_fallback[app]


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, where neither their path nor the working folder has it."""
    root = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _shipped or root in map(Path, [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]):
        return
    _shipped.add(app)
    archive = Path(tempfile.mkdtemp(prefix="equiscan-package-")) / "equiscan.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(Path(__file__).parent.rglob("*.py")):
            out.write(source, str(source.relative_to(root)))
    spark.sparkContext.addPyFile(str(archive))  # the driver hands it to every executor


def run_root(spark: SparkSession) -> str:
    """One folder per application below :func:`shared_dir`, so runs never meet."""
    ship_package(spark)
    app = spark.sparkContext.applicationId
    if app not in _run_roots:
        _run_roots[app] = f"{shared_dir(spark)}/equiscan-{app}-{uuid.uuid4().hex[:8]}"
        _remove_at_end(spark, _run_roots[app])
    return _run_roots[app]


def _remove_at_end(spark: SparkSession, folder: str) -> None:
    """The file system removes the folder when the driver ends, so a run leaves no copies behind."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{run_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession, times: int = 1) -> None:
    """After a large stage was written down: shuffle files go when the driver's JVM finds that nothing refers to them.

    Those of the job that has just ended are often found by a second look only.
    """
    for _ in range(times):
        gc.collect()
        spark._jvm.System.gc()


@contextmanager
def staged_while(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """:func:`staged` for the length of a block; the copy is removed at its end."""
    spark, path = df.sparkSession, f"{run_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, compression="zstd")
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only for a side counted to have at most ``rows`` rows; beyond that the planner shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
