"""Reading the tables, intermediate tables in the shared folder, and their removal."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: An Arrow batch that goes to Python holds about so many bytes, or a single longer row.
BATCH_BYTES = 8 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's own setting: shuffle files go when the query that made them ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local = threading.local()


def _scopes() -> list[list[str]]:
    """The open scopes of this thread, innermost last."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


def modest(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_BYTES, so long texts don't add up in a worker."""
    held = spark.conf.get(_ARROW_BYTES, None)
    if not (held and held.isdigit() and int(held) <= BATCH_BYTES):
        spark.conf.set(_ARROW_BYTES, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, outer: bool = False) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which every executor sees; it goes when its
    ``scope`` (the one around that, if ``outer``) ends, and at the latest with the driver's JVM.

    Only a local session may do without that setting (tests on one machine): there it lies beside the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    path = f"{base.rstrip('/')}/qm-{uuid.uuid4().hex}"
    p, fs = _hadoop(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    if len(_scopes()) > outer:
        _scopes()[-1 - outer].append(path)
    return path


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind: the table written is what later steps read."""
    was = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, was)


def settle(df: DataFrame, outer: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, on files that
    outlive any executor."""
    spark = df.sparkSession
    modest(spark)
    path = shared_dir(spark, outer) + "/t"
    with _tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def settle_buckets(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``settle`` in hash buckets of a column: a join on it moves the other side only."""
    spark = df.sparkSession
    modest(spark)
    path, name = shared_dir(spark) + "/t", f"qm_{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files are the folder's, the plan has them
    return out


def discard(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Discards what is settled inside when it ends, so only what was written elsewhere by then
    stays.  Without a scope, tables stay until the driver's JVM ends, for results are lazy."""
    _scopes().append([])
    try:
        yield
    finally:
        for path in _scopes().pop():
            discard(spark, path)
