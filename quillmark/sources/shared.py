"""Tables that a job writes for its own later steps, in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows, and characters of text, of a batch that a task gives on. A batch a document would cost more than its rows.
BATCH_ROWS, BATCH_CHARS = 10_000, 4 << 20
#: Bytes of an Arrow batch that goes to Python, if no single row is longer.
ARROW_BYTES = 8 << 20


def modest(spark: SparkSession) -> None:
    """Holds Arrow batches to ARROW_BYTES: rows alone would let long texts add up in a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)
    if not (held and held.isdigit() and int(held) <= ARROW_BYTES):
        spark.conf.set(name, str(ARROW_BYTES))


def row_batches(batches: Iterator[pa.RecordBatch], parse: Callable[..., Iterable[tuple]], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """What ``parse`` gives for the content of each row (id, content), behind the row's id: many small documents in one
    batch, a large one in several, and one content at a time in Python; a null content gives nothing."""
    held: list[list] = [[] for _ in names]
    size, own_kind = 0, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, [own_kind, *kinds])], names)

    for b in batches:
        own_kind = b.schema.field(0).type
        for own, data in zip(b.column(0), b.column(1)):
            if not data.is_valid:
                continue
            own = own.as_py()
            for row in parse(data.as_py()):
                for c, v in zip(held, (own, *row)):
                    c.append(v)
                    size += len(v) if isinstance(v, str) else 0
                if len(held[0]) >= BATCH_ROWS or size >= BATCH_CHARS:
                    yield made()
                    held, size = [[] for _ in names], 0
    if held[0]:
        yield made()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt evenly by its keys, before a step whose work is large beside its bytes: small files, and
    exchanges that are joined by their bytes, would leave that to a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def hadoop_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; it goes with the driver's JVM.

    Only a local session may do without that setting: there the folder lies beside the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    path = f"{base.rstrip('/')}/qm-{uuid.uuid4().hex}"
    p, fs = hadoop_path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def settle(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` written once and read back, so later steps start from files; partitioned folders are read with their column."""
    path = shared_folder(df.sparkSession) + "/t"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    kept = [f for f in df.schema.fields if f.name != partition_by] + [f for f in df.schema.fields if f.name == partition_by]
    return df.sparkSession.read.schema(type(df.schema)(kept)).parquet(path)
