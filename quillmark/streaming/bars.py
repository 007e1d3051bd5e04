"""Price bars of a stream: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType

from quillmark.operators.market import bars


def stream_bars(stream: DataFrame, keys: list[str], ts: str, value: str, tie: str, width: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """Bars whose state goes when the watermark has passed them.  Times without a zone are taken in
    the session's, as a watermark needs instants, and bars come back without one."""
    local = isinstance(stream.schema[ts].dataType, TimestampNTZType)
    made = bars(stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late), keys, ts, value, tie, width)
    return made.withColumn("bar", F.col("bar").cast("timestamp_ntz")) if local else made


def run_available(spark: SparkSession, folder: str, schema: str, out: str, keys: list[str], ts: str, value: str, tie: str, width: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """Consume what ``folder`` holds, a file a trigger, and return the bars.

    A trigger writes only the bars that it changed, and state older than the watermark is dropped, so
    neither follows the length of the stream; readers take each bar's last version."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    made = stream_bars(stream, keys, ts, value, tie, width, late)

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{out}/bars/batch={batch}")  # a repeated batch replaces itself

    kind = StructType([*made.schema.fields, StructField("_batch", LongType())])
    spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{out}/bars/batch=none")  # so that a stream without files has a table
    q = made.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    kept = spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(f"{out}/bars")
    values = [c for c in made.columns if c not in (*keys, "bar")]
    return kept.groupBy(*keys, "bar").agg(F.max_by(F.struct(*values), "_batch").alias("x")).select(*keys, "bar", "x.*")


def project_push(stream: DataFrame, record: str) -> DataFrame:
    """Rows of push envelopes {type, data[]} of one type; ``record`` is the DDL of an entry."""
    e = F.from_json("value", f"struct<type:string,data:array<struct<{record}>>>")
    return stream.select(e.alias("e")).select(F.col("e.type").alias("type"), F.inline("e.data"))
