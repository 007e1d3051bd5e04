"""A stored table of chunks (or of their tags) that is changed in place, a bucket of keys at a time.

Rows lie in folders by a hash of their key.  A change reads the buckets that its keys fall in, works out their new rows,
writes those aside, and then puts them in place by dynamic partition overwrite: files of other buckets are neither
read nor written.  A change is repeatable: an upsert, a deletion or a rebuild done twice, or again after a write that
failed half-way, gives what doing it once gives.

One writer at a time.  Of rows of one key in a batch the last by ``order`` counts (without it any one).  Null keys are
keys like others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.sources.shared import hadoop_path, settle

BUCKET = "_bucket"


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 32):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def read(self) -> DataFrame:
        p, fs = hadoop_path(self.spark, self.path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.schema)
        return self._stored().drop(BUCKET)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)

    def touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in self._placed(keys.select(*self.keys)).select(BUCKET).distinct().collect())  # at most ``buckets``

    def _replace(self, rows: DataFrame, buckets: list[int]) -> None:
        """``rows`` become all there is in these buckets."""
        staged = settle(self._placed(rows).select(*[c for c in rows.columns if c != BUCKET], BUCKET), BUCKET)
        full = {r[0] for r in staged.select(BUCKET).distinct().collect()}
        dealt = staged.repartition(max(1, len(buckets)), BUCKET).sortWithinPartitions(BUCKET, *self.keys)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(BUCKET).parquet(self.path)
        for b in buckets:
            if b not in full:  # nothing is left there, so nothing was put over it
                p, fs = hadoop_path(self.spark, f"{self.path}/{BUCKET}={b}")
                fs.delete(p, True)

    def _old(self, buckets: list[int]) -> DataFrame:
        p, fs = hadoop_path(self.spark, self.path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.schema)
        return self._stored().where(F.col(BUCKET).isin(buckets)).drop(BUCKET)

    def _without(self, old: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
        gone = keys.select(*(F.col(c).alias(f"_{c}") for c in on)).distinct()
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
        return old.join(gone, same, "left_anti")

    def upsert(self, batch: DataFrame, order: str | None = None) -> list[int]:
        """Rows of the batch take the place of those of their keys; gives the buckets written."""
        columns = [c.split()[0] for c in self.schema.split(",")]
        w = Window.partitionBy(*self.keys).orderBy(F.col(order).desc() if order else F.lit(1))
        batch = settle(batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*columns))
        buckets = self.touched(batch)
        if buckets:
            self._replace(self._without(self._old(buckets), batch, self.keys).unionByName(batch), buckets)
        return buckets

    def delete(self, keys: DataFrame) -> list[int]:
        keys = settle(keys.select(*self.keys).distinct())
        buckets = self.touched(keys)
        if buckets:
            self._replace(self._without(self._old(buckets), keys, self.keys), buckets)
        return buckets

    def rebuild(self, batch: DataFrame, owner: str) -> list[int]:
        """The batch's rows in place of all rows of its owners (a document's chunks, a chunk's tags); where those lie
        is looked up first, by the owner's column alone."""
        columns = [c.split()[0] for c in self.schema.split(",")]
        batch = settle(batch.select(*columns))
        p, fs = hadoop_path(self.spark, self.path)
        owners = batch.select(F.col(owner).alias("_o")).distinct()
        there = self._stored().select(owner, BUCKET).join(owners, F.col(owner).eqNullSafe(F.col("_o")), "left_semi").select(BUCKET).distinct().collect() if fs.exists(p) else []
        buckets = sorted({r[0] for r in there} | set(self.touched(batch)))
        if buckets:
            old = self._old(buckets)
            self._replace(self._without(old, batch, [owner]).unionByName(batch), buckets)
        return buckets
