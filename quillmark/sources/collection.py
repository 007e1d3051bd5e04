"""A collection of vectors with their fields, as a vector store keeps one: ensured, filled in batches, indexed, searched by
filter, deleted from by filter; and datasets of texts that are taken in, parsed and listed a page at a time.

Vectors lie in a stored table that is changed a bucket at a time (``ChunkStore``), so batches and deletions may be
repeated.  ``index`` builds the cells anew over what is stored; a search reads the cells of its
questions and, of these, the rows that its filter lets pass.

Defined cases: a collection that exists with another dimension is an error; vectors of another size are refused before
anything is written; null vectors are kept and never found; an empty collection finds nothing."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.operators import chunking, vectorindex
from quillmark.sources.chunkstore import ChunkStore
from quillmark.sources.shared import hadoop_path, settle


class Collection:
    def __init__(self, spark: SparkSession, path: str, dim: int, fields: str = "", buckets: int = 16):
        """``fields`` is the DDL of what stands beside ``id`` and ``vector``."""
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim
        self.schema = "id bigint, vector array<float>" + (f", {fields}" if fields else "")
        self.store = ChunkStore(spark, f"{self.path}/rows", self.schema, ["id"], buckets)
        self.cells: vectorindex.VectorIndex | None = None

    def ensure(self) -> "Collection":
        """The collection is there afterwards; twice is once."""
        note = f"{self.path}/collection.json"
        p, fs = hadoop_path(self.spark, note)
        if fs.exists(p):
            held = json.loads(self.spark.read.text(note, wholetext=True).first()[0])
            if held["dim"] != self.dim:
                raise ValueError(f"the collection holds vectors of {held['dim']}")
        else:
            out = fs.create(p, True)
            out.write(bytearray(json.dumps({"dim": self.dim, "fields": self.schema}).encode()))
            out.close()
        return self

    def insert(self, batch: DataFrame) -> None:
        """Rows of the batch, in place of those of their ids."""
        batch = settle(batch.select(*self.columns()))
        if not batch.where(F.col("vector").isNotNull() & (F.size("vector") != self.dim)).isEmpty():
            raise ValueError(f"vectors must have {self.dim} components")
        self.store.upsert(batch)
        self.cells = None

    def columns(self) -> list[str]:
        return [c.strip().split()[0] for c in self.schema.split(", ")]

    def delete(self, where: Column) -> None:
        self.store.delete(self.store.read().where(where))
        self.cells = None

    def rows(self) -> DataFrame:
        return self.store.read()

    def index(self, cells: int = 16) -> None:
        self.cells = vectorindex.build(self.rows(), "id", "vector", cells, self.dim)

    def search(self, questions: DataFrame, k: int, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """query_id, rank, id, score of the ``k`` nearest rows that pass, for questions (id, vector)."""
        if self.rows().isEmpty():
            return self.spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
        if self.cells is None:
            self.index()
        index = self.cells
        if where is not None:
            passed = self.rows().where(where).select("id")
            index = vectorindex.VectorIndex(index.cells.join(passed, "id", "left_semi"), index.centroids, index.widest)
        return vectorindex.search(index, questions, k, probes, "id", "vector")


def take_in(docs: DataFrame, dataset: str, id_col: str, text: str, strategy: str = "FIX_SIZE") -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of datasets: every document with its state (parsed, or empty if it has no text) and number of
    chunks, and the chunks with their dataset."""
    rows = docs.select(F.col(dataset).alias("dataset"), F.col(id_col).alias("document_id"), F.col(text).alias("text"))
    chunks = settle(chunking.chunk(rows, "document_id", "text", strategy).join(rows.select("document_id", "dataset"), "document_id"))
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    state = rows.join(counts, "document_id", "left").select("dataset", "document_id", F.when(F.col("chunks") > 0, "parsed").otherwise("empty").alias("state"), F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"))
    return state, chunks


def listing(rows: DataFrame, group: list[str], order: list[Column], page: int, size: int) -> DataFrame:
    """A page (from 1) of each group's rows in order, with ``total``, how many rows the group has, and ``place``.

    Totals are counted apart, so a group's rows are numbered in order and none beyond the page goes on."""
    w = Window.partitionBy(*group).orderBy(*order)
    some = rows.withColumn("place", F.row_number().over(w)).where((F.col("place") > (page - 1) * size) & (F.col("place") <= page * size))
    return some.join(rows.groupBy(*group).agg(F.count("*").alias("total")), group)
