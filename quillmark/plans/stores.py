"""Registered queries of stored chunk tables and of many patterns in many texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators.manypatterns import contained
from quillmark.plans.queries import _t, query
from quillmark.sources.chunkstore import ChunkStore
from quillmark.sources.shared import shared_folder

_CHUNKS = "chunk_id bigint, source string, size bigint, quality int"


def _store(spark, d):
    """A table of chunks from ``documents``, changed by batches from ``labels``."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.length("text").cast("bigint").alias("size"), F.lit(None).cast("int").alias("quality"))
    store = ChunkStore(spark, f"{shared_folder(spark)}/chunks", _CHUNKS, ["chunk_id"], 16)
    store.upsert(docs)
    return store, docs


@query(
    "m05_store_upsert",
    """SELECT doc_id AS chunk_id, source, len(text)::BIGINT AS size, quality FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT -doc_id - 1, 'new', toxic::BIGINT, quality FROM labels WHERE toxic = 1""",
)
def m05(spark, d):
    """Two batches over a stored table: labelled rows replaced, new rows added; each batch is applied twice."""
    store, docs = _store(spark, d)
    labels = _t(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.col("quality").cast("int").alias("q"), "toxic")
    first = docs.join(labels, "chunk_id").select("chunk_id", "source", "size", F.col("q").alias("quality"))
    second = labels.where("toxic = 1").select((-F.col("chunk_id") - 1).alias("chunk_id"), F.lit("new").alias("source"), F.col("toxic").cast("bigint").alias("size"), F.col("q").alias("quality"))
    for batch in (first, second, first, second):
        store.upsert(batch)
    return store.read()


@query("m06_store_delete", "SELECT doc_id AS chunk_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def m06(spark, d):
    """Rows of toxic documents leave the stored table."""
    store, _ = _store(spark, d)
    store.delete(_t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id")))
    return store.read().select("chunk_id", "source")


@query(
    "m07_store_rebuild",
    """SELECT doc_id AS chunk_id, source, len(text)::BIGINT AS size FROM documents WHERE source IS NULL OR source NOT IN ('src1', 'src2')
UNION ALL SELECT -1, 'src1', count(*) FROM documents WHERE source = 'src1' HAVING count(*) > 0 UNION ALL SELECT -2, 'src2', count(*) FROM documents WHERE source = 'src2' HAVING count(*) > 0""",
)
def m07(spark, d):
    """All chunks of two owners give way to what was built anew for them."""
    store, docs = _store(spark, d)
    made = docs.where("source IN ('src1', 'src2')").groupBy("source").agg(F.count("*").alias("size"))
    store.rebuild(made.select(F.when(F.col("source") == "src1", -1).otherwise(-2).cast("bigint").alias("chunk_id"), "source", "size", F.lit(None).cast("int").alias("quality")), "source")
    return store.read().select("chunk_id", "source", "size")


@query(
    "z40_many_patterns",
    """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT doc_id, word, ((len(t) - len(replace(t, word, ''))) / len(word))::BIGINT AS n FROM (SELECT doc_id, lower(text) AS t FROM documents), w WHERE word <> '' AND contains(t, word)""",
)
def z40(spark, d):
    """Every word of part names in every document, by one automaton."""
    words = _t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return contained(_t(spark, d, "documents").select("doc_id", F.lower("text").alias("t")), "t", words, "word").select("doc_id", "word", "n")


@query(
    "z41_names_in_texts",
    """SELECT item_id, doc_id FROM (SELECT item_id, lower(text) AS x FROM benchmark WHERE text IS NOT NULL), (SELECT doc_id, lower(text) AS t FROM documents) WHERE contains(t, x)""",
)
def z41(spark, d):
    """Documents that hold a benchmark text letter by letter."""
    items = _t(spark, d, "benchmark").select("item_id", F.lower("text").alias("x"))
    held = contained(_t(spark, d, "documents").select("doc_id", F.lower("text").alias("t")), "t", items, "x").select("doc_id", "x")
    return held.join(items, "x").select("item_id", "doc_id")
