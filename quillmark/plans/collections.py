"""Registered queries of vector collections and datasets of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.plans.queries import SQL, _r, _t, query
from quillmark.sources.collection import Collection, listing, take_in
from quillmark.sources.shared import shared_folder


@query(
    "s24_collection",
    """WITH c AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CASE WHEN vec_id % 10 = 0 THEN -x ELSE x END) AS v FROM embeddings WHERE label <> 3 OR label IS NULL),
q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, id, round(list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(e AS DOUBLE[])), 12) AS score FROM c, q WHERE label IN (1, 2, 5))
SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s) WHERE rank <= 10""",
)
def s24(spark, d):
    """A collection filled in two batches, the second over the first, deleted from by filter and searched by filter."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("int").alias("label"))
    c = Collection(spark, f"{shared_folder(spark)}/vectors", 64, "label int").ensure()
    c.insert(e)
    c.insert(e.where("id % 10 = 0").withColumn("vector", F.transform("vector", lambda x: -x)))
    c.delete(F.col("label") == 3)
    return c.search(e.where("id % 20 = 0"), 10, F.col("label").isin(1, 2, 5)).select("query_id", "rank", "id", _r("score").alias("score"))


_PARSED = f"(SELECT d.lang AS dataset, d.doc_id AS document_id, CASE WHEN n > 0 THEN 'parsed' ELSE 'empty' END AS state, coalesce(n, 0)::BIGINT AS chunks FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({SQL['h02_fixed_chunks']}) GROUP BY doc_id) USING (doc_id))"


@query("s25_datasets", f"SELECT dataset, state, count(*) AS documents, sum(chunks)::BIGINT AS chunks FROM {_PARSED} GROUP BY ALL")
def s25(spark, d):
    """Texts taken into a dataset a language and parsed."""
    state, _ = take_in(_t(spark, d, "documents"), "lang", "doc_id", "text")
    return state.groupBy("dataset", "state").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"))


@query("s26_paged_listing", f"SELECT dataset, document_id, state, chunks, place, total FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY chunks DESC, document_id)::INTEGER AS place, count(*) OVER (PARTITION BY dataset) AS total FROM {_PARSED} WHERE dataset IS NOT NULL) WHERE place BETWEEN 31 AND 60")
def s26(spark, d):
    """The second page of each dataset's documents."""
    state, _ = take_in(_t(spark, d, "documents"), "lang", "doc_id", "text")
    return listing(state.where("dataset is not null"), ["dataset"], [F.desc("chunks"), F.col("document_id")], 2, 30).select("dataset", "document_id", "state", "chunks", "place", "total")
