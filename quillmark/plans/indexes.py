"""Registered queries of the stored indexes: words and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import textindex, vectorindex
from quillmark.operators.retrieval import CONTENT_B, CONTENT_WEIGHT, K1, TITLE_B, TITLE_WEIGHT
from quillmark.plans.queries import KEYWORDS, _bm25_sql, _r, _t, query

WORDS = ["the", "of", "und", "src3"]
_RUN = r"[\p{L}\p{N}_]+"


def _index(spark, d):
    return textindex.build(_t(spark, d, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text")


def _words_sql(words: list[str], k: int) -> str:
    n = range(len(words))
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS t{i}, len(list_filter(c, lambda x: x = '{w}')) AS c{i}" for i, w in enumerate(words))
    df = ", ".join(f"greatest(count(*) FILTER (t{i} > 0), count(*) FILTER (c{i} > 0)) AS d{i}" for i in n)
    w = lambda i: f"({TITLE_WEIGHT} * t{i} / (1 - {TITLE_B} + {TITLE_B} * lt / avt) + {CONTENT_WEIGHT} * c{i} / (1 - {CONTENT_B} + {CONTENT_B} * lc / avc))"
    raw = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * {K1 + 1} * {w(i)} / ({K1} + {w(i)})" for i in n)
    return f"""WITH b0 AS (SELECT doc_id, lower(coalesce(source, '')) AS lt0, lower(coalesce(text, '')) AS lc0 FROM documents),
b1 AS (SELECT doc_id, len(lt0) AS lt, len(lc0) AS lc, regexp_extract_all(lt0, '{_RUN}') AS t, regexp_extract_all(lc0, '{_RUN}') AS c FROM b0),
b2 AS (SELECT doc_id, lt, lc, {counts} FROM b1), b3 AS (SELECT count(*) AS n, avg(lt) AS avt, avg(lc) AS avc, {df} FROM b2),
b4 AS (SELECT doc_id, {raw} AS raw FROM b2, b3)
SELECT doc_id, round(raw, 6) AS raw, round(tanh(raw / 5), 6) AS score FROM b4 WHERE raw > 0.01 ORDER BY b4.raw DESC, doc_id LIMIT {k}"""


@query("i01_index_words", _words_sql(WORDS, 50))
def i01(spark, d):
    """The best documents by whole words, from the words' folders of an index over all documents."""
    return textindex.search(_index(spark, d), WORDS, 50).select("doc_id", _r("raw").alias("raw"), _r("score").alias("score"))


@query("i02_index_pieces", f"WITH {_bm25_sql()} SELECT doc_id, round(raw, 6) AS raw FROM bm ORDER BY raw DESC, doc_id LIMIT 50")
def i02(spark, d):
    """The rows of k01, by the vocabulary's terms that hold the pieces."""
    return textindex.search_contains(_index(spark, d), KEYWORDS, 50).select("doc_id", _r("raw").alias("raw"))


@query(
    "i03_vocabulary",
    f"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(source, '')), '{_RUN}'))) AS term, 1 AS f FROM documents
UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{_RUN}'))), 2 FROM documents)
SELECT term, count(*) FILTER (f = 1) AS in_title, count(*) FILTER (f = 2) AS in_content, count(DISTINCT doc_id) AS docs FROM w GROUP BY term""",
)
def i03(spark, d):
    """Document frequencies of every term."""
    return _index(spark, d).vocabulary.select("term", "in_title", "in_content", "docs")


@query(
    "i04_vector_index",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 12) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s)
SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 30""",
)
def i04(spark, d):
    """The 30 nearest of every vector whose id is divisible by 20, cells visited until none can hold a better one."""
    e = _t(spark, d, "embeddings")
    return vectorindex.search(vectorindex.build(e), e.where("vec_id % 20 = 0"), 30).select("query_id", "rank", "id", _r("score").alias("score"))


@query("i05_vector_probes")
def i05(spark, d):
    """The same by as few cells as find 97 % for a sample: not exact, its recall is measured in the tests."""
    e = _t(spark, d, "embeddings")
    index = vectorindex.build(e)
    return vectorindex.search(index, e.where("vec_id % 20 = 0"), 30, probes=vectorindex.calibrate(index, 30)).select("query_id", "rank", "id", F.round("score", 6).alias("score"))
