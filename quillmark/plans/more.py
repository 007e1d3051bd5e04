"""More registered queries: filters, lookups, ordered operators and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions import periods as P
from quillmark.functions import text as T
from quillmark.operators import retrieval, statements, valuation
from quillmark.plans.queries import _r, _t, query

_Q = "year(o_orderdate) || 'Q' || quarter(o_orderdate)"


def _quarter():
    return F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))


@query("f08_metadata_filter", "SELECT o_orderkey FROM orders WHERE upper(o_orderpriority) = '1-URGENT' AND year(o_orderdate) BETWEEN 1994 AND 1996")
def f08(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("form_type"), F.year("o_orderdate").alias("fiscal_year"))
    return retrieval.metadata_filter(o, form_type="1-urgent", years=(1994, 1996)).select("o_orderkey")


@query("f15_period_filter", f"SELECT o_orderkey, {_Q} AS period FROM orders WHERE (year(o_orderdate) = 1993 OR year(o_orderdate) BETWEEN 1995 AND 1996) AND quarter(o_orderdate) IN (1, 4)")
def f15(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", _quarter().alias("period"))
    return o.where(P.period_passes(F.col("period"), [1993, (1995, 1996)], ["Q1", "Q4"]))


@query("f16_metric_contains", "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'a') OR contains(lower(p_type), 'steel')")
def f16(spark, d):
    return _t(spark, d, "part").where(F.lower("p_type").contains("a") | F.lower("p_type").contains("steel")).select("p_partkey")


@query("j05_lookup_ids", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j05(spark, d):
    ids = _t(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    return _t(spark, d, "documents").select("doc_id", "source").join(ids, "doc_id", "left_semi")


@query(
    "j14_dictionary",
    """WITH m(o, t, code) AS (VALUES (1, 'brand#1', 'ONE'), (2, 'brand#2', 'TWO'), (3, 'brand', 'ANY')),
x AS (SELECT p_partkey, code, row_number() OVER (PARTITION BY p_partkey ORDER BY o) AS n FROM part JOIN m ON contains(lower(p_brand), t)) SELECT p_partkey, code FROM x WHERE n = 1""",
)
def j14(spark, d):
    # The dictionary is a constant of the plan: first match wins, as one CASE and no join.
    code = F.when(F.lower("p_brand").contains("brand#1"), "ONE").when(F.lower("p_brand").contains("brand#2"), "TWO").when(F.lower("p_brand").contains("brand"), "ANY")
    return _t(spark, d, "part").select("p_partkey", code.alias("code")).where("code is not null")


@query("j15_synonyms", "WITH g(t, m) AS (VALUES ('click', 'click'), ('click', 'view'), ('purchase', 'purchase'), ('purchase', 'signup'), ('signup', 'purchase'), ('signup', 'signup'), ('view', 'click'), ('view', 'view')) SELECT DISTINCT e.event_type AS term, coalesce(m, e.event_type) AS member FROM events e LEFT JOIN g ON g.t = e.event_type")
def j15(spark, d):
    terms = _t(spark, d, "events").select(F.col("event_type").alias("term")).distinct()
    return retrieval.expand_synonyms(terms, {"look": ["click", "view"], "buy": ["purchase", "signup"]})


@query("a21_mode", "WITH c AS (SELECT l_suppkey, l_linenumber AS q, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY l_suppkey) AS m FROM c) SELECT l_suppkey, min(q) AS q FROM m WHERE n = m GROUP BY l_suppkey")
def a21(spark, d):
    n = _t(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    return n.groupBy("l_suppkey").agg(F.max(F.struct("n", (-F.col("l_linenumber")).alias("k"))).alias("m")).select("l_suppkey", (-F.col("m.k")).alias("q"))


@query("u04_source_precedence", "WITH x AS (SELECT doc_id % 50 AS k, CASE WHEN lang = 'en' THEN 1 WHEN lang = 'de' THEN 2 ELSE 3 END AS p, doc_id FROM documents) SELECT k, p, doc_id FROM x WHERE p = (SELECT min(y.p) FROM x y WHERE y.k = x.k)")
def u04(spark, d):
    x = _t(spark, d, "documents").select((F.col("doc_id") % 50).alias("k"), F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).otherwise(3).alias("p"), "doc_id")
    return statements.first_source(x, ["k"], "p").select("k", "p", "doc_id")


@query("c01_unnest", "SELECT vec_id, count(*) AS n, round(sum(x), 4) AS s FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY vec_id")
def c01(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return e.groupBy("vec_id").agg(F.count("*").alias("n"), _r(F.sum("x"), 4).alias("s"))


@query("z01_best_candidate", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment <> 'BUILDING', c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n = 1")
def z01(spark, d):
    best = F.min_by("c_custkey", F.struct((F.col("c_mktsegment") != "BUILDING").alias("miss"), (-F.col("c_acctbal")).alias("b"), "c_custkey"))
    return _t(spark, d, "customer").groupBy("c_nationkey").agg(best.alias("c_custkey"))


@query("z09_first_nonzero", "SELECT l_orderkey, l_linenumber, round(coalesce(nullif(l_discount, 0), nullif(l_tax, 0), 0), 6) AS x FROM lineitem")
def z09(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r(F.coalesce(F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0)), F.lit(0.0))).alias("x"))


@query("z11_plug", "SELECT o_orderkey, round(o_totalprice - coalesce(s, 0), 2) AS plug FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def z11(spark, d):
    s = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").join(s, "o_orderkey", "left").select("o_orderkey", _r(valuation.plug(F.col("o_totalprice"), [F.col("s")]), 2).alias("plug"))


@query(
    "n24_compare_periods",
    "SELECT o_orderpriority, round(a - b, 2) AS diff, round((a / b - 1) * 100, 2) AS growth FROM (SELECT o_orderpriority, sum(o_totalprice) FILTER (year(o_orderdate) = 1996) AS a, sum(o_totalprice) FILTER (year(o_orderdate) = 1995) AS b FROM orders GROUP BY 1)",
)
def n24(spark, d):
    y = F.year("o_orderdate")
    x = _t(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum(F.when(y == 1996, F.col("o_totalprice"))).alias("a"), F.sum(F.when(y == 1995, F.col("o_totalprice"))).alias("b"))
    return x.select("o_orderpriority", _r(F.col("a") - F.col("b"), 2).alias("diff"), statements.growth(F.col("a"), F.col("b"), 2).alias("growth"))


@query("d16_sort_key", f"SELECT o_orderkey, CAST(year(o_orderdate) * 10 + CASE quarter(o_orderdate) WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 6 END AS INTEGER) AS k FROM orders")
def d16(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", P.statement_sort_key(_quarter()).alias("k"))


@query("w02_chunk_links", "SELECT conv_id, turn, lag(turn) OVER w AS prev, lead(turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w02(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _t(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("prev"), F.lead("turn").over(w).alias("next"))


@query(
    "w05_ladder",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 + 1 AS lv FROM lineitem),
p AS (SELECT a.l_orderkey, a.l_linenumber, max(b.l_linenumber) AS p FROM x a JOIN x b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber < a.l_linenumber AND b.lv = a.lv - 1 GROUP BY ALL),
s AS (SELECT a.l_orderkey, a.l_linenumber, max(b.l_linenumber) AS s FROM x a JOIN x b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber < a.l_linenumber AND b.lv < a.lv - 1 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN s IS NULL OR s < p THEN CAST(p AS VARCHAR) END AS parent FROM x LEFT JOIN p USING (l_orderkey, l_linenumber) LEFT JOIN s USING (l_orderkey, l_linenumber)""",
)
def w05(spark, d):
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3 + 1).alias("lv"), F.col("l_linenumber").cast("string").alias("name"))
    return statements.ladder_parent(x, ["l_orderkey"], "l_linenumber", "lv", "name").select("l_orderkey", "l_linenumber", "parent")


@query("x02_terms", "SELECT conv_id, turn, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS n FROM conversations WHERE text IS NOT NULL")
def x02(spark, d):
    return _t(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.size(T.base_terms(F.col("text"))).cast("bigint").alias("n"))


@query("x07_abbreviate", r"WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(CASE WHEN len(s) > 600 THEN s[1:597] || '...' ELSE s END) AS h FROM t")
def x07(spark, d):
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.abbreviate(F.col("text")).cast("binary")).alias("h"))


@query("n08_segment_margin", "SELECT c_mktsegment, round(sum(o_totalprice) FILTER (o_orderstatus = 'F') / sum(o_totalprice) * 100, 6) AS margin FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def n08(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    x = _t(spark, d, "orders").join(c, "o_custkey").groupBy("c_mktsegment").agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("a"), F.sum("o_totalprice").alias("b"))
    return x.select("c_mktsegment", _r(F.try_divide("a", "b") * 100).alias("margin"))


@query("n02_to_million", "SELECT o_orderkey, CAST(trunc(o_totalprice * 0.001 - 200) AS BIGINT) AS v FROM orders")
def n02(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", statements.to_million(F.col("o_totalprice") * 0.001 - 200, F.lit("million")).cast("bigint").alias("v"))


@query("z25_last_n", "WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM c) SELECT event_type, day, n FROM k WHERE k <= 12")
def z25(spark, d):
    x = _t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return statements.latest(x, ["event_type"], F.col("day"), 12)
