"""Registered queries of the wider inventory: statistics, maps, periods, filters, joins, ranks, models and scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions import periods as P
from quillmark.functions import text as T
from quillmark.operators import market, modelling, retrieval, statements, valuation
from quillmark.plans.more import _Q, _quarter
from quillmark.plans.queries import _COS, _COUNT, KEYWORDS, _bm25, _bm25_sql, _r, _t, _tags, query

# --- aggregates ------------------------------------------------------------------------------

_HITS = ", ".join(f"CASE WHEN {_COUNT.format(x=x, k=k, n=len(k))} > 0 THEN 1 ELSE 0 END AS {x}{i}" for i, k in enumerate(KEYWORDS) for x in "tc")


@query(
    "a03_document_frequency",
    f"WITH b AS (SELECT lower(coalesce(source, '')) AS t, lower(coalesce(text, '')) AS c FROM documents), h AS (SELECT {_HITS} FROM b) "
    + " UNION ALL ".join(f"SELECT '{k}' AS term, CAST(sum(t{i}) AS BIGINT) AS title_df, CAST(sum(c{i}) AS BIGINT) AS content_df, CAST(greatest(sum(t{i}), sum(c{i})) AS BIGINT) AS df FROM h" for i, k in enumerate(KEYWORDS)),
)
def a03(spark, d):
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    docs = _t(spark, d, "documents").select(low("source").alias("t"), low("text").alias("c"))
    hits = F.explode(F.array(*(F.struct(F.lit(k).alias("term"), F.col("t").contains(k).cast("bigint").alias("t"), F.col("c").contains(k).cast("bigint").alias("c")) for k in KEYWORDS)))
    return docs.select(hits.alias("x")).groupBy("x.term").agg(F.sum("x.t").alias("title_df"), F.sum("x.c").alias("content_df"), F.greatest(F.sum("x.t"), F.sum("x.c")).alias("df"))


@query("a04_average_lengths", "SELECT round(avg(length(coalesce(source, ''))), 6) AS title_chars, round(avg(length(coalesce(text, ''))), 6) AS content_chars FROM documents WHERE lang IN ('en', 'de')")
def a04(spark, d):
    docs = _t(spark, d, "documents").where(F.col("lang").isin("en", "de"))
    return docs.agg(*(_r(F.avg(F.length(F.coalesce(F.col(c), F.lit(""))))).alias(n) for c, n in (("source", "title_chars"), ("text", "content_chars"))))


@query("a06_score_gate", f"WITH {_bm25_sql()} SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0.3")
def a06(spark, d):
    return _bm25(spark, d).where("score > 0.3").select("doc_id", _r("score").alias("score"))


@query("a08_cosine", f"WITH {_COS} SELECT vec_id, round(score, 6) AS score FROM vs WHERE vs.score >= 0.1")
def a08(spark, d):
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    # One row, by the key of the query vector.
    scored = e.crossJoin(F.broadcast(q)).select("vec_id", retrieval.cosine(F.col("embedding"), F.col("q")).alias("s")).where("s >= 0.1")
    return scored.select("vec_id", _r("s").alias("score"))


@query(
    "a09_fill_children",
    """WITH c AS (SELECT c_nationkey AS k, round(sum(c_acctbal), 2) AS v FROM customer GROUP BY 1),
n AS (SELECT n_nationkey AS k, n_regionkey AS r, CASE WHEN n_nationkey % 2 = 1 THEN 100.0 ELSE c.v END AS v FROM nation LEFT JOIN c ON c.k = n_nationkey)
SELECT 'r' || r AS code, round(sum(v), 2) AS value FROM n GROUP BY r UNION ALL SELECT 'n' || k, round(v, 2) FROM n""",
)
def a09(spark, d):
    cast = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    row = lambda df, parent, code, level, value: df.select(parent.alias("parent"), code.alias("code"), F.lit(level).alias("level"), F.lit("m").alias("metric"), F.lit("p").alias("period"), value.alias("value"))
    null = F.lit(None).cast("double")
    leaf = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    nodes = row(_t(spark, d, "region"), F.lit(None).cast("string"), cast("r", "r_regionkey"), 1, null)
    nodes = nodes.unionByName(row(_t(spark, d, "nation"), cast("r", "n_regionkey"), cast("n", "n_nationkey"), 2, F.when(F.col("n_nationkey") % 2 == 1, 100.0)))
    nodes = nodes.unionByName(row(leaf, cast("n", "c_nationkey"), cast("c", "c_nationkey"), 3, F.col("v")))
    return statements.fill_from_children(nodes).where("level < 3").select("code", F.round("value", 2).alias("value"))


@query("a15_spread", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS spread, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def a15(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(_r(F.stddev_pop("l_quantity")).alias("spread"), _r(F.avg("l_quantity")).alias("mean"))


@query("a16_capex", "SELECT l_orderkey, round(coalesce(sum(abs(l_tax)) FILTER (l_linenumber IN (2, 3)), sum(abs(l_tax)) FILTER (l_linenumber = 1)), 6) AS capex FROM lineitem GROUP BY 1")
def a16(spark, d):
    part = lambda *k: F.sum(F.when(F.col("l_linenumber").isin(*k), F.abs("l_tax")))
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(_r(F.coalesce(part(2, 3), part(1))).alias("capex"))


@query("a18_report_counts", "SELECT source, count(*) AS docs, count(*) FILTER (coalesce(trim(text), '') = '') AS empty, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def a18(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"), F.countDistinct("lang").alias("langs"))


@query(
    "a19_first_match",
    """WITH s AS (SELECT user_id, sum(value) FILTER (event_type = 'purchase') AS p, sum(value) FILTER (event_type = 'signup') AS s, sum(value) FILTER (event_type = 'view') AS v, sum(value) FILTER (event_type IN ('purchase', 'signup', 'view')) AS a FROM events GROUP BY 1)
SELECT user_id, round(coalesce(p, s, 0) + coalesce(v, 0), 4) AS first_match, round(coalesce(a, 0), 4) AS all_match FROM s""",
)
def a19(spark, d):
    out = statements.first_match_sum(_t(spark, d, "events"), ["user_id"], [["purchase", "signup"], ["view"]], "event_type", "value")
    return out.select("user_id", _r("first_match", 4).alias("first_match"), _r("all_match", 4).alias("all_match"))


@query("a20_confidence", "SELECT l_orderkey, l_linenumber, 80 - CASE WHEN l_returnflag = 'R' THEN 5 ELSE 0 END + CASE WHEN l_tax > 0.04 THEN 5 ELSE 0 END + 5 AS confidence FROM lineitem")
def a20(spark, d):
    unit = F.when(F.col("l_tax") > 0.04, "million")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", statements.confidence(F.col("l_returnflag") == "R", unit, F.lit("USD")).alias("confidence"))


# --- nested data -----------------------------------------------------------------------------


@query("c02_flatten_tags", "SELECT doc_id, 'lang' AS tag_key, lang AS tag_value FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'source', source FROM documents WHERE source IS NOT NULL")
def c02(spark, d):
    tags = _tags(spark, d)
    return retrieval.flatten_tags(retrieval.attach_tags(tags.select("doc_id").distinct(), tags, ["doc_id"]), ["doc_id"])


@query("c04_merge_tags", "SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN 'q' || quality ELSE source END AS source, lang FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def c04(spark, d):
    own = F.map_filter(F.create_map(F.lit("source"), "source", F.lit("lang"), "lang"), lambda _, v: v.isNotNull())
    label = _t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    over = F.when(F.col("q").isNotNull(), F.create_map(F.lit("source"), F.concat(F.lit("q"), F.col("q").cast("string"))))
    m = _t(spark, d, "documents").join(label, "doc_id", "left").select("doc_id", retrieval.merge_maps(own, over).alias("m"))
    return m.select("doc_id", F.col("m")["source"].alias("source"), F.col("m")["lang"].alias("lang"))


@query("c07_tree_rows", "SELECT r_name AS parent, n_name AS name, 2 AS level FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT NULL, r_name, 1 FROM region")
def c07(spark, d):
    tree = _t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list("n_name").alias("kids")).join(_t(spark, d, "region"), "r_regionkey", "right")
    none = F.array(F.struct(F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.lit(1).alias("level")))
    rows = F.concat(none, F.transform(F.coalesce("kids", F.array().cast("array<string>")), lambda k: F.struct(F.col("r_name").alias("parent"), k.alias("name"), F.lit(2).alias("level"))))
    return tree.select(F.explode(rows).alias("x")).select("x.*")


@query("c09_vector_literal", "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)), ',') || ']' AS literal FROM embeddings")
def c09(spark, d):
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("bigint").cast("string"))
    return _t(spark, d, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(whole, ","), F.lit("]")).alias("literal"))


# --- periods ---------------------------------------------------------------------------------


@query(
    "d03_previous",
    """SELECT o_orderkey, CASE WHEN quarter(o_orderdate) = 1 THEN (year(o_orderdate) - 1) || 'Q4' ELSE year(o_orderdate) || 'Q' || (quarter(o_orderdate) - 1) END AS previous,
(year(o_orderdate) - 1) || 'Q' || quarter(o_orderdate) AS year_ago FROM orders""",
)
def d03(spark, d):
    fy, kind = F.year("o_orderdate"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    return _t(spark, d, "orders").select("o_orderkey", P.previous(fy, kind).alias("previous"), P.year_ago(fy, kind).alias("year_ago"))


@query("d08_fiscal_year", "SELECT o_orderkey, CASE WHEN month(o_orderdate) <= 6 THEN year(o_orderdate) ELSE year(o_orderdate) + 1 END AS fy FROM orders")
def d08(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", P.fiscal_year(F.year("o_orderdate"), F.month("o_orderdate"), 6).cast("bigint").alias("fy"))


@query(
    "d09_calendar_label",
    "WITH x AS (SELECT o_orderkey, year(o_orderdate) * 12 + 5 - (4 - quarter(o_orderdate)) * 3 AS m FROM orders) SELECT o_orderkey, (m // 12) || 'Q' || ((m % 12) // 3 + 1) AS label FROM x",
)
def d09(spark, d):
    kind = F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    return _t(spark, d, "orders").select("o_orderkey", P.calendar_label(F.year("o_orderdate"), kind, 6).alias("label"))


@query("d11_context_periods", "SELECT o_orderkey, y || k AS current, (y - 1) || k AS prior FROM (SELECT o_orderkey, year(o_orderdate) AS y, CASE WHEN quarter(o_orderdate) <= 2 THEN 'Q2' ELSE 'Q4' END AS k FROM orders)")
def d11(spark, d):
    half = F.when(F.quarter("o_orderdate") <= 2, "H1").otherwise("H2")
    return _t(spark, d, "orders").select("o_orderkey", P.context_periods(F.year("o_orderdate"), half).alias("x")).select("o_orderkey", "x.*")


@query("d13_annualise", f"SELECT o_orderkey, round(o_totalprice * 4, 2) AS value FROM (SELECT *, {_Q} AS p FROM orders) WHERE p LIKE '%Q%'")
def d13(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * P.annualise(_quarter()), 2).alias("value"))


@query("d14_quarter_label", "SELECT o_orderkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label FROM orders")
def d14(spark, d):
    raw = F.concat(F.lit("(Q"), F.quarter("o_orderdate").cast("string"), F.lit(")"), F.year("o_orderdate").cast("string"))
    return _t(spark, d, "orders").select("o_orderkey", P.quarter_label(raw).alias("label"))


# --- filters ---------------------------------------------------------------------------------


@query("f01_enabled", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND n_chars > 0")
def f01(spark, d):
    return _t(spark, d, "documents").where(F.col("source").isin("src1", "src2") & (F.col("n_chars") > 0)).select("doc_id")


@query("f03_dimension", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def f03(spark, d):
    return _t(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id")


@query("f10_period_keywords", f"SELECT o_orderkey FROM orders WHERE {_Q} IN ('1995Q1', '1996Q4') OR year(o_orderdate) = 1993")
def f10(spark, d):
    asked = spark.createDataFrame([("1995Q1",), ("1996Q4",), ("1993",), ("profit",)], "word string").select(P.parse_period(F.col("word")).alias("p")).where("p is not null").select("p.*")
    rows = _t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("fy"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("q"))
    asked = F.broadcast(asked.select(F.col("fy").alias("a_fy"), "kind"))  # the words of one question
    return rows.join(asked, (F.col("fy") == F.col("a_fy")) & (F.col("kind").isNull() | (F.col("kind") == F.col("q"))), "left_semi").select("o_orderkey")


@query("f13_post_filter", "SELECT d.doc_id FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id WHERE contains(lower(concat_ws(' ', source, text)), 'tion') AND (q IS NULL OR q >= 1)")
def f13(spark, d):
    q = _t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return _t(spark, d, "documents").join(q, "doc_id", "left").where(F.lower(F.concat_ws(" ", "source", "text")).contains("tion") & (F.col("q").isNull() | (F.col("q") >= 1))).select("doc_id")


@query("f14_statement_periods", f"SELECT o_orderkey FROM orders WHERE regexp_matches({_Q}, '^20[0-9]{{2}}(Q[1-4]|H[12])$')")
def f14(spark, d):
    return _t(spark, d, "orders").where(P.is_quarterly(_quarter())).select("o_orderkey")


@query("f23_stock_screen", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 905 AND 1500 AND p_size >= 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 40")
def f23(spark, d):
    config = {"filters": [{"field": "p_retailprice", "min": 905, "max": 1500}, {"field": "p_size", "min": 10}], "sort": [{"field": "p_retailprice", "desc": True}, {"field": "p_partkey"}], "limit": 40}
    return market.screen(_t(spark, d, "part"), config).select("p_partkey", "p_retailprice")


@query("f27_table_type", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'income|revenue|利润|收入') THEN 'income' WHEN regexp_matches(lower(text), 'balance|assets|资产') THEN 'balance' WHEN regexp_matches(lower(text), 'cash flow|现金') THEN 'cashflow' ELSE 'other' END AS kind FROM documents")
def f27(spark, d):
    return _t(spark, d, "documents").select("doc_id", statements.table_type(F.col("text")).alias("kind"))


# --- joins -----------------------------------------------------------------------------------


@query("j02_delete_pairs", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')")
def j02(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return retrieval.delete(li, li.where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"]).drop("l_returnflag")


@query("j04_fill_parents", "SELECT n.n_nationkey AS chunk_id, concat_ws(chr(10), r.r_name, n.n_name) AS content FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey")
def j04(spark, d):
    kids = _t(spark, d, "nation").select(F.col("n_nationkey").alias("chunk_id"), F.col("n_regionkey").alias("parent_chunk_id"), F.col("n_name").alias("content"))
    return retrieval.fill_parents(kids, _t(spark, d, "region").select(F.col("r_regionkey").alias("chunk_id"), F.col("r_name").alias("content"))).select("chunk_id", "content")


@query(
    "j09_statement_join",
    "WITH i AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders), c AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS x FROM lineitem GROUP BY 1) SELECT i.k, i.v, c.x FROM i LEFT JOIN c ON c.k = i.k",
)
def j09(spark, d):
    c = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("x"))
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")).join(c, "k", "left")


@query(
    "j20_cross_indicators",
    "SELECT u AS user_id, round(p / nullif(v, 0), 6) AS rate FROM (SELECT user_id AS u, sum(value) FILTER (event_type = 'purchase') AS p, sum(value) FILTER (event_type = 'view') AS v FROM events GROUP BY 1)",
)
def j20(spark, d):
    wide = statements.to_wide(_t(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("value")), ["user_id"], "event_type", "value", ["purchase", "view"])
    return wide.join(_t(spark, d, "events").select("user_id").distinct(), "user_id", "right").select("user_id", _r(F.try_divide("purchase", "view")).alias("rate"))


@query("j19_members", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def j19(spark, d):
    edges = _t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return market.members(edges, _t(spark, d, "region"), _t(spark, d, "supplier"), "r_regionkey", "s_nationkey").select("s_suppkey", "n_name", "r_name")


# --- top-k and ranks -------------------------------------------------------------------------


@query("k09_latest_periods", f"WITH q AS (SELECT DISTINCT o_custkey, {_Q} AS p FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC) AS n FROM q) SELECT o_custkey, p FROM r WHERE n <= 4")
def k09(spark, d):
    q = _t(spark, d, "orders").select("o_custkey", _quarter().alias("p")).distinct()
    return statements.latest(q, ["o_custkey"], F.col("p"), 4)


@query("k10_preferred", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 9 END, c_custkey LIMIT 60")
def k10(spark, d):
    at = F.array_position(F.array(F.lit("MACHINERY"), F.lit("BUILDING")), F.col("c_mktsegment"))
    return _t(spark, d, "customer").orderBy(F.when(at > 0, at).otherwise(9), "c_custkey").limit(60).select("c_custkey", "c_mktsegment")


@query("k14_tree_order", "SELECT n_nationkey, row_number() OVER (ORDER BY r_name, n_name) AS place FROM nation JOIN region ON r_regionkey = n_regionkey")
def k14(spark, d):
    tree = _t(spark, d, "nation").join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # a row a region
    return tree.select("n_nationkey", F.row_number().over(Window.orderBy("r_name", "n_name")).alias("place"))  # a row a nation


# --- scalar finance --------------------------------------------------------------------------


@query("n01_cell_numbers", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -abs(round(c_acctbal, 2)) ELSE round(c_acctbal, 2) END AS value FROM customer")
def n01(spark, d):
    plain = F.round("c_acctbal", 2).cast("decimal(18,2)")
    cell = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("($"), F.abs(plain).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("RMB "), plain.cast("string")))
    return _t(spark, d, "customer").select("c_custkey", statements.number(cell).alias("value"))


@query("n05_free_cash_flow", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - (abs(l_discount * 1000) + abs(coalesce(CASE WHEN l_linenumber > 1 THEN -l_tax * 1000 END, 0))), 4) AS fcf FROM lineitem")
def n05(spark, d):
    capex = [F.col("l_discount") * 1000, F.when(F.col("l_linenumber") > 1, -F.col("l_tax") * 1000)]
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r(statements.free_cash_flow(F.col("l_extendedprice"), capex), 4).alias("fcf"))


@query("n09_safe_divide", "SELECT l_orderkey, l_linenumber, round(coalesce(l_extendedprice / nullif(l_tax, 0), 0), 4) AS x FROM lineitem")
def n09(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r(F.coalesce(F.try_divide("l_extendedprice", "l_tax"), F.lit(0.0)), 4).alias("x"))


@query(
    "n13_scenarios",
    """WITH c(n, k, q) AS (VALUES ('bear', 0.5, 0.8), ('base', 1.0, 0.9), ('bull', 1.5, 0.95)), t AS (SELECT unnest(range(0, 5)) AS t)
SELECT p_partkey, n AS "case", t + 1 AS year, round(p_size / 500.0 * k * pow(q, t), 9) AS growth FROM part, c, t""",
)
def n13(spark, d):
    cases = {"bear": (0.5, 0.8), "base": (1.0, 0.9), "bull": (1.5, 0.95)}
    out = modelling.scenarios(_t(spark, d, "part").select("p_partkey", (F.col("p_size") / 500.0).alias("rate")), cases, "rate", 5)
    return out.select("p_partkey", "case", F.posexplode("growth").alias("t", "g")).select("p_partkey", "case", (F.col("t") + 1).alias("year"), _r("g", 9).alias("growth"))


_SETUP = "SELECT c_custkey, 1000.0 + abs(c_acctbal) AS revenue, 100.0 AS cash, 80.0 AS receivables, 50.0 AS inventory, 40.0 AS payables, 300.0 AS plant, 200.0 AS debt FROM customer"


@query(
    "n17_three_statements",
    f"""WITH RECURSIVE y(c_custkey, year, revenue, cash, receivables, inventory, payables, plant, debt, equity, net_income) AS (
SELECT c_custkey, 0, revenue, cash, receivables, inventory, payables, plant, debt, cash + receivables + inventory + plant - payables - debt, CAST(0 AS DOUBLE) FROM (SELECT c_custkey, CAST(revenue AS DOUBLE) AS revenue, CAST(cash AS DOUBLE) AS cash, CAST(receivables AS DOUBLE) AS receivables, CAST(inventory AS DOUBLE) AS inventory, CAST(payables AS DOUBLE) AS payables, CAST(plant AS DOUBLE) AS plant, CAST(debt AS DOUBLE) AS debt FROM ({_SETUP}))
UNION ALL SELECT c_custkey, year + 1, r, cash + ni + 0.04 * r + (receivables + inventory - payables) - (r * 45 / 365 + r * 0.6 * 60 / 365 - r * 0.6 * 30 / 365) - 0.05 * r + (10 - 5 - 0.1 * debt), r * 45 / 365, r * 0.6 * 60 / 365, r * 0.6 * 30 / 365, plant + 0.05 * r - 0.04 * r, debt + 10 - 5 - 0.1 * debt, equity + ni, ni
FROM (SELECT *, pre - greatest(0, pre) * 0.25 AS ni FROM (SELECT *, r - r * 0.6 - r * 0.2 - r * 0.04 - debt * 0.06 AS pre FROM (SELECT *, revenue * (CASE year WHEN 0 THEN 1.1 WHEN 1 THEN 1.08 ELSE 1.05 END) AS r FROM y WHERE year < 3))))
SELECT c_custkey, CAST(year AS INTEGER) AS year, round(revenue, 3) AS revenue, round(net_income, 3) AS net_income, round(cash, 3) AS cash, round(debt, 3) AS debt, abs(cash + receivables + inventory + plant - payables - debt - equity) < 1e-6 AS balances FROM y WHERE year > 0""",
)
def n17(spark, d):
    drivers = {"gross_margin": 0.4, "opex": 0.2, "depreciation": 0.04, "capex": 0.05, "tax": 0.25, "dso": 45.0, "dio": 60.0, "dpo": 30.0, "issuance": 10.0, "mandatory": 5.0, "sweep": 0.1, "rate": 0.06}
    opening = {"cash": 100.0, "receivables": 80.0, "inventory": 50.0, "payables": 40.0, "plant": 300.0, "debt": 200.0}
    c = _t(spark, d, "customer").select("c_custkey", (1000.0 + F.abs("c_acctbal")).alias("revenue"), *(F.lit(v).alias(k) for k, v in (opening | drivers).items()), F.array(F.lit(0.1), F.lit(0.08), F.lit(0.05)).alias("growth"))
    y = modelling.three_statements(c).select("c_custkey", F.explode("years").alias("y")).select("c_custkey", "y.*")
    return y.select("c_custkey", "year", *(_r(k, 3).alias(k) for k in ("revenue", "net_income", "cash", "debt")), (F.abs("gap") < 1e-6).alias("balances"))


@query("n22_model_score", "SELECT d.doc_id, round(0.3 * 0.5 + 0.7 * coalesce(least(greatest(q * 12.0, 0), 10) / 10, 0), 6) AS score FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def n22(spark, d):
    q = _t(spark, d, "labels").groupBy("doc_id").agg((F.max("quality") * 12.0).alias("q"))
    return _t(spark, d, "documents").join(q, "doc_id", "left").select("doc_id", _r(retrieval.rerank_blend(F.lit(0.5), retrieval.model_score(F.col("q")))).alias("score"))


# --- dedup, order and windows ----------------------------------------------------------------


@query("u03_merge_facts", "SELECT k, v, f FROM (SELECT l_orderkey AS k, max(l_quantity) AS v, 0 AS f FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 UNION ALL SELECT l_orderkey, max(l_quantity), 1 FROM lineitem GROUP BY 1) QUALIFY row_number() OVER (PARTITION BY k ORDER BY f) = 1")
def u03(spark, d):
    li = _t(spark, d, "lineitem")
    files = [x.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_quantity").alias("v")) for x in (li.where("l_returnflag = 'A'"), li)]
    return statements.merge_facts(files, ["k"]).select("k", "v", F.col("file_no").alias("f"))


@query("u05_tag_insert", "SELECT DISTINCT doc_id % 40 AS chunk, 'lang' AS tag_key, lang AS tag_value FROM documents WHERE lang IS NOT NULL")
def u05(spark, d):
    tags = _t(spark, d, "documents").where("lang is not null").select((F.col("doc_id") % 40).alias("chunk"), F.lit("lang").alias("tag_key"), F.col("lang").alias("tag_value"))
    return tags.dropDuplicates()


@query("u09_unique_ids", "SELECT doc_id, CASE WHEN n = 1 THEN lang ELSE lang || '-' || n END AS unique_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents WHERE lang IS NOT NULL)")
def u09(spark, d):
    return statements.unique_ids(_t(spark, d, "documents").where("lang is not null"), ["source"], "lang", ["doc_id"]).select("doc_id", "unique_id")


@query("w04_returns", "SELECT * FROM (SELECT user_id, event_id, round((value - p) / nullif(p, 0), 6) AS ret FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)) WHERE ret IS NOT NULL")
def w04(spark, d):
    return statements.returns(_t(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").select("user_id", "event_id", _r("ret").alias("ret"))


@query("w07_latest_version", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def w07(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("w09_compound", "SELECT l_orderkey, l_linenumber, round(100 * exp(sum(ln(1 + l_discount)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)), 6) AS value FROM (SELECT l_orderkey, l_linenumber, max(l_discount) / 3 AS l_discount FROM lineitem GROUP BY 1, 2)")
def w09(spark, d):
    li = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_discount") / 3).alias("l_discount")).withColumn("base", F.lit(100.0))
    return statements.compound(li, ["l_orderkey"], "l_linenumber", "l_discount", "base").select("l_orderkey", "l_linenumber", _r("compounded").alias("value"))


@query("w11_debt_history", "SELECT * FROM (SELECT user_id, event_id, round(greatest(0, value - p), 6) AS issuance, round(greatest(0, p - value), 6) AS mandatory FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)) WHERE issuance IS NOT NULL AND user_id IN (SELECT user_id FROM events) AND mandatory IS NOT NULL AND (issuance > 0 OR mandatory > 0)")
def w11(spark, d):
    out = modelling.back_solved_debt(_t(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")
    return out.select("user_id", "event_id", _r("issuance").alias("issuance"), _r("mandatory").alias("mandatory")).where("issuance > 0 or mandatory > 0")


@query(
    "w13_line_groups",
    """WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
b AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM a WHERE event_type IN ('click', 'view'))
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM b GROUP BY user_id, g HAVING count(*) >= 3""",
)
def w13(spark, d):
    return statements.islands(_t(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type").isin("click", "view"))


@query("w16_nearest_header", "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS header FROM events")
def w16(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("h"))
    return statements.nearest_left(e, ["user_id"], "event_id", "h").drop("h")


# --- text ------------------------------------------------------------------------------------


@query("x08_context", "SELECT conv_id, string_agg('[' || n || '] ' || coalesce(role, '') || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id")
def x08(spark, d):
    c = _t(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.col("role").alias("header"), F.col("text").alias("content"))
    return retrieval.context_text(c, ["conv_id"], "turn")


@query("x12_tickers", "SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS ticker, 'HK' AS market FROM supplier WHERE s_suppkey < 100000")
def x12(spark, d):
    raw = F.concat(F.lit("hk."), F.col("s_suppkey").cast("string"))
    return _t(spark, d, "supplier").select("s_suppkey", T.normalise_ticker(raw).alias("ticker"), T.market_of(raw).alias("market"))


@query("x16_signature", "SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' ' || p_brand, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS signature FROM part")
def x16(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.command_signature(F.concat_ws(" ", "p_name", "p_brand")).alias("signature"))


# --- statement building ----------------------------------------------------------------------


@query(
    "z05_ratio_rows",
    """WITH f AS (SELECT l_orderkey AS k, 'price' AS metric, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'quantity', sum(l_quantity) FROM lineitem GROUP BY 1),
w AS (SELECT k, max(value) FILTER (metric = 'price') AS p, max(value) FILTER (metric = 'quantity') AS q FROM f GROUP BY k)
SELECT k, metric AS parent, 0 AS sub_order, metric, value FROM f UNION ALL SELECT k, 'quantity', 1, 'quantity share', round(q / nullif(p, 0) * 100, 2) FROM w""",
)
def z05(spark, d):
    sums = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("price"), F.sum("l_quantity").alias("quantity"))
    return statements.with_ratio_rows(statements.to_long(sums, ["k"], name="metric"), ["k"], [("quantity", "price", "quantity share")])


@query("z12_working_capital", "SELECT o_orderkey, round(o_totalprice * 45 / 365, 4) AS receivables FROM orders")
def z12(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", _r(valuation.working_capital(F.col("o_totalprice"), F.lit(45)), 4).alias("receivables"))


@query("z18_peer_table", "SELECT c_nationkey, round(sum(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 2) AS building, round(sum(c_acctbal) FILTER (c_mktsegment = 'MACHINERY'), 2) AS machinery FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def z18(spark, d):
    c = _t(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    return statements.to_wide(c, ["c_nationkey"], "c_mktsegment", "v", ["BUILDING", "MACHINERY"]).toDF("c_nationkey", "building", "machinery")


# --- market scans: the five shapes of the quote family ---------------------------------------


@query("g01_scan", "SELECT s_name, s_acctbal, s_nationkey FROM supplier WHERE s_name IN ('Supplier#000000001', 'Supplier#000000003')")
def g01(spark, d):
    return market.scan(_t(spark, d, "supplier"), "s_name", ["Supplier#000000001", "Supplier#000000003"], ["s_acctbal", "s_nationkey"])


@query("g02_rank", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def g02(spark, d):
    return market.ranked(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 25, 10)


@query("g03_time_range", "SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'")
def g03(spark, d):
    return market.between_times(_t(spark, d, "events"), "ts", "2024-01-05 00:00:00", "2024-01-06 12:00:00").select("event_id", "value")


@query(
    "r11_correlate",
    """WITH q AS (SELECT user_id, min(ts) AS sent FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT q.user_id, min(e.ts) IS NULL AS timed_out, min(e.ts) AS answered FROM q LEFT JOIN events e ON e.user_id = q.user_id AND e.event_type = 'purchase' AND e.ts >= q.sent AND e.ts <= q.sent + INTERVAL 86400 SECOND GROUP BY 1""",
)
def r11(spark, d):
    e = _t(spark, d, "events")
    sent = e.where("event_type = 'click'").groupBy("user_id").agg(F.min("ts").alias("sent"))
    return market.correlate(sent, e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("got")), "user_id", "sent", "got", 86400).drop("sent")
