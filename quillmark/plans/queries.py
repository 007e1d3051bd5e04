"""Registered queries over the benchmark tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import periods as P
from quillmark.functions import text as T
from quillmark.operators import chunking, market, retrieval, statements, valuation
from quillmark.streaming.bars import run_available

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYWORDS = ["tion", "keit", "the"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c, n: int = 6):
    return F.round(c, n)


# --- retrieval -------------------------------------------------------------------------------

_COUNT = "CAST((len({x}) - len(replace({x}, '{k}', ''))) / {n} AS BIGINT)"


def _bm25_sql(keep: str = "") -> str:
    cols = ", ".join(f"{_COUNT.format(x='t', k=k, n=len(k))} AS t{i}, {_COUNT.format(x='c', k=k, n=len(k))} AS c{i}" for i, k in enumerate(KEYWORDS))
    df = ", ".join(f"greatest(count(*) FILTER (t{i} > 0), count(*) FILTER (c{i} > 0)) AS d{i}" for i in range(len(KEYWORDS)))
    w = "(3.0 * t{i} / (1 - 0.35 + 0.35 * lt / avt) + 1.0 * c{i} / (1 - 0.75 + 0.75 * lc / avc))"
    raw = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * 2.2 * {w.format(i=i)} / (1.2 + {w.format(i=i)})" for i in range(len(KEYWORDS)))
    return f"""b0 AS (SELECT doc_id, lower(coalesce(source, '')) AS t, lower(coalesce(text, '')) AS c FROM documents),
b1 AS (SELECT doc_id, len(t) AS lt, len(c) AS lc, {cols} FROM b0), b2 AS (SELECT count(*) AS n, avg(lt) AS avt, avg(lc) AS avc, {df} FROM b1),
b3 AS (SELECT doc_id, {raw} AS raw FROM b1, b2), bm AS (SELECT doc_id, raw, tanh(raw / 5) AS score FROM b3 WHERE raw > 0.01{keep})"""


def _bm25(spark, d):
    return retrieval.bm25f(_t(spark, d, "documents"), KEYWORDS, "source", "text")


@query("a05_bm25f", f"WITH {_bm25_sql()} SELECT doc_id, round(raw, 6) AS raw, round(score, 6) AS score FROM bm")
def a05(spark, d):
    return _bm25(spark, d).select("doc_id", _r("raw").alias("raw"), _r("score").alias("score"))


@query("k01_keyword_top", f"WITH {_bm25_sql()} SELECT doc_id, round(raw, 6) AS raw FROM bm ORDER BY raw DESC, doc_id LIMIT 50")
def k01(spark, d):
    return retrieval.top(_bm25(spark, d), 50, "doc_id", "raw").select("doc_id", _r("raw").alias("raw"))


_COS = "vs AS (SELECT a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _nearest(spark, d, k):
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()
    return retrieval.nearest(e, list(q[0]), k, "vec_id")


@query("k02_cosine_top", f"WITH {_COS} SELECT vec_id, round(score, 6) AS score FROM vs ORDER BY vs.score DESC, vec_id LIMIT 30")
def k02(spark, d):
    return _nearest(spark, d, 30).select("vec_id", _r("score").alias("score"))


@query(
    "a02_rrf",
    f"""WITH {_bm25_sql()}, {_COS}, k AS (SELECT doc_id AS id, 0.3 / (60 + row_number() OVER (ORDER BY raw DESC, doc_id)) AS s FROM bm ORDER BY raw DESC, doc_id LIMIT 30),
v AS (SELECT vec_id AS id, 0.7 / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) AS s FROM vs ORDER BY score DESC, vec_id LIMIT 30)
SELECT id, round(sum(s), 9) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM v) GROUP BY id ORDER BY sum(s) DESC, id LIMIT 20""",
)
def a02(spark, d):
    k = retrieval.top(_bm25(spark, d), 30, "doc_id", "raw").select(F.col("doc_id").alias("id"), F.col("raw").alias("score"))
    v = _nearest(spark, d, 30).select(F.col("vec_id").alias("id"), "score")
    return retrieval.fuse(k, v, "id", 20).select("id", _r("score", 9).alias("score"))


def _tags(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("tag_key"), F.col(k).alias("tag_value")) for k in ("lang", "source")))).alias("x")).select("doc_id", "x.*").where("tag_value is not null")


@query("f04_tag_filter", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')")
def f04(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "n_chars")
    return retrieval.tag_filter(docs, _tags(spark, d), [("lang", "EQ", ["en"]), ("source", "IN", ["src1", "src2", "src3"])], ["doc_id"])


@query("j03_attach_tags", "SELECT doc_id, concat_ws(',', 'lang=' || lang, 'source=' || source) AS tags FROM documents")
def j03(spark, d):
    out = retrieval.attach_tags(_t(spark, d, "documents").select("doc_id"), _tags(spark, d), ["doc_id"])
    return out.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("tags"))


@query("a01_tag_values", "SELECT DISTINCT source AS tag_value FROM documents WHERE lang = 'en' AND source IS NOT NULL")
def a01(spark, d):
    return _t(spark, d, "documents").where("lang = 'en' and source is not null").select(F.col("source").alias("tag_value")).distinct()


@query("f12_domains", r"SELECT page_id, lower(regexp_extract(url, '://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM pages WHERE regexp_matches(lower(regexp_extract(url, '://(?:[^/@]*@)?([^/:?#]+)', 1)), '(^|\.)example\.(com|org)$') AND NOT regexp_matches(lower(regexp_extract(url, '://(?:[^/@]*@)?([^/:?#]+)', 1)), '^(.*\.)?m\.example\.com$')")
def f12(spark, d):
    return _t(spark, d, "pages").where(T.domain_allowed(F.col("url"), ["example.com", "example.org"], ["m.example.com"])).select("page_id", T.url_host(F.col("url")).alias("host"))


_EST = r"CAST(ceil(len(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) / 1.5) + floor(len(regexp_replace(text, '[^\x21-\x7e]', '', 'g')) / 4.0) + len(regexp_replace(text, '[\x00-\x7f\x{4e00}-\x{9fff}]', '', 'g')) AS BIGINT)"


@query("x05_token_estimate", f"SELECT doc_id, {_EST} AS tokens FROM documents WHERE text IS NOT NULL")
def x05(spark, d):
    return _t(spark, d, "documents").where("text is not null").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "w06_budget",
    f"""WITH r AS (SELECT doc_id, source, n_chars, {_EST} AS tokens FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, sum(tokens) OVER o AS running, row_number() OVER o AS rn FROM r WINDOW o AS (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, doc_id, tokens, CAST(running AS BIGINT) AS running FROM w WHERE rn = 1 OR running <= 12000""",
)
def w06(spark, d):
    docs = _t(spark, d, "documents").where("text is not null")
    return retrieval.budget(docs, "text", 12000, ["source"], "doc_id", "n_chars").select("source", "doc_id", "tokens", "running")


@query("x06_ids", "SELECT doc_id, substr(sha256(text), 1, 16) AS chunk_id FROM documents WHERE text IS NOT NULL")
def x06(spark, d):
    return _t(spark, d, "documents").where("text is not null").select("doc_id", T.hash16(F.col("text")).alias("chunk_id"))


@query("x01_counts", "SELECT doc_id, CAST((len(text) - len(replace(text, 'ung', ''))) / 3 AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def x01(spark, d):
    return _t(spark, d, "documents").where("text is not null").select("doc_id", T.count_occurrences(F.col("text"), "ung").cast("bigint").alias("n"))


@query("x09_markers", "SELECT conv_id, turn, regexp_replace('[1] ' || text || ' [23]', '\\[(\\d+)\\]', '[C\\1]', 'g') AS text FROM conversations WHERE text IS NOT NULL")
def x09(spark, d):
    return _t(spark, d, "conversations").where("text is not null").select("conv_id", "turn", T.citation_markers(F.concat(F.lit("[1] "), "text", F.lit(" [23]"))).alias("text"))


@query("u02_keep_first", "SELECT doc_id, h FROM (SELECT doc_id, md5(lower(text)) AS h, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1")
def u02(spark, d):
    # The least id of each text, counted before it is shuffled: no window over a hot text.
    docs = _t(spark, d, "documents").where("text is not null").select("doc_id", F.md5(F.lower("text").cast("binary")).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"))


@query("m1_upsert", "SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey > 0")
def m1(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    new = o.where("k % 10 = 0").select("k", F.lit("X").alias("v")).unionByName(o.where("k % 100 = 0 and k > 0").select((-F.col("k")).alias("k"), F.lit("N").alias("v")))
    return retrieval.upsert(o, new, ["k"])


@query("m2_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def m2(spark, d):
    gone = _t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return retrieval.delete(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("f07_intent", r"SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 'CLARIFICATION' WHEN regexp_matches(text, '(?i)你好|\b(hi|hello)\b') THEN 'GREETING' WHEN regexp_matches(text, '网页|网络搜索|上网') THEN 'WEB_SEARCH' ELSE 'KB_SEARCH' END AS intent FROM conversations")
def f07(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", retrieval.intent(F.col("text")).alias("intent"))


@query("r12_fold", "SELECT conv_id, md5(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS h, count(*) AS n FROM conversations GROUP BY conv_id")
def r12(spark, d):
    c = _t(spark, d, "conversations")
    part = F.struct("turn", "role", "text", F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))).alias("s"))
    return c.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"]), "\n").cast("binary")).alias("h"), F.count("*").alias("n"))


@query("n21_rerank", "SELECT doc_id, round(0.3 * (n_chars % 10) / 10 + 0.7 * coalesce(l.quality, 0.5), 6) AS score FROM documents LEFT JOIN labels l USING (doc_id)")
def n21(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "n_chars").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select("doc_id", _r(retrieval.rerank_blend(F.col("n_chars") % 10 / 10, F.col("quality").cast("double"))).alias("score"))


# --- statements ------------------------------------------------------------------------------

_MONTHLY = "m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS p, sum(o_totalprice) AS v FROM orders GROUP BY ALL)"


def _by(spark, d, *keys):
    o = _t(spark, d, "orders").select("o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("part"), F.quarter("o_orderdate").alias("q"))
    return o.groupBy(*keys).agg(F.sum("o_totalprice").alias("value"))


@query("j10_yoy", f"WITH {_MONTHLY} SELECT a.y AS year, a.p AS part, round(a.v, 2) AS value, round((a.v / b.v - 1) * 100, 6) AS yoy FROM m a LEFT JOIN m b ON b.y = a.y - 1 AND b.p = a.p")
def j10(spark, d):
    return statements.year_on_year(_by(spark, d, "year", "part"), []).select("year", "part", _r("value", 2).alias("value"), _r("yoy").alias("yoy"))


_QUARTERS = "q AS (SELECT o_orderpriority AS pr, year(o_orderdate) * 10 + quarter(o_orderdate) AS t, sum(o_totalprice) AS v FROM orders GROUP BY ALL), w AS (SELECT pr, t, v / lag(v) OVER o - 1 AS qoq, v / lag(v, 4) OVER o - 1 AS yoy FROM q WINDOW o AS (PARTITION BY pr ORDER BY t))"


def _trended(spark, d):
    x = _by(spark, d, "o_orderpriority", "year", "q").withColumn("t", F.col("year") * 10 + F.col("q"))
    return statements.trend(x, ["o_orderpriority"], "t", "value")


@query("w03_trend", f"WITH {_QUARTERS} SELECT pr AS o_orderpriority, t, round(qoq, 6) AS qoq, round(yoy, 6) AS yoy FROM w")
def w03(spark, d):
    return _trended(spark, d).select("o_orderpriority", "t", _r("qoq").alias("qoq"), _r("yoy").alias("yoy"))


@query("a13_trend_stats", f"WITH {_QUARTERS} SELECT pr AS o_orderpriority, round(avg(qoq), 6) AS mean, round(stddev_samp(qoq), 6) AS std, CASE WHEN avg(qoq) > 0 THEN 'up' WHEN avg(qoq) < 0 THEN 'down' ELSE 'stable' END AS label FROM w GROUP BY pr")
def a13(spark, d):
    return statements.trend_summary(_trended(spark, d), ["o_orderpriority"]).select("o_orderpriority", _r("mean").alias("mean"), _r("std").alias("std"), "label")


@query(
    "a12_beta",
    """WITH p AS (SELECT o_orderpriority AS pr, year(o_orderdate) * 100 + month(o_orderdate) AS t, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
s AS (SELECT pr, t, v / lag(v) OVER (PARTITION BY pr ORDER BY t) - 1 AS r FROM p), a AS (SELECT t, sum(v) AS v FROM p GROUP BY t), b AS (SELECT t, v / lag(v) OVER (ORDER BY t) - 1 AS r FROM a)
SELECT pr AS o_orderpriority, count(*) AS n, round(covar_pop(s.r, b.r) / var_pop(b.r), 6) AS beta, round(corr(s.r, b.r), 6) AS r FROM s JOIN b USING (t) WHERE s.r IS NOT NULL AND b.r IS NOT NULL GROUP BY pr HAVING count(*) >= 24""",
)
def a12(spark, d):
    m = _by(spark, d, "o_orderpriority", "year", "part").withColumn("t", F.col("year") * 100 + F.col("part"))
    every = m.groupBy("t").agg(F.sum("value").alias("value")).withColumn("one", F.lit(1))  # months: few rows
    s, b = statements.returns(m, ["o_orderpriority"], "t", "value"), statements.returns(every, ["one"], "t", "value")
    return statements.beta(s, b, ["o_orderpriority"], "t").select("o_orderpriority", "n", _r("beta").alias("beta"), _r("r").alias("r"))


@query("a14_comps", "SELECT p_brand, round(max(p_retailprice), 6) AS max, round(quantile_cont(p_retailprice, 0.75), 6) AS q3, round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.25), 6) AS q1, round(min(p_retailprice), 6) AS min FROM part GROUP BY p_brand")
def a14(spark, d):
    return statements.comps(_t(spark, d, "part"), ["p_brand"], "p_retailprice").select("p_brand", *(_r(c).alias(c) for c in ("max", "q3", "median", "q1", "min")))


@query(
    "a10_roll_up",
    """WITH x AS (SELECT r_name, n_name, c_mktsegment, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT concat_ws('/', r_name, n_name, c_mktsegment) AS node, CAST(CASE WHEN grouping(n_name) = 1 THEN 1 WHEN grouping(c_mktsegment) = 1 THEN 2 ELSE 3 END AS INTEGER) AS level, round(sum(v), 2) AS value FROM x GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (r_name, n_name, c_mktsegment))""",
)
def a10(spark, d):
    c, n, r = _t(spark, d, "customer"), _t(spark, d, "nation"), _t(spark, d, "region")
    # Sums by customer come first, so the dimension joins see a row a customer.
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("value"))
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return statements.roll_up(x, ["r_name", "n_name", "c_mktsegment"], "value").select("node", "level", _r("value", 2).alias("value"))


@query("a11_total_check", "WITH s AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) AS parts, count(l_extendedprice) AS n_parts FROM lineitem GROUP BY 1) SELECT o_orderkey, n_parts, abs(parts - o_totalprice) <= greatest(1.0, 0.005 * abs(o_totalprice)) AND n_parts >= 2 AS ok FROM orders JOIN s USING (o_orderkey)")
def a11(spark, d):
    parts = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return statements.total_check(parts, _t(spark, d, "orders"), "o_orderkey", "l_extendedprice", "o_totalprice").select("o_orderkey", "n_parts", "ok")


@query("c08_unpivot", "SELECT l_returnflag, measure, round(sum(value), 2) AS value FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice FROM lineitem) ON l_quantity, l_extendedprice INTO NAME measure VALUE value) GROUP BY ALL")
def c08(spark, d):
    long = statements.to_long(_t(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], None, "measure")
    return long.groupBy("l_returnflag", "measure").agg(_r(F.sum("value"), 2).alias("value"))


@query("c08_pivot", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY l_returnflag")
def c08p(spark, d):
    x = _t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("v"))
    return statements.to_wide(x, ["l_returnflag"], "l_linestatus", "v", ["F", "O"]).select("l_returnflag", _r("F", 2).alias("F"), _r("O", 2).alias("O"))


@query(
    "j08_as_of",
    """WITH i AS (SELECT c_mktsegment AS seg, year(o_orderdate) AS fy, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
b AS (SELECT seg, fy, period, v AS bv FROM i WHERE fy % 2 = 0 AND (period LIKE '%Q2' OR period LIKE '%Q4')),
c AS (SELECT i.*, b.fy AS b_fy, b.period AS b_period, b.bv, CASE WHEN b.period = i.period THEN 1 WHEN b.fy = i.fy THEN 2 WHEN b.fy <= i.fy THEN 3 ELSE 4 END AS k FROM i LEFT JOIN b ON i.seg = b.seg),
r AS (SELECT *, row_number() OVER (PARTITION BY seg, period ORDER BY k, CASE WHEN k = 2 THEN 1 WHEN k = 3 THEN -b_fy ELSE b_fy END, b_period) AS n FROM c)
SELECT seg, period, CAST(CASE WHEN b_fy IS NOT NULL THEN k END AS INTEGER) AS match_kind, b_period, round(v / bv, 6) AS ratio FROM r WHERE n = 1""",
)
def j08(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg"))
    o = _t(spark, d, "orders").join(c, "o_custkey").select("seg", F.year("o_orderdate").alias("fy"), F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("period"), "o_totalprice")
    i = o.groupBy("seg", "fy", "period").agg(F.sum("o_totalprice").alias("v"))
    b = i.where("fy % 2 = 0 and (period like '%Q2' or period like '%Q4')").withColumnRenamed("v", "bv")
    out = statements.as_of(i, b, ["seg"], "fy", "fy", "period", "period")
    return out.select("seg", "period", "match_kind", "b_period", _r(F.col("v") / F.col("b_bv")).alias("ratio"))


@query("n03_margins", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice) * 100, 2) AS net_margin, round(sum(l_extendedprice * l_tax) / sum(l_extendedprice) * 100, 2) AS tax_rate FROM lineitem GROUP BY ALL")
def n03(spark, d):
    x = _t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_extendedprice").alias("g"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("n"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("t"))
    return x.select("l_returnflag", "l_linestatus", statements.ratio(F.col("n"), F.col("g")).alias("net_margin"), statements.ratio(F.col("t"), F.col("g")).alias("tax_rate"))


@query(
    "j11_derive_quarters",
    """WITH q AS (SELECT c_nationkey AS k, year(o_orderdate) AS y, quarter(o_orderdate) AS q, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
w AS (SELECT k, y, sum(v) FILTER (q = 1) AS q1, sum(v) FILTER (q <= 2) AS h, sum(v) FILTER (q <= 3) AS n, sum(v) AS f FROM q GROUP BY k, y)
SELECT k, y AS year, 'Q2' AS kind, round(h - q1, 2) AS value FROM w WHERE q1 IS NOT NULL AND h IS NOT NULL UNION ALL SELECT k, y, 'Q3', round(n - h, 2) FROM w WHERE h IS NOT NULL AND n IS NOT NULL UNION ALL SELECT k, y, 'Q4', round(f - n, 2) FROM w WHERE n IS NOT NULL""",
)
def j11(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k"))
    q = _t(spark, d, "orders").join(c, "o_custkey").groupBy("k", F.year("o_orderdate").alias("year")).agg(*(F.sum(F.when(F.quarter("o_orderdate") <= n, F.col("o_totalprice"))).alias(a) for a, n in (("Q1", 1), ("QTD6", 2), ("QTD9", 3), ("FY", 4))))
    facts = statements.to_long(q, ["k", "year"], ["Q1", "QTD6", "QTD9", "FY"], "kind").where("value is not null").withColumns({"source": F.lit("DIRECT"), "confidence": F.lit(80)})
    return statements.derive_quarters(facts, ["k"]).where("source = 'DERIVED'").select("k", "year", "kind", _r("value", 2).alias("value"))


@query("w08_latest_periods", "SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 4")
def w08(spark, d):
    return statements.latest(_t(spark, d, "orders"), ["o_orderpriority"], F.struct("o_orderdate", "o_orderkey"), 4).select("o_orderpriority", "o_orderkey")


# --- periods ---------------------------------------------------------------------------------


@query(
    "d01_periods",
    """WITH p AS (SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders)
SELECT o_orderkey, CAST(y AS INTEGER) AS fy, y || 'Q' || q AS canonical, CAST(y * 10 + q AS INTEGER) AS sort_key, CASE WHEN q > 1 THEN y || 'Q' || (q - 1) ELSE (y - 1) || 'Q4' END AS previous, (y - 1) || 'Q' || q AS year_ago FROM p""",
)
def d01(spark, d):
    raw = F.concat(F.lit("q"), F.quarter("o_orderdate").cast("string"), F.lit("-"), F.year("o_orderdate").cast("string"))
    p = _t(spark, d, "orders").select("o_orderkey", P.parse_period(raw).alias("p"))
    fy, kind = F.col("p.fy"), F.col("p.kind")
    return p.select("o_orderkey", fy.alias("fy"), F.col("p.canonical").alias("canonical"), P.tag_sort_key(fy, kind).alias("sort_key"), P.previous(fy, kind).alias("previous"), P.year_ago(fy, kind).alias("year_ago"))


@query("d07_fiscal", "SELECT o_orderkey, CAST(((month(o_orderdate) - 6 - 1 + 12) % 12) // 3 + 1 AS INTEGER) AS fq, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) <= 6 THEN 0 ELSE 1 END AS INTEGER) AS fy FROM orders")
def d07(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", P.fiscal_quarter(F.month("o_orderdate"), 6).alias("fq"), P.fiscal_year(F.year("o_orderdate"), F.month("o_orderdate"), 6).alias("fy"))


@query("d12_buckets", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders")
def d12(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", *(P.date_bucket(F.col("o_orderdate"), f).alias(f) for f in ("month", "quarter", "year")))


# --- market ----------------------------------------------------------------------------------


@query("f24_screen", "SELECT p_partkey, p_brand, round(p_retailprice, 6) AS p_retailprice FROM part WHERE p_retailprice BETWEEN 905 AND 990 AND p_size >= 10 AND p_brand IN ('Brand#1', 'Brand#10', 'Brand#11', 'Brand#12', 'Brand#13')")
def f24(spark, d):
    config = '{"filters": [{"field": "p_retailprice", "min": 905, "max": 990}, {"field": "p_size", "min": 10}, {"field": "p_brand", "in": ["Brand#1", "Brand#10", "Brand#11", "Brand#12", "Brand#13"]}]}'
    return market.screen(_t(spark, d, "part"), config).select("p_partkey", "p_brand", _r("p_retailprice").alias("p_retailprice"))


@query("k11_rank", "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def k11(spark, d):
    return market.screen(_t(spark, d, "orders"), {"sort": [{"field": "o_totalprice", "desc": True}, {"field": "o_orderkey"}], "offset": 10, "limit": 20}).select("o_orderkey", _r("o_totalprice", 2).alias("o_totalprice"))


@query("j07_enrich", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand, round(p_retailprice, 6) AS p_retailprice FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def j07(spark, d):
    p = _t(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey")
    out = market.enrich(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), p, "l_partkey", ["p_brand", "p_retailprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", _r("p_retailprice").alias("p_retailprice"))


@query("j16_nearest", "SELECT p_brand, p_partkey, round(abs(p_retailprice - 950), 6) AS distance, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice - 950), p_partkey) AS INTEGER) AS place FROM part) WHERE place <= 5")
def j16(spark, d):
    return market.nearest_contract(_t(spark, d, "part"), ["p_brand"], "p_retailprice", F.lit(950.0), "p_partkey").select("p_brand", "p_partkey", _r("distance").alias("distance"), "place")


_BARS = "SELECT event_type, time_bucket(INTERVAL 60 MINUTE, ts) AS bar, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close, count(*) AS n FROM events GROUP BY ALL"
_BAR_COLS = ["open", "high", "low", "close"]


@query("r03_bars", _BARS)
def r03(spark, d):
    return market.bars(_t(spark, d, "events"), ["event_type"], "ts", "value", "event_id").select("event_type", "bar", *(_r(c).alias(c) for c in _BAR_COLS), "n")


@query("r03_stream_bars", _BARS)
def r03s(spark, d):
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # The source takes folders and globs alike, so one pattern fits a file and a folder of parts.
    out = run_available(spark, f"{d}/events.parque[t]", schema, f"{base.rstrip('/')}/qm-{uuid.uuid4().hex}", ["event_type"], "ts", "value", "event_id", late="30 days")
    return out.select("event_type", "bar", *(_r(c).alias(c) for c in _BAR_COLS), "n")


@query(
    "a22_streaks",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, event_type, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, event_type, i HAVING count(*) >= 3""",
)
def a22(spark, d):
    return market.streaks(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("c05_json", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k, count(*) AS n FROM events GROUP BY event_type")
def c05(spark, d):
    e = _t(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count("*").alias("n"))


@query("n10_formula", "SELECT l_orderkey, l_linenumber, round((l_extendedprice - l_quantity * 10) / NULLIF(l_tax, 0), 4) AS x FROM lineitem")
def n10(spark, d):
    f = market.formula("(l_extendedprice - l_quantity * 10) / l_tax", {"l_extendedprice", "l_quantity", "l_tax"})
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r(f, 4).alias("x"))


@query(
    "j17_fx",
    """WITH r(base, quote, rate) AS (VALUES ('AFRICA', 'ASIA', 2.0), ('EUROPE', 'ASIA', 4.0), ('ASIA', 'AMERICA', 5.0))
SELECT n_nationkey, round(100.0 * coalesce(CASE WHEN r_name = 'ASIA' THEN 1.0 END, a.rate, 1 / b.rate, 1.0), 6) AS converted FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN r a ON a.base = r_name AND a.quote = 'ASIA' LEFT JOIN r b ON b.quote = r_name AND b.base = 'ASIA'""",
)
def j17(spark, d):
    rates = spark.createDataFrame([("AFRICA", "ASIA", 2.0), ("EUROPE", "ASIA", 4.0), ("ASIA", "AMERICA", 5.0)], "base string, quote string, rate double")
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("src"), F.lit("ASIA").alias("dst"), F.lit(100.0).alias("amount"))
    return market.convert(n, rates, "amount", "src", "dst").select("n_nationkey", _r("converted").alias("converted"))


# --- valuation -------------------------------------------------------------------------------

_REV = "r AS (SELECT c_nationkey AS k, sum(o_totalprice) / 1e6 AS rev FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"


def _revenue(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k"))
    return _t(spark, d, "orders").join(c, "o_custkey").groupBy("k").agg((F.sum("o_totalprice") / 1e6).alias("rev"))


@query(
    "n12_dcf_grid",
    f"""WITH {_REV}, g AS (SELECT k, rev, CAST(0.09 AS DOUBLE) + a.i * CAST(0.005 AS DOUBLE) AS w, CAST(0.025 AS DOUBLE) + b.i * CAST(0.005 AS DOUBLE) AS g FROM r, (SELECT unnest(range(-2, 3)) AS i) a, (SELECT unnest(range(-2, 3)) AS i) b),
y AS (SELECT *, t, rev * power(1.08, t) AS rt, rev * power(1.08, t - 1) AS rp FROM g, (SELECT unnest(range(1, 6)) AS t)),
f AS (SELECT *, rt * 0.25 * 0.75 + rt * 0.03 - rt * 0.05 - (rt - rp) * 0.1 AS fcf FROM y)
SELECT k, round(w, 4) AS wacc, round(g, 4) AS growth, round(sum(fcf / power(1 + w, t - 0.5)) + max(CASE WHEN t = 5 THEN fcf * (1 + g) / (w - g) / power(1 + w, 4.5) END), 6) AS ev FROM f GROUP BY k, w, g""",
)
def n12(spark, d):
    x = valuation.grid(_revenue(spark, d).withColumns({"w": F.lit(0.09), "g": F.lit(0.025)}), "w", 0.005, "g", 0.005)
    rows = valuation.project(F.col("rev"), F.array(*[F.lit(0.08)] * 5), F.array(*[F.lit(0.25)] * 5), F.lit(0.25), F.lit(0.03), F.lit(0.05), F.lit(0.1))
    x = x.withColumn("rows", rows)
    v = valuation.dcf(F.col("rows"), F.col("w"), F.col("g"), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    return x.select("k", _r("w", 4).alias("wacc"), _r("g", 4).alias("growth"), _r(v["ev"]).alias("ev"))


@query("n11_wacc", f"WITH {_REV} SELECT k, round(CASE WHEN k = 0 THEN 0.04 + 1.1 * 0.055 ELSE rev / greatest(rev + k * 10.0, rev / 2) * (0.04 + 1.1 * 0.055) + k * 10.0 / greatest(rev + k * 10.0, rev / 2) * 0.05 * 0.75 END, 6) AS wacc FROM r")
def n11(spark, d):
    ke = valuation.cost_of_equity(F.lit(0.04), F.lit(1.1), F.lit(0.055))
    return _revenue(spark, d).select("k", _r(valuation.wacc(F.col("rev"), F.col("k") * 10.0, ke, F.lit(0.05), F.lit(0.25))).alias("wacc"))


def _lbo_sql() -> str:
    """The same waterfall as a recursion over years, tranche by tranche."""
    n = len(valuation.TRANCHES)
    share, rate, must = ([t[k] for t in valuation.TRANCHES] for k in (1, 2, 3))
    begin = ", ".join(f"rev * 2 * {valuation.LEVERAGE!r}::DOUBLE * {share[i]!r}::DOUBLE AS e{i}" for i in range(n))
    owed = ", ".join(f"least(e{i}, {must[i]!r}::DOUBLE * rev * 2 * {valuation.LEVERAGE!r}::DOUBLE * {share[i]!r}::DOUBLE) AS m{i}" for i in range(n))
    interest = " + ".join(f"e{i} * {rate[i]!r}::DOUBLE" for i in range(n))
    left = f"SELECT *, rev * power(1.05::DOUBLE, t + 1) * 0.15::DOUBLE - ({interest}) - ({' + '.join(f'm{i}' for i in range(n))}) AS l0 FROM (SELECT *, {owed} FROM w WHERE t < 5)"
    for i in range(n):  # what a tranche sweeps is gone for the next
        left = f"SELECT *, l{i} - s{i} AS l{i + 1} FROM (SELECT *, least(greatest(0, e{i} - m{i}), greatest(0, l{i})) AS s{i} FROM ({left}))"
    step = ", ".join(f"greatest(0, e{i} - m{i} - s{i})" for i in range(n))
    debt = " + ".join(f"e{i}" for i in range(n))
    return f"""WITH RECURSIVE {_REV}, w AS (SELECT k, rev, 0 AS t, {begin} FROM r UNION ALL SELECT k, rev, t + 1, {step} FROM ({left})),
x AS (SELECT k, {debt} AS d, (rev * power(1.05::DOUBLE, 5) * 0.25::DOUBLE * 8 - ({debt})) / (rev * 2 * {1 - valuation.LEVERAGE + valuation.FEES!r}::DOUBLE) AS moic FROM w WHERE t = 5)
SELECT k, round(d, 6) AS end_debt, round(moic, 6) AS moic, round(CASE WHEN moic > 0 THEN power(moic, 0.2::DOUBLE) - 1 END, 6) AS irr FROM x"""


@query("n15_lbo", _lbo_sql())
def n15(spark, d):
    """Debt waterfall and returns of a buyout of each nation's book; folded year by year."""
    x = _revenue(spark, d).withColumn("debt", F.col("rev") * 2 * valuation.LEVERAGE)
    cash = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda t: F.col("rev") * F.pow(F.lit(1.05), t) * 0.15)
    x = x.withColumn("w", valuation.debt_waterfall([F.col("debt") * s for _, s, _, _ in valuation.TRANCHES], cash))
    end = F.aggregate(F.element_at("w", -1)["ends"], F.lit(0.0), lambda a, b: a + b)
    r = valuation.lbo_returns(F.col("rev") * F.pow(F.lit(1.05), F.lit(5)) * 0.25, F.lit(8.0), end, F.col("rev") * 2 * (1 - valuation.LEVERAGE + valuation.FEES))
    return x.select("k", _r(end).alias("end_debt"), _r(r["moic"]).alias("moic"), _r(r["irr"]).alias("irr"))


# --- text to rows ----------------------------------------------------------------------------


def _read_html_sql() -> str:
    """The reader's rules as replacements, one after the other: dropped elements, white space, marks, tags, references."""
    space = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    steps = [("(?s)<!--.*?-->", "''")]
    steps += [(rf"(?is)<{t}(\s[^>]*)?>.*?</{t}\s*>", "''") for t in ("script", "style", "nav", "header", "footer", "noscript")]
    steps += [("<![^>]*>", "''"), (space + "+", "' '")]
    steps += [(rf"(?i)<h{k}(\s[^>]*)?>", f"chr(10) || chr(10) || '{'#' * k} '") for k in (1, 2, 3, 4)]
    steps += [(r"(?i)<li(\s[^>]*)?>", "chr(10) || '- '"), (r"(?i)<t[dh](\s[^>]*)?>", "' | '")]
    steps += [(r"(?i)<(p|div|br|section|article|ul|ol|table|tr)(\s[^>]*)?/?>|</(p|div|br|section|article|ul|ol|table|h[^>]*)>", "chr(10)"), ("<[^>]*>", "''")]
    out = "coalesce(html, '')"
    for pattern, new in steps:
        out = f"regexp_replace({out}, '{pattern}', {new}, 'g')"
    for sign, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
        out = f"regexp_replace({out}, '{sign}?', '{char}', 'g')"  # the closing sign may be cut off
    for pattern, new in ((r" *\n *", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (f"^{space}+", "''"), (f"{space}+$", "''")):
        out = f"regexp_replace({out}, '{pattern}', {new}, 'g')"
    return f"SELECT page_id, {out} AS text FROM pages"


@query("s02_read_html", _read_html_sql())
def s02(spark, d):
    return chunking.read_html(_t(spark, d, "pages"), "page_id", "html")


@query("h01_heading_chunks")
def h01(spark, d):
    return chunking.chunk(chunking.read_html(_t(spark, d, "pages"), "page_id", "html"), "page_id", "text", "HEADING")


@query(
    "h02_fixed_chunks",
    r"""WITH RECURSIVE s AS (SELECT doc_id, regexp_split_to_array(text, '\n{2,}') AS p, regexp_extract_all(text, '\n{2,}') AS g FROM documents WHERE text IS NOT NULL AND text <> ''),
r AS (SELECT doc_id, p, g, 1 AS i, p[1] AS part, CAST(0 AS BIGINT) AS pos, CAST(len(p[1]) AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS done, CAST(NULL AS BIGINT) AS done_at FROM s
UNION ALL SELECT doc_id, p, g, i + 1, CASE WHEN part = '' OR len(part) + len(p[i + 1]) + 2 > 512 THEN p[i + 1] ELSE part || chr(10) || chr(10) || p[i + 1] END,
CASE WHEN part = '' OR len(part) + len(p[i + 1]) + 2 > 512 THEN place + len(g[i]) ELSE pos END, place + len(g[i]) + len(p[i + 1]),
CASE WHEN part <> '' AND len(part) + len(p[i + 1]) + 2 > 512 THEN part END, pos FROM r WHERE i < len(p)),
c AS (SELECT doc_id, i AS k, done AS content, done_at AS start FROM r WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, part, pos FROM r WHERE i = len(p) AND part <> ''),
h AS (SELECT *, left(sha256('fixed|' || start || '|' || content), 16) AS chunk_id FROM c)
SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS chunk_index, chunk_id, CAST(NULL AS VARCHAR) AS parent_id, 'text' AS kind, '' AS header, start, content, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY k)""",
)
def h02(spark, d):
    return chunking.chunk(_t(spark, d, "documents"), "doc_id", "text", "FIX_SIZE")


@query("h04_window_chunks")
def h04(spark, d):
    return chunking.chunk(_t(spark, d, "documents"), "doc_id", "text", "WINDOW")


@query("w14_rank_decay", "SELECT c_custkey, round(100 - (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1) * 2.5, 6) AS score FROM customer")
def w14(spark, d):
    return retrieval.rank_decay(_t(spark, d, "customer"), 100.0, 2.5, ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"]).select("c_custkey", _r("score").alias("score"))


@query("z03_content_filter", r"SELECT page_id, regexp_matches(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), 'tion|ung') AS hit FROM pages WHERE html IS NOT NULL")
def z03(spark, d):
    plain = F.lower(F.regexp_replace("html", "<[^>]*>", " "))
    return _t(spark, d, "pages").where("html is not null").select("page_id", plain.rlike("tion|ung").alias("hit"))


@query("a17_coverage", "SELECT doc_id, count(DISTINCT s) AS n, CASE count(DISTINCT s) WHEN 3 THEN 'complete' WHEN 2 THEN 'acceptable' ELSE 'incomplete' END AS quality FROM (SELECT l_orderkey AS doc_id, l_returnflag AS s FROM lineitem) GROUP BY doc_id")
def a17(spark, d):
    x = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.size(F.collect_set("l_returnflag")).cast("bigint").alias("n"))
    return x.withColumn("quality", F.when(F.col("n") == 3, "complete").when(F.col("n") == 2, "acceptable").otherwise("incomplete"))


@query("w12_cash_roll", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS cash FROM orders")
def w12(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", _r(F.sum("o_totalprice").over(w), 2).alias("cash"))
