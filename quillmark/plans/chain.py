"""Registered queries of the retrieval chain and of small sources and stores beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark import tools
from quillmark.operators import chain, chunking, retrieval, statements
from quillmark.plans.fixtures import fixture
from quillmark.plans.queries import _r, _t, query
from quillmark.plans.sources import put, stated
from quillmark.sources import workbook

_CHUNKS = [
    ("a1", "00700", "2025Q1", "业绩", "一季度营业收入 80 亿元，同比增长 18%。"),
    ("a2", "00700", "2025Q1", "云业务", "云收入稳健增长。"),
    ("b1", "00700", "2025Q2", "业绩", "二季度营业收入 100 亿元，同比增长 25%。"),
    ("b2", "00700", "2025Q2", "成本", "营业成本下降。"),
    ("b3", "00700", "2025Q2", "业绩摘要", "二季度营业收入 100 亿元，同比增长 25%。"),
    ("c1", "BABA", "2025Q2", "业绩", "营业收入 200 亿元。"),
    ("d1", "00700", "2024Q2", "业绩", "营业收入 70 亿元。"),
]


def _chunks(spark):
    return spark.createDataFrame(_CHUNKS, "chunk_id string, ticker string, fiscal_period string, title string, content string")


def _asked(spark, question: str, **options):
    ask = chain.understand(spark, question, **options)
    return chain.run(_chunks(spark), ask).select("place", "chunk_id", "citation")


@stated("q01_chain_latest", "place int, chunk_id string, citation string", [(1, "b1", "[C1] 00700 2025Q2 业绩"), (2, "b2", "[C2] 00700 2025Q2 成本")])
def q01(spark):
    return _asked(spark, "00700 最新财报的营业收入")


@stated("q02_chain_explicit", "place int, chunk_id string, citation string", [(1, "a1", "[C1] 00700 2025Q1 业绩")])
def q02(spark):
    return _asked(spark, "00700 2025Q1 营业收入", k=1)


@stated("q03_chain_year_ago", "place int, chunk_id string, citation string", [(1, "d1", "[C1] 00700 2024Q2 业绩")])
def q03(spark):
    return _asked(spark, "00700 去年同期营业收入")


@stated("q04_chain_greeting", "n bigint", [(0,)])
def q04(spark):
    return _asked(spark, "你好").agg(F.count("*").alias("n"))


@query("f02_full_text", "SELECT doc_id FROM documents WHERE list_has_any(string_split_regex(lower(text), '[^a-z]+'), ['the', 'und', 'les'])")
def f02(spark, d):
    words = F.split(F.lower("text"), "[^a-z]+")
    return _t(spark, d, "documents").where(F.arrays_overlap(words, F.array(F.lit("the"), F.lit("und"), F.lit("les")))).select("doc_id")


_BM = ["the", "of"]
_BM_SQL = ", ".join(f"len(list_filter(w, lambda x: x = '{k}')) AS f{i}" for i, k in enumerate(_BM))


@query(
    "a07_bm25",
    f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, len(w) AS n, {_BM_SQL} FROM d), s AS (SELECT count(*) AS c, avg(n) AS a, {', '.join(f'count(*) FILTER (f{i} > 0) AS d{i}' for i in range(2))} FROM f)
SELECT doc_id, round({' + '.join(f'ln(1 + (c - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (1 - 0.75 + 0.75 * n / a))' for i in range(2))}, 6) AS score FROM f, s WHERE f0 + f1 > 0""",
)
def a07(spark, d):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    docs = _t(spark, d, "documents").where("text is not null").select("doc_id", words.alias("words"))
    return retrieval.bm25(docs, "words", _BM).select("doc_id", _r("score").alias("score"))


_OLD = [("c1", "one", "k", "1"), ("c2", "two", "k", "2"), ("c2", "two", "m", "3"), ("c3", "three", None, None)]
_NEW = [("c2", "TWO", "k", "9"), ("c4", "four", "k", "4")]
_DDL = "chunk_id string, content string, tag string, value string"


@fixture("s23_batch_upsert", _DDL, _OLD, "SELECT * FROM {t} WHERE chunk_id NOT IN (SELECT chunk_id FROM {new}) UNION ALL SELECT * FROM {new}", new=(_DDL, _NEW))
def s23(df, new):
    """Chunks and their tags from parallel arrays, as one batch: rows over rows, tags in place of the old ones."""
    split = lambda x: (x.select("chunk_id", "content").distinct(), x.where("tag is not null").select("chunk_id", "tag", "value"))
    (old_chunks, old_tags), (new_chunks, new_tags) = split(df), split(new)
    packed = new_chunks.agg(F.sort_array(F.collect_list(F.struct("chunk_id", "content"))).alias("x")).select(F.col("x.chunk_id").alias("ids"), F.col("x.content").alias("contents"))
    arrived = packed.select(F.inline(F.arrays_zip("ids", "contents"))).toDF("chunk_id", "content")
    chunks = retrieval.upsert(old_chunks, arrived, ["chunk_id"])
    tags = retrieval.refresh_tags(old_tags, new_tags, arrived, ["chunk_id"])
    return chunks.join(tags, "chunk_id", "left").select("chunk_id", "content", "tag", "value")


@fixture("s22_upsert", "chunk_id string, v int", [("a", 1), ("b", 2)], "SELECT 'a' AS chunk_id, CAST(5 AS INTEGER) AS v UNION ALL SELECT 'b', 2", new=("chunk_id string, v int", [("a", 5)]))
def s22(df, new):
    return retrieval.upsert(df, new, ["chunk_id"]).select("chunk_id", "v")


@query("s27_embeddings", "SELECT doc_id, CAST(64 AS INTEGER) AS size, 1.0::DOUBLE AS norm FROM documents WHERE text IS NOT NULL AND length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0")
def s27(spark, d):
    made = chain.hashed_vectors(_t(spark, d, "documents").where("text is not null"), "doc_id", "text")
    norm = F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6)
    # a text whose signed counts cancel out has no direction; any other vector has length 1
    return made.select("doc_id", F.size("v").alias("size"), F.when(norm == 0, 1.0).otherwise(norm).alias("norm"))


@fixture("s28_search_request", "n int, domains string", [(0, "HTTPS://www.A.com/x,b.org"), (99, ""), (5, "c.net")], "SELECT least(greatest(n, 1), 10) AS n, CASE domains WHEN '' THEN '' WHEN 'c.net' THEN 'c.net' ELSE 'a.com,b.org' END AS domains FROM {t}")
def s28(df):
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "^[a-z]+://", ""), r"^www\.|/.*$", "")
    return df.select(F.least(F.greatest("n", F.lit(1)), F.lit(10)).alias("n"), F.array_join(F.filter(F.transform(F.split("domains", ","), clean), lambda x: x != ""), ",").alias("domains"))


@fixture("s32_cache", "key string, age_days int, body string", [("a", 0, "x"), ("a", 3, "old"), ("b", 8, "stale"), ("c", 6, "y")], "SELECT key, arg_min(body, age_days) AS body FROM {t} WHERE age_days <= 7 GROUP BY key")
def s32(df):
    return statements.latest(df.where("age_days <= 7"), ["key"], -F.col("age_days")).select("key", "body")


@query("s34_paged_history", "SELECT event_id, ts FROM events WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def s34(spark, d):
    from quillmark.operators import market

    # pages of a range of times, side by side
    rows = _t(spark, d, "events").where("event_type = 'view'")
    days = [("2024-01-05 00:00:00", "2024-01-10 00:00:00"), ("2024-01-10 00:00:00.000001", "2024-01-15 00:00:00"), ("2024-01-15 00:00:00.000001", "2024-01-20 00:00:00")]
    pages = [market.between_times(rows, "ts", a, b) for a, b in days]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).select("event_id", "ts")


@fixture(
    "z22_discover",
    "doc string, form_type string, fiscal_year int, processed boolean",
    [("d1", "10-K", 2024, True), ("d2", "10-K", 2024, False), ("d3", "10-Q", 2024, True), ("d4", "10-k", 2020, True), ("d5", "10-K", None, True)],
    "SELECT t.doc, c.content FROM {t} t JOIN {c} c USING (doc) WHERE upper(form_type) = '10-K' AND (fiscal_year IS NULL OR fiscal_year >= 2023)",
    c=("doc string, content string", [("d1", "x"), ("d2", "y"), ("d3", "z"), ("d4", "w"), ("d5", "v")]),
)
def z22(df, c):
    wanted = retrieval.metadata_filter(df.withColumn("fiscal_period", F.lit(None).cast("string")), form_type="10-k", years=(2023, None))
    done, rest = wanted.where("processed").select("doc"), wanted.where("not processed").select("doc")
    return done.unionByName(rest).join(c, "doc").select("doc", "content")  # what isn't processed yet is, by the same chunker


_DISPATCH = [("AUTO", 2), ("HEURISTIC", 2), ("FIX_SIZE", 2), ("HEADING", 3), ("WINDOW", 1)]


@stated("h03_strategies", "strategy string, chunks bigint", _DISPATCH)
def h03(spark):
    text = "# A\n" + "x" * 300 + "\n\n" + "y" * 300
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    out = None
    for name, _ in _DISPATCH:
        part = chunking.chunk(docs, "id", "text", name).agg(F.lit(name).alias("strategy"), F.count("*").alias("chunks"))
        out = part if out is None else out.unionByName(part)
    return out.select("strategy", "chunks")


@stated("w15_sliding_window", "start bigint, size int", [(0, 104), (84, 115), (180, 40)])
def w15(spark):
    body = ("word " * 20 + "end. ") + ("next " * 18 + "stop. ") + "tail " * 4
    docs = spark.createDataFrame([(1, body.strip())], "id int, text string")
    return chunking.chunk(docs, "id", "text", "HEADING", size=100, overlap=20).where("kind = 'child'").select("start", F.length("content").alias("size"))


_FILINGS = {
    f"portfolio/00700/filings/{doc}/{name}": text
    for doc, period, year, revenue, rise in (("2025_Q1", "Q1", 2025, 80, 18), ("2025_Q2", "Q2", 2025, 100, 25))
    for name, text in (
        ("meta.json", f'{{"formType": "6-K", "fiscalYear": {year}, "fiscalPeriod": "{period}", "filingDate": "2025-08-01", "primaryFile": "a.html"}}'),
        ("a.html", f"<h1>公告</h1><h2>业绩</h2><p>营业收入 {revenue} 亿元，同比增长 {rise}%。</p><h2>成本</h2><p>成本下降。</p>"),
    )
}


@stated("t01_build_and_ask", "question string, fiscal_period string, title string, chunks bigint", [("00700 最新财报的营业收入", "2025Q2", "公告 > 业绩", 2), ("00700 2025Q1 的营业收入", "2025Q1", "公告 > 业绩", 2)])
def t01(spark):
    """Two filings are built twice over, then asked; the store holds each chunk once."""
    root = put(spark, _FILINGS)
    for _ in range(2):
        tools.filing_kb_build(spark, f"{root}/portfolio", f"{root}/store")
    held = spark.read.parquet(f"{root}/store").groupBy("fiscal_period").agg(F.count("*").alias("chunks"))
    out = None
    for q in ("00700 最新财报的营业收入", "00700 2025Q1 的营业收入"):
        got = tools.filing_kb_qa(spark, f"{root}/store", q, 1).select(F.lit(q).alias("question"), "fiscal_period", "title").join(held, "fiscal_period")
        out = got if out is None else out.unionByName(got)
    return out.select("question", "fiscal_period", "title", "chunks")


@stated("t02_index_and_ask", "document_id string, title string", [("2", "Cloud")])
def t02(spark):
    store = f"{put(spark, {})}/store"
    docs = spark.createDataFrame([(1, "# Games\nplayers grew strongly"), (2, "# Cloud\ncloud revenue grew"), (3, None)], "id int, text string")
    tools.rag_index(docs, "id", "text", store)
    return tools.rag_qa(spark, store, "cloud revenue", 1).select("document_id", "title")


@stated("z14_filings", "ticker string, document_id string, fiscal_period string", [("00700", "2025_Q1", "2025Q1"), ("00700", "2025_Q2", "2025Q2")])
def z14(spark):
    return tools.lf_filings(spark, put(spark, _FILINGS)).select("ticker", "document_id", "fiscal_period")


@stated("z15_tables_by_type", "label string", [("Revenue",), ("Total revenue",)])
def z15(spark):
    page = "<table><tr><td>Total assets</td><td>5</td></tr></table><table><tr><td>Revenue</td><td>3</td></tr><tr><td>Total revenue</td><td>3</td></tr></table>"
    return tools.lf_extract_table(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html", "income").select("label")


@stated("z13_consensus_files", "ticker string, item string, period string, value double, kind string", [("00700", "revenue", "2026FY", 7.0, "estimate"), ("00700", "eps", "2026FY", None, "estimate"), ("00700", "revenue", "2025FY", 6.0, "actual")])
def z13c(spark):
    root = put(spark, {"00700_consensus.csv": "item,2026FY\nrevenue,7\neps,NaN\n", "other.csv": "item,2026FY\nx,1\n"})
    actual = spark.createDataFrame([("00700", "revenue", "2025FY", 6.0)], "ticker string, item string, period string, value double")
    return tools.lf_consensus(spark, root, actual)


@stated("s37_workbook", "metric string, unit string, period string, value double", [("营业收入", "百万", "2025Q1", 80.5), ("营业收入", "百万", "2024Q1", 70.0), ("成本 & <x>", "百万", "2025Q1", None)])
def s37(spark):
    """A pivoted report written as a workbook and read back as facts."""
    root = put(spark, {})
    ddl = "metric string, unit string, `2025Q1` string, `2024Q1` string"
    report = spark.createDataFrame([("date", "", "2025-03-31", "2024-03-31"), ("营业收入", "百万", "80.5", "70"), ("成本 & <x>", "百万", "-", None)], ddl).coalesce(1)
    workbook.write_workbook(report, f"{root}/HK_00700_income_20250501_080000.xlsx")
    return workbook.statement_facts(workbook.workbooks(spark, root), "path").select("metric", "unit", "period", "value")


@stated("s14_historicals", "metric string, period string, value double, yoy double", [("rev", "2025Q1", 120.0, 20.0), ("rev", "2024Q1", 100.0, None)])
def s14(spark):
    root = put(spark, {})
    rows = spark.createDataFrame([("date", "", "a", "b"), ("rev", "m", "120", "100")], "metric string, unit string, `2025Q1` string, `2024Q1` string").coalesce(1)
    workbook.write_workbook(rows.withColumn("2025Q1", F.lit("1")), f"{root}/HK_00700_income_20250101_000000.xlsx")
    workbook.write_workbook(rows, f"{root}/HK_00700_income_20250501_000000.xlsx")
    return tools.lf_historicals(spark, root).select("metric", "period", "value", "yoy")


@stated("z20_ingest_windows", "document_id string, chunks bigint", [("2025_Q1", 1), ("2025_Q2", 1)])
def z20(spark):
    """The same build with token windows."""
    root = put(spark, _FILINGS)
    return tools.filing_kb_build(spark, f"{root}/portfolio", f"{root}/store", "WINDOW", "00700").select("document_id", "chunks")
