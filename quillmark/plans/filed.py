"""Sources, stores, push streams and the retrieval chain over files and tables made of the benchmark tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain as chained

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark import tools
from quillmark.functions.periods import date_bucket
from quillmark.functions.text import url_host
from quillmark.operators import chain, sections, segments
from quillmark.operators.statements import number
import quillmark.plans.chain  # noqa: F401  (its rules)
from quillmark.plans.fixtures import derived
from quillmark.plans.queries import _r, _t, query
from quillmark.plans.sources import simple_pdf
from quillmark.sources import files, pdf, workbook
from quillmark.sources.shared import dealt, hadoop_path, shared_folder
from quillmark.streaming import pushes


def put_files(df, root: str) -> int:
    """Writes the rows (name, data) as files below ``root``, from the tasks that hold them; gives their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        base = root.replace("file:///", "/").replace("file:/", "/") if root.startswith("file:") else root
        store, base = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = f"{base}/{name}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return df.select("name", F.col("data").cast("binary").alias("data")).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


# --- filings in folders ------------------------------------------------------------------------------


def _filings(spark, d) -> str:
    """portfolio/<ticker>/filings/<document>/ of every supplier: a page, and a meta.json that may lack fields."""
    s = _t(spark, d, "supplier").select(F.format_string("T%05d", "s_suppkey").alias("ticker"), (2018 + F.col("s_suppkey") % 8).alias("year"), F.concat(F.lit("Q"), (1 + F.col("s_nationkey") % 4).cast("string")).alias("quarter"), "s_name", "s_suppkey")
    folder = F.concat(F.lit("portfolio/"), "ticker", F.lit("/filings/"), F.col("year").cast("string"), F.lit("_"), "quarter", F.lit("/"))
    fields = F.struct(
        F.when(F.col("s_suppkey") % 5 > 0, "6-K").alias("formType"), F.col("year").alias("fiscalYear"), F.when(F.col("s_suppkey") % 3 > 0, F.col("quarter")).alias("fiscalPeriod"),
        F.when(F.col("s_suppkey") % 7 > 0, "2025-05-14").alias("filingDate"), F.lit("a.html").alias("primaryFile"),
    )
    meta = s.select(F.concat(folder, F.lit("meta.json")).alias("name"), F.to_json(fields).alias("data"))
    page = s.select(F.concat(folder, F.lit("a.html")).alias("name"), F.concat(F.lit("<html><nav>menu</nav><h1>Report</h1><p>"), "s_name", F.lit(" filed.</p></html>")).alias("data"))
    notes = s.where("s_suppkey % 4 = 0").select(F.concat(folder, F.lit("notes.txt")).alias("name"), F.concat(F.lit("note of "), "s_name").alias("data"))
    root = shared_folder(spark)
    put_files(meta.unionByName(page).unionByName(notes), root)
    return root


_TICKER, _DOC, _QUARTER = "'T' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0')", "(2018 + s_suppkey % 8) || '_Q' || (1 + s_nationkey % 4)", "'Q' || (1 + s_nationkey % 4)"


@query("s01_routed", f"SELECT {_TICKER} || '/a.html' AS name, '# Report' || chr(10) || chr(10) || s_name || ' filed.' AS text FROM supplier UNION ALL SELECT {_TICKER} || '/notes.txt', 'note of ' || s_name FROM supplier WHERE s_suppkey % 4 = 0")
def s01(spark, d):
    """Every file by the reader of its suffix."""
    got = files.as_text(files.routed(spark, _filings(spark, d)).where("suffix <> 'json'"))
    return got.select(F.concat(F.regexp_extract("path", "/portfolio/([^/]+)/", 1), F.lit("/"), F.element_at(F.split("path", "/"), -1)).alias("name"), "text")


@query("s06_filing_scan", f"SELECT {_TICKER} AS ticker, {_DOC} AS document_id, 'html' AS suffix FROM supplier")
def s06(spark, d):
    return files.documents(spark, _filings(spark, d)).select("ticker", "document_id", "suffix")


@query("s08_metadata", f"SELECT {_TICKER} AS ticker, {_DOC} AS document_id, {_QUARTER} AS period, CAST(2018 + s_suppkey % 8 AS INTEGER) AS year FROM supplier")
def s08(spark, d):
    """Periods that meta.json lacks come from the folder's name."""
    return files.metadata(spark, _filings(spark, d)).select("ticker", "document_id", F.col("fiscalPeriod").alias("period"), F.col("fiscalYear").alias("year"))


@query("s09_complete", f"SELECT {_TICKER} AS ticker, {_DOC} AS document_id FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 7 > 0")
def s09(spark, d):
    return files.complete_filings(files.metadata(spark, _filings(spark, d))).select("ticker", "document_id")


@query("s41_incomplete", "SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN s_suppkey % 5 = 0 THEN 'no formType' END, CASE WHEN s_suppkey % 7 = 0 THEN 'no filingDate' END]) AS reason FROM supplier) WHERE reason IS NOT NULL GROUP BY reason")
def s41(spark, d):
    """How many filings lack which field."""
    return files.incomplete_reasons(files.metadata(spark, _filings(spark, d))).select("reason", "n")


@query(
    "s11_latest_versions",
    "SELECT 'HK' AS market, CAST(o_custkey AS VARCHAR) AS ticker, CASE o_orderstatus WHEN 'O' THEN 'income' WHEN 'F' THEN 'balance' ELSE 'cashflow' END AS statement, strftime(max(o_orderdate), '%Y%m%d') AS day FROM orders GROUP BY ALL",
)
def s11(spark, d):
    """The latest workbook of every customer and statement, by the date in its name."""
    kind = F.when(F.col("o_orderstatus") == "O", "income").when(F.col("o_orderstatus") == "F", "balance").otherwise("cashflow")
    paths = _t(spark, d, "orders").select(F.concat(F.lit("/x/HK_"), F.col("o_custkey").cast("string"), F.lit("_"), kind, F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_080000.xlsx")).alias("path"))
    return files.latest_versions(paths).select("market", "ticker", "statement", F.regexp_extract("path", r"_(\d{8})_\d+\.xlsx$", 1).alias("day"))


@query("s12_latest_by_pattern", "SELECT lower(o_orderstatus) AS key, strftime(max(o_orderdate), '%Y%m%d') AS mark FROM orders GROUP BY 1")
def s12(spark, d):
    paths = _t(spark, d, "orders").select(F.concat(F.lower("o_orderstatus"), F.lit("-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".csv")).alias("path"))
    return files.latest_by(paths, r"([a-z]+)-(\d{8})\.csv$").select("key", F.regexp_extract("path", r"(\d{8})", 1).alias("mark"))


@query("s13_fresh", "SELECT user_id AS key, max(event_id) AS newest FROM events WHERE ts = (SELECT max(ts) FROM events e WHERE e.user_id = events.user_id) AND ts >= TIMESTAMP '2024-01-30' GROUP BY user_id")
def s13(spark, d):
    """The newest of each key, if not too old."""
    rows = _t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("modified"), F.col("event_id").alias("path"))
    return files.fresh(rows, ["key"], F.expr("timestamp_ntz'2024-01-31 00:00:00'"), "1 days").select("key", F.col("path").alias("newest"))


# --- PDF and HTML ------------------------------------------------------------------------------------


#: Pages of a volume of a nation's customers, so a file is of one size however many there are. Fixed value.
VOLUME = 50


def _pdfs(spark, d) -> str:
    """PDFs of every nation, a volume for each ``VOLUME`` pages: a title, then its customers' table over pages of 40 rows."""
    balance = F.format_string("%.2f", "c_acctbal").alias("balance")
    at = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey", "c_mktsegment", balance)) - 1
    volume = F.floor(at / (40 * VOLUME)).alias("volume")
    rows = _t(spark, d, "customer").select(F.col("c_nationkey").alias("n"), volume, F.struct("c_custkey", "c_mktsegment", balance).alias("r"))
    rows = dealt(rows.groupBy(F.format_string("n%d-%d.pdf", "n", "volume").alias("name")).agg(F.array_sort(F.collect_list("r")).alias("rows")), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, own in zip(b.column(0), b.column(1)):
                lines = [f"{r['c_custkey']}\t{r['c_mktsegment']}\t{r['balance']}" for r in own.as_py()]
                pages = [["Item 1. Customers", "Key\tSegment\tBalance", *lines[k : k + 40]] for k in range(0, len(lines), 40)]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.string()), pa.array([simple_pdf(pages)], pa.binary())], ["name", "data"])

    root = shared_folder(spark)
    put_files(rows.mapInArrow(run, "name string, data binary"), root)
    return root


@query("s17_pdf_tables", "SELECT c_nationkey AS n, CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment FROM customer")
def s17(spark, d):
    """Tables of PDF pages, back as rows."""
    cells = workbook.pdf_tables(spark, _pdfs(spark, d)).where("row > 1")
    one = lambda k: F.max(F.when(F.col("col") == k, F.col("value")))
    rows = cells.groupBy("path", "sheet", "row").agg(one(1).alias("key"), one(2).alias("segment"))
    return rows.select(F.regexp_extract("path", r"n(\d+)-\d+\.pdf$", 1).cast("int").alias("n"), "key", "segment")


@query(
    "s05_page_sections",
    "SELECT c_nationkey AS n, k // 40 + 1 AS page, count(*) AS customers FROM (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer) GROUP BY ALL",
)
def s05(spark, d):
    """Titled parts of PDF pages, with the page they begin on and what they hold."""
    found = spark.read.format("binaryFile").load(_pdfs(spark, d))
    parts = sections.sections(found, "path", "content", lambda data: sections.page_sections(pdf.pages(data))).where("title is not null")
    lines = F.size(F.filter(F.split("content", "\n"), lambda x: x.rlike(r"^\d")))
    first = F.regexp_extract("path", r"-(\d+)\.pdf$", 1).cast("bigint") * VOLUME
    return parts.select(F.regexp_extract("path", r"n(\d+)-\d+\.pdf$", 1).cast("int").alias("n"), (first + F.col("page")).alias("page"), lines.cast("bigint").alias("customers"))


@query("s18_pdf_table_facts", "SELECT CAST(c_custkey AS VARCHAR) AS metric, 'Balance' AS period, c_acctbal AS value FROM customer")
def s18(spark, d):
    """Facts of tables in PDF pages: names from the first column, periods from the head."""
    cells = workbook.pdf_tables(spark, _pdfs(spark, d))
    head = cells.where("row = 1 and col > 1").select("path", "sheet", "col", F.col("value").alias("period"))
    name = cells.where("row > 1 and col = 1").select("path", "sheet", "row", F.col("value").alias("metric"))
    body = cells.where("row > 1 and col > 1").join(head, ["path", "sheet", "col"]).join(name, ["path", "sheet", "row"])
    return body.where("period = 'Balance'").select("metric", "period", number(F.col("value")).alias("value"))


@query("s03_pdf_text", "SELECT c_nationkey AS n, count(*) AS lines, CAST(ceil(count(*) / 40.0) AS BIGINT) AS headings, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1")
def s03(spark, d):
    """PDF files as marked text: a heading a page, a line a row."""
    text = files.as_text(files.routed(spark, _pdfs(spark, d)))
    line = F.split("text", "\n")
    rows = F.filter(line, lambda x: x.rlike(r"^\d+\s"))
    keys = F.aggregate(F.transform(rows, lambda x: F.regexp_extract(x, r"^(\d+)", 1).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    volumes = text.select(F.regexp_extract("path", r"n(\d+)-\d+\.pdf$", 1).cast("int").alias("n"), F.size(rows).alias("lines"), F.size(F.filter(line, lambda x: x == "## Item 1. Customers")).alias("headings"), keys.alias("keys"))
    return volumes.groupBy("n").agg(*(F.sum(c).alias(c) for c in ("lines", "headings", "keys")))


_LINES = "(SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k, CAST(l_partkey AS VARCHAR) AS part, printf('%.2f', l_extendedprice) AS price FROM lineitem)"


def _tables(spark, d):
    """An order's lines as an HTML table: id, html."""
    row = F.concat(F.lit("<tr><td>"), F.col("l_partkey").cast("string"), F.lit("</td><td>"), F.format_string("%.2f", "l_extendedprice"), F.lit("</td></tr>"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", row.alias("r"))
    rows = dealt(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"), "l_orderkey")
    rows = rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["r"]), "").alias("r"))
    return rows.select("id", F.concat(F.lit("<p>before</p><table><tr><th>Part</th><th>Price</th></tr>"), "r", F.lit("</table><table><tr><td>single</td></tr></table>")).alias("html"))


@query("s16_html_tables", f"SELECT id, CAST(k + 1 AS INTEGER) AS row, part, price FROM {_LINES} UNION ALL SELECT DISTINCT l_orderkey, 1, 'Part', 'Price' FROM lineitem")
def s16(spark, d):
    """Tables of two columns or more of HTML pages."""
    cells = workbook.html_tables(_tables(spark, d), "id", "html")
    one = lambda k: F.max(F.when(F.col("col") == k, F.col("value")))
    return cells.groupBy("id", "sheet", "row").agg(one(1).alias("part"), one(2).alias("price")).select("id", F.col("row").cast("int").alias("row"), "part", "price")


@query("s04_html_sections", "SELECT o_orderkey AS id, place::INTEGER AS place, title, content FROM orders, LATERAL (VALUES (0, NULL, 'Before ' || o_orderpriority || '.'), (1, 'Status ' || o_orderstatus, 'Customer ' || o_custkey || '.'), (2, 'Item 1. Dates', 'Ordered on ' || strftime(o_orderdate, '%Y-%m-%d') || '.')) AS v(place, title, content)")
def s04(spark, d):
    """Titled parts of HTML pages, by headings and bold lines."""
    html = F.concat(
        F.lit("<html><head><title>x</title></head><body><nav>menu</nav><p>Before "), "o_orderpriority", F.lit(".</p><h2>Status "), "o_orderstatus", F.lit("</h2><p>Customer   "), F.col("o_custkey").cast("string"),
        F.lit(".</p><p><b>Item 1. Dates</b></p><div>Ordered on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".</div><script>var x;</script></body></html>"),
    )
    return sections.sections(dealt(_t(spark, d, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("id"), html.alias("html")), "id", "html").select("id", "place", "title", "content")


# --- segment tables of filings -----------------------------------------------------------------------

_SUMS = "(SELECT c_nationkey AS id, c_mktsegment AS segment, CAST(floor(sum(abs(c_acctbal))) AS BIGINT) AS a, CAST(count(*) AS BIGINT) AS b FROM customer GROUP BY 1, 2)"


def _segment_pages(spark, d):
    """A nation's filing: a table of market segments with amounts and counts as two years' quarters, and a total."""
    c = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("segment")).agg(F.floor(F.sum(F.abs("c_acctbal"))).alias("a"), F.count("*").alias("b"))
    cell = lambda x: F.concat(F.lit("<td>"), F.format_number(x, 0), F.lit("</td>"))
    row = F.concat(F.lit('<tr><td style="padding-left:12px">'), F.initcap("segment"), F.lit("</td>"), cell(F.col("a")), cell(F.col("b")), F.lit("</tr>"))
    rows = c.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", row.alias("r")))), lambda x: x["r"]), "").alias("r"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    head = "<p>(In millions of RMB)</p><table><tr><td></td><td colspan=2>Three Months Ended June 30,</td></tr><tr><td></td><td>2025</td><td>2024</td></tr><tr><td><b>Revenue</b></td><td></td><td></td></tr>"
    return rows.select("id", F.concat(F.lit(head), "r", F.lit("<tr><td>Total</td>"), cell(F.col("a")), cell(F.col("b")), F.lit("</tr></table>")).alias("html"))


def _segment_config(spark, d):
    return _t(spark, d, "customer").select(F.col("c_mktsegment").alias("code"), F.initcap("c_mktsegment").alias("name"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent")).distinct()


@query("s19_financial_tables", f"SELECT id, upper(segment) AS label, 1::INTEGER AS indent, false AS total, a, b FROM {_SUMS} UNION ALL SELECT id, 'TOTAL', 0, true, CAST(sum(a) AS BIGINT), CAST(sum(b) AS BIGINT) FROM {_SUMS} GROUP BY id")
def s19(spark, d):
    """Rows of a filing's table with their indents, totals and numbers."""
    rows = segments.financial_tables(_segment_pages(spark, d), "id", "html").withColumn("v", F.transform(F.filter("cells", lambda x: x != ""), number))
    rows = rows.where((F.size("v") == 2) & (F.col("label") != ""))
    return rows.select("id", F.upper("label").alias("label"), "indent", "total", F.col("v")[0].cast("bigint").alias("a"), F.col("v")[1].cast("bigint").alias("b"))


@query("h06_row_facts", f"SELECT id, segment, 'REVENUE' AS metric, p AS period, CAST(CASE p WHEN '2025Q2' THEN a ELSE b END AS DOUBLE) AS value FROM {_SUMS}, (VALUES ('2025Q2'), ('2024Q2')) v(p)")
def h06(spark, d):
    """Facts of tables with segments as rows: segment, metric, period, value."""
    rows, on = segments.financial_tables(_segment_pages(spark, d), "id", "html"), ["id", "sheet"]
    facts = segments.row_facts(rows, segments.period_sequence(rows, on), segments.labelled(rows, _segment_config(spark, d), on), [("REVENUE", "^revenue")], on)
    return facts.select("id", "segment", "metric", "period", "value")


@query("h08_period_sequence", "SELECT DISTINCT c_nationkey AS id, p AS period FROM customer, (VALUES ('2025Q2'), ('2024Q2')) v(p)")
def h08(spark, d):
    """The periods that a table's columns stand for."""
    return segments.period_sequence(segments.financial_tables(_segment_pages(spark, d), "id", "html"), ["id", "sheet"]).select("id", "period").distinct()


@query("h09_by_config", f"SELECT id, segment AS code FROM {_SUMS}")
def h09(spark, d):
    """The first row of every configured segment."""
    return segments.by_config(segments.financial_tables(_segment_pages(spark, d), "id", "html"), _segment_config(spark, d), ["id", "sheet"]).select("id", "code")


@query("h09_by_indent", f"SELECT id, upper(segment) AS label, 2::INTEGER AS level FROM {_SUMS}")
def h09i(spark, d):
    """Labels that may be segments, by their indents."""
    return segments.by_indent(segments.financial_tables(_segment_pages(spark, d), "id", "html"), ["id", "sheet"]).select("id", F.upper("label").alias("label"), "level")


@query(
    "h07_column_facts",
    """SELECT o_orderkey AS id, segment, metric, '2025Q3' AS period, CAST(CASE segment WHEN 'VAS' THEN o_custkey ELSE o_orderkey + 1 END * CASE metric WHEN 'REVENUE' THEN 1 ELSE -2 END AS DOUBLE) AS value
FROM orders, (VALUES ('VAS'), ('ADS')) v(segment), (VALUES ('REVENUE'), ('PROFIT')) w(metric) WHERE o_orderkey % 5 > 0""",
)
def h07(spark, d):
    """Facts of text tables with segments as columns, where these add up to the total."""
    a, b = F.col("o_custkey"), F.col("o_orderkey") + 1
    total = a + b + F.when(F.col("o_orderkey") % 5 == 0, a + b + 10).otherwise(0)
    line = lambda k, form: F.format_string(form, a * k, b * k, total * k)
    text = F.concat(F.lit("Segment results\n"), line(1, "  %d   %d   %d\n"), line(2, "  (%d)   (%d)   (%d)\n"), F.lit("note 5  text\n"), line(3, "  %d  %d  %d"))
    lines = segments.line_cells(_t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text")), "id")
    return segments.column_facts(lines, ["id"], ["VAS", "ADS", "TOTAL"], ["REVENUE", "PROFIT"], "2025Q3", "TOTAL").select("id", "segment", "metric", "period", "value")


@query("z15_tables_by_type", "SELECT o_orderkey AS id, 'Revenue' AS label FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'Total revenue' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")
def z15(spark, d):
    """The rows of a page's income tables."""
    own = F.col("o_orderkey").cast("string")
    income = F.concat(F.lit("<table><tr><td>Revenue</td><td>"), own, F.lit("</td></tr>"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<tr><td>Total revenue</td><td>"), own, F.lit("</td></tr>"))).otherwise(""), F.lit("</table>"))
    html = F.concat(F.lit("<table><tr><td>Total assets</td><td>"), own, F.lit("</td></tr></table>"), F.when(F.col("o_orderkey") % 2 == 0, income).otherwise(""))
    orders = dealt(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return tools.lf_extract_table(orders.select(F.col("o_orderkey").alias("id"), html.alias("html")), "id", "html", "income").select("id", "label")


@query("z14_filings", f"SELECT {_TICKER} AS ticker, {_DOC} AS document_id, (2018 + s_suppkey % 8) || {_QUARTER} AS fiscal_period FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 7 > 0")
def z14(spark, d):
    """Filings of a folder that are whole, with their canonical periods."""
    return tools.lf_filings(spark, _filings(spark, d)).select("ticker", "document_id", "fiscal_period")


# --- stores and sinks --------------------------------------------------------------------------------


def _chunk_table(spark, d):
    return _t(spark, d, "documents").where("source is not null and lang is not null").select(F.col("lang").alias("ticker"), F.col("source").alias("document_id"), F.col("doc_id").alias("chunk"), F.col("text").alias("content"))


_KEPT = "documents WHERE source IS NOT NULL AND lang IS NOT NULL"


@query("s21_chunk_store", f"SELECT lang AS ticker, source AS document_id, doc_id AS chunk, CASE WHEN source IN ('src1', 'src2') THEN 'new' ELSE text END AS content FROM {_KEPT}")
def s21(spark, d):
    """Two sources' chunks are saved anew; the others' files stay."""
    path, rows = f"{shared_folder(spark)}/chunks", _chunk_table(spark, d)
    files.save_chunks(rows, path)
    files.save_chunks(rows.where("document_id IN ('src1', 'src2')").withColumn("content", F.lit("new")), path)
    return files.chunk_store(spark, path).select("ticker", "document_id", "chunk", "content")


@query("s20_chunk_load", f"SELECT source AS document_id, doc_id AS chunk FROM {_KEPT} AND lang = 'en' AND source = 'src3'")
def s20(spark, d):
    """One document's chunks, from its folder alone."""
    path = f"{shared_folder(spark)}/chunks"
    files.save_chunks(_chunk_table(spark, d), path)
    return files.load_chunks(spark, path, "en", "src3").select("document_id", "chunk")


@query("s36_json_sink", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s36(spark, d):
    path = f"{shared_folder(spark)}/json"
    rows = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    files.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query(
    "s15_csv_layouts",
    "SELECT 'wide' AS layout, p_name || ' ' || p_partkey AS item, p AS period, CAST(CASE p WHEN '2025Q1' THEN p_size * 1000 ELSE -p_size END AS DOUBLE) AS value FROM part, (VALUES ('2025Q1'), ('2024FY')) v(p) UNION ALL SELECT 'long', 'revenue', '20' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || 'FY', CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_nationkey * 10 AS DOUBLE) END FROM nation",
)
def s15(spark, d):
    """Statement CSVs, GBK with periods as columns and UTF-8 with a period column: files a brand, and one of nations."""
    line = F.concat(F.lit('营业,"'), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit('","'), F.format_number(F.col("p_size") * 1000, 0), F.lit('",('), F.col("p_size").cast("string"), F.lit(")"))
    wide = _t(spark, d, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 200_000).alias("k")).agg(F.array_join(F.array_sort(F.collect_list(F.regexp_replace(line, "^营业,", ""))), "\n").alias("r"))
    wide = wide.select(F.concat(F.lit("wide-"), F.regexp_replace("p_brand", "#", ""), F.lit("-"), F.col("k").cast("string"), F.lit(".csv")).alias("name"), F.concat(F.lit("项目,2025Q1,2024FY\n"), "r").alias("data"))

    def gbk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.string()), pa.array([text.as_py().encode("gbk")], pa.binary())], ["name", "data"])

    wide = wide.mapInArrow(gbk, "name string, data binary")
    n = F.col("n_nationkey")
    row = F.concat(F.lit("20"), F.lpad(n.cast("string"), 2, "0"), F.lit("FY,"), F.when(n % 3 > 0, (n * 10).cast("string")).otherwise("N/A"))
    long = _t(spark, d, "nation").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("r")).select(F.lit("long.csv").alias("name"), F.encode(F.concat(F.lit("period,revenue\n"), "r"), "UTF-8").alias("data"))
    root = shared_folder(spark)
    put_files(wide.unionByName(long), root)
    return files.statement_csvs(spark, root).select(F.regexp_extract("path", r"/(wide|long)[^/]*\.csv$", 1).alias("layout"), "item", "period", "value")


@query("s29_web_results", "SELECT page_id, lower(regexp_extract(url, '://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, 'text ' || page_id AS content FROM pages WHERE url IS NOT NULL")
def s29(spark, d):
    """Result lists of two providers, in one form."""
    p = _t(spark, d, "pages").where("url is not null")
    text = F.concat(F.lit("text "), F.col("page_id").cast("string"))
    item = lambda name: F.array(F.struct(F.col("page_id").cast("string").alias("title"), "url", text.alias(name)))
    one = F.to_json(F.struct(F.struct(item("description").alias("results")).alias("web")))
    raw = p.select(F.when(F.col("page_id") % 2 == 0, one).otherwise(F.to_json(F.struct(item("content").alias("results")))).alias("value"))
    path = f"{shared_folder(spark)}/results"
    raw.write.text(path)
    kind = "struct<title:string,url:string,description:string,content:string>"
    x = F.from_json("value", f"struct<web:struct<results:array<{kind}>>,results:array<{kind}>>")
    rows = spark.read.text(path).select(F.inline(F.coalesce(x["web"]["results"], x["results"])))
    return rows.select(F.col("title").cast("bigint").alias("page_id"), url_host(F.col("url")).alias("host"), F.coalesce("description", "content").alias("content"))


@query("s31_macro_reports", "SELECT strftime(o_orderdate, '%Y-%m') AS period, round(arg_max(o_totalprice, o_orderkey), 6) AS value FROM orders GROUP BY 1")
def s31(spark, d):
    """Reports of an indicator, a file a status: rows by date, the first of a month counts."""
    row = F.struct((-F.col("o_orderkey")).alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd 00:00:00").alias("REPORT_DATE"), F.col("o_totalprice").alias("NATIONAL_SAME"))
    o = _t(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    made = o.groupBy("month").agg(F.array_sort(F.collect_list(row)).alias("data")).select(F.to_json(F.struct(F.struct(F.transform("data", lambda x: F.struct(x["REPORT_DATE"].alias("REPORT_DATE"), x["NATIONAL_SAME"].alias("NATIONAL_SAME"))).alias("data")).alias("result"))).alias("value"))
    path = f"{shared_folder(spark)}/macro"
    made.write.text(path)
    rows = spark.read.text(path).select(F.from_json("value", "struct<result:struct<data:array<struct<REPORT_DATE:string,NATIONAL_SAME:double>>>>")["result"]["data"].alias("d")).select(F.posexplode("d").alias("place", "x"))
    month = date_bucket(F.to_date(F.substring("x.REPORT_DATE", 1, 10)), "month")
    return rows.groupBy(month.alias("period")).agg(_r(F.min_by("x.NATIONAL_SAME", "place")).alias("value"))


# --- push streams ------------------------------------------------------------------------------------


#: Triggers of a stream over files of messages, at most.
TRIGGERS = 4


def _pushed(spark, d, messages, rows_of):
    """The rows of a stream over files of messages, read to their end."""
    root = shared_folder(spark)
    messages.select("value").write.text(f"{root}/in")
    path, fs = hadoop_path(spark, f"{root}/in")
    # as many triggers however large the table is, so that a trigger's files keep all cores busy
    each = max(4, -(-len(fs.listStatus(path)) // TRIGGERS))
    made = rows_of(spark.readStream.option("maxFilesPerTrigger", each).text(f"{root}/in"))
    pushes.consume(made, f"{root}/out")
    return spark.read.schema(made.schema).parquet(f"{root}/out/rows")


def _envelope(kind: str, *fields):
    return F.to_json(F.struct(F.lit(kind).alias("type"), F.array(F.struct(*fields)).alias("data"))).alias("value")


def _mixed(spark, d):
    """Messages of three types, a message an event, and some that are none."""
    e = _t(spark, d, "events")
    code = F.concat(F.lit("US."), F.col("user_id").cast("string")).alias("code")
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time")
    quote = _envelope("QUOTE", code, F.col("value").alias("last_price"), F.col("event_id").alias("volume"))
    tick = _envelope("TICKER", code, time, F.col("value").alias("price"), F.lit(1).alias("volume"), F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("ticker_direction"))
    minute = _envelope("RT_DATA", code, time, F.col("value").alias("cur_price"), F.col("event_id").alias("volume"))
    return e.where("event_type = 'view'").select(quote).unionByName(e.where("event_type = 'click'").select(tick)).unionByName(e.where("event_type = 'purchase'").select(minute)).unionByName(e.where("event_type = 'error'").select(F.lit("not json").alias("value")))


@query("r04_quote_push", "SELECT 'US.' || user_id AS code, value AS last_price, event_id AS volume FROM events WHERE event_type = 'view'")
def r04(spark, d):
    return _pushed(spark, d, _mixed(spark, d), lambda m: pushes.rows_of(m, "QUOTE")).select("code", "last_price", "volume")


@query("r05_tick_push", "SELECT 'US.' || user_id AS code, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, value AS price, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS ticker_direction FROM events WHERE event_type = 'click'")
def r05(spark, d):
    return _pushed(spark, d, _mixed(spark, d), lambda m: pushes.rows_of(m, "TICKER")).select("code", "time", "price", "ticker_direction")


@query("r07_intraday_push", "SELECT 'US.' || user_id AS code, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, value AS cur_price, event_id AS volume FROM events WHERE event_type = 'purchase'")
def r07(spark, d):
    return _pushed(spark, d, _mixed(spark, d), lambda m: pushes.rows_of(m, "RT_DATA")).select("code", "time", "cur_price", "volume")


def _books(spark, d, kind: str, bid: str, ask: str, entry):
    """Two-sided messages of every order: its even lines bid, its odd lines ask."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    rows = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("rows"))
    side = lambda k, name: F.transform(F.filter("rows", lambda x: x["l_linenumber"] % 2 == k), entry).alias(name)
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.col("l_orderkey").cast("string").alias("code"), F.struct(side(0, bid), side(1, ask)).alias("data"))).alias("value"))


_LEVELS = "SELECT CAST(l_orderkey AS VARCHAR) AS code, CASE l_linenumber % 2 WHEN 0 THEN 'bid' ELSE 'ask' END AS side, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS INTEGER) AS level, {} FROM lineitem"


@query("r06_order_book_push", _LEVELS.format("l_extendedprice AS price, CAST(l_quantity AS BIGINT) AS volume"))
def r06(spark, d):
    entry = lambda x: F.struct(x["l_extendedprice"].alias("price"), x["l_quantity"].cast("bigint").alias("volume"), F.lit(1).alias("orders"))
    return _pushed(spark, d, _books(spark, d, "ORDER_BOOK", "Bid", "Ask", entry), pushes.order_book).select("code", "side", "level", "price", "volume")


@query("r08_broker_push", _LEVELS.format("CAST(l_suppkey AS BIGINT) AS broker_id"))
def r08(spark, d):
    entry = lambda x: F.struct(x["l_suppkey"].alias("broker_id"), F.lit("b").alias("broker_name"))
    return _pushed(spark, d, _books(spark, d, "BROKER", "bid_broker_list", "ask_broker_list", entry), pushes.broker_queue).select("code", "side", "level", "broker_id")


@query("r09_option_push", "SELECT 'US.' || o_custkey AS owner_code, 'C' || o_orderkey AS option_code, o_orderpriority AS message FROM orders")
def r09(spark, d):
    o = _t(spark, d, "orders")
    fields = F.struct(F.concat(F.lit("US."), F.col("o_custkey").cast("string")).alias("owner_code"), F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("option_code"), F.col("o_orderpriority").alias("message"))
    return _pushed(spark, d, o.select(F.to_json(F.struct(F.lit("OPTION_EVENT").alias("type"), fields.alias("data"))).alias("value")), pushes.option_events)


@query("r10_bounded_run", "SELECT count(*) AS messages FROM events WHERE event_type <> 'signup'")
def r10(spark, d):
    """A run that is ended by the clock, and one that goes on from its state."""
    root = shared_folder(spark)
    _mixed(spark, d).write.text(f"{root}/in")
    stream = spark.readStream.option("maxFilesPerTrigger", 2).text(f"{root}/in")
    pushes.consume(stream, f"{root}/out", seconds=0.5)
    pushes.consume(stream, f"{root}/out")
    return spark.read.schema("value string").parquet(f"{root}/out/rows").agg(F.count("*").alias("messages"))


def _log(spark, d, last: bool):
    """A log of subscriptions: what users did to the types of their events; an error ends all if ``last``."""
    e = _t(spark, d, "events")
    action = F.when(F.col("event_type").isin("view", "click", "purchase"), "subscribe").when(F.col("event_type") == "signup", "unsubscribe")
    action = F.coalesce(action, F.lit("unsubscribe_all" if last else "unsubscribe"))
    return e.select(F.col("event_id").cast("int").alias("n"), action.alias("action"), F.array(F.col("user_id").cast("string")).alias("codes"), F.array(F.lit("QUOTE"), F.concat(F.lit("K_"), (F.col("event_id") % 3).cast("string"))).alias("subtypes"), (F.col("event_id") % 2 == 0).alias("first_push"), (F.col("event_id") % 5 == 0).alias("extended"))


_ACTS = """WITH a AS (SELECT event_id AS n, event_type, CAST(user_id AS VARCHAR) AS code, unnest(['QUOTE', 'K_' || event_id % 3]) AS subtype FROM events{keep}),
l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY code, subtype ORDER BY n DESC) = 1)
SELECT code, subtype{more} FROM l WHERE event_type IN ('view', 'click', 'purchase'){where}"""


@query("r01_subscriptions", _ACTS.format(keep="", more=", n % 2 = 0 AS first_push, n % 5 = 0 AS extended", where=""))
def r01(spark, d):
    return pushes.subscriptions(_log(spark, d, False)).select("code", "subtype", "first_push", "extended")


@query("r02_unsubscribe_all", _ACTS.format(keep=" WHERE event_type <> 'error'", more="", where=" AND n > (SELECT max(event_id) FROM events WHERE event_type = 'error')"))
def r02(spark, d):
    return pushes.subscriptions(_log(spark, d, True)).select("code", "subtype")


# --- the chain over documents ------------------------------------------------------------------------

_PERIODS = "(2018 + doc_id % 8) || 'Q' || (1 + (doc_id // 8) % 4)"


def _chain_chunks(spark, d):
    ticker = F.when(F.col("doc_id") % 3 == 0, "00700").when(F.col("doc_id") % 3 == 1, "BABA").otherwise("MSFT")
    period = F.concat((2018 + F.col("doc_id") % 8).cast("string"), F.lit("Q"), (1 + F.floor(F.col("doc_id") / 8) % 4).cast("string"))
    return _t(spark, d, "documents").where("text is not null").select(F.format_string("%08d", "doc_id").alias("chunk_id"), ticker.alias("ticker"), period.alias("fiscal_period"), F.col("source").alias("title"), F.col("text").alias("content"))


def _chain_sql(where: str, terms: list[str], k: int = 5) -> str:
    n = range(len(terms))
    count = lambda x, t: f"CAST((len({x}) - len(replace({x}, '{t}', ''))) / {len(t)} AS BIGINT)"
    cols = ", ".join(f"{count('t', w)} AS t{i}, {count('c', w)} AS c{i}" for i, w in enumerate(terms))
    df = ", ".join(f"greatest(count(*) FILTER (t{i} > 0), count(*) FILTER (c{i} > 0)) AS d{i}" for i in n)
    w = "(3.0 * t{i} / (1 - 0.35 + 0.35 * coalesce(lt / nullif(avt, 0), 0)) + 1.0 * c{i} / (1 - 0.75 + 0.75 * coalesce(lc / nullif(avc, 0), 0)))"
    raw = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * 2.2 * {w.format(i=i)} / (1.2 + {w.format(i=i)})" for i in n)
    return f"""WITH x AS (SELECT printf('%08d', doc_id) AS chunk_id, CASE doc_id % 3 WHEN 0 THEN '00700' WHEN 1 THEN 'BABA' ELSE 'MSFT' END AS ticker, {_PERIODS} AS fiscal_period, source AS title, text AS content FROM documents WHERE text IS NOT NULL),
y AS (SELECT * FROM x WHERE {where}), b0 AS (SELECT *, lower(coalesce(title, '')) AS t, lower(content) AS c FROM y), b1 AS (SELECT *, len(t) AS lt, len(c) AS lc, {cols} FROM b0),
b2 AS (SELECT count(*) AS n, avg(lt) AS avt, avg(lc) AS avc, {df} FROM b1), b3 AS (SELECT b1.*, tanh(({raw}) / 5) AS score, {raw} AS raw FROM b1, b2),
b4 AS (SELECT * FROM b3 WHERE raw > 0.01 ORDER BY score DESC, chunk_id LIMIT {3 * k}),
b5 AS (SELECT * FROM b4 QUALIFY row_number() OVER (PARTITION BY content ORDER BY score DESC, chunk_id) = 1), b6 AS (SELECT * FROM b5 ORDER BY score DESC, chunk_id LIMIT {k})
SELECT CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS place, chunk_id, '[C' || row_number() OVER (ORDER BY score DESC, chunk_id) || '] ' || ticker || ' ' || fiscal_period || coalesce(' ' || title, '') AS citation FROM b6"""


def _asked(spark, d, question):
    return chain.run(_chain_chunks(spark, d), chain.understand(spark, question)).select("place", "chunk_id", "citation")


@query("q01_chain_latest", _chain_sql("ticker = '00700' AND fiscal_period = (SELECT max(fiscal_period) FROM x WHERE ticker = '00700')", ["最新", "新财", "财报", "最新财", "新财报", "最新财报", "00700", "the"]))
def q01(spark, d):
    """A question about the latest period of a ticker."""
    return _asked(spark, d, "00700 最新财报 the")


@query("q02_chain_explicit", _chain_sql("ticker = 'BABA' AND fiscal_period = '2021Q2'", ["baba", "2021q2", "ing"]))
def q02(spark, d):
    return _asked(spark, d, "BABA 2021Q2 ing")


@query("q03_chain_year_ago", _chain_sql("ticker = '00700' AND fiscal_period = (SELECT CAST(CAST(substr(max(fiscal_period), 1, 4) AS INTEGER) - 1 AS VARCHAR) || substr(max(fiscal_period), 5) FROM x WHERE ticker = '00700')", ["去年", "年同", "同期", "去年同", "年同期", "去年同期", "00700", "the"]))
def q03(spark, d):
    return _asked(spark, d, "00700 去年同期 the")


@query("q04_chain_greeting", "SELECT count(*) AS n FROM documents WHERE false")
def q04(spark, d):
    """A greeting retrieves nothing."""
    return _asked(spark, d, "你好").agg(F.count("*").alias("n"))


derived(
    "s28_search_request",
    "SELECT CAST(page_id % 15 - 2 AS INT) AS n, CASE WHEN page_id % 5 = 0 THEN '' ELSE upper(url) || ' ,www.b.org' END AS domains FROM {pages} WHERE url IS NOT NULL",
    sql=r"SELECT CAST(least(greatest(n, 1), 10) AS INTEGER) AS n, array_to_string(list_filter(list_transform(string_split(domains, ','), lambda x: regexp_replace(regexp_replace(lower(trim(x)), '^[a-z]+://', ''), '^www\.|/.*$', '', 'g')), lambda x: x <> ''), ',') AS domains FROM {t}",
)
derived("s32_cache", "SELECT CAST(user_id AS STRING) AS key, CAST(event_id % 12 AS INT) AS age_days, max(event_type || CAST(event_id AS STRING)) AS body FROM {events} GROUP BY CAST(user_id AS STRING), CAST(event_id % 12 AS INT)")


# --- announcements -----------------------------------------------------------------------------------

_TITLES = "SELECT o_orderkey AS id, CASE o_custkey % 6 WHEN 0 THEN '截至' || y || '年12月31日止年度财报公告' WHEN 1 THEN '截至' || y || '年6月30日止六个月中期业绩公告' WHEN 2 THEN y || '年第三季度报告 10-Q' WHEN 3 THEN 'Form 10-K annual report' WHEN 4 THEN '截至' || y || '年3月31日止三个月业绩' ELSE 'Notice of annual general meeting' END AS title, CAST(y AS INT) + 1 AS release_year, CAST(1 + o_orderkey % 12 AS INT) AS release_month FROM (SELECT *, CAST(2005 + o_orderkey % 20 AS STRING) AS y FROM {orders}) x"
_FORMS = """SELECT id, form_type, CAST(CASE WHEN title LIKE 'Form%' THEN CASE WHEN release_month <= 6 THEN release_year - 1 ELSE release_year END ELSE release_year - 1 END AS INTEGER) AS fiscal_year
FROM (SELECT *, unnest(CASE WHEN title LIKE '%年度财报公告' OR title LIKE 'Form%' THEN ['FY'] WHEN title LIKE '%六个月%' THEN ['H1', 'Q2'] WHEN title LIKE '%第三季度%' THEN ['Q3'] WHEN title LIKE '%三个月%' THEN ['Q1'] ELSE [] END) AS form_type FROM {t}) z"""
derived("f20_classify", _TITLES, sql=_FORMS)
derived("f19_announcements", _TITLES, sql=f"SELECT id, form_type FROM ({_FORMS}) WHERE form_type IN ('FY', 'H1', 'Q1') AND fiscal_year BETWEEN 2023 AND 2025 AND id <> 5 AND id IN (SELECT id FROM {{t}} u WHERE contains(u.title, '业绩') OR contains(u.title, '财报'))")


# --- statement workbooks -----------------------------------------------------------------------------


def _statement_books(spark, d) -> str:
    """Income statements of every nation as workbooks, an older version with other numbers beside the newest."""
    c = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("metric")).agg(F.floor(F.sum(F.abs("c_acctbal"))).alias("a"), F.count("*").alias("b"))
    value = lambda x: F.col(x).cast("string")
    facts = c.select("n", F.col("metric").alias("k"), "metric", F.lit("m").alias("unit"), value("a").alias("2025Q1"), value("b").alias("2024Q1"))
    dates = c.select("n").distinct().select("n", F.lit("").alias("k"), F.lit("date").alias("metric"), F.lit("").alias("unit"), F.lit("2025-03-31").alias("2025Q1"), F.lit("2024-03-31").alias("2024Q1"))
    rows = dates.unionByName(facts)
    name = lambda day: F.concat(F.lit("HK_"), F.format_string("%05d", "n"), F.lit(f"_income_{day}_080000.xlsx"))
    both = rows.withColumn("name", name("20250501")).unionByName(rows.withColumn("2025Q1", F.when(F.col("k") == "", F.col("2025Q1")).otherwise("1")).withColumn("name", name("20250101")))
    root = shared_folder(spark)
    put_files(workbook.books(both, "name", "k", ["metric", "unit", "2025Q1", "2024Q1"]), root)
    return root


@query("s37_workbook", f"SELECT id AS n, day, segment AS metric, p AS period, CAST(CASE WHEN p = '2024Q1' THEN b WHEN day = '20250101' THEN 1 ELSE a END AS DOUBLE) AS value FROM {_SUMS}, (VALUES ('2025Q1'), ('2024Q1')) v(p), (VALUES ('20250101'), ('20250501')) w(day)")
def s37(spark, d):
    """Reports written as workbooks and read back as facts."""
    facts = workbook.statement_facts(workbook.workbooks(spark, _statement_books(spark, d)), "path")
    return facts.select(F.regexp_extract("path", r"HK_(\d+)_", 1).cast("int").alias("n"), F.regexp_extract("path", r"income_(\d+)_", 1).alias("day"), "metric", "period", "value")


@query("s14_historicals", f"SELECT id AS n, segment AS metric, p AS period, CAST(CASE p WHEN '2025Q1' THEN a ELSE b END AS DOUBLE) AS value FROM {_SUMS}, (VALUES ('2025Q1'), ('2024Q1')) v(p)")
def s14(spark, d):
    """The newest version of each statement in a folder, as facts."""
    got = tools.lf_historicals(spark, _statement_books(spark, d))
    return got.select(F.col("ticker").cast("int").alias("n"), "metric", "period", "value")


@query("z13_consensus_files", "SELECT 'N' || c_nationkey AS ticker, lower(c_mktsegment) AS item, '2026FY' AS period, CAST(count(*) AS DOUBLE) AS value, 'estimate' AS kind FROM customer GROUP BY ALL UNION ALL SELECT 'N' || n_nationkey, 'revenue', '2025FY', CAST(n_regionkey AS DOUBLE), 'actual' FROM nation")
def z13(spark, d):
    """Estimates of files beside actual facts."""
    c = _t(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    line = F.concat(F.lower("c_mktsegment"), F.lit(","), F.col("n").cast("string"))
    made = c.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("r")).select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("_consensus.csv")).alias("name"), F.concat(F.lit("item,2026FY\n"), "r").alias("data"))
    other = c.groupBy("c_nationkey").agg(F.count("*").alias("n")).select(F.concat(F.lit("other-"), F.col("c_nationkey").cast("string"), F.lit(".csv")).alias("name"), F.lit("item,2026FY\nx,1\n").alias("data"))
    root = shared_folder(spark)
    put_files(made.unionByName(other), root)
    actual = _t(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ticker"), F.lit("revenue").alias("item"), F.lit("2025FY").alias("period"), F.col("n_regionkey").cast("double").alias("value"))
    return tools.lf_consensus(spark, root, actual)


# --- PDF tables by drawn lines -----------------------------------------------------------------------


def ruled_pdf(pages: list[tuple[str, list[list[str]]]], turned: bool) -> bytes:
    """A PDF of tables with rules: over the columns of each page's rows a title spans them all; rules are drawn field by field,
    some as lines and some as thin boxes.  Turned pages are drawn on their side and rotated back."""
    width, height = 612, 792
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{4 + 2 * k} 0 R' for k in range(len(pages)))}] >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    turn = " /Rotate 90" if turned else ""
    for k, (title, rows) in enumerate(pages):
        drawing, begun, packer, shown = _rules(tuple(map(len, rows)), width, height, turned)
        text = (shown % (title, *chained.from_iterable(rows))).encode("latin-1")
        packer = packer.copy()
        packed, kind = begun + packer.compress(text) + packer.flush(), " /Filter /FlateDecode"
        if b"endobj" in packed:  # would end the object for readers that go by the word
            packed, kind = drawing + text, ""
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width} {height}]{turn} /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>".encode())
        objects.append(b"<< /Length %d%b >>\nstream\n%b\nendstream" % (len(packed), kind.encode(), packed))
    return b"%%PDF-1.4\n%btrailer << /Root 1 0 R >>\n%%%%EOF" % b"".join(b"%d 0 obj\n%b\nendobj\n" % x for x in enumerate(objects, 1))


@lru_cache(16)
def _rules(widths: tuple[int, ...], width: int, height: int, turned: bool) -> tuple[bytes, bytes, object, str]:
    """(the rules of a page whose rows have so many fields, what a compressor has made of them, the compressor, what shows the title and the fields)."""
    cols, top, left, w, h = widths[0], (height if not turned else width) - 60, 50, 90, 12
    draw = [f"0 1 -1 0 {width} 0 cm"] if turned else []
    ys = [top - h * i for i in range(len(widths) + 2)]
    for i, y in enumerate(ys):
        draw += [f"{left + w * j} {y} m {left + w * (j + 1)} {y} l S" if (i + j) % 2 else f"{left + w * j} {y - 0.25} {w} 0.5 re f" for j in range(cols)]
    for i in range(len(ys) - 1):
        draw += [f"{left + w * j} {ys[i]} m {left + w * j} {ys[i + 1]} l S" for j in range(cols + 1) if i or j in (0, cols)]
    places = [(left + 3, ys[1] + 3), *((left + w * j + 3, y + 3) for y, n in zip(ys[2:], widths) for j in range(n))]
    drawing, packer = ("\n".join(draw) + "\n").encode("latin-1"), zlib.compressobj(1)
    return drawing, packer.compress(drawing), packer, "".join(f"BT /F1 9 Tf 1 0 0 1 {x} {y} Tm (%s) Tj ET\n" for x, y in places)


#: Lines after which a supplier's next 5000 orders begin another file. Fixed value.
BOOK = 2000


@query("s42_ruled_tables", "SELECT l_suppkey AS supplier, CAST(l_orderkey AS VARCHAR) AS order_key, CAST(l_linenumber AS VARCHAR) AS line, printf('%.2f', l_extendedprice) AS price FROM lineitem")
def s42(spark, d):
    """Every supplier's lines as ruled PDF tables, half of them on turned pages, read back by their lines."""
    order = F.struct("l_orderkey", "l_linenumber", F.format_string("%.2f", "l_extendedprice").alias("price"))
    lines = _t(spark, d, "lineitem").withColumn("block", F.floor(F.col("l_orderkey") / 5000)).select("l_suppkey", "block", order.alias("r"))
    earlier = Window.partitionBy("l_suppkey").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("l_suppkey", "block").agg(F.count("*").alias("k"))
    blocks = blocks.select("l_suppkey", "block", F.floor(F.coalesce(F.sum("k").over(earlier), F.lit(0)) / BOOK).alias("book"))
    lines = dealt(lines.join(blocks, ["l_suppkey", "block"]), "l_suppkey", "book")
    rows = lines.groupBy("l_suppkey", "book").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    rows = rows.withColumn("name", F.format_string("s%d-%d.pdf", "l_suppkey", "book"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, name, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                order, line, price = (c.to_pylist() for c in own.values.flatten())
                lines = list(zip(map(str, order), map(str, line), price))
                data = ruled_pdf([(f"Lines {k} of {n}", lines[k : k + 40]) for k in range(0, len(lines), 40)], n % 2 == 1)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.string()), pa.array([data], pa.binary())], ["name", "data"])

    root = shared_folder(spark)
    put_files(rows.select("l_suppkey", "name", "rows").mapInArrow(run, "name string, data binary"), root)
    books = workbook.pdf_files(spark, root).select(F.regexp_extract("path", r"s(\d+)-\d+\.pdf$", 1).cast("bigint").alias("supplier"), "content")
    value = lambda k: F.get("cells", F.lit(k))
    return workbook.pdf_rows(books, "supplier", "content").where("row > 1").select("supplier", value(0).alias("order_key"), value(1).alias("line"), value(2).alias("price"))
