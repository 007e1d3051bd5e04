"""Cases of file sources, section readers and push streams, which the tests run: each writes small files to the shared
folder first, and reads them back through the source.  ``plans/derived.py`` runs the sources on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions.periods import date_bucket
from quillmark.functions.text import url_host
from quillmark.operators import sections
from quillmark.operators.statements import number
from quillmark.plans.fixtures import CASES, values
from quillmark.sources import files, pdf, workbook
from quillmark.sources.shared import shared_folder
from quillmark.streaming import pushes


def put(spark, contents: dict[str, str | bytes]) -> str:
    """Writes small files below a fresh shared folder, in order; gives the folder."""
    root = shared_folder(spark)
    for name, data in contents.items():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p.getParent())
        out = fs.create(p, True)
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
        out.close()
    return root


def stated(name: str, ddl: str, rows: list[tuple]):
    """A case whose rows are stated."""

    def add(f):
        CASES[name] = (f, "SELECT * FROM " + values(ddl, rows))
        return f

    return add


def simple_pdf(pages: list[list[str]]) -> bytes:
    """A PDF of lines, from the top of each page down; tabs part cells, 100 units wide."""
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{4 + 2 * k} 0 R' for k in range(len(pages)))}] >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for k, lines in enumerate(pages):
        text = "".join(f"BT /F1 11 Tf 1 0 0 1 {72 + 100 * j} {760 - 14 * i} Tm ({x}) Tj ET\n" for i, line in enumerate(lines) for j, x in enumerate(line.split("\t")))
        objects += [f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>", f"<< /Length {len(text)} >>\nstream\n{text}endstream"]
    body = "".join(f"{n} 0 obj\n{o}\nendobj\n" for n, o in enumerate(objects, 1))
    return f"%PDF-1.4\n{body}trailer << /Root 1 0 R >>\n%%EOF".encode("latin-1")


# --- readers ---------------------------------------------------------------------------------------

_HTML = """<html><head><title>x</title></head><body><nav>menu</nav>
<div><a href="#a">One item</a> <a href="#b">Two item</a> <a href="#c">Three</a> <a href="#d">Four</a> <a href="#e">Five</a></div>
<p>Preface text.</p><h2>Business</h2><p>We   build things.</p><p><b>Item 1A. Risk Factors</b></p><p>Risks are many.</p>
<table><tr><th>Year</th><th>Revenue</th></tr><tr><td>2024</td><td>100</td></tr></table>
<p><b>FINANCIAL DATA</b></p><div>Numbers follow.</div><p><b>not a title</b> as it goes on</p><script>var x;</script></body></html>"""
_SECTIONS = [(1, 0, None, "Preface text."), (1, 1, "Business", "We build things."), (1, 2, "Item 1A. Risk Factors", "Risks are many.\n\nYear | Revenue\n2024 | 100"), (1, 3, "FINANCIAL DATA", "Numbers follow.\n\nnot a title as it goes on")]


@stated("s04_html_sections", "id int, place int, title string, content string", _SECTIONS)
def s04(spark):
    docs = spark.createDataFrame([(1, _HTML), (2, None), (3, "")], "id int, html string")
    return sections.sections(docs, "id", "html").select("id", "place", "title", "content")


_PAGES = [["Annual filing", "Item 1. Business", "We build", "things."], ["more of them.", "PART II", "Item 7. Results", "Up 5 %."]]
_PAGED = [(0, None, "Annual filing", None), (1, "Item 1. Business", "We build\nthings.\nmore of them.", 1), (2, "PART II", "", 2), (3, "Item 7. Results", "Up 5 %.", 2)]


@stated("s05_page_sections", "place int, title string, content string, page int", _PAGED)
def s05(spark):
    root = put(spark, {"a.pdf": simple_pdf(_PAGES), "broken.pdf": b"no pdf"})
    docs = spark.read.format("binaryFile").load(root)
    return sections.sections(docs, "path", "content", lambda data: sections.page_sections(pdf.pages(data))).select("place", "title", "content", "page")


@stated("s03_pdf_text", "name string, text string", [("a.pdf", "Annual filing\n## Item 1. Business\nWe build\nthings.\nmore of them.\n## PART II\n## Item 7. Results\nUp 5 %.")])
def s03(spark):
    root = put(spark, {"a.pdf": simple_pdf(_PAGES)})
    return files.as_text(files.routed(spark, root)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "text")


_FILED = {
    "portfolio/00700/filings/2025_Q1/meta.json": '{"formType": "6-K", "fiscalYear": 2025, "filingDate": "2025-05-14", "primaryFile": "q1.html", "reportDate": "2025-03-31"}',
    "portfolio/00700/filings/2025_Q1/q1.html": "<h1>Results</h1><p>Revenue rose.</p>",
    "portfolio/00700/filings/2024_FY/meta.json": '{"formType": "20-F", "fiscalYear": 2024, "fiscalPeriod": "FY", "filingDate": "2025-03-20", "primaryFile": "fy.pdf", "ticker": "00700"}',
    "portfolio/00700/filings/2024_FY/fy.pdf": simple_pdf([["Annual"]]),
    "portfolio/BABA/filings/odd/meta.json": '{"formType": "6-K"}',
    "portfolio/BABA/filings/odd/notes.txt": "plain notes",
}


@stated("s01_routed", "name string, text string", [("fy.pdf", "Annual"), ("notes.txt", "plain notes"), ("q1.html", "# Results\n\nRevenue rose.")])
def s01(spark):
    got = files.as_text(files.routed(spark, put(spark, _FILED)).where("suffix <> 'json'"))
    return got.select(F.element_at(F.split("path", "/"), -1).alias("name"), "text")


@stated("s06_filing_scan", "ticker string, document_id string, suffix string", [("00700", "2024_FY", "pdf"), ("00700", "2025_Q1", "html")])
def s06(spark):
    return files.documents(spark, put(spark, _FILED)).select("ticker", "document_id", "suffix")


@stated("s08_metadata", "ticker string, document_id string, period string, year int", [("00700", "2024_FY", "FY", 2024), ("00700", "2025_Q1", "Q1", 2025), ("BABA", "odd", None, None)])
def s08(spark):
    return files.metadata(spark, put(spark, _FILED)).select("ticker", "document_id", F.col("fiscalPeriod").alias("period"), F.col("fiscalYear").alias("year"))


@stated("s09_complete", "ticker string, document_id string", [("00700", "2024_FY"), ("00700", "2025_Q1")])
def s09(spark):
    return files.complete_filings(files.metadata(spark, put(spark, _FILED))).select("ticker", "document_id")


_BOOKS = ["HK_00700_income_20250101_080000.xlsx", "HK_00700_income_20250301_070000.xlsx", "HK_00700_income_20250301_090000.xlsx", "US_MSFT_balance_20250101_000000.xlsx", "notes.xlsx"]


@stated("s11_latest_versions", "market string, ticker string, statement string, name string", [("HK", "00700", "income", _BOOKS[2]), ("US", "MSFT", "balance", _BOOKS[3])])
def s11(spark):
    found = spark.read.format("binaryFile").load(put(spark, dict.fromkeys(_BOOKS, "x"))).select("path")
    return files.latest_versions(found).select("market", "ticker", "statement", F.element_at(F.split("path", "/"), -1).alias("name"))


@stated("s12_latest_by_pattern", "key string, name string", [("a", "a-20250102.csv"), ("b", "b-20240101.csv")])
def s12(spark):
    found = spark.read.format("binaryFile").load(put(spark, dict.fromkeys(["a-20250101.csv", "a-20250102.csv", "b-20240101.csv", "c.csv"], "x"))).select("path")
    return files.latest_by(found, r"([a-z]+)-(\d{8})\.csv$").select("key", F.element_at(F.split("path", "/"), -1).alias("name"))


@stated("s13_fresh", "name string, age int", [("new", 1), ("newer", 0)])
def s13(spark):
    rows = spark.createDataFrame([("new", "a", 1), ("old", "b", 9), ("newer", "c", 0), ("older", "c", 1)], "path string, key string, age int").withColumn("modified", F.expr("timestamp'2025-01-10 00:00:00' - make_dt_interval(age)"))
    return files.fresh(rows, ["key"], F.expr("timestamp'2025-01-10 00:00:00'"), "7 days").select(F.col("path").alias("name"), "age")


_CSV = {
    "wide.csv": "item,2025Q1,2024FY\n营业收入,\"1,200\",4000\n成本,(300),-\n".encode("gbk"),
    "long.csv": "﻿period,revenue\n2025Q1,10\n2024FY,N/A\n",
}
_CSV_ROWS = [("long.csv", "revenue", "2024FY", None), ("long.csv", "revenue", "2025Q1", 10.0), ("wide.csv", "成本", "2024FY", None), ("wide.csv", "成本", "2025Q1", -300.0), ("wide.csv", "营业收入", "2024FY", 4000.0), ("wide.csv", "营业收入", "2025Q1", 1200.0)]


@stated("s15_csv_layouts", "name string, item string, period string, value double", _CSV_ROWS)
def s15(spark):
    got = files.statement_csvs(spark, put(spark, _CSV))
    return got.select(F.element_at(F.split("path", "/"), -1).alias("name"), "item", "period", "value")


@stated("s16_html_tables", "sheet string, row int, col int, value string", [("0", 1, 1, "Item"), ("0", 1, 2, "2024"), ("0", 2, 1, "Revenue"), ("0", 2, 2, "100")])
def s16(spark):
    page = "<p>x</p><table><tr><th>Item</th><th>2024</th></tr><tr><td>Revenue</td><td>100</td></tr></table><table><tr><td>single</td></tr></table>"
    return workbook.html_tables(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html").select("sheet", "row", "col", "value")


_KEPT = [("t1", "d1", "new"), ("t1", "d2", "old"), ("t2", "d1", "old")]


@stated("s21_chunk_store", "ticker string, document_id string, content string", _KEPT)
def s21(spark):
    path = f"{shared_folder(spark)}/chunks"
    ddl = "ticker string, document_id string, content string"
    files.save_chunks(spark.createDataFrame([("t1", "d1", "old"), ("t1", "d2", "old"), ("t2", "d1", "old")], ddl), path)
    files.save_chunks(spark.createDataFrame([("t1", "d1", "new")], ddl), path)
    return spark.read.schema("content string, ticker string, document_id string").parquet(path).select("ticker", "document_id", "content")


@stated("s20_chunk_load", "document_id string, content string", [("007", "a")])
def s20(spark):
    path = f"{shared_folder(spark)}/chunks"
    files.save_chunks(spark.createDataFrame([("00700", "007", "a"), ("00700", "d2", "b"), ("700", "007", "c")], "ticker string, document_id string, content string"), path)
    return files.load_chunks(spark, path, "00700", "007").select("document_id", "content")


@stated("s36_json_sink", "a int, b string", [(1, "x"), (2, None)])
def s36(spark):
    path = f"{shared_folder(spark)}/json"
    files.write_json(spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"), path)
    return spark.read.schema("a int, b string").json(path)


_TABLED = [["Title", "Item\t2024\t2023", "Revenue\t120\t100", "Cost\t(30)\t(20)", "a note"], ["Item\t2024\t2023", "Revenue\t120\t100", "Cost\t(30)\t(20)"], ["x\ty"]]
_CELLS = [(1, 1, "Item"), (1, 2, "2024"), (1, 3, "2023"), (2, 1, "Revenue"), (2, 2, "120"), (2, 3, "100"), (3, 1, "Cost"), (3, 2, "(30)"), (3, 3, "(20)")]


@stated("s17_pdf_tables", "row int, col int, value string", _CELLS)
def s17(spark):
    return workbook.pdf_tables(spark, put(spark, {"a.pdf": simple_pdf(_TABLED), "b.pdf": b"none"})).select("row", "col", "value")


@stated("s18_pdf_table_facts", "metric string, period string, value double", [("Revenue", "2024", 120.0), ("Revenue", "2023", 100.0), ("Cost", "2024", -30.0), ("Cost", "2023", -20.0)])
def s18(spark):
    cells = workbook.pdf_tables(spark, put(spark, {"a.pdf": simple_pdf(_TABLED)}))
    head = cells.where("row = 1 and col > 1").select("path", "sheet", "col", F.col("value").alias("period"))
    name = cells.where("row > 1 and col = 1").select("path", "sheet", "row", F.col("value").alias("metric"))
    body = cells.where("row > 1 and col > 1").join(head, ["path", "sheet", "col"]).join(name, ["path", "sheet", "row"])
    return body.select("metric", "period", number(F.col("value")).alias("value"))


_MACRO = '{"result": {"data": [{"REPORT_DATE": "2025-03-01 00:00:00", "NATIONAL_SAME": 0.1}, {"REPORT_DATE": "2025-02-01 00:00:00", "NATIONAL_SAME": -0.7}, {"REPORT_DATE": "2025-03-01 00:00:00", "NATIONAL_SAME": 9.9}]}}'


@stated("s31_macro_reports", "period string, value double", [("2025-03", 0.1), ("2025-02", -0.7)])
def s31(spark):
    """A report of an indicator: rows by date, the first of a month counts."""
    raw = spark.read.text(put(spark, {"cpi.json": _MACRO}), wholetext=True)
    rows = raw.select(F.from_json("value", "struct<result:struct<data:array<struct<REPORT_DATE:string,NATIONAL_SAME:double>>>>")["result"]["data"].alias("d")).select(F.posexplode("d").alias("place", "x"))
    month = date_bucket(F.to_date(F.substring("x.REPORT_DATE", 1, 10)), "month")
    return rows.groupBy(month.alias("period")).agg(F.min_by("x.NATIONAL_SAME", "place").alias("value"))


_WEB = ['{"web": {"results": [{"title": "A", "url": "https://www.a.com/1", "description": "one"}]}}', '{"results": [{"title": "B", "url": "http://b.org/2", "content": "two"}]}', "{}"]


@stated("s29_web_results", "title string, host string, content string", [("A", "www.a.com", "one"), ("B", "b.org", "two")])
def s29(spark):
    """Result lists of two providers, in one form."""
    raw = spark.read.text(put(spark, {f"{k}.json": w for k, w in enumerate(_WEB)}))
    item = "struct<title:string,url:string,description:string,content:string>"
    x = F.from_json("value", f"struct<web:struct<results:array<{item}>>,results:array<{item}>>")
    rows = raw.select(F.inline(F.coalesce(x["web"]["results"], x["results"])))
    return rows.select("title", url_host(F.col("url")).alias("host"), F.coalesce("description", "content").alias("content"))


# --- push streams ------------------------------------------------------------------------------------

_MESSAGES = [
    '{"type": "QUOTE", "data": [{"code": "HK.00700", "last_price": 500.5, "volume": 10, "turnover": 5005.0, "high_price": 501.0, "low_price": 499.0}, {"code": "US.MSFT", "last_price": 400.0}]}',
    '{"type": "TICKER", "data": [{"code": "HK.00700", "time": "2025-01-02 09:30:00", "price": 500.0, "volume": 100, "turnover": 50000.0, "ticker_direction": "BUY"}]}',
    '{"type": "RT_DATA", "data": [{"code": "HK.00700", "time": "09:31", "cur_price": 500.0, "avg_price": 499.5, "volume": 7}]}',
    '{"type": "ORDER_BOOK", "code": "HK.00700", "data": {"Bid": [{"price": 499.8, "volume": 300, "orders": 2}, {"price": 499.6, "volume": 100, "orders": 1}], "Ask": [{"price": 500.0, "volume": 50, "orders": 1}]}}',
    '{"type": "BROKER", "code": "HK.00700", "data": {"bid_broker_list": [{"broker_id": 5, "broker_name": "five"}], "ask_broker_list": [{"broker_id": 7, "broker_name": "seven"}, {"broker_id": 8, "broker_name": "eight"}]}}',
    '{"type": "OPTION_EVENT", "data": {"owner_code": "US.MSFT", "option_code": "US.MSFT250117C400", "message": "large trade"}}',
    "not json",
]


def _stream(spark, rows_of):
    """The rows of a stream over files of messages, read to their end."""
    root = put(spark, {f"in/{k}.txt": m + "\n" for k, m in enumerate(_MESSAGES)})
    made = rows_of(spark.readStream.text(f"{root}/in"))
    pushes.consume(made, f"{root}/out")
    return spark.read.schema(made.schema).parquet(f"{root}/out/rows")


@stated("r04_quote_push", "code string, last_price double, volume bigint", [("HK.00700", 500.5, 10), ("US.MSFT", 400.0, None)])
def r04(spark):
    return _stream(spark, lambda m: pushes.rows_of(m, "QUOTE")).select("code", "last_price", "volume")


@stated("r05_tick_push", "code string, time string, price double, ticker_direction string", [("HK.00700", "2025-01-02 09:30:00", 500.0, "BUY")])
def r05(spark):
    return _stream(spark, lambda m: pushes.rows_of(m, "TICKER")).select("code", "time", "price", "ticker_direction")


@stated("r06_order_book_push", "code string, side string, level int, price double, volume bigint", [("HK.00700", "bid", 0, 499.8, 300), ("HK.00700", "bid", 1, 499.6, 100), ("HK.00700", "ask", 0, 500.0, 50)])
def r06(spark):
    return _stream(spark, pushes.order_book).select("code", "side", "level", "price", "volume")


@stated("r07_intraday_push", "code string, time string, cur_price double, volume bigint", [("HK.00700", "09:31", 500.0, 7)])
def r07(spark):
    return _stream(spark, lambda m: pushes.rows_of(m, "RT_DATA")).select("code", "time", "cur_price", "volume")


@stated("r08_broker_push", "code string, side string, level int, broker_id bigint", [("HK.00700", "bid", 0, 5), ("HK.00700", "ask", 0, 7), ("HK.00700", "ask", 1, 8)])
def r08(spark):
    return _stream(spark, pushes.broker_queue).select("code", "side", "level", "broker_id")


@stated("r09_option_push", "owner_code string, option_code string, message string", [("US.MSFT", "US.MSFT250117C400", "large trade")])
def r09(spark):
    return _stream(spark, pushes.option_events)


_LOG = [
    (1, "subscribe", ["A", "B"], ["K_1M", "QUOTE"], True, False),
    (2, "unsubscribe", ["A"], ["QUOTE"], None, None),
    (3, "subscribe", ["C"], ["QUOTE"], False, True),
    (4, "subscribe", ["A"], ["K_1M"], False, True),
]
_LOG_DDL = "n int, action string, codes array<string>, subtypes array<string>, first_push boolean, extended boolean"


@stated("r01_subscriptions", "code string, subtype string, first_push boolean, extended boolean", [("A", "K_1M", False, True), ("B", "K_1M", True, False), ("B", "QUOTE", True, False), ("C", "QUOTE", False, True)])
def r01(spark):
    return pushes.subscriptions(spark.createDataFrame(_LOG, _LOG_DDL))


@stated("r02_unsubscribe_all", "code string, subtype string", [("Z", "RT_DATA")])
def r02(spark):
    more = [*_LOG, (5, "unsubscribe_all", None, None, None, None), (6, "subscribe", ["Z"], ["RT_DATA"], False, False)]
    return pushes.subscriptions(spark.createDataFrame(more, _LOG_DDL)).select("code", "subtype")


@stated("r10_bounded_run", "messages bigint", [(len(_MESSAGES),)])
def r10(spark):
    """A run that is ended by the clock, and one that goes on from its state."""
    root = put(spark, {f"in/{k}.txt": m + "\n" for k, m in enumerate(_MESSAGES)})
    stream = spark.readStream.option("maxFilesPerTrigger", 3).text(f"{root}/in")
    pushes.consume(stream, f"{root}/out", seconds=0.5)
    pushes.consume(stream, f"{root}/out")
    return spark.read.schema("value string").parquet(f"{root}/out/rows").agg(F.count("*").alias("messages"))
