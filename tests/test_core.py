"""Core queries against DuckDB, and the pieces that SQL doesn't reach."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmark.functions import periods as P
from quillmark.functions import text as T
from quillmark.operators import chunking, market, modelling, retrieval, statements, valuation
from quillmark.plans import chain, collections, derived, endpoints, filed, fixtures, indexes, more, queries, segments, sources, stores, streams, structures, wide  # noqa: F401
from quillmark.sources import files, workbook

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    assert got, "a query without rows shows nothing"
    if name in queries.SQL:
        rel = duck.sql(queries.SQL[name])
        at = [rel.columns.index(c) for c in cols]
        assert sorted(rel.columns) == cols
        assert got == Counter(tuple(r[k] for k in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(fixtures.CASES))
def test_case(spark, duck, name):
    """The literal cases of a rule."""
    run, sql = fixtures.CASES[name]
    df, rel = run(spark), duck.sql(sql)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    assert got and got == Counter(tuple(r[k] for k in at) for r in rel.fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, fy, canonical",
    [("2026Q1", 2026, "2026Q1"), ("Q12025", 2025, "2025Q1"), ("2024H1", 2024, "2024H1"), ("FY2025", 2025, "FY2025"), ("2025FY", 2025, "FY2025"), ("2025", 2025, None), ("q1-2025", 2025, "2025Q1"), ("FY 2025", 2025, "FY2025"), ("not a period", None, None), ("", None, None), (None, None, None)],
)
def test_parse_period(spark, raw, fy, canonical):
    p = one(spark, P.parse_period(F.lit(raw).cast("string")))
    assert (p and p.fy) == fy and (p and p.canonical) == canonical


def test_period_algebra(spark):
    prev = lambda y, k, **o: one(spark, P.previous(F.lit(y), F.lit(k), **o))
    assert prev(2025, "Q1") == "2024Q4" and prev(2025, "H2") == "2025H1" and prev(2025, "FY") is None and prev(2025, "H1", half_to_quarter=True) == "2025Q1"
    assert one(spark, P.year_ago(F.lit(2025), F.lit("FY"))) == "FY2024"
    keys = [one(spark, P.tag_sort_key(F.lit(y), F.lit(k))) for y, k in ((2024, "FY"), (2025, "Q1"), (2025, "H1"), (2025, "Q3"), (2025, "H2"), (2025, "FY"))]
    assert keys == sorted(keys) and len(set(keys)) == 6
    assert one(spark, P.relative_intent(F.lit("上季度同比"))) == "YEAR_AGO" and one(spark, P.relative_intent(F.lit("近3期"))) == "LAST_N"
    assert one(spark, P.calendar_label(F.lit(2025), F.lit("QTD6"), 6)) == "2024Q4"
    assert one(spark, P.annualise(F.lit("2025Q9"))) == pytest.approx(4 / 3)


def test_text(spark):
    assert one(spark, T.count_occurrences(F.lit("收入收入收入"), "收入")) == 3
    assert one(spark, T.count_occurrences(F.lit("aaabaaa"), "aa")) == 2 and one(spark, T.count_occurrences(F.lit("a"), "")) == 0
    assert one(spark, T.base_terms(F.lit("营业收入 for AI2025"))) == ["营业", "业收", "收入", "营业收", "业收入", "营业收入", "for", "ai2025"]
    assert one(spark, T.chinese_year(F.lit("二〇二五"))) == 2025
    assert one(spark, T.normalise_ticker(F.lit("hk.700"))) == "00700" and one(spark, T.market_of(F.lit("600519"))) == "SH"
    assert one(spark, T.tickers_in(F.lit("CEO of BABA and 00700"))) == ["OF", "BABA", "00700"]
    assert one(spark, T.citation_markers(F.lit("a [1] b [12]"))) == "a [C1] b [C12]"
    assert one(spark, T.json_keywords(F.lit('x ```json\n["a","b"]\n``` y'))) == ["a", "b"]
    h = one(spark, T.hierarchy(F.lit("  ├─ Cloud")))
    assert (h.name, h.level) == ("Cloud", 2)


def test_numbers(spark):
    for raw, want in (("(1,234.5)", -1234.5), ("$ 12", 12.0), ("—", None), ("N/A", None), ("-3%", -3.0), ("abc", None)):
        assert one(spark, statements.number(F.lit(raw))) == want


def test_tag_filter_rules(spark):
    chunks = spark.createDataFrame([(1,), (2,)], "id int")
    tags = spark.createDataFrame([(1, "ticker", "00700"), (1, "p", "2025Q1"), (2, "ticker", "00700")], "id int, tag_key string, tag_value string")
    ids = lambda c: sorted(r.id for r in retrieval.tag_filter(chunks, tags, c, ["id"]).collect())
    assert ids(None) == ids([]) == ids([("ticker", "EQ", [])]) == [1, 2]
    assert ids([("ticker", "EQ", ["00700", "x"])]) == [1, 2] and ids([("ticker", "EQ", ["00700"]), ("p", "IN", ["2025Q1", "2025Q2"])]) == [1]
    with pytest.raises(ValueError):
        ids([("bad key'; DROP TABLE x", "EQ", ["1"])])


def test_derive_quarters(spark):
    rows = [("s", 2025, k, v, "DIRECT", 80) for k, v in (("Q1", 10.0), ("QTD6", 25.0), ("QTD9", 45.0), ("FY", 70.0), ("Q3", 99.0))]
    out = statements.derive_quarters(spark.createDataFrame(rows, "seg string, year int, kind string, value double, source string, confidence int"), ["seg"])
    assert {(r.kind, r.value, r.confidence) for r in out.where("source = 'DERIVED'").collect()} == {("Q2", 15.0, 60), ("Q4", 25.0, 60)}


def test_fill_from_children(spark):
    rows = [(None, "A", 1, None), ("A", "B", 2, None), ("A", "C", 2, 5.0), ("B", "D", 3, 2.0), ("B", "E", 3, 3.0), (None, "Z", 1, None), ("C", "F", 3, 100.0)]
    df = spark.createDataFrame([(*r[:3], "REV", "2025Q1", r[3]) for r in rows], "parent string, code string, level int, metric string, period string, value double")
    assert {r.code: r.value for r in statements.fill_from_children(df).collect()} == {"A": 10.0, "B": 5.0, "C": 5.0, "D": 2.0, "E": 3.0, "F": 100.0, "Z": None}


def test_lbo_waterfall(spark):
    debt, cash = 1000.0, [120.0, 150.0, 180.0, 200.0, 220.0]
    got = one(spark, valuation.debt_waterfall([F.lit(debt * s) for _, s, _, _ in valuation.TRANCHES], F.array(*map(F.lit, cash))))
    ends = [debt * s for _, s, _, _ in valuation.TRANCHES]
    for year, c in enumerate(cash):
        interest = sum(e * t[2] for e, t in zip(ends, valuation.TRANCHES))
        must = [min(e, t[3] * debt * t[1]) for e, t in zip(ends, valuation.TRANCHES)]
        left = c - interest - sum(must)
        for k in range(4):
            sweep = min(max(0, ends[k] - must[k]), max(0, left))
            ends[k], left = max(0, ends[k] - must[k] - sweep), left - sweep
        assert got[year].ends == pytest.approx(ends) and got[year].interest == pytest.approx(interest)


def test_formula(spark):
    df = spark.createDataFrame([(6.0, 0.0)], "a double, b double")
    assert df.select(market.formula("-(a + 2) * 3 / 4", {"a"}).alias("x")).first().x == -6.0
    assert df.select(market.formula("a / b", {"a", "b"}).alias("x")).first().x is None
    for bad in ("__import__('os')", "a ** 2", "c + 1", "a if b else 1"):
        with pytest.raises(ValueError):
            market.formula(bad, {"a", "b"})


def test_chunkers():
    assert list(chunking.window_chunks("")) == []
    (one_,) = chunking.window_chunks("Short text here.", "Overview")
    assert one_["content"].startswith("Section: Overview\n")
    many = list(chunking.window_chunks("这是一个关于营业收入的句子。" * 100, "x"))
    assert len(many) > 1 and all(chunking.tokens(c["content"]) <= 800 for c in many)
    md = "# A\n" + "text. " * 300 + "\n## B\nmore\n# A\n" + "text. " * 300
    rows = list(chunking.heading_chunks(md, 200, 20))
    assert len({r["chunk_id"] for r in rows}) == len(rows) and {r["header"] for r in rows} == {"A", "A > B"}
    assert rows == list(chunking.heading_chunks(md, 200, 20))
    assert [c["content"] for c in chunking.fixed_chunks("a\n\nb\n\n" + "c" * 600, 10)] == ["a\n\nb", "c" * 600]


def test_html_markdown():
    assert chunking.html_markdown("<nav>x</nav><h2>T</h2><p>a&amp;b<ul><li>one<li>two</ul><table><tr><td>1<td>2</table><script>s</script>").split("\n") == ["## T", "", "a&b", "", "- one", "- two", "", "| 1 | 2"]
    assert chunking.html_markdown(None) == ""


def test_files(spark, tmp_path):
    (tmp_path / "T" / "filings" / "doc_2025Q1").mkdir(parents=True)
    (tmp_path / "T" / "filings" / "doc_2025Q1" / "a.html").write_text("<p>x")
    (tmp_path / "T" / "filings" / "doc_2025Q1" / "meta.json").write_text('{"formType": "10-Q", "fiscalYear": 2025}')
    docs = files.as_text(files.documents(spark, str(tmp_path))).collect()
    assert [(r.ticker, r.document_id, r.text) for r in docs] == [("T", "doc_2025Q1", "x")]
    assert files.metadata(spark, str(tmp_path)).first().fiscalPeriod == "Q1"
    (tmp_path / "s.csv").write_text("item,2025Q1,2025FY\nrevenue,\"1,000\",-\n")
    rows = {(r.item, r.period): r.value for r in files.statement_csv(spark, str(tmp_path / "s.csv")).collect()}
    assert rows == {("revenue", "2025Q1"): 1000.0, ("revenue", "2025FY"): None}
    paths = spark.createDataFrame([("x/US_A_income_20250101_000000.xlsx",), ("x/US_A_income_20250301_000000.xlsx",)], "path string")
    assert files.latest_versions(paths).first().path.endswith("20250301_000000.xlsx")
    chunks = spark.createDataFrame([("T", "d1", "c1"), ("T", "d2", "c2")], "ticker string, document_id string, content string")
    files.save_chunks(chunks, str(tmp_path / "store"))
    files.save_chunks(chunks.where("document_id = 'd1'").withColumn("content", F.lit("new")), str(tmp_path / "store"))
    assert {r.content for r in files.load_chunks(spark, str(tmp_path / "store"), "T").collect()} == {"new", "c2"}


def test_workbook(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = [["metric", "unit", "2025Q1", "2025FY"], ["", "", "2025-03-31", "2025-12-31"], ["Revenue", "M", "1,200", "-"], ["Cost", "M", "(300)", "7"]]
    strings = [v for r in rows for v in r]
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{"ABCD"[j]}{i}" t="s"><v>{4 * (i - 1) + j}</v></c>' for j in range(4)) + "</row>" for i in range(1, 5))
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="income"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{v}</t></si>" for v in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    (tmp_path / "bad.xlsx").write_text("no archive")
    got = {(r.sheet, r.metric, r.period): (r.value, r.report_date) for r in workbook.statement_facts(workbook.workbooks(spark, str(tmp_path)), "path").collect()}
    assert got == {("income", "Revenue", "2025Q1"): (1200.0, "2025-03-31"), ("income", "Revenue", "2025FY"): (None, "2025-12-31"), ("income", "Cost", "2025Q1"): (-300.0, "2025-03-31"), ("income", "Cost", "2025FY"): (7.0, "2025-12-31")}


def test_html_tables(spark):
    html = "<table><tr><th>Segment<th>Q1<th>Q2<th>Q3</tr>" + "".join(f"<tr><td>s{k}<td>{100 + k}<td>{200 + k}<td>3</tr>" for k in range(3)) + "</table><table><tr><td>one</table>"
    cells = workbook.html_tables(spark.createDataFrame([(1, html), (2, None), (3, "<p>none")], "id int, html string"), "id", "html")
    assert cells.count() == 16 and cells.select("id").distinct().count() == 1
    assert workbook.looks_like_segments(cells, "id").first().numbers == 6


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0 and set(E.oracle_sql()) <= set(E.queries())


def test_three_statements(spark):
    row = {"id": 1, "revenue": 100.0, "cash": 10.0, "receivables": 8.0, "inventory": 5.0, "payables": 4.0, "plant": 30.0, "debt": 20.0}
    row |= {"gross_margin": 0.4, "opex": 0.2, "depreciation": 0.04, "capex": 0.05, "tax": 0.25, "dso": 36.5, "dio": 36.5, "dpo": 36.5, "issuance": 1.0, "mandatory": 2.0, "sweep": 0.1, "rate": 0.05}
    df = spark.createDataFrame([row]).crossJoin(spark.createDataFrame([([0.1, 0.0],), ([],), (None,)], "growth array<double>"))
    got = sorted((r.years for r in modelling.three_statements(df).collect()), key=lambda y: y is None)
    assert got[1:] == [None, None]
    first, second = got[0]
    # 110 of revenue: 44 gross, 22 costs, 4.4 depreciation, 1 interest
    assert first.net_income == pytest.approx(16.6 * 0.75) and first.debt == pytest.approx(17.0) and first.cff == pytest.approx(-3.0)
    assert first.cfo == pytest.approx(12.45 + 4.4 + 9.0 - 11.0) and first.cash == pytest.approx(10 + first.cfo - 5.5 - 3)
    assert max(abs(first.gap), abs(second.gap)) < 1e-9 and second.year == 2


def test_correlate(spark):
    sent = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00"), (3, "2024-01-01 00:00:00")], "id int, s string").select("id", F.col("s").cast("timestamp").alias("sent"))
    back = spark.createDataFrame([(1, "2024-01-01 00:00:30"), (1, "2024-01-01 00:00:10"), (2, "2024-01-01 00:01:01")], "id int, g string").select("id", F.col("g").cast("timestamp").alias("got"))
    out = {r.id: (r.timed_out, r.answered and r.answered.second) for r in market.correlate(sent, back, "id", "sent", "got").collect()}
    assert out == {1: (False, 10), 2: (True, None), 3: (True, None)}


def test_tickers_of_every_supplier(spark, tmp_path):
    from quillmark.plans import wide

    keys = [7, 99999, 100000, 300001, 600001, 830001, 1234567]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.s_suppkey: (r.ticker, r.market) for r in wide.x12(spark, str(tmp_path)).collect()}
    assert got == {7: ("00007", "HK"), 99999: ("99999", "HK"), 100000: ("100000", None), 300001: ("300001", "SZ"), 600001: ("600001", "SH"), 830001: ("830001", "BJ"), 1234567: ("1234567", None)}


def test_as_of_keeps_equal_rows(spark):
    left = spark.createDataFrame([(1, 2020, "2020Q1", 5), (1, 2020, "2020Q1", 5), (1, 2021, "2021Q3", 6), (1, 2022, "2022Q1", 7), (1, 2018, "2018Q1", 8), (2, 2020, "2020Q1", 9)], "k int, y int, p string, v int")
    right = spark.createDataFrame([(1, 2020, "2020Q1", 10), (1, 2021, "2021Q1", 11), (1, 2021, "2021FY", 12), (1, 2019, "2019Q4", 13)], "k int, y int, p string, b int")
    got = sorted((r.v, r.match_kind, r.r_b) for r in statements.as_of(left, right, ["k"], "y", "y", "p", "p", "r_").collect() if r.k == 1)
    assert got == [(5, 1, 10), (5, 1, 10), (6, 2, 12), (7, 3, 12), (8, 4, 13)]
    assert [(r.match_kind, r.r_b) for r in statements.as_of(left, right, ["k"], "y", "y", "p", "p", "r_").where("k = 2").collect()] == [(None, None)]


def test_correlate_keeps_equal_rows(spark):
    t = lambda s: f"2024-01-01 00:0{s // 60}:{s % 60:02d}"
    ask = spark.createDataFrame([("a", t(0)), ("a", t(0)), ("a", t(70)), ("b", t(0)), ("c", t(5))], "id string, at string").selectExpr("id", "cast(at as timestamp) sent")
    came = spark.createDataFrame([("a", t(0)), ("a", t(50)), ("a", t(75)), ("b", t(61)), ("c", t(4))], "id string, at string").selectExpr("id", "cast(at as timestamp) got")
    got = sorted((r.id, str(r.answered), r.timed_out) for r in market.correlate(ask, came, "id", "sent", "got").collect())
    day = "2024-01-01 00:0"
    assert got == [("a", day + "0:00", False), ("a", day + "0:00", False), ("a", day + "1:15", False), ("b", "None", True), ("c", "None", True)]


def test_fixed_chunks_know_their_places():
    text = "one\n\n\n\ntwo two\n\nthree" + "\n\n\n" + "x" * 30 + "\n\n"
    for c in chunking.fixed_chunks(text, 12):
        first = c["content"].split("\n\n")[0]
        assert text[c["start"] : c["start"] + len(first)] == first
    assert "".join(c["content"] for c in chunking.fixed_chunks(text, 1)).replace("\n", "") == text.replace("\n", "")
    assert list(chunking.fixed_chunks("")) == []


def test_tokens_add_up():
    for text in ("", "Revenue grew 12 % in 2025.", "营业收入同比增长。 Revenue é naïve", "\n\t"):
        cjk = sum("一" <= c <= "鿿" for c in text)
        plain = sum("!" <= c <= "~" for c in text)
        other = sum(not ("一" <= c <= "鿿") and ord(c) > 127 and not c.isspace() for c in text)
        assert chunking.counts(text) == (cjk, plain, other)


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    from quillmark.streaming import bars

    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").limit(900)
    for k in range(3):  # files in order of time, so the watermark moves between triggers
        events.orderBy("ts").offset(300 * k).limit(300).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    names = (["event_type"], "ts", "value", "event_id")
    got = bars.run_available(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/out", *names, late="2 days").collect()
    assert sorted(map(str, got)) == sorted(map(str, market.bars(events, *names).collect()))
    (tmp_path / "none").mkdir()
    assert bars.run_available(spark, f"{tmp_path}/none", events.schema, f"{tmp_path}/o2", *names).count() == 0


def test_every_endpoint_has_a_shape():
    from quillmark.operators import endpoints as E

    names = [n for x in (*E.SCAN.values(), E.RANK, E.TIMES, E.SCREEN, E.HIERARCHY, E.CALCULATION) for n in x]
    assert len(names) == len(set(names)) and all(E.shape(n) for n in names)
    with pytest.raises(ValueError):
        E.shape("place_order")


def test_pdf_reader():
    import zlib

    from quillmark.plans.sources import simple_pdf
    from quillmark.sources import pdf

    assert pdf.pages(simple_pdf([["one", "two (a)".replace("(", "\\(").replace(")", "\\)")], [], ["last"]])) == ["one\ntwo (a)", "", "last"]
    assert pdf.pages(None) == pdf.pages(b"") == pdf.pages(b"%PDF-1.4 nothing") == []
    text = b"BT /F1 9 Tf 72 700 Td [(Re) -50 (venue) -400 (grew)] TJ 0 -12 Td (below) Tj ET q 1 0 0 1 0 500 cm BT 300 200 Td (right) Tj ET Q BT 72 720 Td <005400> Tj ET"
    cmap = b"beginbfchar <0054> <4E91> <00> <0041> endbfchar"
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Contents [4 0 R] >>", b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(text) + b"\nendstream"]
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % n + o + b"\nendobj\n" for n, o in enumerate(parts, 1))
    assert pdf.pages(data)[0].split("\n")[1:] == ["Revenue grew right", "below"]
    assert pdf._unicode_map(cmap) == {b"\x00\x54": "云", b"\x00": "A"}
    packed = b"5 0 6 6 (five) <<six>>"
    inner = b"<< /Type /ObjStm /First 8 /Filter /FlateDecode >>\nstream\n" + zlib.compress(packed) + b"\nendstream"
    assert pdf._objects(b"9 0 obj\n" + inner + b"\nendobj")[6].strip() == b"<<six>>"


def test_sections_corner_cases():
    from quillmark.operators import sections as S

    assert list(S.html_sections("")) == [] and list(S.page_sections([])) == []
    wide = "<table><tr>" + "<td>x</td>" * 16 + "</tr></table>"
    assert list(S.html_sections(f"<body><div>{wide}<h3>T</h3>text</div></body>")) == [("T", "text", None)]
    assert list(S.html_sections("<h1>" + "long " * 60 + "</h1><p>t</p>"))[0][0] is None
    assert S.heading_marks("Item 2. Properties\nplain") == "## Item 2. Properties\nplain"


def test_classified_titles_without_words(spark):
    from quillmark.operators import filings

    df = spark.createDataFrame([("", 2024, 1), (None, None, None)], "title string, release_year int, release_month int")
    assert filings.classify(df).count() == 0


def test_window_chunks_against_a_plain_version():
    """Counts added up give what counting whole windows anew gives."""
    import random

    tokens = chunking.tokens

    def plain(text, target=400, most=600, overlap=80):
        units = []
        for u in chunking._UNIT.findall(text):
            while tokens(u) > most:
                cut = max(1, len(u) * most // (tokens(u) + 1))
                units.append(u[:cut])
                u = u[cut:]
            if u.strip():
                units.append(u)
        # of joined units the three kinds of characters are added before rounding, as in one text
        windows, cur = [], []
        for u in units:
            if cur and tokens("".join(cur)) + tokens(u) > target:
                windows.append(cur)
                back = []
                for x in reversed(cur):
                    if tokens("".join([x, *back])) > overlap:
                        break
                    back.insert(0, x)
                cur = back if tokens("".join(back)) + tokens(u) <= most else []
            cur = [*cur, u]
        if cur:
            if windows and tokens("".join(cur)) < max(50, target // 3) and tokens("".join(windows[-1] + cur)) <= most:
                windows[-1] = windows[-1] + cur
            else:
                windows.append(cur)
        return ["".join(w).strip() for w in windows]

    r = random.Random(3)
    for _ in range(30):
        text = "".join(r.choice(["revenue ", "营业收入", "rose. ", "12 % ", "é", "；", "\n", "x" * 40, "。"]) for _ in range(r.randint(0, 900)))
        assert [c["content"] for c in chunking.window_chunks(text)] == plain(text)


def test_heading_chunks_lie_in_their_text():
    import random

    r = random.Random(4)
    for _ in range(20):
        text = "".join(r.choice(["# Head\n", "## Sub\n", "some words. ", "more text\n", "\n\n", "long " * 60]) for _ in range(r.randint(1, 60)))
        made = list(chunking.heading_chunks(text, 120, 20))
        parents = {c["chunk_id"]: c for c in made if c["kind"] == "parent"}
        assert len({c["chunk_id"] for c in made}) == len(made)
        for c in made:
            assert c["content"] in text[c["start"] :]
            if c["kind"] == "child":
                assert c["header"] == parents[c["parent_id"]]["header"] and len(c["content"]) <= 220
        # every word of a body stands in some child
        for word in {w for _, _, body in chunking.sections(text) for w in body.split()}:
            assert any(word in c["content"] for c in made if c["kind"] == "child")


def test_window_chunks_of_a_long_unit_take_time_in_proportion():
    """A unit without sentence signs is cut as by counting its rest anew, in linear time."""
    import random
    import time

    r = random.Random(4)
    for size in (900, 5000):
        unit = "".join(r.choice("ab \u4e2d\u6587\u00e9\u3000\u00a0\t") for _ in range(size))
        parts, u = [], unit
        while (n := chunking.tokens(u)) > 600:
            cut = max(1, len(u) * 600 // (n + 1))
            parts.append(u[:cut])
            u = u[cut:]
        run = chunking._running(unit)
        assert [tuple(x) for x in run[[0, 7, size // 2, size]].tolist()] == [chunking.counts(unit[:k]) for k in (0, 7, size // 2, size)]
        got = "".join(c["content"] for c in chunking.window_chunks(unit, overlap=0)).replace(" ", "")
        assert "".join(p for p in [*parts, u]).split() == unit.split() and set(got) <= set(unit)
    took = []
    for n in (200_000, 800_000):
        began = time.time()
        assert len(list(chunking.window_chunks("x" * n))) >= n // 2400
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 1


def test_hashed_vectors_are_units_whatever_the_length(spark):
    from quillmark.operators import chain as C

    docs = spark.createDataFrame([(1, "a b c a"), (2, "word " * 20_000), (3, " \n "), (4, None), (5, "a b c a")], "id int, text string")
    got = {r.id: r.v for r in C.hashed_vectors(docs, "id", "text").collect()}
    assert set(got) == {1, 2, 5} and got[1] == got[5] and all(len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-9 for v in got.values())
