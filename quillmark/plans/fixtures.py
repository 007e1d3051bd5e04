"""Rules of filings, texts, periods and models, each with its SQL and small literal cases, which the tests run.

``derived`` registers a rule as a query over rows that come from the benchmark tables; see ``plans/derived.py``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quillmark.functions import periods as P
from quillmark.functions import text as T
from quillmark.operators import filings, retrieval, statements, valuation
from quillmark.plans.queries import _r, query

_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, float) and math.isnan(v):
        return "'NaN'::DOUBLE"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def values(ddl: str, rows: list[tuple]) -> str:
    """A DuckDB subquery of literal rows with these column types."""
    cols = [c.strip().split(" ") for c in ddl.split(",")]
    cast = ", ".join(f"CAST({n} AS {_TYPES[t]}) AS {n}" for n, t in cols)
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"(SELECT {cast} FROM (VALUES {body}) AS v({', '.join(n for n, _ in cols)}))"


#: Literal cases by name: (what gives the rows for a session, the SQL that gives the same).
CASES: dict[str, tuple] = {}
#: Rules by name: (function of the tables, SQL with {t} and other tables' names).
RULES: dict[str, tuple] = {}


def fixture(name: str, ddl: str, rows: list[tuple], sql: str, **more: tuple[str, list[tuple]]):
    """A rule f(df, **tables) with literal cases; the SQL names them {t} and by the others' names."""
    text = sql.format(t=values(ddl, rows), **{k: values(*v) for k, v in more.items()})

    def add(f):
        CASES[name] = (lambda spark: f(spark.createDataFrame(rows, ddl), **{k: spark.createDataFrame(r, d) for k, (d, r) in more.items()}), text)
        RULES[name] = (f, sql)
        return f

    return add


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def derived(name: str, t: str, sql: str | None = None, **more: str) -> None:
    """Registers a rule as a query: its tables come from SELECTs over the benchmark tables, named in braces, that both
    engines read alike; ``sql`` in place of the rule's own where that is about its literal cases."""
    f, own = RULES[name]
    sources = {"t": t} | more
    text = (sql or own).format(**{k: "(" + v.format(**{x: x for x in _TABLES}) + ")" for k, v in sources.items()})

    def run(spark, d):
        def rows(v: str):
            used = {x: spark.read.parquet(f"{d}/{x}.parquet") for x in _TABLES if "{" + x + "}" in v}
            return spark.sql(v, **used)

        return f(rows(t), **{k: rows(v) for k, v in more.items()})

    query(name, text)(run)


def expected(name: str, ddl: str, rows: list[tuple], out: str, want: list[tuple]):
    """A query whose rows are stated: what the rule gives for each literal input."""
    return fixture(name, ddl, rows, "SELECT * FROM " + values(out, want).replace("{", "{{").replace("}", "}}"))


# --- filings and announcements -------------------------------------------------------------------

_TITLES = [
    (1, "截至2024年12月31日止年度财报公告", 2025, 3),
    (2, "截至二零二四年六月三十日止六个月中期业绩公告", 2024, 8),
    (3, "2024年第三季度报告 10-Q", 2024, 11),
    (4, "Form 10-K annual report", 2025, 2),
    (5, "6-K 业绩公告", 2025, 5),
    (6, "董事会会议召开日期", 2025, 3),
    (7, "2023年年报", 2024, 4),
    (8, "截至2025年3月31日止三个月业绩", 2025, 5),
    (9, "8-K", 0, 1),
    (10, None, 2024, 1),
    (11, "截至2024年12月31日止十二个月业绩", 2025, 3),
    (12, "Notice of annual general meeting", 2025, 4),
    (13, "8-K", 2025, 1),
]
_TITLE_DDL = "id int, title string, release_year int, release_month int"
_FORMS = [(1, "FY", 2024), (2, "H1", 2024), (2, "Q2", 2024), (3, "Q3", 2024), (4, "FY", 2024), (5, "Q1", 2025), (7, "FY", 2023), (8, "Q1", 2025), (11, "Q4", 2024), (13, "Q4", 2024)]


@expected("f20_classify", _TITLE_DDL, _TITLES, "id int, form_type string, fiscal_year int", _FORMS)
def f20(df):
    return filings.classify(df).select("id", "form_type", "fiscal_year")


@expected("f19_announcements", _TITLE_DDL, _TITLES, "id int, form_type string", [(1, "FY"), (2, "H1"), (8, "Q1")])
def f19(df):
    ok = df.where(filings.title_passes(F.col("title"), [], ["业绩", "财报"]))
    return filings.classify(ok).where(F.col("form_type").isin("FY", "H1", "Q1") & (F.col("fiscal_year").isin(2025) | F.col("fiscal_year").between(2023, 2024)) & (F.col("id") != 5)).select("id", "form_type")


@fixture(
    "f21_sec_files",
    "name string, title string, ticker string",
    [("msft-20240630.htm", "Form 10-K", "MSFT"), ("MSFT_20240930.html", "10-Q", "MSFT"), ("other-20240630.htm", "10-K", "MSFT"), ("ex99-1.htm", "6-K", "BABA"), ("d1dex991.htm", "6-K", "TCOM"), ("ex99-10.htm", "6-K", "BABA"), ("baba-20f.htm", "20-F", "BABA"), ("x.htm", "8-K", "A"), ("", "10-K", "A")],
    """SELECT name, title, CASE WHEN name = '' THEN false
  WHEN regexp_matches(title, '10-[KQ]') THEN regexp_matches(lower(name), '^' || lower(ticker) || '[-_][0-9]{{8}}[.]html?$')
  WHEN regexp_matches(title, '6-K|20-F') THEN regexp_matches(lower(name), '20f[.]html?$') OR regexp_matches(lower(name), 'ex99[-_]?1([^0-9]|$)') ELSE false END AS passes,
  ends_with(lower(name), '.htm') AS by_suffix FROM {t}""",
)
def f21(df):
    name, title, ticker = (F.col(c) for c in ("name", "title", "ticker"))
    return df.select("name", "title", filings.file_passes(name, title, ticker).alias("passes"), filings.file_passes(name, title, ticker, [".HTM"]).alias("by_suffix"))


@fixture(
    "f22_security_types",
    "code string, name string, kind string, market int",
    [("00700", "腾讯控股", "港股", 116), ("12345", "腾讯购B", "港股", 116), ("BABA", "阿里巴巴", "美股", 106), ("600519", "贵州茅台", "沪A", 1), ("510300", "沪深300ETF", "基金", 1), ("X", None, None, 7)],
    "SELECT code, CASE market WHEN 116 THEN 'HKEX' WHEN 106 THEN 'NYSE' WHEN 1 THEN 'SSE' ELSE 'OTHER' END AS exchange FROM {t} WHERE (contains(kind, '股') OR contains(kind, 'A')) AND NOT contains(name, '购')",
)
def f22(df):
    ok = df.where(filings.security_passes(F.col("kind"), F.col("name"), ["股", "A"], ["购", "沽"]))
    return ok.select("code", filings.exchange_name(F.col("market"), {"116": "HKEX", "106": "NYSE", "1": "SSE"}).alias("exchange"))


_META = [("a", False, None, True, 2024), ("b", True, None, True, 2024), ("c", None, None, None, 2023), ("d", None, True, None, 2023), ("e", False, False, False, 2022), ("f", None, None, None, None), ("g", None, None, True, 2019)]
_META_DDL = "doc string, is_deleted boolean, deleted boolean, ingest_complete boolean, fiscal_year int"


@fixture("f28_complete", _META_DDL, _META, "SELECT doc, NOT (coalesce(is_deleted, false) OR coalesce(deleted, false)) AND coalesce(ingest_complete, true) AS complete FROM {t}")
def f28(df):
    return df.select("doc", filings.is_complete(F.col("is_deleted"), F.col("deleted"), F.col("ingest_complete")).alias("complete"))


@fixture(
    "s10_selection_reasons",
    _META_DDL,
    _META,
    """WITH r AS (SELECT CASE WHEN coalesce(is_deleted, false) OR coalesce(deleted, false) OR NOT coalesce(ingest_complete, true) THEN 'incomplete'
WHEN fiscal_year IS NULL OR fiscal_year NOT BETWEEN 2020 AND 2024 THEN 'out_of_range' ELSE 'selected' END AS reason FROM {t}) SELECT reason, count(*) AS n FROM r GROUP BY reason""",
)
def s10(df):
    ok = filings.is_complete(F.col("is_deleted"), F.col("deleted"), F.col("ingest_complete"))
    return df.groupBy(filings.selection_reason(F.col("doc"), ok, F.col("fiscal_year"), "2020", "2024").alias("reason")).agg(F.count("*").alias("n"))


@fixture(
    "f29_citation",
    "n int, ticker string, fiscal_year string, fiscal_period string, heading string, header string",
    [(1, "00700", "2025", "2025Q1", "业绩 > 云", "h"), (2, "BABA", None, "2025Q2", " ", "Context"), (3, None, None, None, None, None)],
    """SELECT n, '[C' || n || ']' || coalesce(' ' || nullif(trim(ticker), ''), '') || coalesce(' ' || nullif(trim(fiscal_year), ''), '') || coalesce(' ' || nullif(trim(fiscal_period), ''), '')
|| coalesce(' ' || coalesce(nullif(trim(heading), ''), nullif(trim(header), '')), '') AS citation, ticker FROM {t}""",
)
def f29(df):
    tags = F.create_map(*(x for k in ("ticker", "fiscal_year", "fiscal_period", "heading") for x in (F.lit(k), F.col(k))))
    return df.select("n", filings.citation(F.col("n"), tags, F.col("header")).alias("citation"), tags["ticker"].alias("ticker"))


@fixture(
    "z02_registry",
    "symbol string, market string, name string",
    [("BABA", "US", " Alibaba "), ("MSFT", "US", "Microsoft"), ("00700", "HK", "腾讯"), ("600519", "CN", "茅台"), ("7203", "JP", "Toyota")],
    """SELECT symbol AS ticker, CASE WHEN market IN ('US', 'HK', 'CN') THEN market ELSE '' END AS market, trim(name) AS display_name,
CASE WHEN market = 'US' THEN CASE WHEN symbol IN ('BABA', 'PDD') THEN '20-F,6-K' ELSE '10-K,10-Q' END ELSE '' END AS file_types,
CASE market WHEN 'CN' THEN '季度报告,年度报告' WHEN 'HK' THEN '季度报告,年度报告,业绩公告,财报公告' ELSE '' END AS title_words FROM {t}""",
)
def z02(df):
    return filings.registry_entry(df, ["BABA", "PDD"]).withColumns({c: F.array_join(c, ",") for c in ("file_types", "title_words")})


_SERIES = [("KWEB", 12), ("PGJ", 30), ("US.SPY", 60), ("HK.800000", 60)]


@fixture(
    "z27_benchmark",
    "code string, currency string",
    [("US.BABA", "CNY"), ("US.MSFT", "USD"), ("HK.00700", "CNY"), ("SH.600519", "CNY"), ("plain", None)],
    """WITH c AS (SELECT code, unnest(CASE WHEN code LIKE 'US.%' AND currency = 'CNY' THEN ['KWEB', 'PGJ', 'US.SPY'] WHEN code LIKE 'HK.%' THEN ['HK.800000'] ELSE ['US.SPY'] END) AS benchmark,
generate_subscripts(CASE WHEN code LIKE 'US.%' AND currency = 'CNY' THEN ['KWEB', 'PGJ', 'US.SPY'] WHEN code LIKE 'HK.%' THEN ['HK.800000'] ELSE ['US.SPY'] END, 1) - 1 AS place FROM {t})
SELECT code, arg_min(c.benchmark, place) AS benchmark, CAST(min(place) AS INTEGER) AS place FROM c JOIN {counts} USING (benchmark) WHERE n >= 24 GROUP BY code""",
    counts=("benchmark string, n int", _SERIES),
)
def z27(df, counts):
    c = df.select("code", filings.benchmarks(F.col("code"), F.col("currency"), {"HK": "HK.800000"}, ["KWEB", "PGJ"]).alias("candidates"))
    return filings.first_enough(c, counts, "code")


@fixture(
    "j13_alias_match",
    "id int, label string",
    [(1, "Intelligent Cloud"), (2, "Cloud"), (3, "Other cloud services"), (4, "Gaming"), (5, None), (2, "Cloud"), (6, " gaming ")],
    """WITH m AS (SELECT l.label, arg_min(code, struct_pack(k := CASE WHEN lower(trim(l.label)) = lower(alias) THEN 0 ELSE 1 END, p := place)) AS code FROM (SELECT DISTINCT label FROM {t}) l JOIN {aliases} a ON contains(lower(trim(l.label)), lower(alias)) GROUP BY l.label)
SELECT t.id, t.label, m.code FROM {t} t LEFT JOIN m ON m.label = t.label""",
    aliases=("code string, alias string, place int", [("CLOUD", "cloud", 1), ("AZURE", "Intelligent Cloud", 2), ("GAMES", "GAMING", 3)]),
)
def j13(df, aliases):
    return filings.alias_match(df, aliases)


# --- periods and texts ---------------------------------------------------------------------------

_ASK = [("最近3期营收", "LAST_N", 3), ("近4个季度", "LAST_N", 4), ("过去2季", "LAST_N", 2), ("去年同期", "YEAR_AGO", None), ("同比增长", "YEAR_AGO", None), ("上季度环比", "PREVIOUS", None), ("前一季", "PREVIOUS", None), ("最新财报", "LATEST", None), ("2025Q1", None, None)]


@expected("d06_relative", "q string", [(q,) for q, *_ in _ASK], "q string, intent string, n int", _ASK)
def d06(df):
    return df.select("q", P.relative_intent(F.col("q")).alias("intent"), P.relative_count(F.col("q")).alias("n"))


_CANON = [("2025Q1", 2024, "2025Q1"), ("Q1", 2025, "2025Q1"), ("FY", 2025, "FY2025"), ("h1", 2024, "2024H1"), ("", 2024, None), (None, 2024, None), ("Q7", 2024, None), ("Q2", None, None)]


@expected("d05_canonical", "period string, year int", [(p, y) for p, y, _ in _CANON], "period string, year int, canonical string", _CANON)
def d05(df):
    return df.withColumn("canonical", filings.canonical_period(F.col("period"), F.col("year")))


_RANGE = [("2023Q1", "2024Q4", 2023, 2024, "2023Q1"), ("2023", "FY2024", 2023, 2024, "FY2024"), (None, "2024", None, 2024, None), ("x", None, None, None, None)]


@expected("z23_asked_periods", "a string, b string", [(a, b) for a, b, *_ in _RANGE], "a string, b string, from_year int, to_year int, period string", _RANGE)
def z23(df):
    return df.select("a", "b", filings.asked_periods(F.col("a"), F.col("b")).alias("x")).select("a", "b", "x.*")


@fixture("d02_sort_key", "p string", [("2025Q1",), ("2025H1",), ("2025Q3",), ("2025H2",), ("2025Q4",), ("FY2025",), ("FY2024",)], "SELECT p, row_number() OVER (ORDER BY k) AS place FROM (SELECT p, CASE p WHEN 'FY2024' THEN 20245 WHEN '2025Q1' THEN 20251 WHEN '2025H1' THEN 20252 WHEN '2025Q3' THEN 20253 WHEN '2025H2' THEN 20254.1 WHEN '2025Q4' THEN 20254.2 ELSE 20255 END AS k FROM {t})")
def d02(df):
    from pyspark.sql import Window

    p = P.parse_period(F.col("p"))
    return df.select("p", F.row_number().over(Window.orderBy(P.tag_sort_key(p["fy"], p["kind"]), F.col("p"))).cast("bigint").alias("place"))  # a literal list


_IDS = [("2025_Q1_report", "Q1"), ("h1-2024", "H1"), ("annual-2024", "FY"), ("FY2024", "FY"), ("misc", None)]


@expected("d04_document_period", "id string", [(i,) for i, _ in _IDS], "id string, kind string", _IDS)
def d04(df):
    return df.select("id", P.from_document_id(F.col("id")).alias("kind"))


_TERMS = [("2024年Q3和2025年FY", "2024,2025,Q3,FY"), ("h1 of 2023", "2023,H1"), ("nothing", "")]


@expected("d15_time_terms", "q string", [(q,) for q, _ in _TERMS], "q string, terms string", _TERMS)
def d15(df):
    return df.select("q", F.array_join(P.time_terms(F.col("q")), ",").alias("terms"))


_SEEDS = [("云收入", "云收,收入,云收入"), ("AI云 q1", "ai,q1"), ("", ""), ("毛利率如何", "毛利,利率,率如,如何,毛利率,利率如,率如何")]


@expected("x03_seeds", "q string", [(q,) for q, _ in _SEEDS], "q string, seeds string", _SEEDS)
def x03(df):
    return df.select("q", F.array_join(T.seed_terms(F.col("q")), ",").alias("seeds"))


@fixture("x04_keyword_length", "w string", [("ai",), ("api",), ("云",), ("云计",), ("",), ("é",), ("éa",)], "SELECT w, CASE WHEN regexp_full_match(w, '[\\x00-\\x7f]*') THEN len(w) >= 3 ELSE len(w) >= 2 END AS kept FROM {t}")
def x04(df):
    return df.select("w", (F.size(T.keep_by_length(F.array("w"))) == 1).alias("kept"))


_MANY = [(1, ",".join(f"w{k % 18}" for k in range(40))), (2, "a,b,a"), (3, "x")]


@fixture("k07_keyword_cap", "id int, words string", _MANY, "SELECT id, array_to_string(list_slice(list_distinct_ordered, 1, 15), ',') AS kept FROM (SELECT id, list_transform(list_filter(list_zip(string_split(words, ','), range(len(string_split(words, ',')))), lambda x: list_position(string_split(words, ','), x[1]) = x[2] + 1), lambda x: x[1]) AS list_distinct_ordered FROM {t})")
def k07(df):
    return df.select("id", F.array_join(T.cap(F.split("words", ",")), ",").alias("kept"))


_SPACES = [("a  b\t\tc", "a b c"), ("a \n\n\n\n b", "a\n\nb"), ("  x y ", "x y")]


@expected("x10_spaces", "t string", [(a,) for a, _ in _SPACES], "t string, clean string", _SPACES)
def x10(df):
    return df.select("t", T.normalise_space(F.col("t")).alias("clean"))


_SENT = [("营收增长。利润下降！Why? Yes. No", "营收增长。|利润下降！|Why?|Yes.|No"), ("one\n\ntwo;three", "one|two;|three"), ("", "")]


@expected("x11_sentences", "t string", [(a,) for a, _ in _SENT], "t string, parts string", _SENT)
def x11(df):
    return df.select("t", F.array_join(T.sentences(F.col("t")), "|").alias("parts"))


_TICK = [("what is BABA revenue", None), ("00700.HK 营收", "00700"), ("how about msft?", "ABOUT"), ("600519的ROE", "600519"), ("CEO and CFO", None)]


@expected("x13_tickers", "q string", [(q,) for q, _ in _TICK[1:]], "q string, ticker string", _TICK[1:])
def x13(df):
    return df.select("q", T.first_ticker(F.col("q")).alias("ticker"))


_YEARS = [("二零二五", 2025), ("二〇二四", 2024), ("二○一九", 2019), ("二零二", None), ("2025", 2025), (None, None)]


@expected("x14_chinese_years", "y string", [(y,) for y, _ in _YEARS], "y string, n int", _YEARS)
def x14(df):
    return df.select("y", T.chinese_year(F.col("y")).alias("n"))


_TREE = [("Revenue", "Revenue", 1), ("  ├─ Cloud", "Cloud", 2), ("    └─ IaaS", "IaaS", 3), ("  │ x", "x", 2)]


@expected("x15_hierarchy", "raw string", [(r,) for r, *_ in _TREE], "raw string, name string, level int", _TREE)
def x15(df):
    return df.select("raw", T.hierarchy(F.col("raw")).alias("h")).select("raw", "h.*")


@fixture("x17_field_fallback", "fiscalYear int, fiscal_year int", [(2024, None), (None, 2023), (2022, 2021), (None, None)], "SELECT coalesce(fiscalYear, fiscal_year) AS fiscal_year_found FROM {t}")
def x17(df):
    # a field by its camel-case name, else by its snake-case one
    one = lambda name: F.coalesce(F.col(name), F.col(T.camel_to_snake(name)))
    return df.select(one("fiscalYear").alias("fiscal_year_found"))


_BIG = [(1.5e12, "1.50万亿"), (2.345e8, "2.35亿"), (-31234.0, "-3.12万"), (99.5, "99.50"), (0.0, "0.00")]


@expected("x18_big_numbers", "x double", [(x,) for x, _ in _BIG], "x double, shown string", _BIG)
def x18(df):
    return df.select("x", T.format_big(F.col("x")).alias("shown"))


@fixture("x18_scaled", "v bigint", [(123456,), (-5,), (0,)], "SELECT v, CAST(trunc(v / 10.0) / 100.0 AS DOUBLE) AS x FROM {t}")
def x18s(df):
    return df.select("v", T.scale_int(F.col("v"), 3, 2).cast("double").alias("x"))


# --- retrieval -----------------------------------------------------------------------------------

_CHUNKS = [("c1", "a", 0.9, "云收入"), ("c2", "b", 0.7, "成本"), ("c3", "a", 0.7, "云利润"), ("c4", "c", 0.2, "其他"), ("c5", "b", None, "云")]
_CHUNK_DDL = "chunk_id string, doc string, score double, content string"


@fixture("k04_top", _CHUNK_DDL, _CHUNKS, "SELECT chunk_id FROM {t} ORDER BY score DESC NULLS LAST, chunk_id LIMIT 3")
def k04(df):
    return retrieval.top(df, min(5, 3), "chunk_id").select("chunk_id")


@fixture("k05_merge_order", _CHUNK_DDL, _CHUNKS, "SELECT chunk_id, row_number() OVER (ORDER BY score DESC NULLS LAST, chunk_id) AS place FROM {t}")
def k05(df):
    from pyspark.sql import Window

    return df.select("chunk_id", F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), "chunk_id")).cast("bigint").alias("place"))  # a result list


@fixture("k06_recall", _CHUNK_DDL, _CHUNKS, "SELECT chunk_id FROM (SELECT * FROM {t} WHERE score IS NOT NULL ORDER BY score DESC, chunk_id LIMIT 3) WHERE contains(content, '云') ORDER BY score DESC, chunk_id LIMIT 1")
def k06(df):
    return retrieval.recall(df.where("score is not null"), 1, "chunk_id", F.col("content").contains("云")).select("chunk_id")


@fixture("u01_union", _CHUNK_DDL, _CHUNKS, "SELECT chunk_id, doc FROM {t} UNION ALL SELECT chunk_id, doc FROM {more}", more=(_CHUNK_DDL, [("d1", "z", 0.1, "x"), ("c1", "a", 0.9, "云收入")]))
def u01(df, more):
    return df.unionByName(more).select("chunk_id", "doc")


@fixture("f06_intent_gate", "i string", [(None,), ("KB_SEARCH",), ("CLARIFICATION",), ("SUMMARIZE",), ("WEB_SEARCH",), ("GREETING",)], "SELECT i, i IS NULL OR i IN ('KB_SEARCH', 'CLARIFICATION', 'SUMMARIZE') AS plain, i IS NULL OR i IN ('KB_SEARCH', 'CLARIFICATION', 'SUMMARIZE', 'WEB_SEARCH') AS web FROM {t}")
def f06(df):
    return df.select("i", F.coalesce(retrieval.needs_retrieval(F.col("i")), F.lit(False)).alias("plain"), F.coalesce(retrieval.needs_retrieval(F.col("i"), True), F.lit(False)).alias("web"))


_FILED = [("c1", "00700", "10-K", "2024FY", 2024), ("c2", "00700", "10-Q", "2024Q1", 2024), ("c3", "BABA", "20-F", "2023FY", 2023), ("c4", "00700", "10-K", "2022FY", 2022), ("c5", "00700", "10-K", None, None)]
_FILED_DDL = "chunk_id string, ticker string, form_type string, fiscal_period string, fiscal_year int"


@fixture("f11_vector_filter", _FILED_DDL, _FILED, "SELECT chunk_id FROM {t} WHERE ticker = '00700' AND form_type = '10-K' AND fiscal_year >= 2023 AND fiscal_year <= 2024")
def f11(df):
    return df.where(retrieval.vector_filter(ticker="00700", form_type="10-K", first=2023, last=2024)).select("chunk_id")


@fixture("f05_domain_guard", _FILED_DDL, _FILED, "SELECT chunk_id, 'filing' AS domain FROM {t} WHERE ticker = '00700' UNION ALL SELECT chunk_id, 'general' FROM {t}")
def f05(df):
    only = lambda d: d.where(F.col("ticker") == "00700")
    parts = [retrieval.guarded(df, kind, only).select("chunk_id", F.lit(kind).alias("domain")) for kind in ("filing", "general")]
    return parts[0].unionByName(parts[1])


@fixture("k13_latest_filings", _FILED_DDL, [*_FILED, ("c6", "00700", "10-Q", "2023Q1", 2023), ("c7", "00700", "10-Q", "2021Q1", 2021), ("c8", "00700", "10-Q", "2020Q1", 2020)], "SELECT ticker, chunk_id FROM {t} WHERE fiscal_year IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC, chunk_id DESC) <= 4")
def k13(df):
    return statements.latest(df.where("fiscal_year is not null"), ["ticker"], F.struct("fiscal_year", "chunk_id"), 4).select("ticker", "chunk_id")


@fixture("n23_score_fallback", "id int, score double, vec double, term double", [(1, 0.5, 0.1, 0.2), (2, None, 0.8, 0.4), (3, None, None, 0.4), (4, None, None, None)], "SELECT id, round(coalesce(score, 0.7 * coalesce(vec, 0) + 0.3 * coalesce(term, 0)), 6) AS score FROM {t}")
def n23(df):
    return df.select("id", _r(retrieval.score_or_parts(F.col("score"), F.col("vec"), F.col("term"))).alias("score"))


_OLD = [("t1", "d1", "c1", 1), ("t1", "d1", "c2", 2), ("t1", "d2", "c3", 3), ("t2", "d1", "c4", 4)]
_NEW = [("t1", "d1", "c1", 10), ("t1", "d1", "c9", 11)]
_STORE = "ticker string, doc string, chunk_id string, v int"


@fixture("m3_rebuild", _STORE, _OLD, "SELECT * FROM {t} WHERE NOT (ticker = 't1' AND doc = 'd1') UNION ALL SELECT * FROM {new}", new=(_STORE, _NEW))
def m3(df, new):
    # twice over gives the same rows
    return retrieval.rebuild(retrieval.rebuild(df, new, ["ticker", "doc"]), new, ["ticker", "doc"])


@fixture("z19_delete", _STORE, _OLD, "SELECT * FROM {t} WHERE NOT (ticker = 't1' AND doc = 'd1')", gone=("ticker string, doc string", [("t1", "d1")]))
def z19(df, gone):
    return retrieval.delete(df, gone, ["ticker", "doc"])


@fixture(
    "m4_tag_refresh",
    "chunk_id string, tag string, value string",
    [("c1", "a", "1"), ("c1", "b", "2"), ("c2", "a", "3")],
    "SELECT * FROM {t} WHERE chunk_id <> 'c1' UNION ALL SELECT * FROM {new}",
    new=("chunk_id string, tag string, value string", [("c1", "a", "9")]),
    chunks=("chunk_id string", [("c1",)]),
)
def m4(df, new, chunks):
    return retrieval.refresh_tags(df, new, chunks, ["chunk_id"])


# --- statements and models -----------------------------------------------------------------------

_SEG = [("VAS", None, 1, "REVENUE", "2025Q3", 95860.0), ("GAMES", "VAS", 2, "REVENUE", "2025FY", 60000.0), ("PC", "GAMES", 3, "REVENUE", "2025H1", 20000.0), ("ADS", None, 1, "REVENUE", "", 36242.0), ("CLOUD", None, 1, "COST", "2025Q9", 1.0)]
_SEG_DDL = "code string, parent string, level int, metric string, period string, value double"


@fixture("f17_segment_level", _SEG_DDL, _SEG, "SELECT code, level FROM {t} WHERE level <= 2")
def f17(df):
    return df.where(F.col("level") <= 2).select("code", "level")


@fixture("f18_segment_periods", _SEG_DDL, _SEG, "SELECT code, period FROM {t} WHERE period = '' OR regexp_extract(period, '(FY|Q[1-4]|H[12])$', 1) IN ('FY', 'Q3')")
def f18(df):
    return df.where((F.trim("period") == "") | F.regexp_extract("period", "(FY|Q[1-4]|H[12])$", 1).isin("FY", "Q3")).select("code", "period")


@fixture("u06_table_fingerprint", "page int, cols int, n int, body string", [(1, 4, 3, "100 200"), (1, 4, 3, "100 200"), (2, 4, 3, "100 200"), (1, 5, 3, "100 200")], "SELECT page, cols, n, body FROM {t} GROUP BY ALL")
def u06(df):
    return df.dropDuplicates(["page", "cols", "n", "body"])


@fixture("u07_keep_latest", "indicator string, report_date string, value double", [("cpi", "2025-03-31", 1.0), ("cpi", "2025-03-15", 2.0), ("cpi", "2024-03-31", 3.0), ("ppi", "2025-03-01", 4.0)], "SELECT indicator, substr(report_date, 1, 7) AS period, arg_max(value, report_date) AS value FROM {t} GROUP BY 1, 2")
def u07(df):
    return df.groupBy("indicator", P.date_bucket(F.to_date("report_date"), "month").alias("period")).agg(F.max_by("value", "report_date").alias("value"))


@fixture("u08_accounts", "acc_id int, market string", [(1, "HK"), (2, "US"), (1, "HK")], "SELECT DISTINCT acc_id, market FROM (SELECT * FROM {t} UNION ALL SELECT * FROM {more})", more=("acc_id int, market string", [(2, "US"), (3, "CN")]))
def u08(df, more):
    return df.unionByName(more).dropDuplicates(["acc_id", "market"])


@fixture("n04_gross_margin", "r double, c double", [(100.0, 60.0), (0.0, 5.0), (None, 1.0), (80.0, 90.0)], "SELECT r, c, CASE WHEN r <> 0 THEN round((r - c) / r * 100, 2) END AS margin FROM {t}")
def n04(df):
    return df.withColumn("margin", statements.gross_margin(F.col("r"), F.col("c")))


@fixture(
    "n06_roa_roe",
    "period string, total double, owners double, assets double, equity double",
    [("2025Q1", 12.0, 10.0, 1000.0, 400.0), ("2025FY", None, 50.0, 1000.0, 0.0), ("2025Q6", 30.0, None, None, 500.0), ("2025Q9", 45.0, 44.0, 900.0, 450.0)],
    """WITH f AS (SELECT *, CASE substr(period, 5) WHEN 'FY' THEN 1.0::DOUBLE WHEN 'Q9' THEN 4.0::DOUBLE / 3 WHEN 'Q6' THEN 2.0::DOUBLE ELSE 4.0::DOUBLE END AS k FROM {t})
SELECT period, CASE WHEN assets <> 0 THEN round(coalesce(total, owners) * k / assets * 100, 2) END AS roa, CASE WHEN equity <> 0 THEN round(owners * k / equity * 100, 2) END AS roe FROM f""",
)
def n06(df):
    on = statements.returns_on(*(F.col(c) for c in ("total", "owners", "assets", "equity")), P.annualise(F.col("period")))
    return df.select("period", *(c.alias(k) for k, c in on.items()))


@fixture("z07_cash_conversion", "fcf double, total double, owners double", [(30.0, 20.0, 15.0), (30.0, None, 15.0), (30.0, 0.0, 15.0), (None, 1.0, 1.0), (5.0, None, None)], "SELECT fcf, total, owners, CASE WHEN coalesce(total, owners) <> 0 THEN round(fcf / coalesce(total, owners) * 100, 2) END AS ratio FROM {t}")
def z07(df):
    return df.withColumn("ratio", statements.cash_conversion(F.col("fcf"), F.col("total"), F.col("owners")))


_FIELDS = [("2024FY", "5071", -30.0), ("2024FY", "5073", -5.0), ("2024FY", "5001", 100.0), ("2023FY", "5001", 90.0), ("2022FY", "5073", 4.0), ("2022FY", "5071", None)]


@fixture("z08_capex", "period string, field_id string, value double", _FIELDS, "SELECT period, sum(CASE WHEN field_id IN ('5071', '5073') THEN abs(value) END) AS total FROM {t} GROUP BY period")
def z08(df):
    return statements.abs_sum(df, ["period"], ["5071", "5073"])


@fixture("z10_coverage", "period string, metric string, value double", [("2024FY", "assets", 1.0), ("2024FY", "cash", 2.0), ("2023FY", "assets", 1.0), ("2023FY", "cash", 0.0), ("2022FY", "cash", None)], "SELECT period, CAST(count(*) FILTER (value <> 0) AS BIGINT) AS hits, count(*) FILTER (value <> 0) >= 2 AS covered FROM {t} GROUP BY period")
def z10(df):
    return statements.covered(df, ["period"], ["assets", "cash"])


_COLS = [("2026Q2 2026-06-29", "2026Q1", "2026Q2")]


@expected("z16_column_pick", "a double, b double", [(1.0, 2.0)], "exact double, by_prefix double", [(2.0, 1.0)])
def z16(df):
    wide = df.toDF("2026Q2 2026-06-29", "2026Q1")
    pick = lambda label: F.col(f"`{statements.pick_column(wide.columns, label)}`")
    return wide.select(pick("2026Q1").alias("exact"), pick("2026Q2").alias("by_prefix"))


@fixture("z17_latest_values", "ticker string, metric string, period string, value double", [("A", "rev", "2024FY", 5.0), ("A", "rev", "2023FY", 4.0), ("B", "rev", "2022FY", 1.0)], "SELECT ticker, metric, max(period) AS period, arg_max(value, period) AS value FROM {t} GROUP BY ticker, metric")
def z17(df):
    return statements.latest_values(df, ["ticker", "metric"], "period", "value")


@fixture("z13_estimates", "ticker string, period string, value double", [("A", "2024FY", 5.0), ("A", "2023FY", None)], "SELECT ticker, period, value, 'actual' AS kind FROM {t} UNION ALL SELECT ticker, period, CASE WHEN NOT isnan(value) THEN value END, 'estimate' FROM {est}", est=("ticker string, period string, value double", [("A", "2025FY", 6.0), ("A", "2026FY", float("nan"))]))
def z13(df, est):
    return statements.with_estimates(df, est, ["ticker", "period"])


@fixture("n18_multiples", "name string, ev double, cap double, revenue double, ebit double, earnings double", [("A", 100.0, 90.0, 50.0, 10.0, 6.0), ("B", 100.0, 90.0, 0.0, None, -3.0)], "SELECT name, round(coalesce(ev / nullif(revenue, 0), 0), 6) AS ev_revenue, round(coalesce(ev / nullif(ebit, 0), 0), 6) AS ev_ebit, round(coalesce(cap / nullif(earnings, 0), 0), 6) AS pe FROM {t}")
def n18(df):
    made = valuation.multiples(*(F.col(c) for c in ("ev", "cap", "revenue", "ebit", "earnings")))
    return df.select("name", *(_r(c).alias(k) for k, c in made.items()))


@fixture("j18_comps_lookup", "name string, ticker string", [("one", "A"), ("two", "B"), ("none", "Z")], "SELECT name, t.ticker, coalesce(price, 0) AS price, coalesce(shares, 0) AS shares FROM {t} t LEFT JOIN {sheet} s ON s.ticker = t.ticker", sheet=("ticker string, price double, shares double", [("A", 10.0, 5.0), ("B", None, 7.0)]))
def j18(df, sheet):
    return statements.column_lookup(df, sheet, "ticker", ["price", "shares"]).select("name", "ticker", "price", "shares")


_LBO = [("x", 10.0, 11.0, 0.6, 100.0, 150.0, 250.0), ("y", 1.0, 9.0, 0.85, 40.0, 30.0, 500.0)]
_LBO_DDL = 'name string, entry double, "exit" double, leverage double, ebitda double, exit_ebitda double, repaid double'


@fixture(
    "n16_lbo_grids",
    _LBO_DDL.replace('"', ""),
    _LBO,
    """WITH g AS (SELECT 'entry_exit' AS kind, name, i, j, entry + i - 2 AS en, exit + j - 2 AS ex, leverage AS le, ebitda, exit_ebitda, repaid FROM {t}, range(5) a(i), range(5) b(j)
UNION ALL SELECT 'entry_leverage', name, i, j, entry + i - 2, exit, greatest(0, least(0.9, leverage + (j - 2) * 0.1)), ebitda, exit_ebitda, repaid FROM {t}, range(5) a(i), range(5) b(j)
UNION ALL SELECT 'exit_leverage', name, i, j, entry, exit + i - 2, greatest(0, least(0.9, leverage + (j - 2) * 0.1)), ebitda, exit_ebitda, repaid FROM {t}, range(5) a(i), range(5) b(j)),
m AS (SELECT *, coalesce((ex * exit_ebitda - greatest(0, le * en * ebitda - repaid)) / nullif(en * ebitda - le * en * ebitda, 0), 0) AS moic FROM g)
SELECT kind, name, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(moic, 6) AS moic, round(CASE WHEN moic > 0 THEN pow(moic, 0.2) - 1 ELSE -1 END, 6) AS irr FROM m""",
)
def n16(df):
    out = None
    for kind in ("entry_exit", "entry_leverage", "exit_leverage"):
        part = valuation.lbo_grid(df, *kind.split("_")).select(F.lit(kind).alias("kind"), "name", "i", "j", _r("moic").alias("moic"), _r("irr").alias("irr"))
        out = part if out is None else out.unionByName(part)
    return out


_CASES = [("bear", 0.03, 0.12, 50.0, 100.0), ("base", 0.03, 0.03, 85.0, 100.0), ("bull", 0.02, 0.25, 30.0, 100.0), ("odd", 0.01, 0.08, 1.0, 0.0)]


@fixture("n19_dcf_findings", "name string, growth double, wacc double, pv_terminal double, ev double", _CASES, """SELECT name, 'growth_below_wacc' AS "check", CASE WHEN growth >= wacc THEN 'error' WHEN wacc NOT BETWEEN 0.05 AND 0.2 THEN 'warning' ELSE 'info' END AS level FROM {t}
UNION ALL SELECT name, 'terminal_share', CASE WHEN ev = 0 THEN 'info' WHEN pv_terminal / ev > 0.8 OR pv_terminal / ev < 0.4 THEN 'warning' ELSE 'info' END FROM {t}""")
def n19(df):
    return valuation.dcf_findings(df)


_AUDIT_DDL = "period string, assets double, liabilities double, equity double, cash double, cash_begin double, net_cash_flow double, retained double, retained_begin double, net_income double, dividends double, ppe double, ppe_begin double, capex double, depreciation double"
_AUDIT = [("2024", 100.0, 60.0, 40.0, 12.0, 10.0, 2.0, 30.0, 25.0, 8.0, 3.0, 50.0, 48.0, 7.0, 5.0), ("2025", 110.0, 60.0, 40.0, 12.0, 12.0, 5.0, 30.0, 30.0, 0.0, 0.0, 51.0, 50.0, 7.0, 5.0)]


@fixture(
    "n20_audit",
    _AUDIT_DDL,
    _AUDIT,
    """WITH g AS (SELECT period, 'balance' AS "check", assets - liabilities - equity AS gap FROM {t} UNION ALL SELECT period, 'cash', cash - cash_begin - net_cash_flow FROM {t}
UNION ALL SELECT period, 'retained', retained - retained_begin - net_income + dividends FROM {t} UNION ALL SELECT period, 'fixed_assets', ppe - ppe_begin - capex + depreciation FROM {t})
SELECT *, abs(gap) <= 1 AS ok FROM g""",
)
def n20(df):
    return valuation.model_audit(df)


_EARN = [("2025Q1", "gross", 40.0), ("2025Q1", "assets", 500.0), ("2025Q1", "equity", 200.0), ("2025Q2", "gross", 44.0), ("2025Q2", "assets", None)]


@fixture("n25_earnings", "period string, metric string, value double", _EARN, """WITH p AS (SELECT period, any_value(value) FILTER (metric = 'gross') AS gross_profit, any_value(value) FILTER (metric = 'assets') AS total_assets, any_value(value) FILTER (metric = 'equity') AS shareholders_equity FROM {t} GROUP BY period)
SELECT *, total_assets - shareholders_equity AS total_liabilities FROM p""")
def n25(df):
    return statements.earnings_metrics(df, ["period"], {"gross_profit": "gross", "total_assets": "assets", "shareholders_equity": "equity"})


def _reports(df):
    """Literal (period, field_id, data) rows as one nested report a period."""
    items = F.collect_list(F.when(F.col("field_id").isNotNull(), F.struct("field_id", "data", F.lit(None).cast("double").alias("yoy"))))
    return df.groupBy("period").agg(items.alias("item_list"))


_ITEMS = [("2025Q1", 8001, 100.0), ("2025Q1", 8004, 40.0), ("2025Q2", 8001, 110.0), ("2025Q3", None, None)]


@fixture("c06_nested_items", "period string, field_id int, data double", _ITEMS, "SELECT * FROM {t}")
def c06(df):
    return statements.nested_facts(_reports(df), ["period"]).select("period", "field_id", "data")


@fixture("z04_statement_table", "period string, field_id int, data double", _ITEMS, "SELECT p.period, s.place, s.field_id, s.name, f.data FROM (SELECT DISTINCT period FROM {t}) p CROSS JOIN {s} s LEFT JOIN {t} f ON f.period = p.period AND f.field_id = s.field_id", s=("place int, field_id int, name string", [(0, 8001, "revenue"), (1, 8004, "gross"), (2, 8017, "operating")]))
def z04(df, s):
    return statements.statement_table(_reports(df), [(8001, "revenue"), (8004, "gross"), (8017, "operating")], ["period"])


#: Ratios by market: name, numerator, denominator. Fixed values.
RATIOS = {
    "A": [("营业利润率", 3032, 3001), ("净利润率", 3043, 3001), ("营业费用率", 3005, 3001), ("销售费用率", 3013, 3001), ("管理费用率", 3014, 3001), ("研发费用率", 3015, 3001)],
    "US": [("毛利率", 8004, 8001), ("营业利润率", 8017, 8001), ("净利润率", 8043, 8001), ("营业费用率", 8005, 8001), ("销售和管理费用率", 8007, 8001), ("销售费用率", 8008, 8001), ("管理费用率", 8009, 8001), ("研发费用率", 8010, 8001)],
    "HK": [("毛利率", 5010, 5001), ("营业利润率", 5034, 5001), ("净利润率", 5051, 5001), ("销售成本率", 5008, 5001), ("营业费用率", 5013, 5001), ("销售及分销费用率", 5015, 5001), ("管理费用率", 5016, 5001), ("研发费用率", 5017, 5001)],
}
_MARKET_FACTS = [("US", "2025Q1", 8001, 200.0), ("US", "2025Q1", 8004, 90.0), ("US", "2025Q1", 8010, 20.0), ("HK", "2025Q1", 5001, 50.0), ("HK", "2025Q1", 5051, -5.0), ("A", "2025Q1", 3001, 0.0), ("A", "2025Q1", 3043, 4.0)]


@fixture(
    "z06_market_ratios",
    "market string, period string, field_id int, value double",
    _MARKET_FACTS,
    "SELECT a.market, a.period, c.name, round(a.value / b.value * 100, 2) AS ratio FROM {t} a JOIN {c} c ON c.market = a.market AND c.num = a.field_id JOIN {t} b ON b.market = a.market AND b.period = a.period AND b.field_id = c.den WHERE b.value <> 0",
    c=("market string, name string, num int, den int", [(m, *r) for m, rows in RATIOS.items() for r in rows]),
)
def z06(df, c):
    c = F.broadcast(c)  # a row a configured ratio
    top = df.withColumnRenamed("field_id", "num").join(c, ["market", "num"])
    under = df.select("market", "period", F.col("field_id").alias("den"), F.col("value").alias("base"))
    return top.join(under, ["market", "period", "den"]).select("market", "period", "name", statements.ratio(F.col("value"), F.col("base")).alias("ratio")).where("ratio is not null")


@fixture(
    "f26_segment_table",
    "id int, cells string",
    [(1, "a|100|200|300;b|400|500|600;c|1|2|3"), (2, "a|b;c|d"), (3, "x|1,000|2,000|3;y|(300)|400|5;z|500|6|7"), (4, "a|1|2|3;b|1|2|3;c|1|2|3")],
    """SELECT id, len(string_split(cells, ';')) >= 3 AND len(string_split(string_split(cells, ';')[1], '|')) BETWEEN 4 AND 10
AND len(list_filter(regexp_extract_all(replace(cells, ',', ''), '[0-9]+'), lambda x: CAST(x AS INTEGER) >= 100)) >= 5 AS looks FROM {t}""",
)
def f26(df):
    return df.select("id", statements.looks_like_segments(F.transform(F.split("cells", ";"), lambda r: F.split(r, r"\|"))).alias("looks"))


@fixture("z24_indicators", "name string", [("cpi",), ("CPI同比",), ("unknown",)], "SELECT t.name, c.code FROM {t} t LEFT JOIN {c} c ON lower(t.name) = lower(c.alias)", c=("code string, alias string", [("CPI", "cpi"), ("CPI", "CPI同比"), ("PPI", "ppi")]))
def z24(df, c):
    aliases = F.broadcast(c.groupBy("code").agg(F.collect_list("alias").alias("aliases")).select("code", F.explode("aliases").alias("alias")))  # the catalogue
    return df.join(aliases, F.lower("name") == F.lower("alias"), "left").select("name", "code")


@fixture("z26_positions", "acc_id int, code string, qty double, cost double, price double", [(1, "A", 10.0, 5.0, 6.0), (1, "B", None, None, 2.0), (2, "C", 3.0, None, None)], "SELECT acc_id, code, coalesce(qty, 0) AS qty, coalesce(qty, 0) * coalesce(price, 0) AS market_value, CASE WHEN cost IS NOT NULL THEN coalesce(qty, 0) * (coalesce(price, 0) - cost) END AS gain FROM {t}")
def z26(df):
    q, p = F.coalesce("qty", F.lit(0.0)), F.coalesce("price", F.lit(0.0))
    return df.select("acc_id", "code", q.alias("qty"), (q * p).alias("market_value"), (q * (p - F.col("cost"))).alias("gain"))


@fixture(
    "j12_month_join",
    "month string, r double",
    [("2024-01", 0.1), ("2024-02", 0.2), ("2024-04", 0.3)],
    "SELECT month, t.r AS stock, b.r AS bench FROM {t} t JOIN {b} b USING (month)",
    b=("month string, r double", [("2024-01", 0.01), ("2024-03", 0.02), ("2024-04", 0.03)]),
)
def j12(df, b):
    # by month, not by place, so a gap on one side doesn't shift the other
    return df.withColumnRenamed("r", "stock").join(b.withColumnRenamed("r", "bench"), "month")


_FOUND = [("00700", "腾讯控股", "港股", 116), ("TCEHY", "腾讯控股(ADR)", "美股", 153), ("12345", "腾讯购B", "港股", 116), ("80700", "腾讯控股-R", "港股", 116)]


@fixture(
    "s33_ticker_search",
    "code string, name string, kind string, market int",
    _FOUND,
    """WITH f AS (SELECT *, CASE market WHEN 116 THEN 'HKEX' ELSE 'OTHER' END AS exchange FROM {t} WHERE contains(kind, '股') AND NOT contains(name, '购') AND contains(name, '腾讯')),
r AS (SELECT *, row_number() OVER (ORDER BY CASE exchange WHEN 'HKEX' THEN 0 ELSE 1 END, code) AS n FROM f) SELECT code, exchange, round(1.0 - (n - 1) * 0.1, 4)::DOUBLE AS score FROM r WHERE n <= 2""",
)
def s33(df):
    """Securities of a name, the preferred exchange first, scores falling by place."""
    ok = df.where(filings.security_passes(F.col("kind"), F.col("name"), ["股"], ["购"]) & F.col("name").contains("腾讯"))
    ok = ok.withColumn("exchange", filings.exchange_name(F.col("market"), {"116": "HKEX"}))
    order = [F.when(F.col("exchange") == "HKEX", 0).otherwise(1), F.col("code")]
    ranked = retrieval.rank_decay(ok.orderBy(*order).limit(2).withColumn("g", F.lit(1)), 1.0, 0.1, ["g"], order)  # two rows
    return ranked.select("code", "exchange", _r("score", 4).alias("score"))


@query("z21_filtered_neighbours", "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE label >= 1 AND label <= 5 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) DESC, vec_id LIMIT 10")
def z21(spark, d):
    """Nearest vectors among those that pass a filter on other columns."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    q = e.agg(F.min_by("embedding", "vec_id").alias("v")).first().v
    rows = e.withColumns({"fiscal_year": F.col("label")}).where(retrieval.vector_filter(first=1, last=5))
    return retrieval.nearest(rows, q, 10, "vec_id").select("vec_id", _r("score").alias("score"))
