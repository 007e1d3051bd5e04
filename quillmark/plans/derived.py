"""Rules of filings, texts, periods and models over rows that both engines derive from the benchmark tables by the same
SELECT: what the tables don't hold as such (titles, filings, statements) is made of their keys, dates, amounts and texts."""

from __future__ import annotations

from quillmark.plans import chain, fixtures, segments, sources  # noqa: F401  (their rules)
from quillmark.plans.fixtures import RATIOS, derived

_YEAR = "CAST(2018 + {k} % 8 AS INT)"


def _pick(k: str, *values: str | None) -> str:
    """One of the values by a key."""
    cases = " ".join(f"WHEN {n} THEN {'NULL' if v is None else v}" for n, v in enumerate(values))
    return f"CASE {k} % {len(values)} {cases} END"


def _text(*values: str | None) -> list[str | None]:
    return [None if v is None else "'" + v.replace("'", "''") + "'" for v in values]


# --- filings and announcements -----------------------------------------------------------------------

derived(
    "f21_sec_files",
    f"""SELECT {_pick('o_custkey', "lower(ticker) || '-' || '2024' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || '.htm'", *_text('ex99-1.htm', 'd1dex991.htm', 'ex99-10.htm', 'baba-20f.htm', '', 'other-20240630.htm'))} AS name, title, ticker
FROM (SELECT *, {_pick('o_orderkey', *_text('Form 10-K', '10-Q', '6-K', '20-F', '8-K'))} AS title, {_pick('o_orderkey', *_text('MSFT', 'BABA', 'TCOM'))} AS ticker FROM {{orders}}) x""",
)
derived(
    "f22_security_types",
    f"SELECT CAST(p_partkey AS STRING) AS code, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name || CASE WHEN p_partkey % 5 = 0 THEN '购B' ELSE '' END END AS name, {_pick('p_partkey', *_text('港股', '美股', '沪A', '基金', None))} AS kind, CAST({_pick('p_size', '116', '106', '1', '7')} AS INT) AS market FROM {{part}}",
    sql="SELECT code, CASE market WHEN 116 THEN 'HKEX' WHEN 106 THEN 'NYSE' WHEN 1 THEN 'SSE' ELSE 'OTHER' END AS exchange FROM {t} WHERE (contains(kind, '股') OR contains(kind, 'A')) AND NOT coalesce(contains(name, '购'), false)",
)
_FILED = f"SELECT CAST(doc_id AS STRING) AS doc, {_pick('doc_id', 'true', 'false', 'NULL', 'false', 'NULL')} AS is_deleted, {_pick('doc_id', 'NULL', 'true', 'NULL', 'false', 'NULL', 'NULL', 'false')} AS deleted, {_pick('doc_id', 'true', 'NULL', 'true', 'false')} AS ingest_complete, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(2018 + doc_id % 9 AS INT) END AS fiscal_year FROM {{documents}}"
derived("f28_complete", _FILED)
derived("s10_selection_reasons", _FILED)
derived(
    "f29_citation",
    "SELECT CAST(doc_id AS INT) AS n, source AS ticker, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(2018 + doc_id % 8 AS STRING) END AS fiscal_year, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '2025Q' || CAST(1 + doc_id % 4 AS STRING) END AS fiscal_period, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE lang END AS heading, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'h' || CAST(n_chars AS STRING) END AS header FROM {documents}",
)
derived("z02_registry", f"SELECT {_pick('c_custkey', *_text('BABA', 'PDD'), *['c_mktsegment'] * 4)} AS symbol, {_pick('c_nationkey', *_text('US', 'HK', 'CN', 'JP'))} AS market, ' ' || c_name || ' ' AS name FROM {{customer}}")
derived(
    "z27_benchmark",
    f"SELECT {_pick('c_custkey', *_text('US.', 'HK.', 'SH.', ''))} || c_name AS code, {_pick('c_nationkey', *_text('CNY', 'USD', None))} AS currency FROM {{customer}}",
    counts=f"SELECT benchmark, CAST(count(DISTINCT substr(CAST(o_orderdate AS STRING), 1, 7)) AS INT) AS n FROM (SELECT o_orderdate, CASE WHEN o_orderkey % 997 = 0 THEN 'KWEB' ELSE {_pick('o_orderkey', *_text('PGJ', 'US.SPY', 'HK.800000'))} END AS benchmark FROM {{orders}}) x GROUP BY benchmark",
)
derived(
    "j13_alias_match",
    "SELECT CAST(p_partkey AS INT) AS id, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN upper(split_part(p_name, ' ', 2)) ELSE ' ' || p_name END AS label FROM {part}",
    aliases="SELECT upper(w) AS code, w AS alias, CAST(min(k) AS INT) AS place FROM (SELECT split_part(p_name, ' ', CAST(1 + p_partkey % 2 AS INT)) AS w, p_partkey AS k FROM {part}) x GROUP BY w",
)

# --- periods and texts -------------------------------------------------------------------------------

derived("x04_keyword_length", "SELECT substr(split_part(text, ' ', 1), 1, CAST(1 + doc_id % 4 AS INT)) AS w FROM {documents} WHERE text IS NOT NULL")
derived("k07_keyword_cap", "SELECT CAST(conv_id * 100 + turn AS INT) AS id, replace(text, ' ', ',') AS words FROM {conversations} WHERE text IS NOT NULL")
derived("x17_field_fallback", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(2018 + o_orderkey % 8 AS INT) END AS fiscalYear, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(2000 + o_custkey % 20 AS INT) END AS fiscal_year FROM {orders}")
derived("x18_scaled", "SELECT CAST(floor(o_totalprice * 100) AS BIGINT) - 20000000 AS v FROM {orders}")
derived(
    "d02_sort_key",
    "SELECT DISTINCT CASE k WHEN 'FY' THEN 'FY' || y ELSE y || k END AS p FROM (SELECT substr(CAST(o_orderdate AS STRING), 1, 4) AS y, " + _pick("o_orderkey", *_text("Q1", "H1", "Q3", "H2", "Q4", "FY", "Q2")) + " AS k FROM {orders}) x",
    sql="SELECT p, row_number() OVER (ORDER BY CAST(regexp_extract(p, '[0-9]{{4}}') AS INTEGER), CASE replace(p, regexp_extract(p, '[0-9]{{4}}'), '') WHEN 'Q1' THEN 1 WHEN 'Q2' THEN 2 WHEN 'H1' THEN 2 WHEN 'Q3' THEN 3 WHEN 'H2' THEN 4 WHEN 'Q4' THEN 4 ELSE 5 END, p) AS place FROM {t}",
)
derived(
    "d04_document_period",
    f"SELECT {_pick('o_custkey', *[x for x in _text('_Q1_report', '-h1', '_annual', '_FY', '_misc', '_q3')])} AS suffix, substr(CAST(o_orderdate AS STRING), 1, 4) || {_pick('o_custkey', *_text('_Q1_report', '-h1', '_annual', '_FY', '_misc', '_q3'))} AS id FROM {{orders}}",
    sql="SELECT id, CASE WHEN ends_with(id, '_Q1_report') THEN 'Q1' WHEN ends_with(id, '-h1') THEN 'H1' WHEN ends_with(id, '_annual') OR ends_with(id, '_FY') THEN 'FY' WHEN ends_with(id, '_q3') THEN 'Q3' END AS kind FROM {t}",
)
derived(
    "d05_canonical",
    f"SELECT {_pick('o_custkey', *_text('Q1', 'h1', 'FY', '', None, 'Q7', '2025Q1'))} AS period, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(substr(CAST(o_orderdate AS STRING), 1, 4) AS INT) END AS year FROM {{orders}}",
    sql="SELECT period, year, CASE WHEN period = '2025Q1' THEN period WHEN year IS NULL THEN NULL WHEN period = 'FY' THEN 'FY' || year WHEN upper(period) IN ('Q1', 'H1') THEN year || upper(period) END AS canonical FROM {t}",
)
derived(
    "d06_relative",
    f"SELECT c_name || {_pick('c_custkey', *_text(' 最近', ' 近', ' 过去'))} || CAST(2 + c_custkey % 7 AS STRING) || {_pick('c_nationkey', *_text('期营收', '个季度', '季'))} AS q FROM {{customer}} WHERE c_custkey % 2 = 0 UNION ALL SELECT c_mktsegment || {_pick('c_custkey', *_text(' 去年同期', ' 同比增长', ' 上季度环比', ' 前一季', ' 最新财报', ' revenue'))} FROM {{customer}} WHERE c_custkey % 2 = 1",
    sql="SELECT q, CASE WHEN regexp_matches(q, '(最近|近|过去)[0-9]+(期|个季度|季)') THEN 'LAST_N' WHEN regexp_matches(q, '去年同期|同比') THEN 'YEAR_AGO' WHEN regexp_matches(q, '环比|前一季') THEN 'PREVIOUS' WHEN contains(q, '最新') THEN 'LATEST' END AS intent, CASE WHEN regexp_matches(q, '(最近|近|过去)[0-9]+(期|个季度|季)') THEN CAST(regexp_extract(q, '[近去]([0-9]+)', 1) AS INTEGER) END AS n FROM {t}",
)
derived(
    "z23_asked_periods",
    f"SELECT {_pick('o_orderkey', chr(39) + 'FY' + chr(39) + ' || y', 'y', 'y || ' + chr(39) + 'Q1' + chr(39), 'NULL', chr(39) + 'x' + chr(39))} AS a, {_pick('o_custkey', 'y', 'NULL', 'y || ' + chr(39) + 'Q4' + chr(39))} AS b FROM (SELECT *, substr(CAST(o_orderdate AS STRING), 1, 4) AS y FROM {{orders}}) x",
    sql="SELECT a, b, TRY_CAST(regexp_extract(a, '[0-9]{{4}}') AS INTEGER) AS from_year, TRY_CAST(regexp_extract(b, '[0-9]{{4}}') AS INTEGER) AS to_year, CASE WHEN regexp_matches(a, 'Q|FY') THEN a WHEN regexp_matches(b, 'Q|FY') THEN b END AS period FROM {t}",
)
derived(
    "x14_chinese_years",
    "SELECT translate(substr(CAST(o_orderdate AS STRING), 1, CAST(CASE WHEN o_orderkey % 9 = 0 THEN 3 ELSE 4 END AS INT)), '0123456789', CASE WHEN o_orderkey % 2 = 0 THEN '零一二三四五六七八九' ELSE '〇一二三四五六七八九' END) AS y FROM {orders}",
    sql="SELECT y, CASE WHEN len(y) = 4 THEN CAST(translate(y, '零〇一二三四五六七八九', '00123456789') AS INTEGER) END AS n FROM {t}",
)
derived(
    "x18_big_numbers",
    f"SELECT CAST(floor(o_totalprice) * {_pick('o_orderkey', '1', '100', '100000', '-1', '10000000000')} AS DOUBLE) + 0.5 AS x FROM {{orders}}",
    sql="SELECT x, CASE WHEN abs(x) >= 1e12 THEN printf('%.2f', x / 1e12) || '万亿' WHEN abs(x) >= 1e8 THEN printf('%.2f', x / 1e8) || '亿' WHEN abs(x) >= 1e4 THEN printf('%.2f', x / 1e4) || '万' ELSE printf('%.2f', x) END AS shown FROM {t}",
)

derived("x10_spaces", "SELECT text AS t FROM {documents} WHERE text IS NOT NULL", sql=r"SELECT t, trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\x{{00a0}}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS clean FROM {t}")
derived(
    "x11_sentences",
    "SELECT text AS t FROM {documents} WHERE text IS NOT NULL",
    sql=r"SELECT t, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(t, '([。！？；!?;])', '\1' || chr(1), 'g'), '\.\s+', '.' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM {t}",
)
derived("x13_tickers", "SELECT CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS STRING), 5, '0') || '.HK 营收' WHEN c_custkey % 3 = 1 THEN '6' || lpad(CAST(c_custkey AS STRING), 5, '0') || '的ROE' ELSE '营收如何' END AS q FROM {customer}", sql="SELECT q, nullif(regexp_extract(q, '[0-9]{{5,6}}'), '') AS ticker FROM {t}")
derived("x15_hierarchy", "SELECT repeat('  ', CAST(l_linenumber - 1 AS INT)) || CASE WHEN l_linenumber > 1 THEN '├─ ' ELSE '' END || l_returnflag || CAST(l_partkey AS STRING) AS raw FROM {lineitem}", sql="SELECT raw, regexp_replace(raw, '^[ ├─]+', '') AS name, CAST((len(raw) - len(ltrim(raw, ' '))) // 2 + 1 AS INTEGER) AS level FROM {t}")
derived("d15_time_terms", "SELECT CAST(2015 + o_orderkey % 10 AS STRING) || '年Q' || CAST(1 + o_custkey % 4 AS STRING) || '和' || CAST(2016 + o_orderkey % 10 AS STRING) || '年' || CASE WHEN o_custkey % 3 = 0 THEN 'FY' WHEN o_custkey % 3 = 1 THEN 'h1' ELSE '' END AS q FROM {orders}", sql="SELECT q, array_to_string(list_concat(regexp_extract_all(q, '20[0-9]{{2}}'), regexp_extract_all(upper(q), 'Q[1-4]|H[12]|FY')), ',') AS terms FROM {t}")
_MONTHS = _text("March", "June", "September", "December")
derived(
    "d10_period_type",
    f"SELECT {_pick('o_custkey', *_text('Three Months Ended ', 'For the quarter ended '))} || {_pick('o_orderkey', *_MONTHS)} || ' 30, ' || substr(CAST(o_orderdate AS STRING), 1, 4) AS t FROM {{orders}}",
    sql="SELECT t, CASE WHEN contains(t, 'March') THEN 'Q1' WHEN contains(t, 'June') THEN 'Q2' WHEN contains(t, 'September') THEN 'Q3' ELSE 'Q4' END AS calendar, CASE WHEN contains(t, 'March') THEN 'Q3' WHEN contains(t, 'June') THEN 'Q4' WHEN contains(t, 'September') THEN 'Q1' ELSE 'Q2' END AS june FROM {t}",
)
derived("s33_ticker_search", f"SELECT c_name AS code, {_pick('c_custkey', *_text('腾讯', '腾讯购', '阿里'))} || c_name AS name, {_pick('c_nationkey', *_text('港股', '美股', '基金'))} AS kind, CAST({_pick('c_custkey', '116', '153')} AS INT) AS market FROM {{customer}}")

# --- retrieval ---------------------------------------------------------------------------------------

_CHUNKS = "SELECT CAST({i} AS STRING) AS chunk_id, {s} AS doc, CASE WHEN {i} % 10 = 0 THEN NULL ELSE ({i} * 37 % 101) / 100.0 END AS score, CASE WHEN {i} % 3 = 0 THEN text ELSE '云' || text END AS content FROM "
_OF_DOCS = _CHUNKS.format(i="doc_id", s="source").replace("/ 100.0", "/ CAST(100 AS DOUBLE)") + "{documents}"
_OF_ITEMS = _CHUNKS.format(i="item_id", s="'b'").replace("/ 100.0", "/ CAST(100 AS DOUBLE)") + "{benchmark}"
derived("k04_top", _OF_DOCS)
derived("k05_merge_order", _OF_ITEMS)
derived("k06_recall", _OF_DOCS)
derived("u01_union", _OF_DOCS, more=_OF_ITEMS)
derived("f06_intent_gate", f"SELECT {_pick('event_id', *_text(None, 'KB_SEARCH', 'CLARIFICATION', 'SUMMARIZE', 'WEB_SEARCH', 'GREETING'))} AS i FROM {{events}}")
_TYPED = f"SELECT CAST(doc_id AS STRING) AS chunk_id, {_pick('doc_id', *_text('00700', 'BABA', 'MSFT'))} AS ticker, {_pick('n_chars', *_text('10-K', '10-Q', '20-F'))} AS form_type, CAST(2018 + doc_id % 8 AS STRING) || {_pick('doc_id', *_text('FY', 'Q1'))} AS fiscal_period, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(2018 + doc_id % 8 AS INT) END AS fiscal_year FROM {{documents}} WHERE n_chars IS NOT NULL"
derived("f11_vector_filter", _TYPED)
derived("f05_domain_guard", _TYPED)
derived("k13_latest_filings", _TYPED)
derived("n23_score_fallback", "SELECT CAST(event_id AS INT) AS id, CASE WHEN event_id % 3 = 0 THEN value / 100 END AS score, CASE WHEN event_id % 5 < 3 THEN value / 50 END AS vec, CASE WHEN event_id % 7 < 5 THEN value / 25 END AS term FROM {events}")
_STORE = "SELECT lang AS ticker, source AS doc, CAST(doc_id AS STRING) AS chunk_id, CAST(n_chars AS INT) AS v FROM {documents}"
derived("m3_rebuild", _STORE, "SELECT * FROM {t} t WHERE NOT EXISTS (SELECT 1 FROM {new} n WHERE n.ticker = t.ticker AND n.doc = t.doc) UNION ALL SELECT * FROM {new}", new="SELECT lang AS ticker, source AS doc, 'n' || CAST(doc_id AS STRING) AS chunk_id, 1 AS v FROM {documents} WHERE doc_id % 97 = 0")
derived("z19_delete", _STORE, "SELECT * FROM {t} t WHERE NOT EXISTS (SELECT 1 FROM {gone} n WHERE n.ticker = t.ticker AND n.doc = t.doc)", gone="SELECT DISTINCT lang AS ticker, source AS doc FROM {documents} WHERE doc_id % 97 = 0")
_TAGS = "SELECT CAST(doc_id AS STRING) AS chunk_id, 'lang' AS tag, lang AS value FROM {documents} UNION ALL SELECT CAST(doc_id AS STRING), 'source', source FROM {documents}"
derived("m4_tag_refresh", _TAGS, "SELECT * FROM {t} WHERE chunk_id NOT IN (SELECT chunk_id FROM {chunks}) UNION ALL SELECT * FROM {new}", new="SELECT CAST(doc_id AS STRING) AS chunk_id, 'quality' AS tag, CAST(quality AS STRING) AS value FROM {labels}", chunks="SELECT CAST(doc_id AS STRING) AS chunk_id FROM {labels}")
derived(
    "z22_discover",
    f"SELECT CAST(doc_id AS STRING) AS doc, {_pick('n_chars', *_text('10-K', '10-k', '10-Q'))} AS form_type, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(2018 + doc_id % 8 AS INT) END AS fiscal_year, doc_id % 2 = 0 AS processed FROM {{documents}} WHERE n_chars IS NOT NULL",
    c="SELECT CAST(doc_id AS STRING) AS doc, text AS content FROM {documents}",
)
derived("s22_upsert", "SELECT CAST(doc_id AS STRING) AS chunk_id, CAST(n_chars AS INT) AS v FROM {documents}", "SELECT * FROM {t} WHERE chunk_id NOT IN (SELECT chunk_id FROM {new}) UNION ALL SELECT * FROM {new}", new="SELECT CAST(doc_id * 2 AS STRING) AS chunk_id, CAST(quality AS INT) AS v FROM {labels}")

# --- statements and models ---------------------------------------------------------------------------

_SEGMENTS = "SELECT CAST(l_partkey AS STRING) AS code, CASE WHEN l_linenumber > 1 THEN CAST(l_suppkey AS STRING) END AS parent, CAST(l_linenumber AS INT) AS level, l_returnflag AS metric, CASE WHEN l_orderkey % 9 = 0 THEN '' ELSE substr(CAST(l_shipdate AS STRING), 1, 4) || " + _pick("l_orderkey", *_text("FY", "Q3", "H1", "Q9", "Q1")) + " END AS period, l_extendedprice AS value FROM {lineitem}"
derived("f17_segment_level", _SEGMENTS)
derived("f18_segment_periods", _SEGMENTS)
derived("u06_table_fingerprint", "SELECT CAST(l_linenumber AS INT) AS page, CAST(l_quantity AS INT) AS cols, 3 AS n, l_returnflag || ' ' || l_linestatus AS body FROM {lineitem}")
derived("u07_keep_latest", "SELECT o_orderstatus AS indicator, CAST(o_orderdate AS STRING) AS report_date, max(o_totalprice) AS value FROM {orders} GROUP BY o_orderstatus, CAST(o_orderdate AS STRING)")
derived("u08_accounts", "SELECT CAST(o_custkey AS INT) AS acc_id, o_orderstatus AS market FROM {orders}", more="SELECT CAST(c_custkey AS INT) AS acc_id, substr(c_mktsegment, 1, 1) AS market FROM {customer}")
derived("n04_gross_margin", "SELECT CASE WHEN o_orderkey % 10 = 0 THEN CAST(0 AS DOUBLE) WHEN o_orderkey % 10 = 1 THEN NULL ELSE o_totalprice END AS r, o_totalprice * ((o_custkey * 7919 % 1301) / CAST(1000 AS DOUBLE)) AS c FROM {orders}")
derived(
    "n06_roa_roe",
    f"SELECT substr(CAST(o_orderdate AS STRING), 1, 4) || {_pick('o_orderkey', *_text('Q1', 'FY', 'Q6', 'Q9'))} AS period, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS total, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice * 0.9 END AS owners, CASE WHEN o_custkey % 11 > 0 THEN CAST(o_custkey * 1009 + 17 AS DOUBLE) END AS assets, CASE WHEN o_custkey % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(o_custkey * 503 + 7 AS DOUBLE) END AS equity FROM {{orders}}",
)
derived("z07_cash_conversion", "SELECT CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_custkey * 101 AS DOUBLE) END AS fcf, CASE WHEN o_orderkey % 5 = 0 THEN CAST(0 AS DOUBLE) WHEN o_orderkey % 5 < 4 THEN o_totalprice END AS total, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice * 0.9 END AS owners FROM {orders}")
derived("z08_capex", f"SELECT substr(CAST(o_orderdate AS STRING), 1, 7) AS period, {_pick('o_orderkey', *_text('5071', '5073', '5001'))} AS field_id, CASE WHEN o_custkey % 4 > 0 THEN floor(o_totalprice) - 200000 END AS value FROM {{orders}}")
derived("z10_coverage", f"SELECT period, metric, sum(v) AS value FROM (SELECT substr(CAST(o_orderdate AS STRING), 1, 10) AS period, {_pick('o_orderkey', *_text('assets', 'cash'))} AS metric, CASE WHEN o_custkey % 4 = 0 THEN CAST(0 AS DOUBLE) WHEN o_custkey % 4 > 1 THEN o_totalprice END AS v FROM {{orders}}) x GROUP BY period, metric")
derived("z17_latest_values", f"SELECT CAST(o_custkey AS STRING) AS ticker, o_orderstatus AS metric, substr(CAST(o_orderdate AS STRING), 1, 10) AS period, max(o_totalprice) AS value FROM {{orders}} GROUP BY o_custkey, o_orderstatus, substr(CAST(o_orderdate AS STRING), 1, 10)")
derived("z13_estimates", "SELECT CAST(c_custkey AS STRING) AS ticker, '2024FY' AS period, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS value FROM {customer}", est="SELECT CAST(c_custkey AS STRING) AS ticker, '2025FY' AS period, CASE WHEN c_custkey % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE c_acctbal * 2 END AS value FROM {customer}")
derived("n18_multiples", "SELECT c_name AS name, abs(c_acctbal) * 3 AS ev, abs(c_acctbal) * 2 AS cap, CASE WHEN c_custkey % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(c_custkey AS DOUBLE) END AS revenue, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 0.3 END AS ebit, CASE WHEN c_custkey % 4 = 0 THEN CAST(-c_custkey AS DOUBLE) ELSE c_custkey * 0.2 END AS earnings FROM {customer}")
derived("j18_comps_lookup", "SELECT c_name AS name, 'S' || CAST(c_custkey % 200 AS STRING) AS ticker FROM {customer}", sheet="SELECT 'S' || CAST(s_suppkey AS STRING) AS ticker, CASE WHEN s_suppkey % 6 > 0 THEN s_acctbal END AS price, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_nationkey AS DOUBLE) END AS shares FROM {supplier}")
derived(
    "n16_lbo_grids",
    "SELECT p_brand || CAST(p_partkey AS STRING) AS name, CAST(6 + p_partkey % 9 AS DOUBLE) AS entry, CAST(17 + p_size % 9 AS DOUBLE) AS exit, 0.3 + (p_partkey % 7) * CAST(0.1 AS DOUBLE) AS leverage, p_retailprice AS ebitda, p_retailprice * 1.5 AS exit_ebitda, p_retailprice * (p_size % 5) AS repaid FROM {part}",
)
derived("n19_dcf_findings", "SELECT p_brand || CAST(p_partkey AS STRING) AS name, (p_partkey % 6) / CAST(100 AS DOUBLE) AS growth, (2 + p_size % 24) / CAST(100 AS DOUBLE) AS wacc, p_retailprice * (p_size % 10) / 10 AS pv_terminal, CASE WHEN p_partkey % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE p_retailprice END AS ev FROM {part}")
derived(
    "n20_audit",
    "SELECT CAST(o_orderkey AS STRING) AS period, CAST(c + 60 AS DOUBLE) AS assets, CAST(60 AS DOUBLE) AS liabilities, CAST(c + o_orderkey % 3 AS DOUBLE) AS equity, CAST(c AS DOUBLE) AS cash, CAST(c - 2 AS DOUBLE) AS cash_begin, CAST(o_orderkey % 5 AS DOUBLE) AS net_cash_flow, CAST(c AS DOUBLE) AS retained, CAST(c - 5 AS DOUBLE) AS retained_begin, CAST(8 AS DOUBLE) AS net_income, CAST(o_orderkey % 7 AS DOUBLE) AS dividends, CAST(c + 2 AS DOUBLE) AS ppe, CAST(c AS DOUBLE) AS ppe_begin, CAST(7 AS DOUBLE) AS capex, CAST(o_orderkey % 9 AS DOUBLE) AS depreciation FROM (SELECT o_orderkey, floor(o_totalprice) AS c FROM {orders}) x",
)
derived("n25_earnings", f"SELECT period, metric, max(v) AS value FROM (SELECT substr(CAST(o_orderdate AS STRING), 1, 10) AS period, {_pick('o_orderkey', *_text('gross', 'assets', 'equity'))} AS metric, CASE WHEN o_custkey % 6 > 0 THEN floor(o_totalprice) END AS v FROM {{orders}}) x GROUP BY period, metric")
_ITEMS = f"SELECT CAST(o_orderdate AS STRING) AS period, CAST(field AS INT) AS field_id, max(floor(o_totalprice)) AS data FROM (SELECT *, {_pick('o_orderkey', '8001', '8004', '8010')} AS field FROM {{orders}}) x GROUP BY CAST(o_orderdate AS STRING), field"
derived("c06_nested_items", _ITEMS)
derived(
    "z04_statement_table",
    _ITEMS,
    sql="SELECT p.period, s.place, s.field_id, s.name, f.data FROM (SELECT DISTINCT period FROM {t}) p CROSS JOIN (VALUES (0, 8001, 'revenue'), (1, 8004, 'gross'), (2, 8017, 'operating')) s(place, field_id, name) LEFT JOIN {t} f ON f.period = p.period AND f.field_id = s.field_id",
    s="SELECT r_regionkey AS place FROM {region}",
)
_FIELDS = {"US": ("8001", "8004", "8017", "8010"), "HK": ("5001", "5010", "5051", "5017"), "A": ("3001", "3032", "3043", "3015")}
derived(
    "z06_market_ratios",
    f"SELECT market, period, CAST(CASE market WHEN 'US' THEN {_pick('f', *_FIELDS['US'])} WHEN 'HK' THEN {_pick('f', *_FIELDS['HK'])} ELSE {_pick('f', *_FIELDS['A'])} END AS INT) AS field_id, max(v) AS value FROM (SELECT {_pick('o_custkey', *_text('US', 'HK', 'A'))} AS market, CAST(o_orderdate AS STRING) AS period, o_orderkey % 4 AS f, CASE WHEN o_orderkey % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE floor(o_totalprice) END AS v FROM {{orders}}) x GROUP BY market, period, f",
    c=" UNION ALL ".join(f"SELECT '{m}' AS market, '{n}' AS name, {a} AS num, {b} AS den" for m, rows in RATIOS.items() for n, a, b in rows),
)
derived("f26_segment_table", "SELECT CAST(l_orderkey AS INT) AS id, x AS cells FROM (SELECT l_orderkey, 'a|' || CAST(min(l_partkey) AS STRING) || '|' || CAST(max(l_partkey) AS STRING) || '|' || CAST(count(*) AS STRING) || ';b|' || CAST(min(l_suppkey) AS STRING) || '|' || CAST(max(CAST(l_extendedprice AS INT)) AS STRING) || '|(' || CAST(min(CAST(l_extendedprice AS INT)) AS STRING) || ')' || CASE WHEN l_orderkey % 3 > 0 THEN ';c|1|200|3' ELSE '' END AS x FROM {lineitem} GROUP BY l_orderkey) y")
derived("z26_positions", "SELECT CAST(o_custkey AS INT) AS acc_id, CAST(o_orderkey AS STRING) AS code, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 90 AS DOUBLE) END AS qty, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_custkey AS DOUBLE) END AS cost, CASE WHEN o_orderkey % 11 > 0 THEN floor(o_totalprice) END AS price FROM {orders}")
derived("z24_indicators", "SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_brand END AS name FROM {part}", c="SELECT max(p_brand) AS code, p_name AS alias FROM {part} GROUP BY p_name")
derived("j12_month_join", "SELECT substr(CAST(o_orderdate AS STRING), 1, 10) AS month, max(o_totalprice) AS r FROM {orders} WHERE o_orderkey % 2 = 0 GROUP BY substr(CAST(o_orderdate AS STRING), 1, 10)", b="SELECT substr(CAST(o_orderdate AS STRING), 1, 10) AS month, min(o_totalprice) AS r FROM {orders} WHERE o_orderkey % 3 = 0 GROUP BY substr(CAST(o_orderdate AS STRING), 1, 10)")
