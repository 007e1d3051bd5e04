"""Registered queries of segment tables, over literal filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import segments as S
from quillmark.plans.fixtures import expected
from quillmark.plans.sources import stated

_PAGE = """<p>(In millions of RMB)</p><table>
<tr><td></td><td colspan="4">Three Months Ended June 30,</td><td colspan="2">Six Months Ended June 30,</td></tr>
<tr><td></td><td colspan="2">2025</td><td colspan="2">2024</td><td colspan="2">2025</td></tr>
<tr><td><b>Revenue</b></td><td></td><td></td><td></td></tr>
<tr><td>Cloud</td><td></td><td>1,200</td><td></td><td>1,000</td><td></td><td>2,300</td></tr>
<tr><td style="padding-left:12px">Infrastructure</td><td></td><td>800</td><td></td><td>700</td><td></td><td>1,500</td></tr>
<tr><td>Games</td><td>$</td><td>500</td><td>$</td><td>450</td><td>$</td><td>900</td></tr>
<tr><td>Total</td><td></td><td>1,700</td><td></td><td>1,450</td><td></td><td>3,200</td></tr>
<tr><td><b>Operating income</b></td><td></td><td></td><td></td></tr>
<tr><td>Cloud</td><td>(</td><td>20)</td><td></td><td>10</td><td></td><td>-</td></tr>
</table><table><tr><td>one column</td></tr></table>"""


def _pages(spark):
    return spark.createDataFrame([(1, _PAGE), (2, None), (3, "<p>no table</p>")], "id int, html string")


def _table(spark):
    return S.financial_tables(_pages(spark), "id", "html")


_ROWS = [
    (1, "", 0, False, "Three Months Ended June 30,||||Six Months Ended June 30,|", "CNY", "million"),
    (2, "", 0, False, "2025||2024||2025|", "CNY", "million"),
    (3, "Revenue", 0, False, "|||||", "CNY", "million"),
    (4, "Cloud", 0, False, "|1,200||1,000||2,300", "CNY", "million"),
    (5, "Infrastructure", 1, False, "|800||700||1,500", "CNY", "million"),
    (6, "Games", 0, False, "|$500||$450||$900", "CNY", "million"),
    (7, "Total", 0, True, "|1,700||1,450||3,200", "CNY", "million"),
    (8, "Operating income", 0, False, "|||||", "CNY", "million"),
    (9, "Cloud", 0, False, "|(20)||10||-", "CNY", "million"),
]


@stated("s19_financial_tables", "row int, label string, indent int, total boolean, cells string, currency string, unit string", _ROWS)
def s19(spark):
    return _table(spark).select("row", "label", "indent", "total", F.array_join("cells", "|").alias("cells"), "currency", "unit")


_TYPES = [("Three Months Ended June 30, 2025", "Q2", "Q4"), ("For the quarter ended September 30", "Q3", "Q1"), ("Six months ended June 30", "QTD6", "QTD6"), ("nine months ended", "QTD9", "QTD9"), ("Fiscal year ended March 31, 2026", "FY", "FY"), ("three-month figures", "Q1", "Q1"), ("2025", None, None)]


@expected("d10_period_type", "t string", [(t,) for t, *_ in _TYPES], "t string, calendar string, june string", _TYPES)
def d10(df):
    return df.select("t", S.period_type(F.col("t")).alias("calendar"), S.period_type(F.col("t"), 6).alias("june"))


@stated("h08_period_sequence", "col int, period string", [(1, "2025Q2"), (2, "2025Q2"), (3, "2024Q2"), (4, "2024Q2"), (5, "2025QTD6"), (6, "2025QTD6")])
def h08(spark):
    return S.period_sequence(_table(spark), ["id", "sheet"]).select("col", "period")


@stated("h09_by_indent", "label string, level int, parent string", [("Cloud", 1, None), ("Infrastructure", 2, "Cloud"), ("Games", 1, None), ("Cloud", 1, None)])
def h09(spark):
    return S.by_indent(_table(spark), ["id", "sheet"]).select("label", "level", "parent")


_CONFIG = [("CLOUD", "cloud", 1, None), ("IAAS", "infrastructure", 2, "CLOUD"), ("GAMES", "Games", 1, None), ("ADS", "advertising", 1, None)]


@stated("h09_by_config", "row int, code string, parent string", [(4, "CLOUD", None), (5, "IAAS", "CLOUD"), (6, "GAMES", None)])
def h09c(spark):
    config = spark.createDataFrame(_CONFIG, "code string, name string, level int, parent string")
    return S.by_config(_table(spark), config, ["id", "sheet"]).select("row", "code", "parent")


_FACTS = [
    ("CLOUD", "REVENUE", "2025Q2", 1200.0), ("CLOUD", "REVENUE", "2024Q2", 1000.0), ("CLOUD", "REVENUE", "2025QTD6", 2300.0),
    ("IAAS", "REVENUE", "2025Q2", 800.0), ("IAAS", "REVENUE", "2024Q2", 700.0), ("IAAS", "REVENUE", "2025QTD6", 1500.0),
    ("GAMES", "REVENUE", "2025Q2", 500.0), ("GAMES", "REVENUE", "2024Q2", 450.0), ("GAMES", "REVENUE", "2025QTD6", 900.0),
    ("CLOUD", "OPERATING_INCOME", "2025Q2", -20.0), ("CLOUD", "OPERATING_INCOME", "2024Q2", 10.0),
]


@stated("h06_row_facts", "segment string, metric string, period string, value double", _FACTS)
def h06(spark):
    rows, on = _table(spark), ["id", "sheet"]
    config = spark.createDataFrame(_CONFIG, "code string, name string, level int, parent string")
    metrics = [("REVENUE", "^revenue"), ("OPERATING_INCOME", "^operating income")]
    return S.row_facts(rows, S.period_sequence(rows, on), S.labelled(rows, config, on), metrics, on).select("segment", "metric", "period", "value")


_TEXT = "Segment results\n  100   200   300\n  (10)  30  20\nnote 5  text\n  1  2  3"


@stated("h07_column_facts", "segment string, metric string, period string, value double", [("VAS", "REVENUE", "2025Q3", 100.0), ("ADS", "REVENUE", "2025Q3", 200.0), ("VAS", "PROFIT", "2025Q3", -10.0), ("ADS", "PROFIT", "2025Q3", 30.0)])
def h07(spark):
    lines = S.line_cells(spark.createDataFrame([(1, _TEXT), (2, "1  1  9\n2  2  9")], "id int, text string"), "id")
    return S.column_facts(lines, ["id"], ["VAS", "ADS", "TOTAL"], ["REVENUE", "PROFIT"], "2025Q3", "TOTAL").select("segment", "metric", "period", "value")
