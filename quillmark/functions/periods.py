"""Fiscal-period algebra as Column expressions (no Python on the executors).

One internal form serves every period vocabulary: struct(fy int, kind string, ord int), where kind is
Q1..Q4, H1, H2 or FY.  Renderers give the spelling of each domain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order inside a year. Fixed values.
TAG_ORDER = {"Q1": 1, "Q2": 2, "H1": 2, "Q3": 3, "Q4": 4, "H2": 4, "FY": 5}
STATEMENT_ORDER = {"Q1": 1, "H1": 2, "Q2": 3, "Q3": 4, "H2": 5, "Q4": 6, "FY": 7}
#: Annualisation factors by period type. Fixed values.
ANNUALISE = {"FY": 1.0, "Q9": 4 / 3, "H1": 2.0, "H2": 2.0, "Q6": 2.0, "Q1": 4.0, "Q2": 4.0, "Q3": 4.0, "Q4": 4.0}


def _case(key: Column, values: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in reversed(values.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def parse_period(text: Column) -> Column:
    """struct(fy, kind, canonical): 2025Q1, Q12025, 2025H1, FY2025, 2025FY or 2025 (year only, no
    canonical); dashes and spaces don't count; anything else is null."""
    t = F.upper(F.regexp_replace(text, r"[-\s]", ""))
    forms = [(r"^(\d{4})(Q[1-4])$", 1, 2), (r"^(Q[1-4])(\d{4})$", 2, 1), (r"^(\d{4})(H[12])$", 1, 2), (r"^(FY)(\d{4})$", 2, 1), (r"^(\d{4})(FY)$", 1, 2)]
    fy = F.when(t.rlike(r"^\d{4}$"), t.cast("int"))
    kind = F.lit(None).cast("string")
    for pattern, year, part in reversed(forms):
        hit = t.rlike(pattern)
        fy = F.when(hit, F.regexp_extract(t, pattern, year).cast("int")).otherwise(fy)
        kind = F.when(hit, F.regexp_extract(t, pattern, part)).otherwise(kind)
    return F.when(fy.isNotNull(), F.struct(fy.alias("fy"), kind.alias("kind"), tag_label(fy, kind).alias("canonical")))


def tag_label(fy: Column, kind: Column) -> Column:
    """FY2025 or 2025Q1."""
    return F.when(kind == "FY", F.concat(F.lit("FY"), fy.cast("string"))).otherwise(F.concat(fy.cast("string"), kind))


def statement_label(fy: Column, kind: Column) -> Column:
    """2025FY or 2025Q1."""
    return F.concat(fy.cast("string"), kind)


def tag_sort_key(fy: Column, kind: Column) -> Column:
    return fy * 10 + _case(kind, TAG_ORDER)


def statement_sort_key(label: Column) -> Column:
    """Sort key of a statement column label; unknown kinds come first in their year."""
    fy = F.when(label.rlike(r"^\d{4}"), F.substring(label, 1, 4).cast("int"))
    return fy * 10 + F.coalesce(_case(F.substring(label, 5, 2), STATEMENT_ORDER), F.lit(0))


def previous(fy: Column, kind: Column, half_to_quarter: bool = False) -> Column:
    """Label of the period before; a whole year has none. A half goes to the half before, or
    (``half_to_quarter``) to the quarter whose order precedes it."""
    q = F.substring(kind, 2, 1).cast("int")
    quarter = F.when(q > 1, tag_label(fy, F.concat(F.lit("Q"), (q - 1).cast("string")))).otherwise(tag_label(fy - 1, F.lit("Q4")))
    half = F.when(kind == "H2", tag_label(fy, F.lit("H1"))).otherwise(tag_label(fy - 1, F.lit("H2")))
    if half_to_quarter:
        half = F.when(kind == "H1", tag_label(fy, F.lit("Q1"))).otherwise(tag_label(fy, F.lit("Q3")))
    return F.when(kind.startswith("Q"), quarter).when(kind.startswith("H"), half)


def year_ago(fy: Column, kind: Column) -> Column:
    return tag_label(fy - 1, kind)


#: Words that name a period relative to the latest. Fixed values.
LATEST_WORDS = "最新财报|最新一期|最近一期|最新季报|最新年报|最新的"
YEAR_AGO_WORDS = "去年同期|同比"
PREVIOUS_WORDS = "上季度|上一季|环比|前一季"
LAST_N_WORDS = r"(?:最近|近|过去)(\d+)(?:个季度|期|季)"


def relative_intent(query: Column) -> Column:
    """LAST_N, YEAR_AGO, PREVIOUS or LATEST, in that precedence; null if none."""
    return (
        F.when(query.rlike(LAST_N_WORDS), "LAST_N")
        .when(query.rlike(YEAR_AGO_WORDS), "YEAR_AGO")
        .when(query.rlike(PREVIOUS_WORDS), "PREVIOUS")
        .when(query.rlike(LATEST_WORDS), "LATEST")
    )


def relative_count(query: Column) -> Column:
    """How many periods a LAST_N query asks for; null for others."""
    return F.when(query.rlike(LAST_N_WORDS), F.regexp_extract(query, LAST_N_WORDS, 1).cast("int"))


def fiscal_quarter(month: Column, fy_end_month: int) -> Column:
    """Fiscal quarter of a calendar month for a year that ends in ``fy_end_month``."""
    return F.floor(F.pmod(month - fy_end_month - 1, F.lit(12)) / 3).cast("int") + 1


def fiscal_year(year: Column, month: Column, fy_end_month: int) -> Column:
    return F.when(month <= fy_end_month, year).otherwise(year + 1)


def calendar_label(fy: Column, kind: Column, fy_end_month: int) -> Column:
    """Calendar quarter label of a fiscal quarter, half (by its last quarter) or YTD period; a year
    keeps its own label."""
    q = _case(kind, {"Q1": 1, "Q2": 2, "H1": 2, "QTD6": 2, "Q3": 3, "QTD9": 3, "Q4": 4, "H2": 4})
    months = fy * 12 + (fy_end_month - 1) - (4 - q) * 3
    return F.when(kind == "FY", F.concat(fy.cast("string"), F.lit("FY"))).otherwise(
        F.concat(F.floor(months / 12).cast("int").cast("string"), F.lit("Q"), (F.floor(F.pmod(months, F.lit(12)) / 3).cast("int") + 1).cast("string"))
    )


def date_bucket(date: Column, freq: str) -> Column:
    """month 2026-06, quarter 2026Q2 or year 2026 of a date."""
    if freq == "month":
        return F.date_format(date, "yyyy-MM")
    if freq == "quarter":
        return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))
    return F.year(date).cast("string")


def previous_bucket(period: Column, freq: str) -> Column:
    """The bucket a year earlier."""
    return F.concat((F.substring(period, 1, 4).cast("int") - 1).cast("string"), F.substring(period, 5, 10))


def annualise(period: Column) -> Column:
    kind = F.regexp_extract(period, r"(FY|Q9|Q6|H[12]|Q[1-4])", 1)
    return F.coalesce(_case(kind, ANNUALISE), F.lit(1.0))


def quarter_label(raw: Column) -> Column:
    """2025/Q1, 2025 Q1 or (Q1)2025 as 2025Q1."""
    t = F.upper(F.regexp_replace(raw, r"[^0-9A-Za-z]", ""))
    return F.regexp_replace(F.regexp_replace(t, r"^(Q[1-4]|FY|H[12])(\d{4})$", "$2$1"), r"^(\d{4})(Q[1-4]|FY|H[12])$", "$1$2")


def time_terms(text: Column) -> Column:
    """Years 20xx and period kinds named in a text, in order, each once."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"(20\d{2})"), F.lit(1)), F.regexp_extract_all(F.upper(text), F.lit(r"(Q[1-4]|H[12]|FY)"), F.lit(1))))


def from_document_id(document_id: Column) -> Column:
    """Period kind named in a document id: first of Q1..Q4, H1, H2, FY/annual."""
    u = F.upper(document_id)
    out = F.when(u.contains("FY") | u.contains("ANNUAL"), "FY")
    for k in ("H2", "H1", "Q4", "Q3", "Q2", "Q1"):
        out = F.when(u.contains(k), k).otherwise(out)
    return out


def context_periods(fy: Column, kind: Column) -> Column:
    """struct(current, prior): a filing's own period and a year earlier; H1 reads as Q2, H2 and FY as
    Q4."""
    k = F.when(kind == "H1", "Q2").when(kind.isin("H2", "FY"), "Q4").otherwise(kind)
    return F.struct(statement_label(fy, k).alias("current"), statement_label(fy - 1, k).alias("prior"))


def is_quarterly(label: Column) -> Column:
    return label.rlike(r"^20\d{2}(Q[1-4]|H[12])$")


def is_annual(label: Column) -> Column:
    return label.rlike(r"^20\d{2}FY$")


def period_passes(label: Column, years: list[int | tuple[int, int]] | None = None, kinds: list[str] | None = None, exact: list[str] | None = None) -> Column:
    """Year set and closed ranges, kinds, and exact labels; a part left out doesn't restrict."""
    fy, kind, ok = F.substring(label, 1, 4).cast("int"), F.substring(label, 5, 4), F.lit(True)
    if years:
        some = F.lit(False)
        for y in years:
            some = some | (fy.between(*y) if isinstance(y, tuple) else fy == y)
        ok = ok & some
    if kinds:
        ok = ok & kind.isin(kinds)
    if exact:
        ok = ok & label.isin(exact)
    return ok
