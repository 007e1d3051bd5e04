"""Segment tables of filings: rows with indents and units, period types and sequences, recognition, and the layouts
that turn tables into facts (segment, metric, period, value)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.periods import fiscal_quarter, fiscal_year
from quillmark.operators.manypatterns import contained
from quillmark.operators.sections import Node, tree
from quillmark.operators.statements import number
from quillmark.sources.shared import row_batches

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_MONTH = "(" + "|".join(MONTHS) + ")"
#: Words of labels that are metrics and no segments. Fixed values.
METRIC_WORDS = ["revenue", "income", "profit", "loss", "expense", "cost", "margin", "earnings", "per share", "eps", "ads", "cash", "asset", "liability", "equity", "depreciation", "amortization", "tax", "interest", "ebit", "ebitda", "ebita", "adjusted", "non-gaap", "gaap", "收入", "利润", "亏损", "成本", "费用", "支出", "收益", "每股", "现金", "资产", "负债", "权益", "折旧", "摊销", "税", "利息", "经调整", "调整后", "非公认", "公认会计", "numerator", "denominator", "basic", "diluted", "share", "shares", "months", "year", "quarter", "0-3", "3-6", "6-12", "over", "accounts receivable", "accounts payable", "current", "deferred", "impairment", "goodwill", "intangible", "buyer protection", "less:", "add:", "for the", "for the three", "for the six", "减值", "商誉", "无形资产", "买家保障", "存款"]
HEADER_ROWS = 5
_INDENT = re.compile(r"(?:padding-left|margin-left|text-indent)\s*:\s*(\d+)", re.I)


# --- tables of HTML filings -------------------------------------------------------------------------


def _rows(table: Node) -> Iterator[tuple[str, int, bool, bool, list[str]]]:
    """(label, indent, bold, total, cells): leading no-break spaces in threes or 12 units of padding are a step in.

    A cell stands at the first of the columns that it spans; a currency sign or opening bracket in a cell of its own
    goes to the number behind it, a closing bracket or per cent sign to the one before."""
    for r in (n for n in table.walk() if n.tag == "tr"):
        cells = [c for c in r.walk() if c.tag in ("td", "th")]
        grid: list[str] = []
        for c in cells:
            span = c.attrs.get("colspan", "1")
            grid += [c.words().strip(), *[""] * (min(int(span), 100) - 1 if span.isdigit() else 0)]
        if not any(grid):
            continue
        sign = ""
        for k in range(1, len(grid)):
            text = grid[k]
            before = next((j for j in range(k - 1, 0, -1) if grid[j]), 0)
            if text in ("$", "¥", "(", "$(", "¥("):
                sign, grid[k] = sign + text, ""
            elif text in (")", "%", ")%") and before:
                grid[before], grid[k] = grid[before] + text, ""
            elif text:
                sign, grid[k] = "", sign + text
        first = cells[0]
        raw = "".join(n.text for n in first.walk() if not n.tag)
        space = len(raw) - len(raw.lstrip("\xa0 \t\r\n"))
        pad = max((int(m) for n in first.walk() for m in _INDENT.findall(n.attrs.get("style", ""))), default=0)
        bold = any(n.tag in ("b", "strong") or "bold" in n.attrs.get("style", "") for n in first.walk())
        yield grid[0], max(space // 3, pad // 12), bold, grid[0].lower().startswith(("total", "subtotal", "合计", "总计", "小计")), grid[1:]


def _compact(rows: list[tuple]) -> list[tuple]:
    """Rows of one width, without the columns that no row fills."""
    width = max((len(r[4]) for r in rows), default=0)
    cells = [r[4] + [""] * (width - len(r[4])) for r in rows]
    keep = [k for k in range(width) if any(c[k] for c in cells)]
    return [(*r[:4], [c[k] for k in keep]) for r, c in zip(rows, cells)]


def _units(text: str) -> tuple[str | None, str | None]:
    """(currency, unit) that a text names."""
    low = text.lower()
    money = next((c for c, p in (("CNY", "rmb|人民币|cny"), ("HKD", r"hk\$|hkd|港元"), ("USD", r"us\$|usd|\$|美元")) if re.search(p, low)), None)
    unit = next((u for u, p in (("million", "million|百万"), ("thousand", "thousand|千元"), ("billion", "billion|十亿")) if re.search(p, low)), None)
    return money, unit


def whole_tables(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """id, sheet, rows (row, label, indent, bold, total, cells), currency, unit: a row for each table of two columns or
    more; currency and unit are those that the table names, else the page."""
    kind = dict(pages.dtypes)[id_col]
    row = pa.struct([("row", pa.int32()), ("label", pa.string()), ("indent", pa.int32()), ("bold", pa.bool_()), ("total", pa.bool_()), ("cells", pa.list_(pa.string()))])
    types, names = [pa.int32(), pa.list_(row), pa.string(), pa.string()], ["sheet", "rows", "currency", "unit"]

    def parse(data: str) -> Iterator[tuple]:
        top = tree(data)
        page = _units(top.words()[:4000])
        for k, t in enumerate(n for n in top.walk() if n.tag == "table"):
            rows = _compact(list(_rows(t)))
            own = _units(" ".join(r[0] + " " + " ".join(r[4]) for r in rows[:HEADER_ROWS]))
            if max((1 + len(r[4]) for r in rows), default=0) >= 2:
                yield k, [dict(zip(("row", "label", "indent", "bold", "total", "cells"), (i, *r))) for i, r in enumerate(rows, 1)], own[0] or page[0], own[1] or page[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return row_batches(batches, parse, [id_col, *names], types)

    schema = f"`{id_col}` {kind}, sheet int, rows array<struct<row:int,label:string,indent:int,bold:boolean,total:boolean,cells:array<string>>>, currency string, unit string"
    return pages.select(id_col, F.col(html).cast("string")).mapInArrow(run, schema)


def table_rows(tables: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``whole_tables``, with further columns if there are any."""
    more = [c for c in tables.columns if c not in (id_col, "sheet", "rows", "currency", "unit")]
    return tables.select(id_col, "sheet", F.explode("rows").alias("_r"), "currency", "unit", *more).select(id_col, "sheet", "_r.*", "currency", "unit", *more)


def financial_tables(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """id, sheet, row, label, indent, bold, total, cells, currency, unit: a row for each row of each table of two
    columns or more; currency and unit are those that the table names, else the page."""
    return table_rows(whole_tables(pages, id_col, html), id_col)


# --- periods of columns -----------------------------------------------------------------------------


def month_number(text: Column) -> Column:
    name = F.regexp_extract(F.lower(text), _MONTH, 1)
    return F.when(name != "", F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int"))


def period_type(text: Column, fy_end_month: int = 12) -> Column:
    """FY, QTD9, QTD6 or a quarter, as a title or header words it; null if it doesn't."""
    t = F.lower(text)
    quarter = F.concat(F.lit("Q"), F.coalesce(fiscal_quarter(month_number(t), fy_end_month), F.lit(1)).cast("string"))
    return (
        F.when(t.rlike("(three|3)[ -]months?|quarter(ly)? ended"), quarter)
        .when(t.rlike("(nine|9) months? ended"), "QTD9")
        .when(t.rlike("(six|6) months? ended|half year"), "QTD6")
        .when(t.rlike("(twelve|12) months? ended|year ended"), "FY")
    )


def period_sequence(rows: DataFrame, keys: list[str], fy_end_month: int = 12) -> DataFrame:
    """(keys, col, period) of the columns of tables: the year that stands nearest to the left in one of the first rows,
    under the period words nearest to the left (or before all columns)."""
    head = rows.where(F.col("row") <= HEADER_ROWS).select(*keys, "row", F.posexplode(F.concat(F.array("label"), "cells")).alias("col", "text"))
    kind = period_type(F.col("text"), fy_end_month)
    year = F.regexp_extract("text", r"^\D*(20\d{2})(?!\d)", 1)
    words = F.when(kind.isNotNull(), F.struct("row", kind.alias("kind"), month_number(F.col("text")).alias("month")))
    dated = F.when((F.col("col") > 0) & (year != "") & (F.length("text") <= 40), F.struct("row", year.cast("int").alias("y"), month_number(F.col("text")).alias("m")))
    columns = head.groupBy(*keys, "col").agg(F.min(words).alias("w"), F.max(dated).alias("y"))
    left = Window.partitionBy(*keys).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    both = columns.withColumns({c: F.last(c, ignorenulls=True).over(left) for c in ("w", "y")}).where("y is not null")
    month = F.coalesce("y.m", "w.month", F.lit(fy_end_month))
    own = F.coalesce(F.col("w.kind"), F.lit("FY"))
    kind = F.when(own.rlike("^Q[1-4]$"), F.concat(F.lit("Q"), fiscal_quarter(month, fy_end_month).cast("string"))).otherwise(own)
    return both.select(*keys, "col", F.concat(fiscal_year(F.col("y.y"), month, fy_end_month).cast("string"), kind).alias("period"))


# --- recognition ------------------------------------------------------------------------------------


def may_be_segment(label: Column) -> Column:
    """2 to 100 characters, none of the words of metrics, at most a fifth digits."""
    t = F.lower(F.trim(label))
    metric = t.rlike("|".join(re.escape(w) for w in METRIC_WORDS))
    digits = F.regexp_count(t, F.lit(r"\d"))
    return F.length(t).between(2, 100) & ~metric & (digits <= 0.2 * F.length(t))


def by_indent(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, label, level, parent) of labels that may be segments; the parent is the last one above that stands
    further out."""
    from quillmark.operators.statements import ladder_parent

    named = rows.where(may_be_segment(F.col("label")) & ~F.col("total")).select(*keys, "row", "label", (F.col("indent") + 1).alias("level"))
    return ladder_parent(named, keys, "row", "level", "label")


def labelled(rows: DataFrame, config: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, code, level, parent, kind) of rows whose label is (kind 0), or holds (1), a configured segment's name;
    of several the equal one, then the longest.  ``config`` (code, name, level, parent) may be of any size."""
    c = config.select("code", F.lower("name").alias("_name"), "level", "parent")
    label = F.lower(F.trim("label"))
    held = contained(rows.where(~F.col("total")).select(*keys, "row", label.alias("_label")), "_label", c, "_name")
    hits = held.join(c, "_name")
    kind = F.when(F.col("_label") == F.col("_name"), 0).otherwise(1)
    best = F.min(F.struct(kind.alias("kind"), (-F.length("_name")).alias("size"), "code", "level", "parent"))
    return hits.groupBy(*keys, "row").agg(best.alias("m")).select(*keys, "row", "m.code", "m.level", "m.parent", "m.kind")


def by_config(rows: DataFrame, config: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, code, level, parent) of the first row of each configured segment, equal labels before others."""
    hits = labelled(rows, config, keys)
    return hits.groupBy(*keys, "code", "level", "parent").agg(F.min(F.struct("kind", "row")).alias("f")).select(*keys, F.col("f.row").alias("row"), "code", "level", "parent")


# --- layouts ----------------------------------------------------------------------------------------


def row_facts(rows: DataFrame, periods: DataFrame, segments: DataFrame, metrics: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """Facts of tables with segments as rows and periods as columns, in blocks below metric titles.

    ``metrics`` are (code, pattern); a block's metric is the last label above, or in the row itself, that matches."""
    code = F.coalesce(*(F.when(F.lower("label").rlike(p), m) for m, p in metrics))
    above = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    titled = rows.withColumn("metric", F.last(code, ignorenulls=True).over(above))
    cells = titled.join(segments.select(*keys, "row", F.col("code").alias("segment")), [*keys, "row"]).select(*keys, "segment", "metric", F.posexplode("cells").alias("_at", "text"))
    value = number(F.col("text"))
    out = cells.withColumn("col", F.col("_at") + 1).join(periods, [*keys, "col"]).select(*keys, "segment", "metric", "period", value.alias("value"))
    return out.where("metric is not null and value is not null")


def column_facts(lines: DataFrame, keys: list[str], segments: list[str], metrics: list[str], period: str, total: str | None = None) -> DataFrame:
    """Facts of text tables with segments as columns: of lines with a number for every segment, the first is the first
    metric, and so on.  With ``total``, a document counts where half its lines or more add up to that column."""
    values = F.transform("cells", number)
    whole = lines.withColumn("v", values).where((F.size("v") == len(segments)) & ~F.exists("v", lambda x: x.isNull()))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("row"))
    whole = whole.withColumn("n", rank).where(F.col("n") <= len(metrics))
    if total:
        at = segments.index(total)
        rest = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) - 2 * F.col("v")[at]
        adds = F.abs(rest) <= F.greatest(F.lit(1.0), 0.005 * F.abs(F.col("v")[at]))
        ok = whole.groupBy(*keys).agg(F.count_if(adds).alias("k"), F.count("*").alias("m")).where((F.col("k") * 2 >= F.col("m")) & (F.col("m") == len(metrics)))
        whole = whole.join(ok.select(*keys), keys, "left_semi")
    name = lambda items, k: F.element_at(F.array(*map(F.lit, items)), k)
    rows = whole.select(*keys, name(metrics, F.col("n")).alias("metric"), F.posexplode("v").alias("_at", "value"))
    out = rows.select(*keys, name(segments, F.col("_at") + 1).alias("segment"), "metric", F.lit(period).alias("period"), "value")
    return out.where(F.col("segment") != total) if total else out


def line_cells(text: DataFrame, id_col: str, column: str = "text") -> DataFrame:
    """id, row, cells: lines of a text, cut at two spaces or more."""
    lines = text.select(id_col, F.posexplode(F.split(column, "\n")).alias("row", "line"))
    return lines.select(id_col, "row", F.filter(F.split("line", r"\s{2,}|\t"), lambda x: F.trim(x) != "").alias("cells"))
