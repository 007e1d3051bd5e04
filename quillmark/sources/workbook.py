"""Workbooks and HTML tables as rows of cells, read by the standard library over Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.sections import feed
from quillmark.operators.statements import number
from quillmark.sources import ruled
from quillmark.sources.shared import BATCH_CHARS, BATCH_ROWS, row_batches

_CELL = "sheet string, row int, col int, value string"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def workbook_cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of the filled cells of an .xlsx file; nothing if it isn't one."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    names = set(z.namelist())
    local = lambda e: e.tag.rpartition("}")[2]
    shared = []
    if "xl/sharedStrings.xml" in names:
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in si.iter() if local(t) == "t"))
    titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(s) == "sheet"] if "xl/workbook.xml" in names else []
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    for k, name in enumerate(sheets):
        title, row = titles[k] if k < len(titles) else name, 0
        for r in (e for e in ElementTree.fromstring(z.read(name)).iter() if local(e) == "row"):
            row, col = int(r.get("r", row + 1)), 0
            for c in r:
                col = _column(c.get("r", "")) or col + 1
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter() if local(t) == "t")
                else:
                    text = next((v.text or "" for v in c if local(v) == "v"), "")
                    text = shared[int(text)] if c.get("t") == "s" and text else text
                if text:
                    yield title, row, col, text


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def _close(self) -> None:
        if self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
        self.cell = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self._close()
            self.open.append([])
        elif self.open and tag == "tr":
            self._close()
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            self._close()
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self._close()
        elif tag == "table" and self.open:
            self._close()
            self.tables.append(self.open.pop())

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def updatepos(self, i: int, j: int) -> int:  # lines are not asked for
        return j


def table_cells(html: str | None) -> Iterator[tuple[str, int, int, str]]:
    """(table number, row, column, text) of tables with two columns or more, inner tables first."""
    p = _Tables()
    feed(p, html or "")
    p._close()
    for k, t in enumerate([*p.tables, *reversed(p.open)]):
        if max((len(r) for r in t), default=0) >= 2:
            for i, r in enumerate(t, 1):
                for j, v in enumerate(r, 1):
                    if v:
                        yield str(k), i, j, v


def _cells(df: DataFrame, id_col: str, content: str, parse) -> DataFrame:
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return row_batches(batches, parse, [id_col, "sheet", "row", "col", "value"], [pa.string(), pa.int32(), pa.int32(), pa.string()])

    return df.select(id_col, content).mapInArrow(run, f"`{id_col}` {kind}, {_CELL}")


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, col, value of the .xlsx files below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)
    return _cells(files, "path", "content", workbook_cells)


def html_tables(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    return _cells(pages.withColumn(html, F.col(html).cast("string")), id_col, html, table_cells)


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """The .pdf files below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)


def pdf_tables(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, col, value of the tables of the .pdf files below ``path``: by their drawn lines, or by the gaps
    between columns on pages without such."""
    return _cells(pdf_files(spark, path), "path", "content", ruled.table_cells)


def pdf_rows(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """The id, sheet, row, cells (texts by column, null where none begins) of the tables that ``pdf_tables`` tells: a row is
    whole where it is read, so no exchange has to bring its cells together."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sheets, rows, texts, size = [], [], [], [], 0
        for b in batches:
            own_kind = b.schema.field(0).type

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(ids, own_kind), pa.array(sheets, pa.string()), pa.array(rows, pa.int32()), pa.array(texts, pa.list_(pa.string()))], [id_col, "sheet", "row", "cells"])

            for own, data in zip(b.column(0), b.column(1)):
                own = own.as_py()
                for sheet, numbers, cells in ruled.table_rows(data.as_py()):
                    ids += [own] * len(numbers)
                    sheets += [sheet] * len(numbers)
                    rows += numbers
                    texts += cells
                    size += sum(len(t) for r in cells for t in r if t)
                    if len(rows) >= BATCH_ROWS or size >= BATCH_CHARS:
                        yield made()
                        ids, sheets, rows, texts, size = [], [], [], [], 0
            if rows:
                yield made()
                ids, sheets, rows, texts, size = [], [], [], [], 0

    return df.select(id_col, content).mapInArrow(run, f"`{id_col}` {kind}, sheet string, row int, cells array<string>")


def statement_facts(cells: DataFrame, id_col: str) -> DataFrame:
    """Tidy facts of statement sheets: periods in row 1 from column 3, report dates in row 2, metric and
    unit in columns 1 and 2, values from row 3."""
    on = [id_col, "sheet"]
    head = cells.where("row = 1 and col >= 3").select(*on, "col", F.col("value").alias("period"))
    date = cells.where("row = 2 and col >= 3").select(*on, "col", F.col("value").alias("report_date"))
    name = cells.where("row >= 3 and col <= 2").groupBy(*on, "row").agg(F.max(F.when(F.col("col") == 1, F.col("value"))).alias("metric"), F.max(F.when(F.col("col") == 2, F.col("value"))).alias("unit"))
    body = cells.where("row >= 3 and col >= 3").withColumn("value", number(F.col("value")))
    return body.join(head, [*on, "col"]).join(date, [*on, "col"], "left").join(name, [*on, "row"]).select(*on, "metric", "unit", "period", "report_date", "value")


def looks_like_segments(cells: DataFrame, id_col: str) -> DataFrame:
    """Tables of three rows or more, four to ten columns and five numbers of 100 or more."""
    big = F.count_if(F.abs(number(F.col("value"))) >= 100)
    return cells.groupBy(id_col, "sheet").agg(F.countDistinct("row").alias("rows"), F.max("col").alias("cols"), big.alias("numbers")).where("rows >= 3 and cols between 4 and 10 and numbers >= 5")


#: Rows of a sheet that the format holds. Fixed value.
SHEET_ROWS = 1_048_576


def _sheet(columns: list[str], rows: Iterator[tuple]) -> bytes:
    """A workbook of one sheet, strings inline."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool) or not isinstance(v, int | float) or v != v:
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
        return f"<c><v>{v!r}</v></c>"

    body = io.StringIO()
    for n, r in enumerate([columns, *rows], 1):
        if n > SHEET_ROWS:
            raise ValueError(f"a sheet holds {SHEET_ROWS} rows")
        body.write(f'<row r="{n}">{"".join(map(cell, r))}</row>')
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body.getvalue()}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def books(rows: DataFrame, name: str, order: str, columns: list[str]) -> DataFrame:
    """(name, data): a workbook a name, made in the tasks, of its rows in ``order``; a sheet holds what the format allows."""
    held = rows.groupBy(F.col(name).alias("name")).agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*columns).alias("_row")))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_sheet(columns, (tuple(r["_row"].values()) for r in own)) for own in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["name", "data"])

    return held.mapInArrow(run, "name string, data binary")


def write_workbook(df: DataFrame, path: str) -> None:
    """A report as one .xlsx file: column names, then rows in order; more rows than a sheet holds are an error."""
    data = _sheet(df.columns, (tuple(r) for r in df.toLocalIterator()))
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()
