"""File sources and sinks: everything goes through Spark's readers, so any file system works."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillmark.operators.chunking import html_markdown
from quillmark.operators.statements import latest, number, to_long
from quillmark.sources import pdf
from quillmark.sources.shared import row_batches

DOCUMENT_SUFFIXES = ["pdf", "html", "htm"]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def documents(spark: SparkSession, root: str) -> DataFrame:
    """path, suffix, content of filing documents below ``root/<ticker>/filings/<document>/``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = F.regexp_extract
    return df.select(
        "path",
        suffix(F.col("path")).alias("suffix"),
        parts("path", r"/([^/]+)/filings/([^/]+)/[^/]+$", 1).alias("ticker"),
        parts("path", r"/([^/]+)/filings/([^/]+)/[^/]+$", 2).alias("document_id"),
        F.col("modificationTime").alias("modified"),
        "content",
    ).where(F.col("suffix").isin(DOCUMENT_SUFFIXES))


def routed(spark: SparkSession, root: str) -> DataFrame:
    """path, suffix, content of all files below ``root``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select("path", suffix(F.col("path")).alias("suffix"), "content")


def as_text(df: DataFrame) -> DataFrame:
    """``text`` in place of ``content``, by the reader of the suffix: PDF and HTML as marked text, any other file
    as UTF-8."""
    rest = [c for c in df.columns if c != "content"]
    schema = StructType([*(df.schema[c] for c in rest), StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kind = b.schema.get_field_index("content"), b.schema.get_field_index("suffix")
            made = []
            for k in range(b.num_rows):
                data, name = b.column(at)[k].as_py(), b.column(kind)[k].as_py()
                plain = (data or b"").decode("utf-8", "replace")
                made.append(None if data is None else pdf.markdown(data) if name == "pdf" else html_markdown(plain) if name in ("html", "htm") else plain)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(b.num_columns) if c != at), pa.array(made, pa.string())], [*rest, "text"])

    return df.select(*rest, "content").mapInArrow(run, schema)


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """Filing meta.json files; the period falls back to the document folder's name."""
    schema = "formType string, fiscalYear int, fiscalPeriod string, filingDate string, reportDate string, primaryFile string, ticker string"
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json").json(root).withColumn("path", F.col("_metadata.file_path"))
    from quillmark.functions.periods import from_document_id

    folder = F.regexp_extract("path", r"/([^/]+)/meta\.json$", 1)
    return df.withColumns({"document_id": folder, "fiscalPeriod": F.coalesce("fiscalPeriod", from_document_id(folder)), "ticker": F.coalesce("ticker", F.regexp_extract("path", r"/([^/]+)/filings/", 1))})


def complete_filings(meta: DataFrame, form_type: str | None = None, n: int = 4) -> DataFrame:
    """Filings with every required field, the ``n`` latest of each ticker."""
    need = ["formType", "fiscalYear", "fiscalPeriod", "filingDate", "primaryFile", "ticker"]
    ok = meta.dropna(subset=need)
    if form_type:
        ok = ok.where(F.upper("formType") == form_type.upper())
    return latest(ok, ["ticker"], F.struct(F.coalesce("reportDate", F.lit("")), "filingDate", "document_id"), n)


def incomplete_reasons(meta: DataFrame) -> DataFrame:
    """Counts of filings by what they lack."""
    need = ["formType", "fiscalYear", "fiscalPeriod", "filingDate", "primaryFile"]
    why = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in need)), lambda x: x.isNotNull())
    return meta.select(F.explode(why).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def latest_versions(paths: DataFrame, keys: str = r"([A-Z]+)_([A-Za-z0-9]+)_(income|balance|cashflow)_(\d{8})_(\d{6})\.xlsx$") -> DataFrame:
    """market, ticker, statement and the path of the latest version by the date and time in the name."""
    part = lambda k: F.regexp_extract("path", keys, k)
    hit = paths.where(F.col("path").rlike(keys))
    return hit.groupBy(part(1).alias("market"), part(2).alias("ticker"), part(3).alias("statement")).agg(F.max_by("path", F.struct(part(4), part(5))).alias("path"))


def latest_by(paths: DataFrame, pattern: str) -> DataFrame:
    """key and the path of the greatest mark: a pattern's first and second group."""
    hit = paths.where(F.col("path").rlike(pattern))
    return hit.groupBy(F.regexp_extract("path", pattern, 1).alias("key")).agg(F.max_by("path", F.regexp_extract("path", pattern, 2)).alias("path"))


def fresh(files: DataFrame, key: list[str], now: Column, ttl: str) -> DataFrame:
    """The newest file of each key, if younger than ``ttl`` (an interval)."""
    return latest(files.where(F.col("modified") >= now - F.expr(f"interval {ttl}")), key, F.struct("modified", "path"))


def statement_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """item, period, value of a CSV with periods as columns, or with a ``period`` column and items as
    columns."""
    df = spark.read.option("header", True).option("encoding", encoding).csv(path)
    first = df.columns[0]
    long = to_long(df, [first]).toDF("a", "b", "value")
    long = long.select(F.col("b").alias("item"), F.col("a").alias("period"), "value") if first.lower() == "period" else long.select(F.col("a").alias("item"), F.col("b").alias("period"), "value")
    return long.withColumn("value", number(F.col("value")))


def statement_csvs(spark: SparkSession, path: str) -> DataFrame:
    """path, item, period, value of small CSV files, each UTF-8 or else GBK, with periods as columns or with a ``period``
    column."""

    def parse(data: bytes) -> Iterator[tuple[str, str, str]]:
        try:
            text = data.decode("utf-8-sig")
        except UnicodeDecodeError:
            text = data.decode("gbk", "replace")
        rows = csv.reader(io.StringIO(text))
        head = next(filter(None, rows), [])
        for r in filter(None, rows):
            for name, value in zip(head[1:], r[1:]):
                yield (name, r[0], value) if head[0].strip().lower() == "period" else (r[0], name, value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return row_batches(batches, parse, ["path", "item", "period", "value"], [pa.string()] * 3)

    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path).select("path", "content")
    return df.mapInArrow(run, "path string, item string, period string, value string").withColumn("value", number(F.col("value")))


def statement_rows(rows: DataFrame, periods: list[str]) -> DataFrame:
    """(ticker, statement, metric, unit, <periods>) as tidy facts."""
    return to_long(rows, ["ticker", "statement", "metric", "unit"], periods).withColumn("value", number(F.col("value").cast("string")))


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk store by ticker and document; only the partitions written are replaced."""
    chunks.write.partitionBy("ticker", "document_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def chunk_store(spark: SparkSession, path: str) -> DataFrame:
    """All chunks; tickers and documents stay text, so 00700 is no number."""
    found = spark.read.parquet(path).schema
    kinds = [StructField(f.name, StringType() if f.name in ("ticker", "document_id") else f.dataType) for f in found]
    return spark.read.schema(StructType(kinds)).parquet(path)


def load_chunks(spark: SparkSession, path: str, ticker: str, document_id: str | None = None) -> DataFrame:
    df = chunk_store(spark, path).where(F.col("ticker") == ticker)
    return df if document_id is None else df.where(F.col("document_id") == document_id)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
