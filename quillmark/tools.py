"""Public functions over a folder of filings: build the chunk store, ask it, and read statements, estimates, filings and
tables from it.  Everything returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.periods import previous_bucket
from quillmark.operators import chain, chunking, filings, segments, statements, valuation
from quillmark.sources import files, workbook


def filing_kb_build(spark: SparkSession, root: str, store: str, strategy: str = "HEADING", ticker: str | None = None) -> DataFrame:
    """Reads ``root/<ticker>/filings/<document>/``, cuts each document into chunks and writes them to ``store`` by ticker and
    document; building again replaces a document's chunks.  Returns ticker, document_id, chunks."""
    docs = files.documents(spark, root)
    docs = docs.where(F.col("ticker") == ticker) if ticker else docs
    meta = files.metadata(spark, root)
    period = filings.canonical_period(F.col("fiscalPeriod"), F.col("fiscalYear"))
    about = meta.groupBy("ticker", "document_id").agg(F.max(F.struct(period.alias("fiscal_period"), F.col("formType").alias("form_type"), F.col("fiscalYear").alias("fiscal_year"))).alias("m"))
    texts = files.as_text(docs).withColumn("key", F.to_json(F.struct("ticker", "document_id", "path")))
    made = chunking.chunk(texts, "key", "text", strategy).where("kind <> 'parent'")
    k = F.from_json("key", "struct<ticker:string,document_id:string,path:string>")
    rows = made.select(k.alias("k"), "chunk_id", "chunk_index", F.col("header").alias("title"), "content").select("k.ticker", "k.document_id", "chunk_id", "chunk_index", "title", "content")
    rows = rows.join(about, ["ticker", "document_id"], "left").select("*", "m.fiscal_period", "m.form_type", "m.fiscal_year").drop("m")
    files.save_chunks(rows, store)
    done = files.chunk_store(spark, store).groupBy("ticker", "document_id").agg(F.count("*").alias("chunks"))
    return done.where(F.col("ticker") == ticker) if ticker else done


def filing_kb_qa(spark: SparkSession, store: str, question: str, k: int = 5, vector: list[float] | None = None) -> DataFrame:
    """place, chunk_id, ticker, fiscal_period, title, content, score, citation of the chunks that answer a question."""
    got = chain.run(files.chunk_store(spark, store), chain.understand(spark, question, vector, k))
    return got.select("place", "chunk_id", "ticker", "document_id", "fiscal_period", "title", "content", "score", "citation")


def rag_index(docs: DataFrame, id_col: str, text_col: str, store: str, strategy: str = "HEADING") -> DataFrame:
    """Chunks of any documents, written to ``store``: the knowledge base without filings' tags."""
    made = chunking.chunk(docs, id_col, text_col, strategy).where("kind <> 'parent'")
    rows = made.select(F.lit("").alias("ticker"), F.col(id_col).cast("string").alias("document_id"), "chunk_id", "chunk_index", F.col("header").alias("title"), "content", F.lit(None).cast("string").alias("fiscal_period"))
    files.save_chunks(rows, store)
    return rows.groupBy("document_id").agg(F.count("*").alias("chunks"))


def rag_qa(spark: SparkSession, store: str, question: str, k: int = 5) -> DataFrame:
    """Chunks for a question from a store without filings' tags: search, merge and the first k."""
    ask = chain.understand(spark, question, k=k)
    return chain.run(files.chunk_store(spark, store), ask, "hybrid").select("chunk_id", "document_id", "title", "content", "score")


def lf_historicals(spark: SparkSession, root: str, n: int = 8) -> DataFrame:
    """statement, metric, unit, period, value, yoy of the latest version of each statement workbook, the last n periods."""
    books = workbook.workbooks(spark, root)
    newest = files.latest_versions(books.select("path").distinct()).select("ticker", "statement", "path")
    facts = workbook.statement_facts(books.join(newest.select("path"), "path", "left_semi"), "path")
    facts = facts.join(newest, "path").select("ticker", "statement", "metric", "unit", "period", "value")
    prior = facts.select("ticker", "statement", "metric", F.col("period").alias("before"), F.col("value").alias("prev"))
    out = facts.withColumn("before", previous_bucket(F.col("period"), "quarter")).join(prior, ["ticker", "statement", "metric", "before"], "left")
    out = out.withColumn("yoy", statements.growth(F.col("value"), F.col("prev"), 2)).drop("before", "prev")
    return statements.latest(out, ["ticker", "statement", "metric"], F.col("period"), n)


def lf_consensus(spark: SparkSession, root: str, actual: DataFrame | None = None) -> DataFrame:
    """item, period, value, kind of estimate files (``<ticker>_consensus.csv``), beside actual facts if given."""
    got = files.statement_csvs(spark, root).where(F.col("path").rlike("_consensus\\.csv$")).withColumn("ticker", F.regexp_extract("path", r"([^/]+)_consensus\.csv$", 1))
    keys = ["ticker", "item", "period"]
    none = spark.createDataFrame([], "ticker string, item string, period string, value double")
    return statements.with_estimates(none if actual is None else actual, got.select(*keys, "value"), keys)


def lf_filings(spark: SparkSession, root: str, form_type: str | None = None, n: int = 4) -> DataFrame:
    """The latest complete filings of each ticker, with their periods."""
    got = files.complete_filings(files.metadata(spark, root), form_type, n)
    return got.select("ticker", "document_id", F.col("formType").alias("form_type"), filings.canonical_period(F.col("fiscalPeriod"), F.col("fiscalYear")).alias("fiscal_period"), F.col("filingDate").alias("filing_date"))


def lf_extract_table(pages: DataFrame, id_col: str, html: str, kind: str = "all") -> DataFrame:
    """Rows of a document's tables, of one type (income, balance, cashflow, other) or all."""
    tables = segments.whole_tables(pages, id_col, html)
    words = F.array_join(F.transform("rows", lambda r: F.concat_ws(" ", r["label"], F.array_join(r["cells"], " "))), " ")
    tables = tables.withColumn("table_type", statements.table_type(words))
    return segments.table_rows(tables if kind == "all" else tables.where(F.col("table_type") == kind), id_col)


def lf_validate(models: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """period, check, gap, ok of linked models."""
    return valuation.model_audit(models, tolerance)

