"""Corpus pipeline over ``documents``: language ID, near-dedup, decontamination, privacy, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the
columns of ``documents``; the last returns the packed pieces.  ``run`` writes every stage's rows to the
shared folder and reads them for the next; an empty table gives no rows.  Language ID and packing have no SQL form, so there
is no ORACLE_SQL; tests/llm compares the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, langid, neardup, packing, pii
from quillmark.llm.tables import scope, settle, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter, and rows like no learned language, go."""
    return langid.keep_known(docs.select(*COLUMNS), langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays, one row of it.  Where an id stands for several
    texts each row is judged by its own.  Rows without an id belong to no group and stay."""
    return neardup.keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold three quarters of a benchmark item's shingles go."""
    return decontaminate.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; n_chars follows the new text."""
    out = pii.anonymise(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint")))
    return out.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packed pieces of every document."""
    return packing.pack(packing.pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("privacy", privacy), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; a stage's own intermediate tables go when its rows are written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scope(spark):
            docs = settle(stage(spark, docs, sf_dir), outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
