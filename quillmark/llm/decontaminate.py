"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are dealt into classes by set size (powers of two), each with an index and a threshold of
its own.  An item of n distinct 5-word shingles keeps a bottom-m MinHash sketch, its m least
shingle hashes, where m is what a match may miss at the class's upper size and ``SPARE`` more of it;
a document that holds 75 % of the item's shingles holds m less what it may miss of them, and only
documents that do are candidates.  So no match is missed however long the document, which is why
documents, against which items are tiny, are looked up whole and not sketched.  Candidates are
confirmed on whole sets.

A set of up to ``BROADCAST_BYTES`` is indexed once and broadcast; all documents pass it with no
shuffle.  A larger one stays distributed: a bitmap of bounded size, of all sketch hashes, is
broadcast instead; the documents' hashes that may be in it are joined with the sketches by hash,
counted by document and item, and candidates meet their texts by join.

Defined cases: a null or word-less text has no shingles and is kept; a text of 1 to 4 words is one
shingle of its whole sequence; a null or word-less item matches nothing; a repeated item id counts
each of its distinct texts apart and reports the id; ties go to the greatest containment, then the
smallest item_id, null last; an item without an id is matched like any other, and reported with a null id;
repeated rows are each judged; an empty set matches nothing; extra columns don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .tables import modest, settle, table

WORDS = 5
PERCENT = 75
#: Share of a class's upper size by which sketches exceed what a match may miss.
SPARE = 16
BROADCAST_BYTES = 16 << 20
BITS = 25
ROW = "__qm_row"


def _sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of slices of a column."""
    raw, offs, _ = V.column(texts)
    for i, j in V.slices(offs):
        yield i, V.distinct(*V.shingles(V.split(raw, offs, i, j, lower=True), WORDS))


def sketch(s: np.ndarray) -> tuple[int, np.ndarray, int]:
    """(class, sketch, hits asked) of an item's sorted set."""
    n = len(s)
    upper = 1 << (n - 1).bit_length()
    miss = lambda size: size - -(-size * PERCENT // 100)
    m = min(n, miss(upper) + 1 + upper // SPARE)
    return upper.bit_length() - 1, s[:m], m - miss(n)


class Index:
    """Sketch postings by size class, and whole sets."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids, self.sets = [i for i, _ in items], []
        for _, sets in _sets(pa.array([t for _, t in items], pa.large_string())):
            self.sets += sets
        self.asked = np.zeros(len(items), np.int64)
        parts: dict[int, tuple[list, list]] = {}
        for k, s in enumerate(self.sets):
            if len(s):
                kind, least, self.asked[k] = sketch(s)
                keys, owner = parts.setdefault(kind, ([], []))
                keys.append(least)
                owner.append(np.full(len(least), k))
        self.classes = []
        for _, (keys, owner) in sorted(parts.items()):
            key, who = np.concatenate(keys), np.concatenate(owner)
            order = np.argsort(key, kind="stable")
            self.classes.append((key[order], who[order]))

    def matches(self, found: np.ndarray) -> list[tuple[Fraction, int, int, int]]:
        """(containment, item id, shared, size) of the items that a sorted distinct set holds."""
        out = []
        for key, owner in self.classes:
            # look the fewer up among the more
            if len(found) < len(key):
                lo, hi = np.searchsorted(key, found, "left"), np.searchsorted(key, found, "right")
                hit = np.flatnonzero(hi > lo)
                held = np.concatenate([owner[lo[h] : hi[h]] for h in hit] or [owner[:0]])
            else:
                at = np.minimum(np.searchsorted(found, key), len(found) - 1)
                held = owner[found[at] == key]
            who, n = np.unique(held, return_counts=True)
            for k in who[n >= self.asked[who]].tolist():
                shared = _shared(found, self.sets[k])
                if 100 * shared >= PERCENT * len(self.sets[k]):
                    out.append((Fraction(shared, len(self.sets[k])), self.ids[k], shared, len(self.sets[k])))
        return out


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("item")).where("item is not null").distinct()


def _small(items: DataFrame) -> Index | None:
    """The index of a set whose measured size may be broadcast."""
    if (items.agg(F.sum(F.octet_length("item") + 16)).first()[0] or 0) > BROADCAST_BYTES:
        return None
    return Index([(r.item_id, r.item) for r in items.orderBy("item_id", "item").toLocalIterator()])


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, n_items, item_id, n_shared, item_size (of the best item, or
    null) and contaminated."""
    modest(docs.sparkSession)
    items = _items(benchmark)
    index = _small(items)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if index is None:
        return _scan_large(rows, items)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for i, sets in _sets(batch.column(1)):
                out = []
                for found in sets:
                    got = index.matches(found) if len(found) else []
                    best = min(got, key=lambda x: (-x[0], x[1] is None, x[1] or 0)) if got else None
                    out.append((len(found), len(got), *(best[1:] if best else (None, None, None)), bool(got)))
                kinds = [pa.int64()] * 5 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sets)), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "n_shingles", "n_items", "item_id", "n_shared", "item_size", "contaminated"])

    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, n_items bigint, item_id bigint, n_shared bigint, item_size bigint, contaminated boolean")


def _matches(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(row, item_id, n_shared, item_size) of every match, for a set of any size; ``rows`` have ROW and text."""
    items = settle(items.withColumn("k", F.monotonically_increasing_id()))
    spark = rows.sparkSession

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sets in _sets(batch.column(1)):
                for k, s in zip(batch.column(0).slice(i, len(sets)).to_pylist(), sets):
                    if len(s):
                        kind, least, asked = sketch(s)
                        n = len(least)
                        yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array([k] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([asked] * n, pa.int32())], ["h", "k", "kind", "asked"])

    postings = settle(items.select("k", "item").mapInArrow(sketched, "h bigint, k bigint, kind int, asked int"))
    place = F.shiftrightunsigned("h", 64 - BITS)
    words = postings.groupBy(F.shiftright(place, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 as int))")).alias("bits"))
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    for r in words.toLocalIterator():  # at most 2**(BITS - 6) rows, whatever the set
        bitmap[r.w] = r.bits
    shared = spark.sparkContext.broadcast(bitmap.view(V.U))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for i, sets in _sets(batch.column(1)):
                for row, s in zip(batch.column(0).slice(i, len(sets)).to_pylist(), sets):
                    at = s >> V.U(64 - BITS)
                    s = s[(bits[(at >> V.U(6)).astype(np.int64)] >> (at & V.U(63)) & V.U(1)).astype(bool)]
                    if len(s):
                        yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array([row] * len(s), pa.int64())], ["h", "row"])

    texts = rows.select(F.col(ROW).alias("row"), "text").where("text is not null")
    found = texts.mapInArrow(hits, "h bigint, row bigint").join(postings, "h").groupBy("row", "k").agg(F.count("*").alias("n"), F.first("asked").alias("asked"))
    pairs = settle(found.where("n >= asked").select("row", "k"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for j in range(batch.num_rows):
                (_, (a,)), (_, (b,)) = (next(_sets(batch.column(c).slice(j, 1))) for c in (2, 3))
                shared = _shared(a, b)
                if 100 * shared >= PERCENT * len(b):
                    out.append((batch.column(0)[j].as_py(), batch.column(1)[j].as_py(), shared, len(b)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["row", "item_id", "n_shared", "item_size"])

    both = pairs.join(items, "k").join(texts, "row").select("row", "item_id", "text", "item")
    return both.mapInArrow(confirm, "row bigint, item_id bigint, n_shared bigint, item_size bigint")


def _scan_large(rows: DataFrame, items: DataFrame) -> DataFrame:
    rows = settle(rows.withColumn(ROW, F.monotonically_increasing_id()))  # a number of its own for every row, written once
    rank = F.struct((F.col("n_shared") / F.col("item_size")).alias("c"), (-F.col("item_id")).alias("i"), "n_shared", "item_size")
    best = _matches(rows, items).groupBy("row").agg(F.count("*").alias("n_items"), F.max(rank).alias("best"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sets in _sets(batch.column(2)):
                n = len(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array([len(s) for s in sets], pa.int64())], ["row", "doc_id", "n_shingles"])

    sized = rows.select(ROW, "doc_id", "text").mapInArrow(count, "row bigint, doc_id bigint, n_shingles bigint")
    out = sized.join(best, "row", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), (-F.col("best.i")).alias("item_id"), "best.n_shared", "best.item_size", F.col("n_items").isNotNull().alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of ``benchmark``."""
    modest(docs.sparkSession)
    items = _items(benchmark)
    index = _small(items)
    if index is None:
        rows = settle(docs.withColumn(ROW, F.monotonically_increasing_id()))
        dirty = _matches(rows.select(ROW, F.col("text").cast("string").alias("text")), items).select(F.col("row").alias(ROW)).distinct()
        return rows.join(dirty, ROW, "left_anti").drop(ROW)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for i, sets in _sets(batch.column(batch.schema.get_field_index("text"))):
                yield batch.slice(i, len(sets)).filter(pa.array([not (len(s) and index.matches(s)) for s in sets], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM d),
bs AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM b),
de AS (SELECT id, unnest(s) AS g FROM ds), be AS (SELECT id, len(s) AS n, unnest(s) AS g FROM bs),
m AS (SELECT de.id AS doc_id, be.id AS item_id, be.n AS n, count(*) AS k FROM de JOIN be USING (g) GROUP BY ALL HAVING 100 * count(*) >= 75 * be.n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k / n DESC, item_id) AS rn, count(*) OVER (PARTITION BY doc_id) AS c FROM m)
SELECT ds.id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CAST(coalesce(r.c, 0) AS BIGINT) AS n_items, r.item_id AS item_id, CAST(r.k AS BIGINT) AS n_shared, CAST(r.n AS BIGINT) AS item_size, r.doc_id IS NOT NULL AS contaminated
FROM ds LEFT JOIN r ON r.doc_id = ds.id AND r.rn = 1
"""
