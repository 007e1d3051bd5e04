"""Ranked lexical search over a clustered index of reordered documents, exact in integers.

*Reordering.*  Recursive graph bisection is fitted on a sample: documents are halved, and pairs of them change
sides while that lowers the logarithmic gap cost of the postings of both halves, ``LEVELS`` times.  Every
other document goes down the same tree by the same cost: to the side where its terms cost less.  The
leaves, in order, are the shards of the index; a document's number is its shard, segment and place.

*Index.*  A task gathers postings of about ``POSTINGS`` (term, document) pairs and writes, for every shard, a segment: a
small inverted index of sorted term hashes, places, frequencies and lengths, with the doc_ids to map back to.
A segment holds no more than its task read, so a shard that most documents like is many segments.

*Search.*  A first pass reads the terms' document frequencies and their best parts of a score in each shard; the sum of
weight times best part bounds what an item can score there.  An item then visits its shards by falling bound, a few
in the first rounds (``VISITS``), and stops where the bound is below its 50th score: an equal bound is still visited,
as a smaller doc_id may stand there.  Nothing is approximate; order and bounds only save work.

The sample: ``SAMPLE`` rows by a threshold on the hashed doc_id (twice as many at most), of each the ``DOC_TERMS``
terms of smallest hash.  It decides where documents stand, never what is found.  Items are searched in
blocks of about ``BLOCK_TERMS`` terms, which go out with the tasks.  Terms are compared by 64-bit hashes: among
1e9 distinct terms some term of 20,000 asked is another's equal with probability 1e-6.

Defined cases: null texts and texts without a term are in no index and never found; an item without a known term
has no rows; rows of repeated ids are ranked each, null doc_ids after the others of their score; rows of repeated or
null item_ids are items each; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectext as V
from .tables import settle, shared_dir, table

TOP = 50
LEVELS = 5
SAMPLE, DOC_TERMS, MODEL_TERMS, SWEEPS = 2048, 4096, 1 << 16, 20
POSTINGS = 1_000_000
SLICE = 2 << 20
BLOCK_TERMS = 1 << 15
VISITS = (2, 6)
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LAST_ID = np.iinfo(np.int64).max
INDEX = "docs bigint, terms_in bigint, ids array<bigint>, lengths binary, terms binary, counts binary, places binary, tfs binary"


def _narrow(a: np.ndarray) -> bytes:
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def _wide(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(b) // n]).astype(np.int64) if n else np.zeros(0, np.int64)


def _postings(raw: np.ndarray, offs: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, term number, row, frequency) of rows i..j-1, by term and row."""
    w = V.split(raw, offs, i, j, lower=True, gap=_GAP)
    terms, number = np.unique(w.hashes(), return_inverse=True)
    row = np.repeat(np.arange(j - i), w.counts)
    pair, tf = np.unique(number * np.int64(j - i) + row, return_counts=True)
    return terms, pair // (j - i), pair % (j - i), tf


class Order:
    """The tree of the bisection: for each inner node, how much its left side is preferred by each term."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, middles: np.ndarray):
        self.terms, self.weights, self.middles = terms, weights, middles

    @classmethod
    def fit(cls, sample: list[np.ndarray], levels: int = LEVELS) -> "Order":
        """``sample``: the distinct terms of each document.  Half of it is bisected; the other half then goes down the tree, and
        the middle of its preferences at a node is what parts the sides there, so that shards are of like size."""
        sample = [s for s in {s.tobytes(): s for s in sample}.values() if len(s)]
        sample = [sample[i] for i in np.random.default_rng(0).permutation(len(sample))]
        sample, other = (sample[::2], sample[1::2]) if len(sample) > 3 else (sample, [])
        flat = np.concatenate(sample) if sample else np.zeros(0, V.U)
        terms, number, df = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sample)), [len(s) for s in sample])
        often = np.sort(np.lexsort((terms, -df))[:MODEL_TERMS])
        often = often[df[often] > 1]
        new = np.full(len(terms), -1)
        new[often] = np.arange(len(often))
        number, row = new[number][new[number] >= 0], row[new[number] >= 0]
        weights = np.zeros(((1 << levels) - 1, len(often)), np.float32)
        node = np.zeros(len(sample), np.int64)
        for at in range(len(weights)):
            docs = np.flatnonzero(node == at)
            if len(docs) < 2:
                node[docs] = 2 * at + 1
                continue
            left, weights[at] = cls._bisect(docs, row, number, len(sample), len(often))
            node[docs] = np.where(left, 2 * at + 1, 2 * at + 2)
        made = cls(terms[often], weights, np.zeros(len(weights)))
        if other:
            u, number = np.unique(np.concatenate(other), return_inverse=True)
            made.shards(u, number, np.repeat(np.arange(len(other)), [len(s) for s in other]), len(other), np.zeros(len(other), np.int64), learn=True)
        return made

    @staticmethod
    def _bisect(docs: np.ndarray, row: np.ndarray, number: np.ndarray, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
        place = np.full(n_docs, -1)
        place[docs] = np.arange(len(docs))
        own = place[row] >= 0
        row, number = place[row[own]], number[own]
        left = np.arange(len(docs)) < len(docs) // 2
        size = {True: int(left.sum()), False: int((~left).sum())}
        cost = lambda d, n: d * np.log2(n / (d + 1.0))
        for _ in range(SWEEPS):
            dl, dr = (np.bincount(number[left[row] == side], minlength=n_terms) for side in (True, False))
            now = cost(dl, size[True]) + cost(dr, size[False])
            go = now - cost(np.maximum(dl - 1, 0), size[True]) - cost(dr + 1, size[False])
            come = now - cost(dl + 1, size[True]) - cost(np.maximum(dr - 1, 0), size[False])
            gain = np.bincount(row, np.where(left[row], go[number], come[number]), minlength=len(docs))
            a, b = (np.flatnonzero(s)[np.argsort(-gain[s], kind="stable")] for s in (left, ~left))
            n = min(len(a), len(b))
            swaps = int((gain[a[:n]] + gain[b[:n]] > 1e-9).sum())
            if not swaps:
                break
            left[a[:swaps]], left[b[:swaps]] = False, True
        dl, dr = (np.bincount(number[left[row] == side], minlength=n_terms) for side in (True, False))
        more = lambda d, n: cost(d + 1, n) - cost(d, n)
        return left, more(dr, size[False]) - more(dl, size[True])

    def shards(self, terms: np.ndarray, number: np.ndarray, row: np.ndarray, rows: int, turn: np.ndarray, learn: bool = False) -> np.ndarray:
        """The leaf of each row, by its terms' mean preference; at the very middle the bits of ``turn`` choose."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        known = (self.terms[at] == terms) if len(self.terms) else np.zeros(len(terms), bool)
        own = known[number]
        at, row = at[number[own]], row[own]
        count = np.maximum(np.bincount(row, minlength=rows), 1)
        node, inner = np.zeros(rows, np.int64), len(self.weights)
        for level in range((inner + 1).bit_length() - 1):
            v = np.bincount(row, self.weights[node[row], at], minlength=rows) / count
            if learn:
                for n in np.unique(node):
                    own = np.sort(v[node == n])
                    own = own[int(0.4 * (len(own) - 1)) : math.ceil(0.6 * (len(own) - 1)) + 1]  # the widest gap near the middle
                    k = int(np.argmax(np.diff(own))) if len(own) > 1 else 0
                    self.middles[n] = own[k : k + 2].mean()
            middle = self.middles[node]
            right = (v < middle) | ((v == middle) & ((turn >> level) & 1).astype(bool))
            node = 2 * node + 1 + right
        return node - inner


def _sample(docs: DataFrame) -> list[np.ndarray]:
    rows = docs.count()
    share = min(1 << 20, -(-(SAMPLE << 20) // max(rows, 1)))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).limit(2 * SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs, _ = V.column(batch.column(0))
            for i, j in V.slices(offs, SLICE):
                w = V.split(raw, offs, i, j, lower=True, gap=_GAP)
                found = V.distinct(w.hashes(), w.bounds)
                yield pa.RecordBatch.from_arrays([pa.array([d[:DOC_TERMS].tobytes() for d in found], pa.binary())], ["terms"])

    return [np.frombuffer(r.terms, V.U) for r in some.select("text").mapInArrow(run, "terms binary").collect()]


def build_index(docs: DataFrame) -> DataFrame:
    """The segments of ``docs`` (doc_id, text), written in shards: shard and the columns ``INDEX``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    order = spark.sparkContext.broadcast(Order.fit(_sample(docs)))  # at most 31 x MODEL_TERMS weights

    def segments(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Postings of all held slices, as a segment a shard."""
        base = np.cumsum([0, *(len(h[3]) for h in held)])
        number = np.cumsum([0, *(len(h[0]) for h in held)])
        terms, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        term = back[np.concatenate([h[1] + k for h, k in zip(held, number)])]
        doc = np.concatenate([h[2] + k for h, k in zip(held, base)])
        ids, length, shard, tf = [v for h in held for v in h[3]], *(np.concatenate([h[k] for h in held]) for k in (4, 5, 6))
        key = (shard[doc] * np.int64(len(terms)) + term) * np.int64(len(ids)) + doc
        at = np.argsort(key)
        term, doc, tf = term[at], doc[at], tf[at]
        bounds = np.searchsorted(shard[doc], np.arange(len(order.value.weights) + 2))
        place = np.zeros(len(ids), np.int64)
        for s in np.unique(shard[doc]):
            a, b = bounds[s], bounds[s + 1]
            own = np.flatnonzero((shard == s) & (length > 0))
            place[own] = np.arange(len(own))
            first = np.flatnonzero(np.diff(term[a:b], prepend=-1))
            row = (s, len(own), int(length[own].sum()), [ids[k] for k in own], _narrow(length[own]), terms[term[a:b][first]].tobytes(), _narrow(np.diff(first, append=b - a)), _narrow(place[doc[a:b]]), _narrow(tf[a:b]))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["shard", "docs", "terms_in", "ids", "lengths", "terms", "counts", "places", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        held, size = [], 0
        for batch in batches:
            raw, offs, _ = V.column(batch.column(1))
            for i, j in V.slices(offs, SLICE):
                terms, number, row, tf = _postings(raw, offs, i, j)
                length = np.bincount(row, tf, minlength=j - i).astype(np.int64)
                shard = order.value.shards(terms, number, row, j - i, length)
                held.append((terms, number.astype(np.int32), row.astype(np.int32), batch.column(0).slice(i, j - i).to_pylist(), length, shard, tf.astype(np.int32)))
                size += len(number)
                if size >= POSTINGS:
                    yield from segments(held)
                    held, size = [], 0
        if size:
            yield from segments(held)

    made = docs.mapInArrow(run, "shard int, " + INDEX)
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)  # some eight files a task, whatever the size of a shard
    path = shared_dir(spark) + "/index"
    dealt = made.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))).repartition("shard", "salt").drop("salt")
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(INDEX + ", shard int").parquet(path)


def _length_part(length: np.ndarray, n: int, total: int) -> np.ndarray:
    """100 - 50 + (50 * length * n) div total."""
    if len(length) and int(length.max()) * 50 * n >= 1 << 63:
        return np.array([50 + 50 * int(x) * n // total for x in length], np.int64)
    return 50 + 50 * n * length // total


class Segment:
    """A row of the index, with the postings of the asked terms."""

    def __init__(self, row: dict, asked: np.ndarray, n: int, total: int):
        terms = np.frombuffer(row["terms"], V.U)
        counts = _wide(row["counts"], len(terms))
        at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
        self.df = np.where(terms[at] == asked, counts[at], 0)
        start = (np.cumsum(counts) - counts)[at]
        postings = int(counts.sum())
        pick = np.arange(int(self.df.sum())) - np.repeat(np.cumsum(self.df) - self.df, self.df) + np.repeat(start, self.df)
        self.place = _wide(row["places"], postings)[pick]
        tf = _wide(row["tfs"], postings)[pick]
        self.docs = row["docs"]
        m = _length_part(_wide(row["lengths"], self.docs), n, total)
        self.part = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.place])
        self.start = np.cumsum(self.df) - self.df

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Score of each of the segment's documents; ``terms`` are numbers of asked terms."""
        df = self.df[terms]
        at = np.arange(int(df.sum())) - np.repeat(np.cumsum(df) - df, df) + np.repeat(self.start[terms], df)
        value = self.part[at] * np.repeat(weights, df)
        if int(weights.sum()) * 1_000_000 < 1 << 53:  # then sums in doubles are exact
            return np.bincount(self.place[at], value, minlength=self.docs).astype(np.int64)
        out = np.zeros(self.docs, np.int64)
        np.add.at(out, self.place[at], value)
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(c)[k].as_py() if name != "ids" else batch.column(c)[k].values for c, name in enumerate(batch.schema.names)}


def _bounds(index: DataFrame, asked: np.ndarray, n: int, total: int) -> pa.Table:
    """(shard, term, df, best): over the segments of a shard, for the asked terms that occur there."""
    shipped = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, found = shipped.value, {}
        for row in _rows(batches):
            s = Segment(row, asked, n, total)
            df, best = found.setdefault(row["shard"], (np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)))
            df += s.df
            some = np.flatnonzero(s.df)
            if len(some):
                best[some] = np.maximum(best[some], np.maximum.reduceat(s.part, s.start[some]))
        for shard, (df, best) in found.items():
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard), pa.int32()), pa.array(some, pa.int32()), pa.array(df[some]), pa.array(best[some])], ["shard", "term", "df", "best"])

    made = index.select("shard", "docs", "lengths", "terms", "counts", "places", "tfs").mapInArrow(run, "shard int, term int, df bigint, best bigint")
    return made.groupBy("shard", "term").agg(F.sum("df").alias("df"), F.max("best").alias("best")).toArrow()


def _visit(index: DataFrame, asked: np.ndarray, n: int, total: int, items: dict[int, tuple[np.ndarray, np.ndarray]], visits: dict[int, list[int]], floor: dict[int, int], top: int) -> DataFrame:
    """(item, doc_id, score) of the best of the visited shards: ``top`` of each item from a task, not below its floor."""
    shipped = index.sparkSession.sparkContext.broadcast((asked, items, visits, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, items, visits, floor = shipped.value
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        least = dict(floor)
        for row in _rows(batches):
            own = visits.get(row["shard"], ())
            if not own:
                continue
            s = Segment(row, asked, n, total)
            valid = np.asarray(row["ids"].is_valid())
            ids = row["ids"].fill_null(_LAST_ID).to_numpy(zero_copy_only=False)
            for item in own:
                score = s.scores(*items[item])
                good = np.flatnonzero(score >= max(1, least.get(item, 1)))
                if not len(good):
                    continue
                new = (score[good], ids[good], valid[good])
                if item in best:
                    new = tuple(np.concatenate(c) for c in zip(best[item], new))
                if len(new[0]) > top:
                    keep = np.lexsort((new[1], ~new[2], -new[0]))[:top]
                    new = tuple(c[keep] for c in new)
                    least[item] = int(new[0][-1])
                best[item] = new
        for item, (score, ids, valid) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item)), pa.array(ids, mask=~valid), pa.array(score)], ["item", "doc_id", "score"])

    shards = [k for k, v in visits.items() if v]
    return index.where(F.col("shard").isin(shards)).select("shard", "docs", "lengths", "terms", "counts", "places", "tfs", "ids").mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def _best(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item with their rank, first within shares of the tasks."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).drop("share")


def _block(index: DataFrame, found: list[tuple[int, np.ndarray]], n: int, total: int, top: int) -> DataFrame | None:
    """The best of the items (number, terms)."""
    asked = np.unique(np.concatenate([t for _, t in found]))
    b = _bounds(index, asked, n, total)
    shard, term, df, best = (b[c].to_numpy() for c in ("shard", "term", "df", "best"))
    whole = np.zeros(len(asked), np.int64)
    np.add.at(whole, term, df)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) if d else 0 for d in whole], np.int64)
    part = np.zeros((1 << LEVELS, len(asked)), np.int64)
    part[shard, term] = best
    items = {k: (at := np.searchsorted(asked, t), weight[at]) for k, t in found}
    bound = {k: part[:, at] @ w for k, (at, w) in items.items()}
    order = {k: np.argsort(-v, kind="stable") for k, v in bound.items()}
    floor, done, rows = {k: 1 for k in items}, 0, None
    for more in (*VISITS, 1 << LEVELS):
        visits: dict[int, list[int]] = {}
        for k in items:
            for s in order[k][done : done + more].tolist():
                if bound[k][s] >= floor[k]:
                    visits.setdefault(s, []).append(k)
        done += more
        if not visits:
            break
        new = _visit(index, asked, n, total, items, visits, floor, top)
        rows = settle(_best(new if rows is None else rows.drop("rank").unionByName(new), top))
        floor |= {r.item: r.score for r in rows.where(F.col("rank") == top).select("item", "score").collect()}  # a number an item
    return rows


def _terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms binary) of the items that have terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs, _ = V.column(batch.column(2))
            for i, j in V.slices(offs, SLICE):
                w = V.split(raw, offs, i, j, lower=True, gap=_GAP)
                made = pa.array([d.tobytes() for d in V.distinct(w.hashes(), w.bounds)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), made], ["item", "item_id", "terms"])

    named = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    return settle(named.mapInArrow(run, "item bigint, item_id bigint, terms binary").where(F.length("terms") > 0))


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item (item_id, text) that score above 0."""
    spark = index.sparkSession
    n, total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms_in"), F.lit(0))).first()
    asked = _terms(items)
    held = asked.agg(F.coalesce(F.sum(F.length("terms")), F.lit(0))).first()[0] // 8
    blocks = -(-held // BLOCK_TERMS) if n else 0
    out = spark.createDataFrame([], "item bigint, doc_id bigint, score bigint, rank int")
    for k in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).select("item", "terms").collect()  # about BLOCK_TERMS terms
        if own and (rows := _block(index, [(r.item, np.frombuffer(r.terms, V.U)) for r in own], n, total, top)) is not None:
            out = out.unionByName(rows)
    return out.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_AZ = "abcdefghijklmnopqrstuvwxyz"
_SPLIT = f"regexp_extract_all(translate(text, '{_AZ.upper()}', '{_AZ}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
OP12_SQL = f"""WITH found AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_SPLIT}) AS term FROM documents) GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM found GROUP BY doc_id),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM found, corpus GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark)),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN found USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}"""
