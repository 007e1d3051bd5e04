"""Vector code compression: product codes with exact integers, assigned by exponion search.

Components become integers, vectors are cut into 16 parts, and each part position has a codebook of
``ENTRIES`` entries.  A part starts at the entry it had before (entry 0 in the first round), at
squared distance u.  By the triangle inequality no entry further than 2 * sqrt(u) from that one
can be as near, so the entries are visited in order of their distance from it, as far as
``distance squared <= 4 * u``; equal distances go to the lower index.  All of this is whole numbers.

A round is one map: it writes each vector with its new codes, and after a task's last vector the task's
sums and counts per entry (16 * 64 rows at most).  Those are added up in Spark; the new entries alone,
16 * 64 * part length numbers, come to the driver and go out with the next round's tasks.

Numbers are 64-bit while every component is under 2**16 in size; beyond, Python's own integers
take over (sums then travel as digits of 30 bits), so no result is rounded.

Defined cases: rows with a null vector, or a null or non-finite component, are dropped.  The dimension is
that of the smallest vec_id (nulls last, equal ids by vector) whose length is a multiple of 16; vectors of
another length can't be cut and keep null code and errors, and a sum beyond 64 bits is null as well.  Rows of
repeated or null ids are coded each.  With fewer vectors than ``ENTRIES`` the codebooks are as small.  Null
labels are one label.  No kept row: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import settle, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of up to this size are handled in 64 bits.
SMALL = 1 << 24
#: So many labels' sums are broadcast; beyond, only those of over a thousandth of the rows.
MAX_LABELS = 1 << 16
_BITS = 30


def kept(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull()).where(fine).select("vec_id", "label", "embedding")


def whole(values: np.ndarray, small: bool) -> np.ndarray:
    """floor(256 * x) of doubles, exactly."""
    if small:
        return np.floor(values * float(SCALE)).astype(np.int64)
    big = [int(x) * SCALE if abs(x) >= 2.0**52 else math.floor(x * SCALE) for x in values.ravel().tolist()]
    out = np.empty(len(big), object)
    out[:] = big
    return out.reshape(values.shape)


class Search:
    """Nearest entries of one part position; entries is (entries, length)."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries.T)
        gap = self.entries[:, :, None] - self.entries[:, None, :]
        apart = np.asarray((gap * gap).sum(0)) if len(gap) else np.zeros(gap.shape[1:], np.int64)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def distance(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        d = x - self.entries[:, entry]
        return (d * d).sum(0) if len(d) else np.zeros(len(entry), np.int64)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each column of x, searched from ``start``."""
        u = self.distance(x, start)
        reach = np.zeros(len(start), np.int64)  # entries inside the radius, the start itself among them
        for a in np.unique(start):
            own = np.flatnonzero(start == a)
            reach[own] = np.searchsorted(self.apart[a], 4 * u[own], side="right")
        far = np.argsort(-reach, kind="stable")
        x, entry, best, first = x[:, far], start[far], u[far], start[far]
        ends = np.searchsorted(-reach[far], -np.arange(self.order.shape[1]), side="left")
        for k in range(self.order.shape[1]):
            n = ends[k]  # so many reach the k-th neighbour
            if not n:
                break
            other = self.order[first[:n], k]
            d = self.distance(x[:, :n], other)
            better = (d < best[:n]) | ((d == best[:n]) & (other < entry[:n]))
            entry[:n] = np.where(better, other, entry[:n])
            best[:n] = np.where(better, d, best[:n])
        back = np.empty_like(far)
        back[far] = np.arange(len(far))
        return entry[back], best[back]


def _digits(v: int, n: int) -> list[int]:
    """v in n digits of 30 bits, the last with the sign and all the rest."""
    return [(v >> _BITS * i) & ((1 << _BITS) - 1) for i in range(n - 1)] + [v >> _BITS * (n - 1)]


def _matrix(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have ``dim`` components, their values)."""
    sizes = np.diff(column.offsets.to_numpy())
    own = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
    return own, flat.astype(np.float64).reshape(len(own), dim)


def _round(vectors: DataFrame, books: list[np.ndarray], dim: int, small: bool, digits: int, last: bool) -> DataFrame:
    """One assignment.  Not the last: the vectors with their codes, and rows (part, entry, n, sums).
    The last: vec_id, label, code, error, wide (the error is beyond 64 bits)."""
    kinds = dict((f.name, f.dataType.simpleString()) for f in vectors.schema)
    head = f"vec_id {kinds['vec_id']}, label {kinds['label']}, "
    schema = head + ("code string, error bigint, wide boolean" if last else f"embedding {kinds['embedding']}, codes binary, part int, entry int, n bigint, sums array<bigint>")
    length = dim // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(b) for b in books]
        kind = np.int64 if small else object
        size = len(books[0])
        sums, counts = np.zeros((PARTS, length, size), kind), np.zeros((PARTS, size), np.int64)
        form = None
        for batch in batches:
            form = batch.schema
            own, values = _matrix(batch.column(2), dim)
            x = np.ascontiguousarray(whole(values, small).T).reshape(PARTS, length, len(own))
            start = np.zeros((PARTS, len(own)), np.int64)
            if batch.num_columns > 3:
                held = b"".join(c.as_py() for c in batch.column(3).take(pa.array(own)))
                start = np.frombuffer(held, np.uint8).reshape(len(own), PARTS).T.astype(np.int64)
            codes, errors = np.zeros((len(own), PARTS), np.uint8), np.zeros(len(own), kind)
            for m in range(PARTS):
                entry, d = searches[m].nearest(x[m], start[m])
                codes[:, m] = entry
                errors = errors + d
                if not last:
                    counts[m] += np.bincount(entry, minlength=size)
                    for i in range(length):
                        np.add.at(sums[m, i], entry, x[m, i])
            place = np.full(len(batch), -1)
            place[own] = np.arange(len(own))
            at = pa.array(place, pa.int64(), mask=place < 0)
            if last:
                code = pa.array([c.tobytes().hex() for c in codes], pa.string()).take(at)
                error = pa.array([int(e) if e < 1 << 63 else None for e in errors], pa.int64()).take(at)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, error, pa.array(np.asarray(error.is_null()) & (place >= 0))], ["vec_id", "label", "code", "error", "wide"])
                continue
            none = [pa.nulls(len(batch), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            made = pa.array([c.tobytes() for c in codes], pa.binary()).take(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), made, *none], ["vec_id", "label", "embedding", "codes", "part", "entry", "n", "sums"])
        if form is not None and not last:
            m, e = np.nonzero(counts)
            flat = [[g for i in range(length) for g in _digits(int(sums[a, i, b]), digits)] for a, b in zip(m, e)]
            none = [pa.nulls(len(m), form.field(i).type) for i in range(3)] + [pa.nulls(len(m), pa.binary())]
            some = [pa.array(m, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[m, e], pa.int64()), pa.array(flat, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, *some], ["vec_id", "label", "embedding", "codes", "part", "entry", "n", "sums"])

    return vectors.mapInArrow(run, schema)


def _renewed(sums: DataFrame, books: list[np.ndarray], digits: int) -> list[np.ndarray]:
    """Entries replaced by the floored means of their parts; entries without parts stay."""
    counts = sums.groupBy("part", "entry").agg(F.sum("n").alias("v")).withColumn("pos", F.lit(-1))
    each = sums.select("part", "entry", F.posexplode("sums").alias("pos", "v")).groupBy("part", "entry", "pos").agg(F.sum("v").alias("v"))
    found = {(r.part, r.entry, r.pos): r.v for r in counts.unionByName(each).collect()}  # no more than the codebooks hold
    out = [b.copy() for b in books]
    for (m, e, pos), n in found.items():
        if pos < 0:
            for i in range(out[m].shape[1]):
                total = sum(found[m, e, i * digits + g] << _BITS * g for g in range(digits))
                out[m][e, i] = total // n
    return out


def learn(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], int, bool] | None:
    """(kept vectors with their last codes, codebooks, dimension, whether 64 bits are enough); None without a vector."""
    vectors = kept(vectors)
    proper = vectors.where(F.size("embedding") % PARTS == 0)
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = proper.orderBy(*order).limit(1).collect()
    if not first:
        return None
    dim = len(first[0].embedding)
    starts = [r.embedding for r in proper.where(F.size("embedding") == dim).orderBy(*order).limit(entries).collect()]
    most = vectors.where(F.size("embedding") == dim).agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0] or 0.0
    small = most * SCALE < SMALL and dim // PARTS <= 1024
    digits = 1 if small else (math.frexp(most)[1] + 8 + 63) // _BITS + 1
    begun = whole(np.array(starts, np.float64).reshape(len(starts), dim), small).reshape(len(starts), PARTS, dim // PARTS)
    books = [begun[:, m, :] for m in range(PARTS)]
    for _ in range(rounds):
        done = settle(_round(vectors, books, dim, small, digits, False))
        books = _renewed(done.where("part is not null"), books, digits)
        vectors = done.where("part is null").select("vec_id", "label", "embedding", "codes")
    return vectors, books, dim, small


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, wide; the codebooks).  Without a kept vector, no rows and no codebooks."""
    known = learn(vectors, entries, rounds)
    if known is None:
        return _round(kept(vectors).where("false"), [np.zeros((1, 0), np.int64)] * PARTS, 0, True, 1, True), []
    coded, books, dim, small = known
    return _round(coded, books, dim, small, 1, True), books


def with_label_error(coded: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """Adds label_error.  A label may hold most of the rows, so rows meet their label's sum by broadcast: all
    sums if they are few, else those of the labels that are common; rows of the others are joined by a shuffle."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = settle(coded.groupBy("label").agg(F.when(~F.max("wide"), total).alias("s"), F.count("*").alias("n")).select("label", F.expr("try_cast(s AS bigint)").alias("label_error"), "n"))
    same = lambda a, b: a["label"].eqNullSafe(b["label"])
    labels, rows = sums.agg(F.count("*"), F.sum("n")).first()
    if labels <= max_labels:
        return coded.join(F.broadcast(sums), same(coded, sums), "left").select(coded["*"], sums["label_error"])
    common = settle(sums.where(F.col("n") * 1000 >= rows))
    rare = settle(sums.join(F.broadcast(common), same(sums, common), "left_anti"))
    one = coded.join(F.broadcast(common), same(coded, common)).select(coded["*"], common["label_error"])
    left = coded.join(F.broadcast(common), same(coded, common), "left_anti")
    return one.unionByName(left.join(rare, same(left, rare)).select(left["*"], rare["label_error"]))


def op11_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    out = with_label_error(settle(coded))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _assigned(name: str, book: str) -> str:
    """key = squared distance * 64 + index, the least of which is the assignment."""
    return f"""{name} AS (SELECT rid, p, min(CAST(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS BIGINT) * 64 + e) AS key
  FROM parts JOIN {book} USING (p) GROUP BY rid, p)"""


def _book(name: str, old: str, keys: str) -> str:
    return f"""{name} AS (SELECT p, e, coalesce(m, c) AS c FROM {old} LEFT JOIN (
  SELECT p, e, list(floor(s / n) ORDER BY i) AS m FROM (
    SELECT p, key % 64 AS e, i, sum(x[i]) AS s, count(*) AS n FROM parts JOIN {keys} USING (rid, p), range(1, 5) r(i) GROUP BY ALL) GROUP BY p, e) USING (p, e))"""


OP11_SQL = f"""WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, p, v[4 * p + 1 : 4 * p + 4] AS x FROM kept, range(16) r(p)),
book0 AS (SELECT p, rid AS e, x AS c FROM parts WHERE rid < 64),
{_assigned("key0", "book0")},
{_book("book1", "book0", "key0")},
{_assigned("key1", "book1")},
{_book("book2", "book1", "key1")},
{_assigned("key2", "book2")},
coded AS (SELECT rid, string_agg(printf('%02x', key % 64), '' ORDER BY p) AS code, CAST(sum(key // 64) AS BIGINT) AS error FROM key2 GROUP BY rid),
sha AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book2, range(1, 5) r(i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), sha"""
