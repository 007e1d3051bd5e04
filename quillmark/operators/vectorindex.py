"""An inverted-file index for cosine neighbours: vectors in folders by their nearest centroid.

Centroids are learned by Spark's k-means on unit vectors (a sample of about ``SAMPLE`` by hashed id); every vector of the
index's size is assigned and written to its cell's folder, a large cell in several files.  A cell also keeps the widest
angle between its centroid and a vector of it.

Stated questions are searched in blocks of ``BLOCK``, which go out with the tasks; a task keeps the k best of each
question over the files it reads.  With ``probes`` a question reads that many cells, nearest centroid first.  Without,
the search goes on to all cells that may hold a better one: no vector of a cell is nearer to the question than the
angle to the centroid less the cell's widest angle; so the result is that of a scan.

Null and zero vectors and those of another size are in no cell; equal scores go by id."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.sources.shared import settle

SAMPLE, BLOCK, FILE_ROWS = 100_000, 4096, 1 << 20
#: Scores within this of each other may be computed in another order.
SLACK = 1e-9


@dataclass
class VectorIndex:
    """cells: id, v (unit vector), cell; centroids (unit) and widest angles by cell."""

    cells: DataFrame
    centroids: np.ndarray
    widest: np.ndarray


def _unit(vectors: DataFrame, id_col: str, col: str, size: int | None) -> DataFrame:
    x = F.transform(F.col(col), lambda e: e.cast("double"))
    rows = vectors.where(F.col(col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), x.alias("x"))
    rows = rows.where(~F.exists("x", lambda e: e.isNull() | F.isnan(e)))
    if size is not None:
        rows = rows.where(F.size("x") == size)
    rows = rows.withColumn("n", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e))).where("n > 0 and n < double('inf')")
    return rows.select("id", F.transform("x", lambda e: e / F.col("n")).alias("v"))


def build(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", cells: int = 16, size: int | None = None, seed: int = 7) -> VectorIndex:
    size = size or vectors.where(F.size(col) > 0).select(F.size(col)).first()[0]
    rows = _unit(vectors, id_col, col, size)
    n = rows.count()
    share = min(1 << 20, -(-(SAMPLE << 20) // max(n, 1)))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).select(array_to_vector("v").alias("features"))
    model = KMeans(k=max(1, min(cells, n)), seed=seed, maxIter=20, distanceMeasure="cosine").fit(sample)
    centroids = np.array(model.clusterCenters(), np.float64)
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-300)
    known = model.transform(rows.withColumn("features", array_to_vector("v"))).select("id", "v", F.col("prediction").alias("cell"))
    files = max(1, -(-n // (FILE_ROWS * len(centroids))))
    written = settle(known.repartition(len(centroids) * files, "cell", F.pmod(F.xxhash64("id"), F.lit(files * 4))), "cell")
    of = F.element_at(F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in centroids)), F.col("cell") + 1)
    cosine = F.aggregate(F.zip_with("v", of, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    widest = np.zeros(len(centroids))
    for r in written.groupBy("cell").agg(F.min(cosine).alias("c")).collect():  # a number a cell
        widest[r.cell] = np.arccos(np.clip(r.c, -1, 1)) + SLACK
    return VectorIndex(written, centroids, widest)


def _visit(index: VectorIndex, cells: list[int], asked: dict[int, list[int]], q: np.ndarray, floor: np.ndarray, k: int) -> DataFrame:
    """(q, id, score): of each question the k best of the cells it visits, for each task, not under its floor."""
    shipped = index.cells.sparkSession.sparkContext.broadcast((asked, q, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q, floor = shipped.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cell = batch.column(2).to_numpy()
            ids = batch.column(0).to_numpy()
            v = batch.column(1).flatten().to_numpy().reshape(len(ids), -1)
            for c in np.unique(cell):
                rows = np.flatnonzero(cell == c)
                for some in (asked[c][i : i + 256] for i in range(0, len(asked[c]), 256)):
                    scores = np.round(v[rows] @ q[some].T, 12)  # equal vectors have equal scores, whatever the blocks
                    for j, n in enumerate(some):
                        s = scores[:, j]
                        least = max(floor[n], best[n][0].min() if n in best and len(best[n][0]) == k else -2.0)
                        good = np.flatnonzero(s >= least - SLACK)
                        s, i = s[good], ids[rows[good]]
                        if n in best:
                            s, i = np.concatenate([best[n][0], s]), np.concatenate([best[n][1], i])
                        keep = np.lexsort((i, -s))[:k]
                        best[n] = s[keep], i[keep]
        for n, (s, i) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), n)), pa.array(i), pa.array(s)], ["q", "id", "score"])

    return index.cells.where(F.col("cell").isin(cells)).select("id", "v", "cell").mapInArrow(run, "q bigint, id bigint, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.col("id")]
    w = Window.partitionBy("q", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy(*order)  # a question's candidates in shares first
    some = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def calibrate(index: VectorIndex, k: int, target: float = 0.97, questions: int = 256) -> int:
    """The least number of probes that finds ``target`` of the k nearest of about so many of the index's own vectors.

    One exact search tells: each neighbour's cell has a place in its question's order of cells."""
    n = index.cells.count()
    share = min(1 << 20, -(-(questions << 20) // max(n, 1)))
    asked = index.cells.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < share).select("id", "v")
    near = search(index, asked, k, id_col="id", col="v")
    found = near.join(index.cells.select("id", "cell"), "id").groupBy("query_id").agg(F.collect_list("cell").alias("cells")).join(asked.withColumnRenamed("id", "query_id"), "query_id").limit(4 * questions).collect()
    if not found:
        return len(index.centroids)
    angle = np.arccos(np.clip(np.array([r.v for r in found]) @ index.centroids.T, -1, 1))
    place = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1)
    at = np.concatenate([place[n, r.cells] for n, r in enumerate(found)])
    return int(np.sort(at)[max(0, int(np.ceil(target * len(at))) - 1)]) + 1


def search(index: VectorIndex, questions: DataFrame, k: int, probes: int | None = None, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of the k nearest of each question."""
    spark = index.cells.sparkSession
    asked = settle(_unit(questions, id_col, col, index.centroids.shape[1]))
    out = spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    blocks = -(-asked.count() // BLOCK)
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()  # about BLOCK vectors
        if not rows:
            continue
        q = np.array([r.v for r in rows])
        angle = np.arccos(np.clip(q @ index.centroids.T, -1, 1))
        order = np.argsort(angle, axis=1, kind="stable")
        floor, done, found = np.full(len(q), -2.0), 0, None
        for more in (probes,) if probes else (4, len(index.centroids)):
            visits: dict[int, list[int]] = {}
            for n in range(len(q)):
                for c in order[n, done : done + more].tolist():
                    if probes or np.cos(max(0.0, angle[n, c] - index.widest[c])) >= floor[n] - SLACK:
                        visits.setdefault(c, []).append(n)
            done += more
            if not visits:
                break
            new = _visit(index, sorted(visits), visits, q, floor, k)
            found = settle(_best(new if found is None else found.drop("rank").unionByName(new), k))
            for r in found.where(F.col("rank") == k).select("q", "score").collect():  # a number a question
                floor[r.q] = r.score
        names = F.broadcast(spark.createDataFrame([(n, r.id) for n, r in enumerate(rows)], "q bigint, query_id bigint"))
        out = out.unionByName(found.join(names, "q").select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))
    return out
