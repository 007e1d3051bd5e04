"""The retrieval chain over filing chunks: a question is understood once, then named steps narrow, search, fuse, rerank
and cite, each a step of one DataFrame plan."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import periods as P
from quillmark.functions import text as T
from quillmark.operators import filings, retrieval, textindex, vectorindex


#: A step of a chain: chunks and the question to chunks.
Step = Callable[[DataFrame, "Ask"], DataFrame]


@dataclass
class Ask:
    """A question and what was found in it."""

    question: str
    intent: str | None = None
    ticker: str | None = None
    period: str | None = None
    relative: str | None = None
    count: int | None = None
    terms: list[str] = field(default_factory=list)
    vector: list[float] | None = None
    k: int = 5


def understand(spark: SparkSession, question: str, vector: list[float] | None = None, k: int = 5) -> Ask:
    """Intent, ticker, explicit or relative period and terms of a question: one row, evaluated once."""
    q = F.lit(question)
    explicit = F.regexp_extract(F.upper(q), r"(20\d{2}\s*(?:Q[1-4]|H[12]|FY)|(?:Q[1-4]|FY)\s*20\d{2})", 1)
    r = spark.range(1).select(
        retrieval.intent(q).alias("intent"), T.first_ticker(q).alias("ticker"), P.parse_period(F.when(explicit != "", explicit))["canonical"].alias("period"),
        P.relative_intent(q).alias("relative"), P.relative_count(q).alias("count"), T.cap(T.base_terms(q)).alias("terms"),
    ).first()
    return Ask(question, r.intent, r.ticker, r.period, None if r.period else r.relative, r["count"], list(r.terms), vector, k)


def by_tags(chunks: DataFrame, ask: Ask) -> DataFrame:
    """Chunks of the ticker and the explicit period, as far as the question names them."""
    for name, value in (("ticker", ask.ticker), ("fiscal_period", ask.period)):
        chunks = chunks.where(F.col(name) == value) if value else chunks
    return chunks


def by_relative_period(chunks: DataFrame, ask: Ask) -> DataFrame:
    """Chunks of the periods that a relative expression means among those that the chunks have: the latest, the last n,
    the one before the latest, or the latest's a year ago."""
    if not ask.relative:
        return chunks
    p = P.parse_period(F.col("fiscal_period"))
    # Few distinct periods, put in order; a semi-join carries the choice to the chunks.
    there = chunks.select("fiscal_period").distinct().where(p.isNotNull()).withColumn("_key", P.tag_sort_key(p["fy"], p["kind"]))
    ranked = there.withColumn("_n", F.row_number().over(Window.orderBy(F.col("_key").desc())))
    last = ranked.where("_n = 1").select(P.previous(p["fy"], p["kind"]).alias("_before"), P.year_ago(p["fy"], p["kind"]).alias("_ago"))
    chosen = {
        "LATEST": lambda: ranked.where("_n = 1"),
        "LAST_N": lambda: ranked.where(F.col("_n") <= max(1, ask.count or 1)),
        "PREVIOUS": lambda: ranked.join(F.broadcast(last), F.col("fiscal_period") == F.col("_before")),
        "YEAR_AGO": lambda: ranked.join(F.broadcast(last), F.col("fiscal_period") == F.col("_ago")),
    }[ask.relative]()
    return chunks.join(F.broadcast(chosen.select("fiscal_period")), "fiscal_period", "left_semi")  # at most the distinct periods


class Backend(Protocol):
    """What answers a question by words or by its vector: the best ``k`` of ``chunks`` as (chunk_id, score), or None
    where the question has nothing that it could go by."""

    def find(self, chunks: DataFrame, ask: Ask, k: int) -> DataFrame | None: ...


class WordScan:
    def find(self, chunks: DataFrame, ask: Ask, k: int) -> DataFrame | None:
        if not ask.terms:
            return None
        return retrieval.top(retrieval.bm25f(chunks, ask.terms, "title", "content"), k, "chunk_id").select("chunk_id", "score")


class VectorScan:
    def find(self, chunks: DataFrame, ask: Ask, k: int) -> DataFrame | None:
        if not ask.vector:
            return None
        return retrieval.nearest(chunks, ask.vector, k, "chunk_id").select("chunk_id", "score")


@dataclass
class WordIndex:
    """A stored index of chunks; its figures are those of all of them, whichever a question is narrowed to.  Terms that
    no piece of a word can be are left out."""

    index: textindex.TextIndex

    def find(self, chunks: DataFrame, ask: Ask, k: int) -> DataFrame | None:
        terms = [t for t in ask.terms if re.fullmatch(r"\w+", t)]
        if not terms:
            return None
        found = textindex.scores_contains(self.index, terms).withColumnRenamed("id", "chunk_id")
        return retrieval.top(found.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), k, "chunk_id", "raw").select("chunk_id", "score")


@dataclass
class VectorCells:
    """A stored index of vectors by numbered chunks: ``numbers`` (id, chunk_id) tells whose they are."""

    index: vectorindex.VectorIndex
    numbers: DataFrame
    probes: int | None = None
    spare: int = 4

    def find(self, chunks: DataFrame, ask: Ask, k: int) -> DataFrame | None:
        """Of ``spare`` times as many neighbours those that the question is narrowed to."""
        if not ask.vector:
            return None
        asked = chunks.sparkSession.createDataFrame([(0, [float(x) for x in ask.vector])], "vec_id bigint, embedding array<double>")
        near = vectorindex.search(self.index, asked, self.spare * k, self.probes).join(self.numbers, "id")
        return retrieval.top(near.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), k, "chunk_id").select("chunk_id", "score")


#: Backends by name and their weights in the fusion; ``register_backend`` adds more.
BACKENDS: dict[str, tuple[Backend, float]] = {"words": (WordScan(), retrieval.KEYWORD_WEIGHT), "vectors": (VectorScan(), retrieval.VECTOR_WEIGHT)}


def register_backend(name: str, backend: Backend, weight: float) -> None:
    BACKENDS[name] = (backend, weight)


def search_by(*names: str, factor: int = 3) -> Step:
    """A step that asks these backends, fuses what they find by place, and gives the chunks with all their columns.  One list
    alone keeps its scores; of a question that none can go by nothing is found."""

    def step(chunks: DataFrame, ask: Ask) -> DataFrame:
        k = factor * ask.k
        lists = [(found, BACKENDS[n][1]) for n in names if (found := BACKENDS[n][0].find(chunks, ask, k)) is not None]
        if not lists:
            return chunks.limit(0).withColumn("score", F.lit(0.0))
        found = lists[0][0]
        if len(lists) > 1:
            found = retrieval.fuse_lists(lists, "chunk_id", k)
        return chunks.join(found.select("chunk_id", "score"), "chunk_id")

    return step


search = search_by("words", "vectors")


def merge(results: DataFrame, ask: Ask) -> DataFrame:
    """One result a content, the best."""
    return retrieval.keep_first(results, ["content"], [F.desc("score"), "chunk_id"])


def rerank(results: DataFrame, ask: Ask) -> DataFrame:
    """Base score blended with a model's (column ``model``, 0 to 10), where there is one."""
    if "model" not in results.columns:
        return results
    return results.withColumn("score", retrieval.rerank_blend(F.col("score"), retrieval.model_score(F.col("model"))))


def top_k(results: DataFrame, ask: Ask) -> DataFrame:
    return retrieval.top(results, ask.k, "chunk_id")


def cite(results: DataFrame, ask: Ask) -> DataFrame:
    """place and citation beside the results."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))  # at most k rows
    tags = F.create_map(F.lit("ticker"), F.col("ticker"), F.lit("fiscal_period"), F.col("fiscal_period"), F.lit("heading"), F.col("title"))
    rows = results.withColumn("place", place)
    return rows.withColumn("citation", filings.citation(F.col("place"), tags, F.lit(None).cast("string")))


STEPS: dict[str, Step] = {
    "parse_tags": by_tags,
    "normalise_period": by_relative_period,
    "search": search,
    "merge": merge,
    "rerank": rerank,
    "top_k": top_k,
    "cite": cite,
}
#: Steps of each scene, in order.
SCENES = {"filing": ["parse_tags", "normalise_period", "search", "merge", "rerank", "top_k", "cite"], "hybrid": ["search", "merge", "top_k"], "chat": []}


def register_step(name: str, step: Step) -> None:
    """A handler that scenes may name."""
    STEPS[name] = step


def register_scene(name: str, steps: list[str]) -> None:
    """A chain of registered handlers; an unknown one is an error at once."""
    if missing := [s for s in steps if s not in STEPS]:
        raise ValueError(f"no such steps: {missing}")
    SCENES[name] = list(steps)


def run(chunks: DataFrame, ask: Ask, scene: str = "filing", web: bool = False) -> DataFrame:
    """The chunks for a question, by the steps of a scene; none where its intent needs no retrieval.

    Columns of chunks: chunk_id, ticker, fiscal_period, title, content (and embedding, for a question with a vector)."""
    if scene not in SCENES:
        raise ValueError(f"no such scene: {scene}")
    needed = ask.intent in (None, "KB_SEARCH", "CLARIFICATION", "SUMMARIZE") or (web and ask.intent == "WEB_SEARCH")
    out = chunks if needed and SCENES[scene] else chunks.limit(0)
    for name in SCENES[scene]:
        out = STEPS[name](out, ask)
    return out


def hashed_vectors(docs: DataFrame, id_col: str, text: str, size: int = 64) -> DataFrame:
    """(id, v): unit vectors of texts without a model: signed counts of their words, by hash.  Words are added up
    where they are read, so a text of any length is ``size`` sums; texts without a word have no vector, and one whose
    counts cancel out is all zeros.  ids are keys."""
    word = docs.select(id_col, F.explode(F.split(F.lower(text), r"\s+")).alias("w")).where("w <> ''")
    placed = word.select(id_col, F.pmod(F.xxhash64("w"), F.lit(size)).alias("p"), F.when(F.pmod(F.xxhash64("w", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s"))
    sums = placed.groupBy(id_col).agg(*(F.sum(F.when(F.col("p") == k, F.col("s")).otherwise(0.0)).alias(f"_{k}") for k in range(size)))
    v = F.array(*(F.col(f"_{k}") for k in range(size)))
    made = sums.select(id_col, v.alias("v")).withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    return made.select(id_col, F.transform("v", lambda x: F.coalesce(F.try_divide(x, F.col("n")), F.lit(0.0))).alias("v"))
