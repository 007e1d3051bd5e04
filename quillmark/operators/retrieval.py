"""Retrieval: BM25F, exact cosine neighbours, rank fusion, tags, merge, budget and citations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import count_occurrences, estimate_tokens

#: BM25F parameters. Fixed values.
K1, TITLE_WEIGHT, CONTENT_WEIGHT, TITLE_B, CONTENT_B = 1.2, 3.0, 1.0, 0.35, 0.75
SQUASH, MIN_RAW = 5.0, 0.01
RRF_K, KEYWORD_WEIGHT, VECTOR_WEIGHT = 60, 0.3, 0.7
FUSED = 10
RERANK_BASE, RERANK_MODEL = 0.3, 0.7
_KEY = re.compile(r"[A-Za-z0-9_]+")


def bm25f(docs: DataFrame, keywords: list[str], title: str, content: str, min_raw: float = MIN_RAW) -> DataFrame:
    """``docs`` with raw and score = tanh(raw / 5), rows under ``min_raw`` dropped.

    Keywords are few and known at plan time, so the counts are columns of one scan; the corpus
    statistics are one aggregate row, joined by broadcast."""
    t, c = F.lower(F.coalesce(F.col(title), F.lit(""))), F.lower(F.coalesce(F.col(content), F.lit("")))
    rows = docs.withColumns({"_lt": F.length(t), "_lc": F.length(c)} | {f"_t{i}": count_occurrences(t, k.lower()) for i, k in enumerate(keywords)} | {f"_c{i}": count_occurrences(c, k.lower()) for i, k in enumerate(keywords)})
    stats = rows.agg(
        F.count("*").alias("_n"),
        F.avg("_lt").alias("_at"),
        F.avg("_lc").alias("_ac"),
        *(F.greatest(F.count_if(F.col(f"_t{i}") > 0), F.count_if(F.col(f"_c{i}") > 0)).alias(f"_d{i}") for i in range(len(keywords))),
    )
    rows = rows.crossJoin(F.broadcast(stats))  # one row of statistics

    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        length = lambda n, b, avg: 1 - b + b * F.coalesce(F.try_divide(F.col(n), F.col(avg)), F.lit(0.0))
        w = TITLE_WEIGHT * F.col(f"_t{i}") / length("_lt", TITLE_B, "_at") + CONTENT_WEIGHT * F.col(f"_c{i}") / length("_lc", CONTENT_B, "_ac")
        return idf * (K1 + 1) * w / (K1 + w)

    raw = reduce(lambda a, b: a + b, [part(i) for i in range(len(keywords))], F.lit(0.0))
    return rows.withColumn("raw", raw).where(F.col("raw") > min_raw).select(*docs.columns, "raw", F.tanh(F.col("raw") / SQUASH).alias("score"))


def top(df: DataFrame, k: int, id_col: str, score: str = "score", offset: int = 0) -> DataFrame:
    """The k best by score, smallest id first of equals."""
    out = df.orderBy(F.desc(score), id_col)
    return (out.offset(offset) if offset else out).limit(k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str, col: str = "embedding", min_score: float | None = None) -> DataFrame:
    """Exact cosine neighbours of one query among vectors of its size."""
    q = F.array(*(F.lit(float(x)) for x in query))
    out = vectors.where(F.size(col) == len(query)).withColumn("score", cosine(F.col(col), q))
    return top(out if min_score is None else out.where(F.col("score") >= min_score), k, id_col)


def fuse(keyword: DataFrame, vector: DataFrame, id_col: str, k: int, w_keyword: float = KEYWORD_WEIGHT, w_vector: float = VECTOR_WEIGHT) -> DataFrame:
    """Weighted reciprocal-rank fusion of two top lists: sum of w / (60 + rank)."""
    return fuse_lists([(keyword, w_keyword), (vector, w_vector)], id_col, k)


def fuse_lists(lists: list[tuple[DataFrame, float]], id_col: str, k: int) -> DataFrame:
    """The k best of lists, of each of which no more than ``FUSED`` * k rows count."""
    w = Window.orderBy(F.desc("score"), id_col)  # of rows that were cut to that number
    ranked = [top(df.select(id_col, "score"), FUSED * k, id_col).select(id_col, (x / (RRF_K + F.row_number().over(w))).alias("s")) for df, x in lists]
    return top(reduce(DataFrame.unionByName, ranked).groupBy(id_col).agg(F.sum("s").alias("score")), k, id_col)


def tag_filter(chunks: DataFrame, tags: DataFrame, conditions: list[tuple[str, str, list[str]]] | None, on: list[str]) -> DataFrame:
    """One left-semi join a condition (key, EQ or IN, values), all must hold; empty conditions don't
    restrict; keys are letters, digits and underscores or a ValueError."""
    for key, op, values in conditions or []:
        if not key or not values:
            continue
        if not _KEY.fullmatch(key):
            raise ValueError(f"tag key {key!r}")
        hit = F.col("tag_value") == values[0] if op == "EQ" else F.col("tag_value").isin(values)
        chunks = chunks.join(tags.where((F.col("tag_key") == key) & hit).select(*on).distinct(), on, "left_semi")
    return chunks


def attach_tags(chunks: DataFrame, tags: DataFrame, on: list[str]) -> DataFrame:
    """``tags``: a map column of the chunk's tags (the greatest value of a repeated key)."""
    one = tags.groupBy(*on, "tag_key").agg(F.max("tag_value").alias("v"))
    maps = one.groupBy(*on).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag_key", "v")))).alias("tags"))
    return chunks.join(maps, on, "left")


def flatten_tags(df: DataFrame, on: list[str], tags: str = "tags") -> DataFrame:
    return df.select(*on, F.explode(tags).alias("tag_key", "tag_value")).dropDuplicates()


def merge_maps(base: Column, over: Column) -> Column:
    """Entries of both, ``over`` winning."""
    empty = F.create_map().cast("map<string,string>")
    b, o = F.coalesce(base, empty), F.coalesce(over, empty)
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.map_contains_key(o, k)), o)


def fill_parents(results: DataFrame, chunks: DataFrame, id_col: str = "chunk_id", parent: str = "parent_chunk_id") -> DataFrame:
    """Content preceded by the parent's, where there is one."""
    p = chunks.select(F.col(id_col).alias(parent), F.col("content").alias("_parent"))
    return results.join(p, parent, "left").withColumn("content", F.concat_ws("\n", "_parent", "content")).drop("_parent")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` and those of ``old`` that it has no key of."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def refresh_tags(old: DataFrame, new: DataFrame, chunks: DataFrame, on: list[str]) -> DataFrame:
    """Tags of the upserted chunks are replaced, repeats ignored."""
    return old.join(chunks.select(*on).distinct(), on, "left_anti").unionByName(new).dropDuplicates()


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def budget(results: DataFrame, content: str, limit: int, group: list[str], id_col: str, score: str = "score") -> DataFrame:
    """Per group, results by score until the running token estimate first passes ``limit``; the first
    is always kept."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), id_col)
    run = results.withColumns({"tokens": estimate_tokens(F.col(content))}).withColumns({"running": F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)), "rn": F.row_number().over(w)})
    return run.where((F.col("rn") == 1) | (F.col("running") <= limit))


def rerank_blend(base: Column, model: Column) -> Column:
    return RERANK_BASE * base + RERANK_MODEL * F.coalesce(model, F.lit(0.5))


def model_score(raw: Column) -> Column:
    """A 0 to 10 grade as 0 to 1; unmentioned is 0."""
    return F.coalesce(F.least(F.greatest(raw, F.lit(0.0)), F.lit(10.0)) / 10, F.lit(0.0))


def rank_decay(df: DataFrame, base: float, decay: float, group: list[str], order: list) -> DataFrame:
    return df.withColumn("score", base - (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) * decay)


def expand_synonyms(terms: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Each term and the members of its group; a term in several belongs to the last."""
    last = {t: g for g, members in groups.items() for t in members}
    rows = [(t, m) for t, g in last.items() for m in groups[g]]
    dim = F.broadcast(terms.sparkSession.createDataFrame(rows, "term string, member string"))
    return terms.join(dim, "term", "left").select("term", F.coalesce("member", "term").alias("member")).distinct()


def intent(query: Column, legacy: bool = False) -> Column:
    """GREETING, WEB_SEARCH, CLARIFICATION (blank) or KB_SEARCH; ``legacy`` finds hi inside words."""
    hello = query.rlike("(?i)你好|hi|hello" if legacy else r"(?i)你好|\b(hi|hello)\b")
    return F.when(F.trim(F.coalesce(query, F.lit(""))) == "", "CLARIFICATION").when(hello, "GREETING").when(query.rlike("网页|网络搜索|上网"), "WEB_SEARCH").otherwise("KB_SEARCH")


def needs_retrieval(i: Column, web: bool = False) -> Column:
    return i.isNull() | i.isin("KB_SEARCH", "CLARIFICATION", "SUMMARIZE") | (F.lit(web) & (i == "WEB_SEARCH"))


def metadata_filter(df: DataFrame, form_type: str | None = None, fiscal_period: str | None = None, years: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Equality without case; the year range passes rows without a year."""
    if form_type:
        df = df.where(F.upper("form_type") == form_type.upper())
    if fiscal_period:
        df = df.where(F.upper("fiscal_period") == fiscal_period.upper())
    low, high = years
    if low is not None:
        df = df.where(F.col("fiscal_year").isNull() | (F.col("fiscal_year") >= low))
    return df if high is None else df.where(F.col("fiscal_year").isNull() | (F.col("fiscal_year") <= high))


def context_text(results: DataFrame, group: list[str], order: str) -> DataFrame:
    """[n] header and content of each group's results, in order, as one text."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    rows = results.withColumn("n", n).withColumn("part", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.coalesce("header", F.lit("")), F.lit("\n"), F.col("content")))
    return rows.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n\n").alias("context"))


def recall(df: DataFrame, k: int, id_col: str, keep: Column, factor: int = 3, score: str = "score") -> DataFrame:
    """The best ``k`` that pass among the best ``factor`` * k: filtering after the search costs recall, not results."""
    return top(top(df, factor * k, id_col, score).where(keep), k, id_col, score)


def vector_filter(ticker: str | None = None, form_type: str | None = None, period: str | None = None, year: int | None = None, first: int | None = None, last: int | None = None) -> Column:
    """The predicate that goes with a vector search: equalities, and a closed range of years."""
    ok = F.lit(True)
    for name, value in (("ticker", ticker), ("form_type", form_type), ("fiscal_period", period), ("fiscal_year", year)):
        ok = ok & (F.col(name) == value) if value is not None else ok
    ok = ok & (F.col("fiscal_year") >= first) if first is not None else ok
    return ok & (F.col("fiscal_year") <= last) if last is not None else ok


def guarded(df: DataFrame, domain: str, handler) -> DataFrame:
    """``handler`` applied in the filing domain only; decided when the plan is built."""
    return handler(df) if domain == "filing" else df


def score_or_parts(score: Column, vector: Column, term: Column) -> Column:
    """A result's score, or 0.7 of its vector's and 0.3 of its terms' similarity."""
    return F.coalesce(score, 0.7 * F.coalesce(vector, F.lit(0.0)) + 0.3 * F.coalesce(term, F.lit(0.0)))


def rebuild(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` in place of all rows of its keys, so building again changes nothing."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new)


def bm25(docs: DataFrame, words: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``docs`` that hold a term, with the plain score of one field of words; statistics are one row."""
    counts = {f"_f{i}": F.size(F.filter(words, lambda w: w == t)) for i, t in enumerate(terms)}  # noqa: B023  (applied at once)
    rows = docs.withColumns({"_n": F.size(words)} | counts)
    stats = rows.agg(F.count("*").alias("_c"), F.avg("_n").alias("_a"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(terms))))

    def part(i: int) -> Column:
        d, f = F.col(f"_d{i}"), F.col(f"_f{i}")
        return F.log(1 + (F.col("_c") - d + 0.5) / (d + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_n") / F.col("_a")))

    some = reduce(lambda x, y: x | y, [F.col(f"_f{i}") > 0 for i in range(len(terms))], F.lit(False))
    score = reduce(lambda x, y: x + y, [part(i) for i in range(len(terms))], F.lit(0.0))
    return rows.where(some).crossJoin(F.broadcast(stats)).select(*docs.columns, score.alias("score"))
