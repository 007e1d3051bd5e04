"""The stored indexes against scans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillmark.operators import retrieval, textindex, vectorindex


def docs(spark, n=300, seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)] + ["nation", "motion", "über", "x_1"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 4))), ", ".join(r.choice(vocab[: 5 + i % 80]) for _ in range(r.randint(0, 60)))) for i in range(n)]
    rows += [(n, None, None), (n + 1, "", "..."), (n + 2, "nation", None), (n + 3, None, "nation nation-nation NATION")]
    return spark.createDataFrame(rows, "id bigint, title string, body string").repartition(3)


def scan(df, words, k):
    """Whole-word scores by the scanning operator, over texts in which words can't hold one another."""
    spaced = df.withColumns({c: F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "body")})
    runs = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    import math

    rows = spaced.select("id", F.length("title").alias("lt"), F.length("body").alias("lc"), runs("title").alias("t"), runs("body").alias("c")).collect()
    n, at, ac = len(rows), sum(r.lt for r in rows) / len(rows), sum(r.lc for r in rows) / len(rows)
    out = []
    df_ = {w: max(sum(w in r.t for r in rows), sum(w in r.c for r in rows)) for w in words}
    for r in rows:
        raw = 0.0
        for w in words:
            v = 3.0 * r.t.count(w) / (0.65 + 0.35 * r.lt / at) + r.c.count(w) / (0.25 + 0.75 * r.lc / ac)
            raw += math.log(1 + (n - df_[w] + 0.5) / (df_[w] + 0.5)) * 2.2 * v / (1.2 + v)
        if raw > 0.01:
            out.append((-round(raw, 9), r.id))
    return sorted(out)[:k]


@pytest.mark.parametrize("block", [4096, 20])
def test_words_are_scored_as_by_counting(spark, monkeypatch, block):
    monkeypatch.setattr(textindex, "BLOCK", block)
    monkeypatch.setattr(textindex, "FIRST", 2)
    df = docs(spark)
    index = textindex.build(df, "id", "title", "body")
    for words in (["nation"], ["w1", "w2", "motion"], ["über", "absent", "X_1"], ["w70", "w70"]):
        got = [(-round(r.raw, 9), r.id) for r in textindex.search(index, words, 15).collect()]
        assert got == scan(df, list(dict.fromkeys(w.lower() for w in words)), 15)
    assert textindex.search(index, ["absent"], 5).count() == textindex.search(index, [], 5).count() == 0


def test_blocks_are_skipped_and_folders_pruned(spark, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 10)
    index = textindex.build(docs(spark, 600), "id", "title", "body")
    best = textindex.search(index, ["nation"], 3)
    held, left = textindex.skipped(index, ["nation"], min(r.raw for r in best.collect()))
    assert left > held / 2
    rows = index.postings.where(F.col("bucket").isin(textindex._folders(index, ["nation"])) & (F.col("term") == "nation"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,nation)" in plan
    files = {r[0] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1


def test_pieces_are_the_scan_s(spark):
    df = docs(spark)
    index = textindex.build(df, "id", "title", "body")
    for pieces in (["tion"], ["w1", "o"], ["zzz"], ["NAT"]):
        got = [(r.id, round(r.raw, 9), round(r.score, 9)) for r in textindex.search_contains(index, pieces, 20).collect()]
        want = [(r.id, round(r.raw, 9), round(r.score, 9)) for r in retrieval.top(retrieval.bm25f(df, pieces, "title", "body"), 20, "id", "raw").collect()]
        assert got == want
    with pytest.raises(ValueError):
        textindex.search_contains(index, ["a b"], 5)


def test_an_empty_table_has_an_index(spark):
    index = textindex.build(docs(spark).limit(0), "id", "title", "body")
    assert textindex.search(index, ["w1"], 5).collect() == [] == textindex.search_contains(index, ["w1"], 5).collect()


def vectors(spark, n=800, seed=4):
    r = random.Random(seed)
    middle = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [m + r.gauss(0, 0.4) for m in middle[i % 6]]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(60)] + [(5000, None), (5001, [0.0] * 8), (5002, [1.0] * 3), (5003, [float("nan")] * 8)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)


def test_neighbours_are_the_scan_s(spark, monkeypatch):
    v = vectors(spark)
    monkeypatch.setattr(vectorindex, "BLOCK", 5)
    index = vectorindex.build(v, cells=12, size=8)
    asked = v.where("vec_id in (0, 3, 21, 5001, 5000, 810)")
    got = vectorindex.search(index, asked, 10).collect()
    assert {r.query_id for r in got} == {0, 3, 21, 810}
    for q in (0, 3, 21, 810):
        one = v.where(F.col("vec_id") == q).first().embedding
        scan = v.where("vec_id < 5000").withColumn("score", F.round(retrieval.cosine(F.col("embedding"), F.array(*map(F.lit, one))), 12))
        want = [(r.vec_id, round(r.score, 9)) for r in retrieval.top(scan, 10, "vec_id").collect()]
        assert [(r.id, round(r.score, 9)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_probes_find_nearly_all(spark):
    """Recall at 30 over every id divisible by 20 of a benchmark table, against the exact search."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index, asked = vectorindex.build(e), e.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.id) for r in vectorindex.search(index, asked, 30).collect()}
    probes = vectorindex.calibrate(index, 30)
    some = {(r.query_id, r.id) for r in vectorindex.search(index, asked, 30, probes=probes).collect()}
    assert len(exact & some) >= 0.95 * len(exact) and probes < len(index.centroids)
    close = vectorindex.build(vectors(spark), cells=12, size=8)
    assert vectorindex.calibrate(close, 10) <= 6  # vectors with groups need few cells
    read = index.cells.where(F.col("cell").isin([1, 2]))
    assert "PartitionFilters: [cell" in read._jdf.queryExecution().executedPlan().toString()


def test_backends_and_scenes_are_registered_by_name(spark):
    """The chain by scans and by stored indexes gives the same; handlers and scenes are added by name."""
    from quillmark.operators import chain as C

    base = docs(spark, 200).select(F.format_string("c%05d", "id").alias("chunk_id"), F.lit("00700").alias("ticker"), F.lit("2025Q1").alias("fiscal_period"), "title", F.col("body").alias("content"), F.col("id").alias("number"))
    r = random.Random(9)
    v = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(200)], "number bigint, embedding array<double>")
    chunks = base.join(v, "number")
    ask = C.Ask("w1 nation", terms=["nation", "w1", "no-word"], vector=[1.0, 0.5, 0, 0, -1, 0, 0.2, 0], k=5)
    words, cells = textindex.build(chunks, "chunk_id", "title", "content"), vectorindex.build(chunks, "number", "embedding", cells=6, size=8)
    C.register_backend("word index", C.WordIndex(words), retrieval.KEYWORD_WEIGHT)
    C.register_backend("cells", C.VectorCells(cells, chunks.select(F.col("number").alias("id"), "chunk_id")), retrieval.VECTOR_WEIGHT)
    C.register_step("search stored", C.search_by("word index", "cells"))
    C.register_scene("stored", ["search stored", "merge", "top_k", "cite"])
    C.register_scene("scanned", ["search", "merge", "top_k", "cite"])
    rows = lambda scene, a: [(x.place, x.chunk_id, round(x.score, 9)) for x in C.run(chunks, a, scene).orderBy("place").collect()]
    assert rows("stored", ask) == rows("scanned", ask) and len(rows("stored", ask)) == 5
    only = C.Ask("w1 nation", terms=["nation"], k=4)
    assert rows("stored", only) == rows("scanned", only)
    assert rows("stored", C.Ask("?", terms=["!"], k=3)) == []
    some = chunks.where("number % 2 = 0")
    assert {x.chunk_id for x in C.run(some, only, "stored").collect()} <= {x.chunk_id for x in some.collect()}
    with pytest.raises(ValueError):
        C.register_scene("bad", ["none such"])


def test_an_index_is_written_in_as_many_tasks_as_its_text_asks_for(spark, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 10)
    df = docs(spark, 600)
    plain = textindex.build(df, "id", "title", "body")
    monkeypatch.setattr(textindex, "TASK_CHARS", 500, raising=False)
    index = textindex.build(df, "id", "title", "body")
    tasks = lambda i: len({f.rsplit("/", 1)[1].split("-")[1] for f in i.postings.inputFiles()})
    assert tasks(plain) <= 4 < tasks(index)
    rows = lambda i: sorted((r.block, r.term, r.best, r.in_title, r.in_content, sorted(map(tuple, r.docs))) for r in i.postings.collect())
    assert rows(plain) == rows(index)
    assert sorted(map(tuple, plain.vocabulary.collect())) == sorted(map(tuple, index.vocabulary.collect()))
