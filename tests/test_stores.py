"""Stored chunk tables and the automaton."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmark.operators import filings, manypatterns, segments
from quillmark.sources import chunkstore

DDL = "k string, v int, owner string"


def store(spark, tmp_path, buckets=8):
    return chunkstore.ChunkStore(spark, f"file://{tmp_path}/s", DDL, ["k"], buckets)


def held(s):
    return sorted(((r.k, r.v, r.owner) for r in s.read().collect()), key=str)


def files(tmp_path):
    return {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in Path(tmp_path / "s").rglob("*.parquet")}


def test_changes_touch_their_buckets_alone(spark, tmp_path):
    s = store(spark, tmp_path)
    rows = [(f"k{i}", i, f"o{i % 5}") for i in range(60)] + [(None, 1, None)]
    df = lambda r: spark.createDataFrame(r, DDL)
    assert s.read().count() == 0 and s.delete(df(rows)) != [] and s.upsert(df([])) == []
    s.upsert(df(rows))
    assert held(s) == sorted(rows, key=str)
    before = files(tmp_path)
    touched = s.upsert(df([("k3", 300, "o3"), ("fresh", 1, "x"), (None, 2, "n")]))
    after = files(tmp_path)
    assert len(touched) <= 3 and {p for p in before if before[p] != after.get(p)} == {p for p in before if int(str(p).split("_bucket=")[1].split("/")[0]) in touched}
    want = {r[0]: r for r in rows} | {"k3": ("k3", 300, "o3"), "fresh": ("fresh", 1, "x"), None: (None, 2, "n")}
    assert held(s) == sorted(want.values(), key=str)
    s.delete(df([(k, 0, "") for k in want if k and k.startswith("k1")] + [("absent", 0, "")]))
    want = {k: v for k, v in want.items() if not (k and k.startswith("k1"))}
    assert held(s) == sorted(want.values(), key=str)
    s.rebuild(df([("n1", 1, "o2"), ("n2", 2, "o2")]), "owner")
    want = {k: v for k, v in want.items() if v[2] != "o2"} | {"n1": ("n1", 1, "o2"), "n2": ("n2", 2, "o2")}
    assert held(s) == sorted(want.values(), key=str)
    s.delete(s.read())
    assert held(s) == [] and not files(tmp_path)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches_and_a_write_that_fails_halfway(spark, tmp_path, seed, monkeypatch):
    r, s, want = random.Random(seed), store(spark, tmp_path, 4), {}
    for step in range(5):
        batch = {f"k{r.randrange(30)}": r.randrange(1000) for _ in range(12)}
        rows = spark.createDataFrame([(k, v, "o") for k, v in batch.items()] + [(k, -1, "o") for k in list(batch)[:3]], DDL)
        if step == 2:  # some buckets are in place already when the job is lost
            real = s._replace

            def half(rows, buckets, real=real):
                real(rows.where(F.pmod(F.xxhash64("k"), F.lit(4)).isin(buckets[: len(buckets) // 2])), buckets[: len(buckets) // 2])
                raise RuntimeError("lost")

            monkeypatch.setattr(s, "_replace", half)
            with pytest.raises(RuntimeError):
                s.upsert(rows, "v")
            monkeypatch.setattr(s, "_replace", real)
        s.upsert(rows, "v")
        want |= batch
        assert held(s) == sorted(((k, v, "o") for k, v in want.items()), key=str)


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_every_pattern_is_found(spark, monkeypatch, block):
    monkeypatch.setattr(manypatterns, "BLOCK_BYTES", block)
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abü") for _ in range(n))
    patterns = [word(r.randint(1, 5)) for _ in range(25)] + [None, "", "aa", "aa", "é"]
    texts = [(i, word(r.randint(0, 60)), "x") for i in range(80)] + [(900, None, "x"), (901, "", "x"), (902, "a é b" * 3000, "x")]
    t = spark.createDataFrame(texts, "id int, t string, n string").repartition(3).withColumnRenamed("n", "other")
    got = manypatterns.contained(t, "t", spark.createDataFrame([(p,) for p in patterns], "p string"), "p")
    count = lambda x, p: sum(x.startswith(p, k) for k in range(len(x)))
    want = {(i, p, count(x, p)) for i, x, _ in texts if x for p in set(patterns) - {None, ""} if p in x}
    rows = [(x.id, x.p, x.n) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert manypatterns.contained(t, "t", spark.createDataFrame([], "p string"), "p").count() == 0


def test_labels_meet_their_names_without_nested_loops(spark):
    rows = spark.createDataFrame([(1, 1, "Cloud Services", False), (1, 2, "cloud", False), (1, 3, "Games total", True), (1, 4, None, False), (1, 5, "other", False)], "id int, row int, label string, total boolean")
    config = spark.createDataFrame([("C", "Cloud", 1, None), ("CS", "cloud services", 2, "C"), ("G", "Games", 1, None)], "code string, name string, level int, parent string")
    got = segments.labelled(rows, config, ["id"])
    assert {(r.row, r.code, r.kind) for r in got.collect()} == {(1, "CS", 0), (2, "C", 0)}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    aliases = spark.createDataFrame([("C", "cloud", 1), ("X", "services", 0)], "code string, alias string, place int")
    got = filings.alias_match(rows.select("row", "label"), aliases)
    assert {(r.row, r.code) for r in got.collect()} == {(1, "X"), (2, "C"), (3, None), (4, None), (5, None)}
