"""Ranked search against plain counting."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillmark.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=50):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def corpus(seed=2, n=400):
    r = random.Random(seed)
    topics = [[f"t{k}x{i}" for i in range(60)] for k in range(6)]
    common = ["the", "Of", "naïve", "東京", "and", "x" * 300, "İ", " "]
    docs = []
    for i in range(n):
        own = r.choice(topics)
        docs.append((i, r.choice([" ", ", ", "\n", "_"]).join(r.choice(own if r.random() < 0.7 else common) for _ in range(r.randint(1, 80)))))
    docs += [(n + i, docs[7][1]) for i in range(150)]  # ties by the hundred
    docs += [(9000, None), (9001, ""), (9002, "  --- !"), (None, docs[7][1]), (None, "t1x1 the"), (3, "t1x1 t2x2"), (9003, "The THE the"), (9004, " ".join(topics[0] * 300)), (-5, docs[7][1])]
    items = [(k, " ".join(r.choice(topics[k % 6]) for _ in range(12)) + " the of naïve 東京") for k in range(20)]
    items += [(50, docs[7][1]), (51, None), (52, "..."), (53, "absent"), (None, "t1x1"), (4, "t1x1 t1x1 and"), (4, "T1X1 t1x1 and"), (54, "the")]
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' AS score", "1 AS shard").repartition(5)
    q = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "7 AS rank")
    return sorted((tuple(r) for r in L.search(L.build_index(d), q).collect()), key=str)


def test_equals_counting(spark, monkeypatch):
    docs, items = corpus()
    expected = plain(docs, items)
    assert run(spark, docs, items) == expected
    monkeypatch.setattr(L, "POSTINGS", 500)  # many segments
    monkeypatch.setattr(L, "SLICE", 1000)
    monkeypatch.setattr(L, "BLOCK_TERMS", 60)  # several blocks of items
    assert run(spark, docs, items) == expected


def test_empty_tables(spark):
    docs, items = corpus(n=20)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [(1, None), (2, "-")], items) == []


def test_sums_beyond_exact_doubles(monkeypatch):
    row = {"docs": 2, "lengths": L._narrow(np.array([3, 4])), "terms": np.array([5, 9], "u8").tobytes(), "counts": L._narrow(np.array([2, 1])), "places": L._narrow(np.array([0, 1, 1])), "tfs": L._narrow(np.array([3, 1, 3]))}
    s = L.Segment(row, np.array([1, 5, 9], "u8"), 2, 7)
    big = np.array([1, 1 << 40, 3], np.int64)
    m = [50 + 50 * 2 * x // 7 for x in (3, 4)]
    part = lambda tf, k: 10**9 * tf // (1000 * tf + 20 * m[k])
    assert s.scores(np.array([0, 1, 2]), big).tolist() == [part(3, 0) << 40, (part(1, 1) << 40) + 3 * part(3, 1)]
    assert L._length_part(np.array([1 << 40]), 1 << 40, 1 << 60)[0] == 50 + 50 * (1 << 80) // (1 << 60)


def test_bisection_tells_topics_apart_and_bounds_stop_visits(spark, monkeypatch):
    r = random.Random(1)
    topics = [np.arange(k * 100, k * 100 + 100, dtype="u8") for k in range(4)]
    sample = [np.sort(np.array(r.sample(topics[i % 4].tolist(), 30), "u8")) for i in range(200)]
    order = L.Order.fit(sample, 2)
    flat, row = np.concatenate(sample), np.repeat(np.arange(200), 30)
    u, number = np.unique(flat, return_inverse=True)
    shard = order.shards(u, number, row, 200, np.zeros(200, np.int64))
    assert all(len({s for i, s in enumerate(shard) if i % 4 == k}) == 1 for k in range(4)) and len(set(shard)) == 4
    # a query of one topic's words needs no shard of the others
    docs = [(i, " ".join(f"q{x}" for x in sample[i])) for i in range(200)]
    seen, visit = [], L._visit
    monkeypatch.setattr(L, "_visit", lambda index, asked, n, total, items, visits, *a: seen.append(sorted(visits)) or visit(index, asked, n, total, items, visits, *a))
    items = [(1, "q5 q6 q7")]
    assert run(spark, docs, items) == plain(docs, items)
    assert len({s for v in seen for s in v}) < 1 << L.LEVELS


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    at = f"/root/testdata/{sf}"
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    got = {tuple(r) for r in L.op12_lexical(spark, at).collect()}
    assert got == {tuple(r) for r in duckdb.sql(L.OP12_SQL).fetchall()} and len(got) > 50
