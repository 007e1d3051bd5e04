"""Vector codes against plain Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from quillmark.llm import vectorcodes as C

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string"


def plain(rows, dim, entries=64):
    """{row number: (code, error, label_error)} and the codebooks' hash, by trying every entry."""
    good = [k for k, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ok = [k for k in good if len(rows[k][1]) == dim]
    size = dim // 16
    v = {k: [math.floor(256 * int(x)) if abs(x) >= 2**52 else math.floor(256 * x) for x in rows[k][1]] for k in ok}
    part = {(k, p): v[k][p * size : (p + 1) * size] for k in ok for p in range(16)}
    first = sorted(ok, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[part[k, p] for k in first] for p in range(16)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))
    for _ in range(2):
        held = [[[] for _ in books[p]] for p in range(16)]
        for k in ok:
            for p in range(16):
                held[p][near(p, part[k, p])[1]].append(part[k, p])
        books = [[[sum(c) // len(c) for c in zip(*h)] if h else c for c, h in zip(books[p], held[p])] for p in range(16)]
    last = {k: [near(p, part[k, p]) for p in range(16)] for k in ok}
    error = {k: sum(d for d, _ in last[k]) for k in ok}
    by_label = {}
    for k in ok:
        by_label[rows[k][2]] = by_label.get(rows[k][2], 0) + error[k]
    fit = lambda n: n if n < 1 << 63 else None
    wide = {rows[k][2] for k in ok if fit(error[k]) is None}
    codes = {k: ("".join(f"{e:02x}" for _, e in last[k]), fit(error[k]), None if rows[k][2] in wide else fit(by_label[rows[k][2]])) if k in last else (None, None, by_label.get(rows[k][2])) for k in good}
    return codes, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def vectors(n, dim, seed, size=1.0, step=None):
    r = random.Random(seed)
    one = lambda: r.choice([-1, -0.5, 0, 0.25, 1]) if step else r.gauss(0, size)
    return [(i * 3 % n, [float(np.float32(one())) for _ in range(dim)], r.choice([0, 1, 1, 1, None]), "clash") for i in range(n)]


def check(spark, rows, dim, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = C.op11_vectorcodes(spark, str(tmp_path)).collect()
    codes, sha = plain(rows, dim)
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    expected = sorted(((rows[k][0], *c) for k, c in codes.items()), key=lambda t: (key(t[:1]), t[1] or "", key(t[2:])))
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=lambda t: (key(t[:1]), t[1] or "", key(t[2:]))) == expected
    assert {r.codebooks_sha256 for r in got} == {sha}


@pytest.mark.parametrize("seed,dim,step", [(1, 16, None), (2, 32, True), (3, 64, None)])
def test_codes_are_those_of_trying_every_entry(spark, tmp_path, seed, dim, step):
    check(spark, vectors(300, dim, seed, step=step), dim, tmp_path)


def test_nulls_repeats_and_few_vectors(spark, tmp_path):
    rows = vectors(30, 16, 5)
    rows += [rows[3], (None, rows[4][1], 7, "x"), (None, rows[4][1], None, "x"), (500, None, 1, "x"), (501, [None] + rows[0][1][1:], 1, "x"), (502, [float("nan")] * 16, 1, "x"), (503, [float("-inf")] * 16, 1, "x"), (504, [1.0] * 3, 1, "x"), (505, [0.0] * 32, 9, "x"), (506, [], None, "x")]
    check(spark, rows, 16, tmp_path)


def test_many_equal_vectors(spark, tmp_path):
    rows = vectors(80, 16, 6)
    check(spark, rows + [(1000 + i, rows[0][1], 1, "x") for i in range(200)], 16, tmp_path)


def test_numbers_beyond_64_bits(spark, tmp_path):
    rows = vectors(90, 16, 7, size=1e3)
    rows[5] = (rows[5][0], [float(np.float32(x * 1e35)) for x in rows[5][1]], 4, "x")
    rows[7] = (rows[7][0], [float(np.float32(x * 1e14)) for x in rows[7][1]], 1, "x")
    check(spark, rows, 16, tmp_path)


def test_an_empty_table_has_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert C.op11_vectorcodes(spark, str(tmp_path)).collect() == []


def test_label_sums_of_many_labels_are_joined(spark):
    rows = [(i, None if i < 400 else i // 3, "00", i, False) for i in range(1000)]
    coded = spark.createDataFrame(rows, "vec_id bigint, label bigint, code string, error bigint, wide boolean")
    few, many = C.with_label_error(coded), C.with_label_error(coded, max_labels=10)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()}
    assert many.count() == 1000 and {r.label_error for r in many.where("label is null").collect()} == {sum(range(400))}


def test_the_radius_holds_every_nearest_entry():
    r = np.random.default_rng(4)
    for spread in (1, 3, 200):
        e, x = r.integers(-spread, spread + 1, (40, 4)), r.integers(-spread, spread + 1, (500, 4))
        d = ((x[:, None] - e[None]) ** 2).sum(2)
        entry, best = C.Search(e).nearest(np.ascontiguousarray(x.T), r.integers(0, 40, 500))
        assert (entry == d.argmin(1)).all() and (best == d.min(1)).all()


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    expected = {tuple(r) for r in duckdb.sql(C.OP11_SQL).fetchall()}
    got = {tuple(r) for r in C.op11_vectorcodes(spark, sf).collect()}
    assert got == expected and len(got) > 0
