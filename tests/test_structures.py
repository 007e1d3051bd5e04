"""Trees, interval joins and sketches against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillmark.operators import ranges, statements, trees
from quillmark.plans import structures


def forest(seed):
    r = random.Random(seed)
    rows = [(i, r.randrange(max(0, i - 3), i) if i else None, r.choice([None, r.randint(1, 99)])) for i in range(200)]  # deep
    rows += [(1000 + i, 5, i) for i in range(150)]  # a hot parent
    rows += [(2000, 2001, 1), (2001, 2002, 2), (2002, 2000, 3), (2003, 2002, 4), (2004, 2004, 5)]  # cycles, and what hangs below
    rows += [(3000, 9999, 7), (3001, 3000, 8), (None, 3, 9), (3002, None, None), (3003, 3002, None)]  # orphans, a null id
    return rows + [(3001, 3000, 8)]  # a repeated row


def plain(rows):
    parent = {i: p for i, p, _ in rows if i is not None}
    out = {}
    for i in parent:
        path, seen = [i], {i}
        while (p := parent[path[-1]]) is not None and p in parent:
            if p in seen:
                path = None
                break
            path.append(p)
            seen.add(p)
        out[i] = path
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_climb_and_sums(spark, seed):
    rows = forest(seed)
    paths = plain(rows)
    df = spark.createDataFrame(rows, "id int, parent int, v bigint").repartition(3)
    got = {r.id: r for r in trees.climb(df, "id", "parent", "id").collect()}
    assert set(got) == set(paths)
    for i, p in paths.items():
        assert got[i].cyclic == (p is None)
        if p:
            assert (got[i].root, got[i].depth, got[i].path) == (p[-1], len(p) - 1, "/".join(map(str, reversed(p))))
        else:
            assert (got[i].root, got[i].depth, got[i].path) == (None, None, None)
    value = {i: v for i, _, v in rows if i is not None}
    total = defaultdict(list)
    for i, p in paths.items():
        for a in p or []:
            total[a] += [value[i]] if value[i] is not None else []
    sums = {r.id: r.total for r in trees.subtree_sums(df, "id", "parent", "v").collect()}
    assert sums == {i: sum(total[i]) if total[i] else None for i in paths}


def test_a_chain_of_thousands_and_an_empty_tree(spark):
    n = 3000
    chain = spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1).cast("bigint").alias("v"))
    assert trees.climb(chain, "id", "parent").agg(F.max("depth"), F.countDistinct("root")).first()[:] == (n - 1, 1)
    assert trees.subtree_sums(chain, "id", "parent", "v").where(F.col("total") != n - F.col("id")).count() == 0
    assert trees.climb(chain.limit(0), "id", "parent").collect() == [] == trees.subtree_sums(chain.limit(0), "id", "parent", "v").collect()


def written(monkeypatch):
    """The rows of every table that a climb writes."""
    rows, settle = [], trees.settle

    def counted(df):
        out = settle(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(trees, "settle", counted)
    return rows


def test_rounds_shrink_where_a_tree_branches(spark, monkeypatch):
    monkeypatch.setattr(trees, "FEW", 0, raising=False)
    n = 3000
    rows = [(i, (i - 1) // 3 if i else None, 1) for i in range(n)]
    tables = written(monkeypatch)
    got = {r.id: r for r in trees.climb(spark.createDataFrame(rows, "id int, parent int, v int"), "id", "parent", "id").collect()}
    assert {i: (got[i].root, got[i].depth, got[i].path) for i in got} == {i: (p[-1], len(p) - 1, "/".join(map(str, reversed(p)))) for i, p in plain(rows).items()}
    assert sum(tables) < 2.5 * n


def test_leaves_give_their_values_before_the_rounds(spark, monkeypatch):
    n = 3000
    rows = [(i, (i - 1) // 3 if i else None, i % 7) for i in range(n)]
    want = {i: v for i, _, v in rows}
    for i in range(n - 1, 0, -1):
        want[(i - 1) // 3] += want[i]
    tables = written(monkeypatch)
    got = trees.subtree_sums(spark.createDataFrame(rows, "id int, parent bigint, v bigint"), "id", "parent", "v")
    assert {r.id: r.total for r in got.collect()} == want and dict(got.dtypes) == {"id": "int", "total": "bigint"}
    assert sum(tables) < 4.5 * n


@pytest.mark.parametrize("name", ["id", "label"])
def test_those_who_wait_meet_common_keys_cycles_and_orphans(spark, monkeypatch, name):
    monkeypatch.setattr(trees, "FEW", 0, raising=False)
    monkeypatch.setattr(trees, "least", lambda size: 4, raising=False)
    rows = forest(3) + [(5000 + i, 2000 + i % 5, i) for i in range(400)] + [(6000 + i, 9990 + i % 7, i) for i in range(100)]
    rows += [(7000 + i, 150 + i % 9, i) for i in range(300)] + [(8000 + i, 7000 + i % 60, i) for i in range(900)]
    label = lambda i: None if i % 4 == 1 else f"n{i}"
    df = spark.createDataFrame([(*r, None if r[0] is None else label(r[0])) for r in rows], "id int, parent bigint, v bigint, label string").repartition(3)
    got = {r.id: r for r in trees.climb(df, "id", "parent", name).collect()}
    paths = plain(rows)
    assert set(got) == set(paths)
    for i, p in paths.items():
        names = [x for x in (str(j) if name == "id" else label(j) for j in reversed(p or [])) if x]
        want = (p[-1], len(p) - 1, "/".join(names) if names else None, False) if p else (None, None, None, True)
        assert (got[i].root, got[i].depth, got[i].path, got[i].cyclic) == want


def test_rounds_end_when_only_cycles_are_left(spark, monkeypatch):
    tables = written(monkeypatch)
    ring = [(i, (i + 1) % 500, 1) for i in range(500)] + [(1000, 3, 1), (1001, None, 1), (1002, 1001, 1)]
    got = trees.climb(spark.createDataFrame(ring, "id int, parent int, v int"), "id", "parent", "id").collect()
    assert sorted(r.id for r in got if not r.cyclic) == [1001, 1002] and len(got) == 503
    assert len(tables) <= 4


def test_fill_reaches_every_level(spark):
    depth = 9
    rows = [(f"n{i - 1}" if i else None, f"n{i}", "REV", "FY", 5.0 if i == depth else None) for i in range(depth + 1)]
    rows += [("n3", "x", "REV", "FY", 2.0), ("n4", "y", "COST", "FY", 9.0), ("x", "under", "REV", "FY", 70.0), (None, "lone", "REV", "FY", None)]
    got = {(r.code, r.metric): r.value for r in statements.fill_from_children(spark.createDataFrame(rows, "parent string, code string, metric string, period string, value double")).collect()}
    assert all(got[f"n{i}", "REV"] == (7.0 if i <= 3 else 5.0) for i in range(depth + 1))
    assert got["x", "REV"] == 2.0 and got["lone", "REV"] is None


@pytest.mark.parametrize("levels", [3, 12, 60])
def test_ladder_of_any_depth(spark, levels):
    r = random.Random(levels)
    rows = [(g, i, r.randint(1, levels) if r.random() < 0.3 else 1 + i % levels, f"r{i}") for g in range(3) for i in range(100)]
    want = {}
    for g, i, lv, _ in rows:
        above = [x for x in rows if x[0] == g and x[1] < i and x[2] <= lv - 1]
        want[g, i] = above[-1][3] if above and above[-1][2] == lv - 1 else None
    got = statements.ladder_parent(spark.createDataFrame(rows, "g int, i int, lv int, name string"), ["g"], "i", "lv", "name")
    assert {(x.g, x.i): x.parent for x in got.collect()} == want


def spans(seed):
    r = random.Random(seed)
    points = [(i, r.choice([None, r.randint(-500, 5000)]) if i % 9 == 0 else r.randint(0, 3000), r.choice("ab")) for i in range(300)] + [(1000 + i, 777, "a") for i in range(200)]
    made = [(i, a := r.randint(-500, 4000), a + r.choice([0, -3, 1, 5, 40]), r.choice("ab")) for i in range(150)]
    made += [(500, -(10**6), 10**6, "a"), (501, 0, 40_000, "b"), (502, None, 5, "a"), (503, 5, None, "a"), (504, 777, 778, "a")]
    return points, made


@pytest.mark.parametrize("how", ["inner", "left", "right"])
@pytest.mark.parametrize("on", [[], ["g"]])
def test_points_in_intervals(spark, how, on):
    points, made = spans(3)
    p = spark.createDataFrame(points, "p int, t int, g string")
    s = spark.createDataFrame(made, "s int, a int, b int, g string") if on else spark.createDataFrame([m[:3] for m in made], "s int, a int, b int")
    got = ranges.point_join(p, s, "t", "a", "b", on, how, full=50)
    pairs = [(x[0], m[0]) for x in points for m in made if None not in (x[1], m[1], m[2]) and m[1] <= x[1] < m[2] and (not on or x[2] == m[3])]
    if how == "left":
        pairs += [(x[0], None) for x in points if x[0] not in {q for q, _ in pairs}]
    if how == "right":
        pairs += [(None, m[0]) for m in made if m[0] not in {q for _, q in pairs}]
    assert sorted(((r.p, r.s) for r in got.collect()), key=str) == sorted(pairs, key=str)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("on", [[], ["g"]])
def test_points_are_counted_without_pairs(spark, on):
    points, made = spans(4)
    p = spark.createDataFrame([*points, (2000, 778, None), (2001, 5, None)], "p int, t int, g string")
    made = [*made, (505, 0, 9000, None), made[0]]
    s = spark.createDataFrame([m if on else m[:3] for m in made], "s int, a int, b int" + (", g string" if on else ""))
    holds = lambda x, m: None not in (x[1], m[1], m[2]) and m[1] <= x[1] < m[2] and (not on or (x[2] is not None and x[2] == m[3]))
    want = sorted((m[0], sum(holds(x, m) for x in [*points, (2000, 778, None), (2001, 5, None)])) for m in made)
    got = ranges.point_counts(p, s, "t", "a", "b", on)
    assert sorted((r.s, r.n) for r in got.collect()) == want
    assert sorted(r.n for r in ranges.point_counts(p.limit(0), s, "t", "a", "b", on).collect()) == [0] * len(made)


def test_counts_of_orders_make_no_pairs(spark, tmp_path):
    """20,000 events of one second and 2,000 orders that hold it are 40,000,000 pairs."""
    moment = 1704067200 + 7919 * 100 % 2592000
    spark.range(20_000).select(F.col("id").alias("event_id"), F.lit(1).alias("user_id"), F.timestamp_seconds(F.lit(moment)).alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(2000).select(F.lit(100).cast("bigint").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    made = []
    kept = ranges.settle
    ranges.settle = lambda df, *a: made.append(kept(df, *a)) or made[-1]
    try:
        got = structures.z34(spark, str(tmp_path)).collect()
    finally:
        ranges.settle = kept
    assert [tuple(r) for r in got] == [(100, 40_000_000)]
    assert all(m.count() < 10 for m in made)


def test_pairs_of_few_bytes_are_made_in_many_tasks(spark):
    p = spark.range(5000).select("id", (F.col("id") % 500).alias("t")).coalesce(1)
    s = spark.range(500).select(F.col("id").alias("s"), F.col("id").alias("a"), (F.col("id") + 5).alias("b")).coalesce(1)
    assert ranges.point_join(p, s, "t", "a", "b").rdd.getNumPartitions() >= 16


def test_intervals_of_one_bin_are_dealt_out(spark):
    p = spark.range(100).select("id", F.lit(10).alias("t"))
    s = spark.range(1000).select(F.col("id").alias("s"), F.lit(0).alias("a"), F.lit(20).alias("b"))
    placed, kept = [], ranges.dealt
    ranges.dealt = lambda df, *a: placed.append((df, a)) or kept(df, *a)
    try:
        got = ranges.point_join(p, s, "t", "a", "b", width=100, full=50)
    finally:
        ranges.dealt = kept
    assert got.count() == got.distinct().count() == 100 * 1000
    (points, keys), = placed
    assert points.select(*keys).distinct().count() == 2 * 20  # shares by lots


def test_points_of_one_bin_are_dealt_out(spark):
    p = spark.range(5000).select("id", F.lit(10).alias("t"))
    s = spark.createDataFrame([(1, 0, 20), (2, 15, 30)], "s int, a int, b int")
    got = ranges.point_join(p, s, "t", "a", "b", width=100, full=100)
    assert got.count() == 5000 and {r.s for r in got.select("s").distinct().collect()} == {1}


def test_overlaps(spark):
    _, made = spans(5)
    other = [(i, a, b) for i, a, b, _ in spans(6)[1]]
    x, y = spark.createDataFrame([m[:3] for m in made], "s int, a int, b int"), spark.createDataFrame(other, "u int, c int, d int")
    good = lambda m: None not in m and m[1] < m[2]
    want = sorted((m[0], o[0]) for m in made for o in other if good(m[:3]) and good(o) and m[1] < o[2] and o[1] < m[2])
    assert sorted((r.s, r.u) for r in ranges.overlap_join(x, y, ("a", "b"), ("c", "d")).collect()) == want


def test_sketches_merge_over_days(spark):
    events = spark.range(40_000).select((F.col("id") % 9000).alias("user"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 10 as int))").alias("ts"))
    kept = structures.sketches(events, "ts", "user")
    assert kept.count() == 10
    got = structures.distinct_in(kept, "2024-01-02", "2024-01-04").first()
    true = events.where("ts >= '2024-01-02' and ts < '2024-01-05'").select("user").distinct().count()
    assert abs(got.estimate - true) <= 0.02 * true and got.n == 12_000


def test_sketches_are_as_wide_as_their_bound_needs(spark, tmp_path):
    """Weeks of many events, events that come twice, and one without a number: counts are of distinct ones, estimates within 2 %."""
    rows = spark.range(120_000).select((F.col("id") * 7 + 1).alias("event_id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 30 as int))").alias("ts"))
    twice = rows.where("event_id % 3 = 0").unionByName(spark.createDataFrame([(None,)], "event_id bigint").select("event_id", F.expr("timestamp'2024-01-02'").alias("ts")))
    rows.unionByName(twice).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in structures.z38(spark, str(tmp_path)).collect())
    assert got == [(w, 4000 * n, True) for w, n in enumerate((7, 7, 7, 7, 2))]
    assert structures.sketch_bits(0.02) == 17
    with pytest.raises(ValueError):
        structures.sketch_bits(0.0001)
