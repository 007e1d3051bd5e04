"""Ids that are no keys: repeated doc_ids with other texts, and items without an id."""

from __future__ import annotations

import random

import pytest

from quillmark.llm import decontaminate, neardup


def texts(seed, n=6):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(500)}" for _ in range(60)) for _ in range(n)]


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain(rows):
    """Component by row number, and the smallest id of each."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                n = len(sets[a] & sets[b])
                if rows[a][0] is not None and rows[b][0] is not None and n and 100 * n >= 75 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_each_row_is_judged_by_its_text(spark, seed):
    r = random.Random(seed)
    base = texts(seed)
    rows = [(1, base[0]), (5, base[0] + " more"), (5, base[1]), (5, base[1]), (7, base[1] + " again"), (None, base[0]), (2, ""), (2, base[2]), (3, None), (9, base[2]), (9, base[2] + " x"), (3, base[3])]
    rows += [(r.randrange(12), r.choice(base) + r.choice(["", " tail", " end of it"])) for _ in range(12)]
    label = plain(rows)
    name = {}
    for k, (i, _) in zip(label, rows):
        if i is not None:
            name[k] = min(name.get(k, i), i)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS kept").repartition(3)
    got = sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(df).collect()), key=str)
    want = sorted(((i, len(shingles(t)), None if i is None else name[k], i is None or i == name[k]) for k, (i, t) in zip(label, rows)), key=str)
    assert got == want
    kept = [(x.doc_id, x.text) for x in neardup.keep_one(df).collect()]
    groups = {}
    for k, row in zip(label, rows):
        groups.setdefault(k, []).append(row)
    assert sorted(i for i, _ in kept if i is not None) == sorted(min(i for i, _ in g) for k, g in groups.items() if g[0][0] is not None)
    assert kept.count((None, base[0])) == 1 and set(kept) <= set(rows)


def test_a_near_copy_goes_and_the_other_text_of_its_id_stays(spark):
    x, y = texts(4)[:2]
    kept = neardup.keep_one(spark.createDataFrame([(1, x), (5, x + " w"), (5, y)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, x), (5, y)]


def test_rows_equal_in_id_and_text_come_down_to_one(spark):
    x, y = texts(5)[:2]
    df = spark.createDataFrame([(1, x, "a"), (1, x, "b"), (2, y, "c"), (None, None, "d"), (None, None, "d"), (8, "", "e"), (8, "", "e")], "doc_id bigint, text string, lang string")
    got = sorted((r.doc_id or 0, r.lang) for r in neardup.keep_one(df).collect())
    assert [g for g in got if g[0] != 1] == [(0, "d"), (0, "d"), (2, "c"), (8, "e"), (8, "e")] and sum(g[0] == 1 for g in got) == 1


@pytest.mark.parametrize("large", [False, True])
def test_items_without_an_id_are_matched(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    a, b, c = texts(6)[:3]
    items = spark.createDataFrame([(None, a), (None, b), (4, b), (None, None), (7, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, a + " and so on"), (2, b), (3, c), (4, None)], "doc_id bigint, text string")
    got = {r.doc_id: (r.contaminated, r.n_items, r.item_id) for r in decontaminate.scan(docs, items).collect()}
    assert got == {1: (True, 1, None), 2: (True, 2, 4), 3: (False, 0, None), 4: (False, 0, None)}
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, items).collect()) == [3, 4]


@pytest.mark.parametrize("size", [1000, 40, 7])
def test_units_of_a_hot_key_s_common_label_meet_the_others_only(spark, size):
    """The pairs are those of comparing every two units, whatever the blocks; units of one label give none."""
    r = random.Random(size)
    labels = [0] * 60 + [r.randint(1, 4) for _ in range(15)]
    rows = []
    for key, mixed in ((1, False), (2, True)):
        for u, lab in enumerate(labels):
            lo, hi = (lab, lab) if not mixed or u % 5 else (min(lab, 2), max(lab, 2))
            rows.append((key, key * 1000 + u, lo, hi, 90 + u % 20, 100 + u % 20, None))
    met = spark.createDataFrame(rows, "key bigint, unit bigint, lo bigint, hi bigint, small bigint, large bigint, sig binary")
    want = set()
    for a in rows:
        for b in rows:
            one = a[2] == b[3] and a[3] == b[2]
            if a[0] == b[0] and a[1] <= b[1] and not one and 75 * a[4] <= 100 * b[5] and 75 * b[4] <= 100 * a[5]:
                want.add((a[1], b[1]))
    got = [(x.a, x.b) for x in neardup._unit_pairs(met, size).collect()]
    assert len(got) == len(set(got)) and set(got) == want
