"""Vector collections and listings against plain lists."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmark.sources.collection import Collection, listing, take_in


def test_a_collection_is_filled_changed_and_searched(spark, tmp_path):
    r = random.Random(2)
    ddl = "id bigint, vector array<float>, tag string"
    held = {i: ([float(r.randint(-9, 9)) for _ in range(4)], r.choice("ab")) for i in range(80)}
    frame = lambda ids: spark.createDataFrame([(i, *held[i]) for i in ids], ddl)
    c = Collection(spark, f"file://{tmp_path}/c", 4, "tag string").ensure().ensure()
    assert c.search(frame([1]).select("id", "vector"), 3).collect() == []
    c.insert(frame(range(50)))
    for i in range(40, 50):
        held[i] = ([1.0, 0.0, float(i), 0.0], "b")
    c.insert(frame(range(40, 80)))
    c.insert(spark.createDataFrame([(900, None, "a")], ddl))
    c.delete(F.col("id") % 7 == 0)
    left = {i: v for i, v in held.items() if i % 7}
    assert c.rows().count() == len(left) + 1
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    for where, keep in ((None, "ab"), (F.col("tag") == "b", "b")):
        got = c.search(frame([1, 2, 45]).select("id", "vector"), 6, where).collect()
        for q in (1, 2, 45):
            want = sorted((-round(cosine(held[q][0], v), 9), i) for i, (v, t) in left.items() if t in keep and any(v))[:6]
            assert [(-round(x.score, 9), x.id) for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == q] == want
    with pytest.raises(ValueError):
        c.insert(spark.createDataFrame([(1, [1.0], "a")], ddl))
    with pytest.raises(ValueError):
        Collection(spark, f"file://{tmp_path}/c", 5, "tag string").ensure()
    assert c.rows().count() == len(left) + 1


def test_pages_of_a_listing(spark):
    rows = [("a", i, i % 3) for i in range(25)] + [("b", 1, 1)]
    df = spark.createDataFrame(rows, "g string, i int, k int")
    want = sorted(((-k, i) for g, i, k in rows if g == "a"))
    seen = []
    for page in (1, 2, 3, 4):
        got = listing(df, ["g"], [F.desc("k"), F.col("i")], page, 10).where("g = 'a'").orderBy("place").collect()
        assert all(x.total == 25 for x in got)
        seen += [(-x.k, x.i) for x in got]
    assert seen == want
    state, chunks = take_in(spark.createDataFrame([("d", 1, "a\n\nb"), ("d", 2, ""), ("e", 3, None)], "ds string, id int, t string"), "ds", "id", "t")
    assert {(x.dataset, x.document_id, x.state, x.chunks) for x in state.collect()} == {("d", 1, "parsed", 1), ("d", 2, "empty", 0), ("e", 3, "empty", 0)}
    assert [(x.dataset, x.content) for x in chunks.collect()] == [("d", "a\n\nb")]
