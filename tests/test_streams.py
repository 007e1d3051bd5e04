"""Paged histories and keyed streams: retries, pushed filters, order, late rows, restarts and bounded state."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmark.sources import paged
from quillmark.streaming import keyed

DDL = "id bigint, ts timestamp_ntz, code string, v double"
DAY = datetime(2024, 1, 1)


def history(n=230, seed=1):
    r = random.Random(seed)
    return [(i, DAY + timedelta(minutes=r.randrange(5000), microseconds=r.randrange(10**6)), r.choice(["a", "b c", "ü/x", "a"]), r.choice([None, r.random()])) for i in range(n)]


@pytest.fixture
def pages(spark, tmp_path):
    rows = history()
    df = spark.createDataFrame(rows, DDL)
    paged.write_pages(df, f"file://{tmp_path}/p", "code", "ts", "id", 20)
    return f"file://{tmp_path}/p", rows


def test_pages_come_back_whole_and_short_ones_last(spark, pages):
    folder, rows = pages
    got = paged.read_pages(spark, folder, DDL, "code", "ts", span=3)
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows, key=lambda r: r[0])
    counts = paged.Folder(folder).pages()
    assert sum(counts.values()) == sum(-(-sum(r[2] == c for r in rows) // 20) for c in counts) and got.rdd.getNumPartitions() == sum(-(-n // 3) for n in counts.values())
    for c, n in counts.items():
        sizes = [len(paged.Folder(folder).page(c, k)["rows"]) for k in range(n)]
        assert sizes[:-1] == [20] * (n - 1) and 0 < sizes[-1] <= 20
        assert [paged.Folder(folder).page(c, k).get("next") for k in range(n)] == [*range(1, n), None]


def test_filters_reach_the_source(spark, pages):
    folder, rows = pages
    got = paged.read_pages(spark, folder, DDL, "code", "ts", span=1)
    low, high = DAY + timedelta(minutes=1000), DAY + timedelta(minutes=2500)
    some = got.where((F.col("code") == "ü/x") & (F.col("ts") > F.lit(low)) & (F.col("ts") <= F.lit(high)) & (F.col("v") > 0.5))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in some.collect()) == sorted(i for i, t, c, v in rows if c == "ü/x" and low < t <= high and v is not None and v > 0.5)
    assert "= ü/x" not in plan and "2024-01" not in plan and "> 0.5" in plan  # the source answers for code and time alone
    two = got.where(F.col("code").isin("a", "b c"))
    assert two.rdd.getNumPartitions() < got.rdd.getNumPartitions() and two.count() == sum(r[2] != "ü/x" for r in rows)
    assert got.where("code = 'none'").count() == 0 and got.count() == len(rows)  # nothing of a filter stays for the next query


def test_a_page_is_asked_for_again(spark, pages, monkeypatch):
    folder, rows = pages
    reader = paged.HistoryReader(spark.createDataFrame([], DDL).schema, {"path": folder, "retries": "2"})
    real, asked = paged.Folder.page, []

    def flaky(self, code, number):
        asked.append((code, number))
        if len(asked) % 3:
            raise OSError("busy")
        return real(self, code, number)

    monkeypatch.setattr(paged.Folder, "page", flaky)
    monkeypatch.setattr(paged, "PAUSE", 0.001)
    assert len(list(reader.read(paged.Chain("a", 0, 100)))) == sum(r[2] == "a" for r in rows)
    monkeypatch.setattr(paged.Folder, "page", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        list(reader.read(paged.Chain("a", 0, 1)))


def test_the_source_streams_what_came_since(spark, tmp_path):
    folder = f"file://{tmp_path}/p"
    rows = history(100)
    late = [(1000 + i, datetime(2025, 1, 1) + timedelta(minutes=i), "new", 1.0) for i in range(30)]
    paged.write_pages(spark.createDataFrame(rows, DDL), folder, "code", "ts", "id", 20)
    spark.dataSource.register(paged.PagedHistory)
    stream = lambda: spark.readStream.format("paged_history").options(path=folder, schema=DDL, code="code", time="ts").load()
    keyed.run(stream(), f"{tmp_path}/o")
    assert spark.read.parquet(f"{tmp_path}/o/rows").count() == 100
    paged.write_pages(spark.createDataFrame(late, DDL), folder, "code", "ts", "id", 20)
    keyed.run(stream(), f"{tmp_path}/o")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/o/rows").collect()) == sorted(r[0] for r in rows + late)


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    (tmp_path / "p").mkdir()
    assert paged.read_pages(spark, f"file://{tmp_path}/p", DDL, "code", "ts").collect() == []


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def at(minutes):
    return DAY + timedelta(minutes=minutes)


def kind():
    return F.when(F.col("event_type") == "view", "request").when(F.col("event_type").isin("click", "end"), "answer")


def correlate(spark, tmp_path, triggers=None):
    schema = spark.createDataFrame([], EVENTS).schema
    made = keyed.correlated(keyed.files(spark, f"{tmp_path}/in", schema), "user_id", kind(), "event_id", "ts", 60 * 60 * 1000, "30 minutes")
    return keyed.run(made, f"{tmp_path}/out", triggers)


def test_answers_across_batches_restarts_and_order(spark, tmp_path):
    """Requests and answers out of order within the watermark, a stop between them, and answers that come too late."""
    folder = f"{tmp_path}/in"
    put(spark, folder, [(1, at(10), 7, "view"), (2, at(20), 8, "view"), (20, at(5), 7, "click"), (9, at(12), None, "view")])
    put(spark, folder, [(21, at(25), 7, "click"), (3, at(0), 9, "view"), (22, at(15), 7, "click")])  # 15 after 25
    correlate(spark, tmp_path)
    put(spark, folder, [(23, at(81), 8, "click"), (4, at(90), 7, "view"), (24, at(60), 9, "click")])  # 81: one minute too late; 60: just in time
    put(spark, folder, [(5, at(500), 7, "view"), (25, at(560), 7, "click")])
    put(spark, folder, [(27, at(565), 3, "click")])  # what is too late is told by the batch before the last
    put(spark, folder, [(26, at(95), 7, "click")])  # later than the watermark lets in
    put(spark, folder, [(-1, datetime(2100, 1, 1), -1, "end")])
    correlate(spark, tmp_path)
    got = {r.id: r for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()}
    minutes = lambda r: None if r.answered is None else (datetime.utcfromtimestamp(r.answered / 1000) - DAY).total_seconds() / 60
    assert {i: minutes(r) for i, r in got.items()} == {1: 15, 2: None, 3: 60, 4: None, 5: 560}


def test_state_follows_what_is_open_and_not_the_stream(spark, tmp_path):
    folder = f"{tmp_path}/in"
    for day in range(6):
        rows = [(day * 1000 + i, at(day * 1440 + i), i % 5, "view" if i % 2 else "click") for i in range(200)]
        put(spark, folder, rows)
    put(spark, folder, [(-1, datetime(2100, 1, 1), -1, "end")])
    correlate(spark, tmp_path)
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == 600
    held = []
    for f in sorted(Path(f"{tmp_path}/out/state/commits").glob("[0-9]*"), key=lambda p: int(p.name)):
        held.append(json.loads(f.read_text().split("\n")[1]).get("nextBatchWatermarkMs", 0))
    assert held == sorted(held) and len(held) >= 7
    state = spark.read.format("statestore").option("path", f"{tmp_path}/out/state").option("stateVarName", "requests").load()
    assert state.count() == 0  # every request is settled


def test_correlation_keeps_a_timer_a_share_and_no_answers_without_requests(spark, tmp_path):
    folder, names = f"{tmp_path}/in", {"answers": 0, "requests": 0}
    for day in range(3):  # users 0 to 49 only answer; the others ask and are answered a minute later
        rows = [(day * 1000 + i, at(day * 1440 + i // 50), i % 100, "click" if i % 100 < 50 or i >= 100 else "view") for i in range(200)]
        put(spark, folder, rows)
    put(spark, folder, [(-1, datetime(2100, 1, 1), -1, "end")])
    schema = spark.createDataFrame([], EVENTS).schema
    made = keyed.correlated(keyed.files(spark, folder, schema), "user_id", kind(), "event_id", "ts", 60 * 60 * 1000, "30 minutes", shares=3)
    keyed.run(made, f"{tmp_path}/out", 1)
    timers = spark.read.format("statestore").option("path", f"{tmp_path}/out/state").option("readRegisteredTimers", True).load()
    assert 0 < timers.count() <= 3
    keyed.run(made, f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out/rows").collect()
    assert len(got) == 150 and all(r.answered - r.ms == 2 * 60_000 for r in got)
    for name in names:
        state = spark.read.format("statestore").option("path", f"{tmp_path}/out/state").option("stateVarName", name)
        names[name] = state.load().count()
    assert names == {"answers": 1, "requests": 0}  # the end's own


def test_sessions_over_batches_and_late_rows(spark, tmp_path):
    folder = f"{tmp_path}/in"
    put(spark, folder, [(1, at(0), 1, "x"), (2, at(20), 1, "x"), (3, at(5), 2, "x")])
    put(spark, folder, [(4, at(45), 1, "x"), (5, at(38), 1, "x")])  # one session over two batches, out of order
    put(spark, folder, [(6, at(300), 1, "x")])
    put(spark, folder, [(8, at(305), 1, "x")])
    put(spark, folder, [(7, at(6), 2, "x")])  # later than the watermark: dropped
    put(spark, folder, [(-1, datetime(2100, 1, 1), -1, "end")])
    schema = spark.createDataFrame([], EVENTS).schema
    made = lambda: keyed.sessions(keyed.files(spark, folder, schema), ["user_id"], "ts", "30 minutes", "10 minutes")
    keyed.run(made(), f"{tmp_path}/o", triggers=1)
    keyed.run(made(), f"{tmp_path}/o")
    got = sorted((r.user_id, r.n, (r.start - DAY).total_seconds() / 60, (r.end - DAY).total_seconds() / 60) for r in spark.read.parquet(f"{tmp_path}/o/rows").where("user_id > 0").collect())
    assert got == [(1, 2, 300, 335), (1, 4, 0, 75), (2, 1, 5, 35)]
