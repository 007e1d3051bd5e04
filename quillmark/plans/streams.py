"""Registered queries of paged histories and keyed streams, over replays of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.plans.queries import _t, query
from quillmark.sources.paged import read_pages, write_pages
from quillmark.sources.shared import shared_folder
from quillmark.streaming import keyed

_EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
_CUTS = ["2024-01-07", "2024-01-13", "2024-01-19", "2024-01-25"]


def _paged(spark, d):
    folder = f"{shared_folder(spark)}/pages"
    e = _t(spark, d, "events").selectExpr("CAST(event_id AS bigint) event_id", "CAST(ts AS timestamp_ntz) ts", "CAST(user_id AS bigint) user_id", "event_type", "CAST(value AS double) value")
    write_pages(e, folder, "event_type", "ts", "event_id", 500)
    return read_pages(spark, folder, _EVENT, "event_type", "ts")


@query("s39_paged_source", "SELECT event_id, ts, user_id, event_type, round(value, 6) AS value FROM events")
def s39(spark, d):
    """Everything, by pages that name the next one's key."""
    return _paged(spark, d).withColumn("value", F.round("value", 6))


@query("s40_paged_filtered", "SELECT event_id, ts FROM events WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 12:00:00'")
def s40(spark, d):
    """Two codes in a range of times: filters that the source takes over."""
    return _paged(spark, d).where("event_type IN ('view', 'click') AND ts >= timestamp_ntz'2024-01-05' AND ts < timestamp_ntz'2024-01-20 12:00:00'").select("event_id", "ts")


def _replayed(spark, d):
    """(a stream of files in order of time, a fresh folder for results, the number of rows)."""
    e = _t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    folder, rows = shared_folder(spark), e.count()
    each = 1 + rows // (len(_CUTS) + 1) // 500_000
    keyed.replay(e, "ts", _CUTS, f"{folder}/in", {"event_id": -1, "user_id": -1, "event_type": "end"}, each)
    return lambda: keyed.files(spark, f"{folder}/in", e.schema, each), folder, rows


@query(
    "r12_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def r12(spark, d):
    """Sessions of users, from a stream of files that stops and goes on from its checkpoint."""
    events, out, _ = _replayed(spark, d)
    made = lambda: keyed.sessions(events(), ["user_id"], "ts", "6 hours", "10 minutes")
    keyed.run(made(), out, triggers=2)
    keyed.run(made(), out)
    rows = spark.read.schema(made().schema).parquet(f"{out}/rows").where("user_id >= 0")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(
    "r13_correlated",
    """SELECT q.event_id AS id, q.user_id, min(a.ts) IS NULL AS timed_out, min(epoch_us(a.ts) // 1000) AS answered FROM events q
LEFT JOIN events a ON a.user_id = q.user_id AND a.event_type = 'click' AND epoch_us(a.ts) // 1000 BETWEEN epoch_us(q.ts) // 1000 AND epoch_us(q.ts) // 1000 + 7200000 WHERE q.event_type = 'view' GROUP BY ALL""",
)
def r13(spark, d):
    """Each request's first answer within two hours, or that it timed out, by keyed state and timers across a restart."""
    events, out, n = _replayed(spark, d)
    shares = max(64, n // 20_000)
    kind = F.when(F.col("event_type") == "view", "request").when(F.col("event_type").isin("click", "end"), "answer")
    made = lambda: keyed.correlated(events(), "user_id", kind, "event_id", "ts", 7_200_000, "10 minutes", shares)
    keyed.run(made(), out, triggers=2)
    keyed.run(made(), out)
    rows = spark.read.schema("key bigint, id bigint, ms bigint, answered bigint").parquet(f"{out}/rows")
    return rows.select("id", F.col("key").alias("user_id"), F.col("answered").isNull().alias("timed_out"), "answered")


@query(
    "r14_matched",
    """SELECT q.event_id AS id, q.user_id, a.ts AS got FROM events q LEFT JOIN events a ON a.user_id = q.user_id AND a.event_type = 'purchase' AND a.ts >= q.ts AND a.ts <= q.ts + INTERVAL 3 HOUR WHERE q.event_type = 'click'""",
)
def r14(spark, d):
    """Requests with all answers within three hours, as a join of two streams."""
    events, out, _ = _replayed(spark, d)

    def made():
        e = lambda kind: events().where(F.col("event_type").isin(kind, "end"))
        sent = e("click").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("sent"))
        return keyed.matched(sent, e("purchase").select("user_id", F.col("ts").alias("got")), "user_id", "sent", "got", "3 hours", "10 minutes")

    keyed.run(made(), out, triggers=2)
    keyed.run(made(), out)
    rows = spark.read.schema(made().schema).parquet(f"{out}/rows").where("user_id >= 0")
    return rows.select("id", "user_id", F.col("got").cast("timestamp_ntz").alias("got"))
