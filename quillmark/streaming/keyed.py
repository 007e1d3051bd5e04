"""Keyed stateful streams: sessions, and requests matched with their answers.

Sessions and the interval join are Spark's own stateful operators under watermarks.  ``correlated`` keeps its own state:
it holds the requests and answers of a share of the keys until the watermark says that no earlier answer can come, then
a timer settles the requests that are due, by their first answers in time or as timed out.  So the order of rows within
what the watermark allows doesn't matter.  The state holds what came within the timeout and the watermark's delay, no more.

``replay`` lays a table out as files in order of time, for streams that read a file a trigger; a last file of one row
far in the future lets the watermark pass everything.  Rows without a key or a time never enter a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The time of the row that ends a replay.
END = "2200-01-01 00:00:00"
#: Rows of a chunk of kept state.
CHUNK = 10_000


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """(keys, start, end, n): runs of rows less than ``gap`` apart."""
    w = F.session_window(ts, gap).alias("w")
    made = stream.withWatermark(ts, late).groupBy(*keys, w).agg(F.count("*").alias("n"))
    return made.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def matched(requests: DataFrame, answers: DataFrame, key: str, sent: str, got: str, within: str, late: str) -> DataFrame:
    """Requests with every answer of their key within so long, or with none once the watermark has passed that.
    Both sides' state goes when the other side's watermark has passed it."""
    r = requests.withWatermark(sent, late).alias("r")
    a = answers.withColumnRenamed(key, "_key").withWatermark(got, late).alias("a")
    span = F.expr(f"interval {within}")
    return r.join(a, (F.col(key) == F.col("_key")) & (F.col(got) >= F.col(sent)) & (F.col(got) <= F.col(sent) + span), "left_outer").drop("_key")


def _correlator(timeout: int) -> StatefulProcessor:
    """The class is made here so that it travels by value: the state's Python on the driver may not know this package."""

    class Correlator(StatefulProcessor):
        """Input: share, key, kind ('request' or 'answer'), id, ms (time in milliseconds). Output: key, id, ms, answered.

        A share's rows are kept in chunks as they came; one timer, for its oldest row, settles all that is due by then."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.requests = handle.getListState("requests", "keys array<bigint>, ids array<bigint>, ms array<bigint>")
            self.answers = handle.getListState("answers", "keys array<bigint>, ms array<bigint>")

        def due(self, first: int | None) -> None:
            """The share's timer: for the row of this time, if that is before the one that is set."""
            timers = list(self.handle.listTimers())
            if first is not None and (not timers or first + timeout < min(timers)):
                for x in timers:
                    self.handle.deleteTimer(x)
                self.handle.registerTimer(first + timeout)

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
            first = None
            for part in rows:
                asked = part["kind"] == "request"
                for state, own, names in ((self.requests, part[asked], ["key", "id", "ms"]), (self.answers, part[~asked], ["key", "ms"])):
                    if len(own):
                        state.appendValue(tuple(own[c].tolist() for c in names))
                if len(part):
                    first = int(part["ms"].min()) if first is None else min(first, int(part["ms"].min()))
            self.due(first)
            return iter([])

        def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs()

            def held(state, names: list[str]) -> pd.DataFrame:
                columns = list(zip(*state.get())) if state.exists() else [[]] * len(names)
                return pd.DataFrame({n: np.concatenate([np.asarray(c, np.int64) for c in chunks] or [np.empty(0, np.int64)]) for n, chunks in zip(names, columns)})

            def kept(state, left: pd.DataFrame) -> None:
                chunks = [left.iloc[i : i + CHUNK] for i in range(0, len(left), CHUNK)]
                state.put([tuple(c[n].tolist() for n in left.columns) for c in chunks]) if chunks else state.clear()

            requests, answers = held(self.requests, ["key", "id", "ms"]), held(self.answers, ["key", "ms"])
            over = requests["ms"] + timeout <= now
            came = answers.assign(answered=answers["ms"].astype("Int64")).sort_values("ms")
            out = pd.merge_asof(requests[over].sort_values("ms"), came, on="ms", by="key", direction="forward", tolerance=timeout)
            left = requests[~over]
            # what is older than any request that waits or may still come can answer none
            oldest = min(now, int(left["ms"].min())) if len(left) else now
            answers = answers[answers["ms"] >= oldest]
            kept(self.requests, left)
            kept(self.answers, answers)
            rest = [int(x["ms"].min()) for x in (left, answers) if len(x)]
            self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
            self.due(min(rest) if rest else None)
            yield out[["key", "id", "ms", "answered"]]

        def close(self) -> None:
            pass

    return Correlator()


def correlated(stream: DataFrame, key: str, kind: Column, id_col: str, ts: str, timeout_ms: int, late: str, shares: int = 64) -> DataFrame:
    """key, id, ms, answered (null: timed out) of every request, when it is settled; needs the RocksDB state store.

    Keys are dealt into ``shares``, each with its state and timer, as calls cost more than rows. A share's open rows are
    in a task's memory together; a stream keeps its number of shares when it goes on."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own = F.col(key).cast("bigint")
    share = F.pmod(F.xxhash64(own), F.lit(shares)).cast("int").alias("share")
    rows = stream.withWatermark(ts, late).select(share, own.alias("key"), kind.alias("kind"), F.col(id_col).cast("bigint").alias("id"), F.unix_millis(F.col(ts)).alias("ms"), ts).where("kind is not null and key is not null")
    return rows.groupBy("share").transformWithStateInPandas(_correlator(timeout_ms), "key bigint, id bigint, ms bigint, answered bigint", "append", "EventTime")


def replay(df: DataFrame, ts: str, cuts: list[str], folder: str, end: dict, files: int = 1) -> int:
    """Writes the rows with a time, cut at these times, so many files a cut, one cut after the other, and a last file of the
    row ``end`` at ``END``."""
    spark, kind = df.sparkSession, df.schema
    rows = df.where(F.col(ts).isNotNull())
    bounds = [None, *cuts, None]
    for a, b in zip(bounds, bounds[1:]):
        part = rows if a is None else rows.where(F.col(ts) >= F.lit(a).cast("timestamp"))
        part = part if b is None else part.where(F.col(ts) < F.lit(b).cast("timestamp"))
        part.repartition(files).write.mode("append").parquet(folder)
    last = spark.range(1).select(*(F.lit(END if f.name == ts else end.get(f.name)).cast(f.dataType).alias(f.name) for f in kind.fields))
    last.write.mode("append").parquet(folder)
    return len(cuts) + 2


def run(stream: DataFrame, out: str, triggers: int | None = None) -> int:
    """Appends a stream's rows to ``out``, what is there now; with ``triggers`` it stops after about so many, as a job that is
    lost does.  The next call goes on from the checkpoint.  Gives the number of batches that ran."""
    w = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
    if triggers is None:
        q = w.trigger(availableNow=True).start()
        q.awaitTermination()
        return len(q.recentProgress)
    q = w.start()
    while q.isActive and len(q.recentProgress) < triggers:
        q.awaitTermination(0.2)
    q.stop()
    return len(q.recentProgress)


def files(spark: SparkSession, folder: str, schema, each: int = 1) -> DataFrame:
    """``each`` files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(folder)
