"""Push messages: subscriptions as a state of a log, and the rows of each kind of envelope, for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.streaming.bars import project_push

#: Records of the flat envelopes by type.
RECORDS = {
    "QUOTE": "code string, last_price double, volume bigint, turnover double, high_price double, low_price double",
    "TICKER": "code string, time string, price double, volume bigint, turnover double, ticker_direction string",
    "RT_DATA": "code string, time string, cur_price double, avg_price double, volume bigint",
    "KLINE": "code string, time_key string, open double, close double, high double, low double, volume bigint",
}


def rows_of(messages: DataFrame, kind: str) -> DataFrame:
    """Rows of one type of flat envelopes; ``value`` holds a message."""
    return project_push(messages, RECORDS[kind]).where(F.col("type") == kind).drop("type")


def _sides(messages: DataFrame, kind: str, bid: str, ask: str, entry: str) -> DataFrame:
    m = F.from_json("value", f"struct<type:string,code:string,data:struct<{bid}:array<{entry}>,{ask}:array<{entry}>>>")
    # a message is read once: a filter on its type would read it again
    read = messages.select(m.alias("m"))
    m = F.col("m")
    sides = F.array(*(F.struct(F.lit(side).alias("side"), m["data"][name].alias("items")) for side, name in (("bid", bid), ("ask", ask))))
    rows = read.select(m["code"].alias("code"), F.inline(F.when(m["type"] == kind, sides)))
    return rows.select("code", "side", F.posexplode("items").alias("level", "item"))


def order_book(messages: DataFrame) -> DataFrame:
    """code, side, level, price, volume, orders of order books."""
    entry = "struct<price:double,volume:bigint,orders:int>"
    return _sides(messages, "ORDER_BOOK", "Bid", "Ask", entry).select("code", "side", "level", "item.*")


def broker_queue(messages: DataFrame) -> DataFrame:
    """code, side, level, broker_id, broker_name of broker queues."""
    entry = "struct<broker_id:bigint,broker_name:string>"
    return _sides(messages, "BROKER", "bid_broker_list", "ask_broker_list", entry).select("code", "side", "level", "item.*")


def option_events(messages: DataFrame) -> DataFrame:
    """owner_code, option_code, message."""
    m = F.from_json("value", "struct<type:string,data:struct<owner_code:string,option_code:string,message:string>>")
    return messages.where(m["type"] == "OPTION_EVENT").select(m["data"].alias("d")).select("d.*")


def subscriptions(log: DataFrame) -> DataFrame:
    """What is subscribed after a log of actions: code, subtype, first_push, extended.

    Log rows: n, action (subscribe, unsubscribe, unsubscribe_all), codes, subtypes (arrays), first_push, extended."""
    last_all = log.where("action = 'unsubscribe_all'").agg(F.max("n").alias("_all"))
    acts = log.where("action <> 'unsubscribe_all'").withColumn("code", F.explode("codes")).withColumn("subtype", F.explode("subtypes"))
    w = Window.partitionBy("code", "subtype").orderBy(F.col("n").desc())
    now = acts.withColumn("_k", F.row_number().over(w)).where("_k = 1 and action = 'subscribe'")
    now = now.join(F.broadcast(last_all), F.lit(True)).where(F.col("n") > F.coalesce("_all", F.lit(-1)))  # one row
    return now.select("code", "subtype", "first_push", "extended")


def consume(stream: DataFrame, out: str, seconds: float | None = None, name: str | None = None) -> bool:
    """Append a stream's rows to ``out`` for so many seconds, or till what is there has been read; whether it
    ended by itself."""
    w = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
    w = w.queryName(name) if name else w
    q = (w.trigger(availableNow=True) if seconds is None else w.trigger(processingTime="1 second")).start()
    if seconds is None:
        q.awaitTermination()
        return True
    ended = q.awaitTermination(seconds)
    q.stop()
    return bool(ended)
