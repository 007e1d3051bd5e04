"""Market data: screeners from JSON configs, ranks, enrichment, nearest contracts, bars and streaks."""

from __future__ import annotations

import ast
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def screen(df: DataFrame, config: str | dict) -> DataFrame:
    """Filters [{field, min, max, in, contains}], sort [{field, desc}], offset and limit, from JSON."""
    c = json.loads(config) if isinstance(config, str) else config
    for f in c.get("filters", []):
        x = F.col(f["field"])
        if f.get("min") is not None:
            df = df.where(x >= f["min"])
        if f.get("max") is not None:
            df = df.where(x <= f["max"])
        if f.get("in"):
            df = df.where(x.isin(f["in"]))
        if f.get("contains"):
            df = df.where(x.contains(f["contains"]))
    if c.get("sort"):
        df = df.orderBy(*(F.col(s["field"]).desc() if s.get("desc") else F.col(s["field"]) for s in c["sort"]))
    if c.get("offset"):
        df = df.offset(c["offset"])
    return df.limit(c["limit"]) if c.get("limit") else df


def enrich(df: DataFrame, snapshot: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Snapshot values over the row's own, where there are any; the planner picks the join."""
    s = snapshot.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    out = df.join(s, key, "left")
    own = set(df.columns)
    return out.withColumns({f: F.coalesce(f"_{f}", F.col(f)) if f in own else F.col(f"_{f}") for f in fields}).drop(*(f"_{f}" for f in fields))


def nearest_contract(df: DataFrame, keys: list[str], strike: str, target: Column, id_col: str, k: int = 5) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("distance", id_col)
    return df.withColumn("distance", F.abs(F.col(strike) - target)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def bars(ticks: DataFrame, keys: list[str], ts: str, value: str, tie: str, width: str = "60 minutes") -> DataFrame:
    """Open, high, low, close, volume of each window; ticks of one time go by ``tie``."""
    o = F.struct(ts, tie)
    return (
        ticks.groupBy(*keys, F.window(ts, width).alias("w"))
        .agg(F.min_by(value, o).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, o).alias("close"), F.count("*").alias("n"))
        .select(*keys, F.col("w.start").alias("bar"), "open", "high", "low", "close", "n")
    )


def streaks(events: DataFrame, key: str, order: list[str], sign: str, least: int = 3) -> DataFrame:
    """Runs of ``least`` equal signs or more in a key's sequence: key, sign, start, n."""
    w = Window.partitionBy(key).orderBy(*order)
    v = Window.partitionBy(key, sign).orderBy(*order)
    runs = events.withColumn("island", F.row_number().over(w) - F.row_number().over(v))
    return runs.groupBy(key, sign, "island").agg(F.min(order[0]).alias("start"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def adjust(prices: DataFrame, factors: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Price times the product of the factors that take effect later (forward adjustment)."""
    rows = prices.select(F.col(key).alias("_id"), F.col(time).alias("_t"), F.lit(None).cast("double").alias("_f"), F.struct(*prices.columns).alias("_row"))
    marks = factors.select(F.col(key).alias("_id"), F.col(time).alias("_t"), F.log("factor").alias("_f"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    later = Window.partitionBy("_id").orderBy(F.col("_t").desc(), F.col("_f").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.unionByName(marks).withColumn("_m", F.exp(F.coalesce(F.sum("_f").over(later), F.lit(0.0)))).where("_row is not null").select("_row.*", "_m")
    return seen.withColumn(value, F.col(value) * F.col("_m")).drop("_m")


def convert(df: DataFrame, rates: DataFrame, amount: str, source: str, target: str, default: float = 1.0) -> DataFrame:
    """``converted`` by the direct rate, the inverse of the reverse one, or ``default``."""
    direct = rates.select(F.col("base").alias(source), F.col("quote").alias(target), F.col("rate").alias("_d"))
    back = rates.select(F.col("quote").alias(source), F.col("base").alias(target), (1 / F.col("rate")).alias("_i"))
    same = F.when(F.col(source) == F.col(target), F.lit(1.0))
    out = df.join(direct, [source, target], "left").join(back, [source, target], "left")
    return out.withColumn("converted", F.col(amount) * F.coalesce(same, F.col("_d"), F.col("_i"), F.lit(default))).drop("_d", "_i")


def formula(text: str, names: set[str]) -> Column:
    """A Column of + - * / and unary signs over known names and numbers; division by zero and missing
    values give null, anything else a ValueError."""

    def walk(n: ast.AST) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float) and not isinstance(n.value, bool):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name) and n.id in names:
            return F.col(n.id)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.UAdd | ast.USub):
            return walk(n.operand) if isinstance(n.op, ast.UAdd) else -walk(n.operand)
        if isinstance(n, ast.BinOp):
            a, b = walk(n.left), walk(n.right)
            for kind, f in ((ast.Add, lambda: a + b), (ast.Sub, lambda: a - b), (ast.Mult, lambda: a * b), (ast.Div, lambda: F.try_divide(a, b))):
                if isinstance(n.op, kind):
                    return f()
        raise ValueError(f"not allowed in a formula: {ast.dump(n)}")

    return walk(ast.parse(text, mode="eval").body)


def scan(df: DataFrame, code: str, codes: list[str] | None, fields: list[str]) -> DataFrame:
    """Chosen fields of some (or all) securities."""
    return (df.where(F.col(code).isin(codes)) if codes else df).select(code, *fields)


def ranked(df: DataFrame, by: str, id_col: str, n: int, offset: int = 0, ascending: bool = False) -> DataFrame:
    """A page of a ranking, smallest id first of equals."""
    out = df.orderBy(F.asc(by) if ascending else F.desc(by), id_col)
    return (out.offset(offset) if offset else out).limit(n)


def between_times(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows of a closed time range; the bounds are literals, so they reach the scan."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def members(edges: DataFrame, parents: DataFrame, children: DataFrame, parent: str, child: str) -> DataFrame:
    """Edges with the columns of both of their ends."""
    return edges.join(children, child).join(parents, parent)


def correlate(requests: DataFrame, results: DataFrame, request_id: str, sent: str, got: str, seconds: int = 60) -> DataFrame:
    """Each request with its first result inside the time allowed; ``timed_out`` where none came.

    Requests and results of an id are put in order once, and each request sees the next result, so equal
    requests stay apart and an id's rows are never multiplied."""
    asked = requests.select(F.col(request_id).alias("_id"), F.col(sent).alias("_at"), F.lit(None).cast(results.schema[got].dataType).alias("_got"), F.struct(*requests.columns).alias("_row"))
    came = results.select(F.col(request_id).alias("_id"), F.col(got).alias("_at"), F.col(got).alias("_got"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    ahead = Window.partitionBy("_id").orderBy("_at", F.col("_got").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    seen = asked.unionByName(came).withColumn("_next", F.first("_got", ignorenulls=True).over(ahead)).where("_row is not null").select("_row.*", "_next")
    answered = F.when(F.col("_next") <= F.col(sent) + F.make_dt_interval(secs=F.lit(seconds)), F.col("_next"))
    return seen.withColumn("answered", answered).drop("_next").withColumn("timed_out", F.col("answered").isNull())
