"""Registered queries of the market and account endpoints: every endpoint of a shape is called, with parameters of its
own, over a benchmark table that stands for its records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import endpoints as E
from quillmark.plans.queries import _r, _t, query

#: Stand-in tables of the scan families: table, code, two fields.
_SCANS = {
    "quote": ("part", "p_partkey", "p_name", "p_retailprice"),
    "company": ("customer", "c_custkey", "c_name", "c_acctbal"),
    "option": ("orders", "o_orderkey", "o_orderpriority", "o_totalprice"),
    "research": ("nation", "n_nationkey", "n_name", "n_regionkey"),
    "account": ("supplier", "s_suppkey", "s_name", "s_acctbal"),
}


def _every(names: list[str], one: Callable[[int, str], DataFrame]) -> DataFrame:
    """Results of all endpoints, each with its name."""
    return reduce(DataFrame.unionByName, (one(k, n).withColumn("endpoint", F.lit(n)) for k, n in enumerate(names)))


def _sql(names: list[str], one: Callable[[int], str]) -> str:
    return " UNION ALL ".join(f"SELECT *, '{n}' AS endpoint FROM ({one(k)})" for k, n in enumerate(names))


def _codes(k: int) -> list[int]:
    """The k-th call's codes."""
    return [k + 1, k + 3, 2 * k + 6]


def _scan_query(family: str) -> None:
    table, code, a, b = _SCANS[family]

    def run(spark, d):
        df = _t(spark, d, table)
        found = E.scans(df, code, {n: _codes(k) for k, n in enumerate(E.SCAN[family])}, [a, b])
        return found.select(F.col(code).alias("code"), F.col(a).alias("a"), _r(F.col(b).cast("double")).alias("b"), "endpoint")

    sql = _sql(E.SCAN[family], lambda k: f"SELECT {code} AS code, {a} AS a, round(CAST({b} AS DOUBLE), 6) AS b FROM {table} WHERE {code} IN ({', '.join(map(str, _codes(k)))})")
    query(f"e_scan_{family}", sql)(run)


for _family in _SCANS:
    _scan_query(_family)


def _rank(k: int) -> dict:
    return {"by": ("p_retailprice", "p_size")[k % 2], "count": 3 + k, "offset": k % 3, "ascending": k % 4 == 3, "filters": [{"indicator_type": "p_size", "interval_min": k, "interval_max": 40 + k}]}


def _rank_sql(k: int) -> str:
    r = _rank(k)
    return f"SELECT p_partkey AS code, p_size AS size FROM part WHERE p_size BETWEEN {k} AND {40 + k} ORDER BY {r['by']} {'ASC' if r['ascending'] else 'DESC'}, p_partkey LIMIT {r['count']} OFFSET {r['offset']}"


@query("e_rank", _sql(E.RANK, _rank_sql))
def e_rank(spark, d):
    df = _t(spark, d, "part")
    return _every(E.RANK, lambda k, n: E.call(n, df, code="p_partkey", **_rank(k)).select(F.col("p_partkey").alias("code"), F.col("p_size").alias("size")))


_KINDS = ["click", "view", "purchase", "signup", "error"]


def _span(k: int) -> tuple[str, str]:
    return f"2024-01-{1 + k:02d} 06:00:00", f"2024-01-{3 + k:02d} 18:00:00"


@query(
    "e_times",
    _sql(E.TIMES, lambda k: f"SELECT event_type AS code, ts, round(value, 6) AS value FROM events WHERE event_type = '{_KINDS[k % 5]}' AND ts BETWEEN TIMESTAMP '{_span(k)[0]}' AND TIMESTAMP '{_span(k)[1]}' QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= {5 + k}"),
)
def e_times(spark, d):
    """Every endpoint's last rows of its range of times, in one reading of the events."""
    calls = {n: {"code": _KINDS[k % 5], "start": _span(k)[0], "end": _span(k)[1], "last": 5 + k} for k, n in enumerate(E.TIMES)}
    return E.all_series(_t(spark, d, "events"), "event_type", "ts", "event_id", calls).select(F.col("event_type").alias("code"), "ts", _r("value").alias("value"), "endpoint")


_SEGMENTS = ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"]


def _screen(k: int) -> dict:
    return {"filters": [{"field": "c_acctbal", "min": 100 * k, "max": 6000 + 300 * k}, {"field": "c_mktsegment", "in": [_SEGMENTS[k % 5], _SEGMENTS[(k + 1) % 5]]}, {"field": "c_name", "contains": "1"}], "sort": [{"field": "c_acctbal", "desc": k % 2 == 0}, {"field": "c_custkey"}], "limit": 4 + k}


@query(
    "e_screen",
    _sql(E.SCREEN, lambda k: f"SELECT c_custkey AS code, round(c_acctbal, 6) AS value FROM customer WHERE c_acctbal BETWEEN {100 * k} AND {6000 + 300 * k} AND c_mktsegment IN ('{_SEGMENTS[k % 5]}', '{_SEGMENTS[(k + 1) % 5]}') AND contains(c_name, '1') ORDER BY c_acctbal {'DESC' if k % 2 == 0 else 'ASC'}, c_custkey LIMIT {4 + k}"),
)
def e_screen(spark, d):
    df = _t(spark, d, "customer")
    return _every(E.SCREEN, lambda k, n: E.call(n, df, config=_screen(k)).select(F.col("c_custkey").alias("code"), _r("c_acctbal").alias("value")))


def _members(k: int) -> dict:
    return {"of": ["asia", k % 5], "aliases": {"asia": (k + 2) % 5}} if k % 2 else {"owners_of": [k, k + 1, (3 * k) % 25]}


def _members_sql(k: int) -> str:
    where = f"n_regionkey IN ({(k + 2) % 5}, {k % 5})" if k % 2 else f"n_nationkey IN ({k}, {k + 1}, {(3 * k) % 25})"
    return f"SELECT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey WHERE {where}"


@query("e_hierarchy", _sql(E.HIERARCHY, _members_sql))
def e_hierarchy(spark, d):
    edges, parents = _t(spark, d, "nation").withColumnRenamed("n_regionkey", "region"), _t(spark, d, "region").withColumnRenamed("r_regionkey", "region")
    return _every(E.HIERARCHY, lambda k, n: E.call(n, edges, parents=parents, parent="region", child="n_nationkey", **_members(k)).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")))


def _mean_sql(span: int) -> str:
    """The recursion of an exponential mean, row by row."""
    a = 2.0 / (span + 1)
    return f"e{span} AS (SELECT code, i, v AS e FROM b WHERE i = 1 UNION ALL SELECT b.code, b.i, e * {1 - a!r} + v * {a!r} FROM e{span} JOIN b ON b.code = e{span}.code AND b.i = e{span}.i + 1)"


@query(
    "e_calculation",
    f"""WITH RECURSIVE b AS (SELECT event_type AS code, CAST(ts AS DATE) AS day, avg(value) AS v, row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) AS i FROM events GROUP BY 1, 2),
{_mean_sql(3)}, {_mean_sql(6)},
w AS (SELECT code, day, i, avg(v) OVER p AS m, stddev_pop(v) OVER p AS s, count(*) OVER p AS n FROM b WINDOW p AS (PARTITION BY code ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT code, day, round(CASE WHEN n = 3 THEN m END, 6) AS ma, round(CASE WHEN n = 3 THEN m - 2 * s END, 6) AS lower, round(CASE WHEN n = 3 THEN m + 2 * s END, 6) AS upper, round(e3.e - e6.e, 6) AS dif
FROM w JOIN e3 USING (code, i) JOIN e6 USING (code, i)""",
)
def e_calculation(spark, d):
    bars = _t(spark, d, "events").groupBy(F.col("event_type").alias("code"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    made = E.call(E.CALCULATION[0], bars, code="code", order="day", value="v", short=3, long=6)
    return made.select("code", "day", *(_r(c).alias(c) for c in ("ma", "lower", "upper", "dif")))
