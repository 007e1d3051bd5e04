"""Statement facts: reshaping, growth, as-of ratios, derived quarters, roll-ups, comparables and beta."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.operators import trees
from quillmark.operators.skew import lookup
from quillmark.sources.shared import settle

#: Indentation levels that a window is planned for.
LADDER = 32
NULL_TOKENS = ["-", "—", "–", "*", "", "N/A", "NaN"]


def number(text: Column) -> Column:
    """A cell's number: currency signs, separators and % dropped; (x) and -x negative; signs for
    missing are null."""
    t = F.trim(F.regexp_replace(text, r"US\$|RMB|HK\$|[$¥€£,，%\s]", ""))
    body = F.regexp_replace(t, r"^[(（](.*)[)）]$", "$1")
    value = F.when(~t.isin(NULL_TOKENS) & body.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), body.cast("double"))
    return F.when(t.rlike(r"^[(（]"), -F.abs(value)).otherwise(value)


def to_million(value: Column, unit: Column, mode: str = "trunc") -> Column:
    """Whole millions of a value in its unit, cut toward zero or (``floor``) downward."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    x = value * F.when(u.rlike("billion|十亿"), 1000.0).when(u.rlike("million|百万"), 1.0).when(u.rlike("thousand|千"), 0.001).when(u.rlike("亿"), 100.0).when(u.rlike("万"), 0.01).otherwise(1.0)
    return F.floor(x) if mode == "floor" else F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


def to_long(wide: DataFrame, ids: list[str], values: list[str] | None = None, name: str = "period", value: str = "value") -> DataFrame:
    return wide.unpivot(ids, values or [c for c in wide.columns if c not in ids], name, value)


def to_wide(long: DataFrame, ids: list[str], name: str, value: str, columns: list[str]) -> DataFrame:
    """Columns are named by the caller, so pivoting needs no pass to find them."""
    return long.groupBy(*ids).pivot(name, columns).agg(F.first(value, ignorenulls=True))


def growth(now: Column, before: Column, digits: int | None = None) -> Column:
    g = (F.try_divide(now, before) - 1) * 100
    return g if digits is None else F.round(g, digits)


def year_on_year(facts: DataFrame, keys: list[str], year: str = "year", part: str = "part", value: str = "value") -> DataFrame:
    """``prev`` and ``yoy`` by a self join on the shifted year, so gaps stay gaps."""
    old = facts.select(*keys, (F.col(year) + 1).alias(year), part, F.col(value).alias("prev"))
    return facts.join(old, [*keys, year, part], "left").withColumn("yoy", growth(F.col(value), F.col("prev")))


def trend(facts: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """qoq (against 1 before) and yoy (4 before), by position."""
    w = Window.partitionBy(*keys).orderBy(order)
    return facts.withColumns({"qoq": F.try_divide(F.col(value), F.lag(value, 1).over(w)) - 1, "yoy": F.try_divide(F.col(value), F.lag(value, 4).over(w)) - 1})


def trend_summary(trended: DataFrame, keys: list[str], flat: float = 0.0) -> DataFrame:
    avg = F.avg("qoq")
    return trended.groupBy(*keys).agg(avg.alias("mean"), F.stddev_samp("qoq").alias("std"), F.when(avg > flat, "up").when(avg < -flat, "down").otherwise("stable").alias("label"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_year: str, right_year: str, left_period: str, right_period: str, prefix: str = "b_") -> DataFrame:
    """Best right row for each left row: same period, then same year (FY first), then the last year
    not later, then the first of all; ``match_kind`` 1 to 4, null where the key has none.

    The right side comes down to one row for each key and period, key and year, and key before it meets
    the left, so left rows, equal ones too, are neither multiplied nor merged, however hot a key."""
    own = [c for c in right.columns if c not in keys]
    row = F.struct(*(F.col(c).alias(prefix + c) for c in own)).alias("row")
    ry, rp = F.col(right_year), F.col(right_period)

    def least(by: list[str], *order: Column) -> DataFrame:
        return right.groupBy(*by).agg(F.min(F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)), row)).alias("m"))

    period = least([*keys, right_period], ry, rp).select(*keys, F.col(right_period).alias("_period"), F.col("m.row").alias("_m1"))
    year = least([*keys, right_year], F.when(rp.contains("FY"), 0).otherwise(1), rp).select(*keys, F.col(right_year).alias("_year"), F.col("m.row").alias("_m2"))
    first = least(keys, ry, rp).select(*keys, F.col("m.row").alias("_m4"))
    # The last year not later: the years asked for among the years there are, in order.
    there = least([*keys, right_year], rp).select(*keys, F.col(right_year).alias("_year"), F.col("m.row").alias("r"))
    asked = left.select(*keys, F.col(left_year).alias("_year")).distinct()
    back = Window.partitionBy(*keys).orderBy("_year").rowsBetween(Window.unboundedPreceding, 0)
    years = asked.join(there, [*keys, "_year"], "full").withColumn("_m3", F.last("r", ignorenulls=True).over(back)).drop("r")
    out = left.withColumns({"_period": F.col(left_period), "_year": F.col(left_year)})
    out = out.join(period, [*keys, "_period"], "left").join(year, [*keys, "_year"], "left").join(years, [*keys, "_year"], "left").join(first, keys, "left")
    kind = F.when(F.col("_m1").isNotNull(), 1).when(F.col("_m2").isNotNull(), 2).when(F.col("_m3").isNotNull(), 3).when(F.col("_m4").isNotNull(), 4)
    best = F.coalesce("_m1", "_m2", "_m3", "_m4").alias("best")
    return out.select(*(out[c] for c in left.columns), kind.alias("match_kind"), best).select(*left.columns, "match_kind", *(F.col(f"best.{prefix}{c}") for c in own))


def derive_quarters(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds Q2 = QTD6 - Q1, Q3 = QTD9 - QTD6 and Q4 = FY - QTD9 where missing (confidence 60,
    source DERIVED).  Columns: keys, year, kind, value, source, confidence."""
    on = [*keys, "year"]
    wide = facts.groupBy(*on).pivot("kind", ["Q1", "Q2", "Q3", "Q4", "QTD6", "QTD9", "FY"]).agg(F.first("value", ignorenulls=True))
    made = [("Q2", F.col("QTD6") - F.col("Q1")), ("Q3", F.col("QTD9") - F.col("QTD6")), ("Q4", F.col("FY") - F.col("QTD9"))]
    new = wide.select(*on, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.when(F.col(k).isNull(), v).alias("value")) for k, v in made))).alias("x")).select(*on, "x.kind", "x.value").where("value is not null")
    return facts.unionByName(new.select(*on, "kind", "value", F.lit("DERIVED").alias("source"), F.lit(60).alias("confidence")))


def roll_up(leaves: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Sums of every level of a path of columns, bottom up: node, level, value."""
    out, cur = None, leaves
    for k in range(len(levels), 0, -1):
        cur = cur.groupBy(*levels[:k]).agg(F.sum(value).alias(value))
        row = cur.select(F.concat_ws("/", *(F.col(c).cast("string") for c in levels[:k])).alias("node"), F.lit(k).alias("level"), value)
        out = row if out is None else out.unionByName(row)
    return out


def fill_from_children(nodes: DataFrame) -> DataFrame:
    """(parent, code, metric, period, value and more): a missing value becomes the sum of the node's children, which are filled
    first, at any depth; none stays null, and an own value is never replaced.  Below or in a cycle it stays missing."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("code"), "metric", "period"))
    own = settle(nodes.select(at("code").alias("key"), at("parent").alias("up"), "value"))
    # what a node passes on ends at a node with a value of its own
    valued = own.where("value is not null").select(F.col("key").alias("up"), F.lit(True).alias("ends")).distinct()
    cut = lookup(own, valued, "up", own.count()).withColumn("up", F.when(F.col("ends").isNull(), F.col("up"))).drop("ends")
    sums = trees.subtree_sums(cut, "key", "up", "value").select("key", F.col("total").alias("_s"))
    return nodes.withColumn("key", at("code")).join(sums, "key", "left").withColumn("value", F.coalesce("value", "_s")).select(*nodes.columns)


def total_check(parts: DataFrame, totals: DataFrame, key: str, part: str, total: str) -> DataFrame:
    """ok where |sum - total| <= max(1, 0.5 % of |total|) and two parts or more."""
    s = parts.groupBy(key).agg(F.sum(part).alias("parts"), F.count(part).alias("n_parts"))
    return totals.select(key, total).join(s, key).withColumn("ok", (F.abs(F.col("parts") - F.col(total)) <= F.greatest(F.lit(1.0), 0.005 * F.abs(F.col(total)))) & (F.col("n_parts") >= 2))


def comps(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """max, third quartile, median, first quartile, min; quartiles by linear interpolation."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(F.max(value).alias("max"), q.alias("q"), F.min(value).alias("min"))
    return out.select(*keys, "max", F.col("q")[2].alias("q3"), F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), "min")


def returns(prices: DataFrame, keys: list[str], time: str, close: str) -> DataFrame:
    before = F.lag(close).over(Window.partitionBy(*keys).orderBy(time))
    return prices.withColumn("ret", F.try_divide(F.col(close) - before, before)).where("ret is not null")


def beta(stock: DataFrame, bench: DataFrame, keys: list[str], time: str, least: int = 24) -> DataFrame:
    """cov / var and correlation of returns joined on time, where ``least`` months or more meet."""
    b = bench.select(time, F.col("ret").alias("bench"))
    out = stock.join(b, time).groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("ret", "bench"), F.var_pop("bench")).alias("beta"), F.corr("ret", "bench").alias("r"))
    return out.where(F.col("n") >= least)


def first_source(df: DataFrame, group: list[str], priority: str) -> DataFrame:
    """Rows of the best (smallest) priority that a group has."""
    return df.join(df.groupBy(*group).agg(F.min(priority).alias(priority)), [*group, priority], "left_semi")


def latest(df: DataFrame, keys: list[str], order: Column, n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def ratio(a: Column, b: Column, absolute: bool = False) -> Column:
    return F.round(F.try_divide(F.abs(a) if absolute else a, b) * 100, 2)


def free_cash_flow(ocf: Column, capex: list[Column]) -> Column:
    """Operating cash flow less the sizes of the capex items; null if either side is missing."""
    some = F.coalesce(*capex)
    return F.when(some.isNotNull(), ocf - sum((F.coalesce(F.abs(c), F.lit(0.0)) for c in capex), F.lit(0.0)))


def confidence(parens: Column, unit: Column, currency: Column) -> Column:
    return 80 - F.when(parens, 5).otherwise(0) + F.when(unit.isNotNull(), 5).otherwise(0) + F.when(currency.isNotNull(), 5).otherwise(0)


def table_type(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("income|revenue|利润|收入"), "income").when(t.rlike("balance|assets|资产"), "balance").when(t.rlike("cash flow|现金"), "cashflow").otherwise("other")


def ladder_parent(rows: DataFrame, group: list[str], order: str, level: str, name: str) -> DataFrame:
    """Parent of an indented row: the last row above that is not as deep, if it is one level up.

    As many levels as the rows have, in one window; tables of over ``LADDER`` levels are walked a table at a time."""
    deepest = rows.agg(F.max(level)).first()[0] or 0
    if deepest > LADDER:
        kind = T.StructType([*rows.schema.fields, T.StructField("parent", T.StringType())])

        def walk(t: pd.DataFrame) -> pd.DataFrame:
            t, stack, out = t.sort_values(order), [], []
            for depth, label in zip(t[level], t[name]):
                while stack and stack[-1][0] >= depth:
                    stack.pop()
                out.append(stack[-1][1] if stack and stack[-1][0] == depth - 1 else None)
                stack.append((depth, label))
            return t.assign(parent=out)

        return rows.groupBy(*group).applyInPandas(walk, kind)
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast("string")
    for k in range(1, deepest):
        above = F.max(F.when(F.col(level) <= k, F.struct(order, level, name))).over(w)
        parent = F.when((F.col(level) == k + 1) & (above[level] == k), above[name]).otherwise(parent)
    return rows.withColumn("parent", parent)


def first_match_sum(df: DataFrame, keys: list[str], groups: list[list[str]], name: str, value: str) -> DataFrame:
    """first_match: over groups of labels, the sum of each group's first label that is there;
    all_match: the sum over every label of any group."""
    sums = [[F.sum(F.when(F.col(name) == label, F.col(value))) for label in g] for g in groups]
    first = sum((F.coalesce(*g, F.lit(0.0)) for g in sums[1:]), F.coalesce(*sums[0], F.lit(0.0)))
    labels = sorted({label for g in groups for label in g})
    return df.groupBy(*keys).agg(first.alias("first_match"), F.coalesce(F.sum(F.when(F.col(name).isin(labels), F.col(value))), F.lit(0.0)).alias("all_match"))


def merge_facts(files: list[DataFrame], keys: list[str]) -> DataFrame:
    """Facts of files in order of precedence; of a key the first file that has it counts."""
    out = None
    for k, f in enumerate(files):
        f = f.withColumn("file_no", F.lit(k))
        out = f if out is None else out.unionByName(f)
    rest = [c for c in out.columns if c not in keys]
    return out.groupBy(*keys).agg(F.min_by(F.struct(*rest), "file_no").alias("x")).select(*keys, "x.*")


def with_ratio_rows(facts: DataFrame, keys: list[str], config: list[tuple[str, str, str]], name: str = "metric", value: str = "value") -> DataFrame:
    """``facts`` (order 0) and, behind each numerator, its ratio rows in percent (order 1, 2 ...).

    One aggregate puts a period's configured metrics side by side, so no self join is needed."""
    used = sorted({m for a, b, _ in config for m in (a, b)})
    wide = facts.where(F.col(name).isin(used)).groupBy(*keys).agg(*(F.first(F.when(F.col(name) == m, F.col(value)), ignorenulls=True).alias(m) for m in used))
    rows = [F.struct(F.lit(a).alias("parent"), F.lit(k + 1).alias("sub_order"), F.lit(label).alias(name), ratio(F.col(a), F.col(b)).alias(value)) for k, (a, b, label) in enumerate(config)]
    made = wide.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*").where(F.col(value).isNotNull())
    own = facts.select(*keys, F.col(name).alias("parent"), F.lit(0).alias("sub_order"), name, value)
    return own.unionByName(made)


def unique_ids(df: DataFrame, group: list[str], base: str, order: list) -> DataFrame:
    """base, base-2, base-3 ... inside a group."""
    n = F.row_number().over(Window.partitionBy(*group, base).orderBy(*order))
    return df.withColumn("unique_id", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))


def islands(df: DataFrame, group: list[str], order: str, hit: Column, least: int = 3) -> DataFrame:
    """Runs of ``least`` or more consecutive rows that ``hit``: group, first, last, n."""
    w = Window.partitionBy(*group).orderBy(order)
    rows = df.withColumn("_all", F.row_number().over(w)).where(hit)
    rows = rows.withColumn("_run", F.col("_all") - F.row_number().over(w))
    return rows.groupBy(*group, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_run")


def compound(df: DataFrame, keys: list[str], order: str, rate: str, base: str) -> DataFrame:
    """value_t = value_(t-1) * (1 + rate_t) from ``base``, as a running sum of logs; rates over -1."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("compounded", F.col(base) * F.exp(F.sum(F.log1p(rate)).over(w)))


def nearest_left(df: DataFrame, group: list[str], order: str, header: str) -> DataFrame:
    """Each column's header, or that of the nearest one to its left that has any."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("header", F.last(header, ignorenulls=True).over(w))


def nested_facts(reports: DataFrame, keys: list[str], items: str = "item_list") -> DataFrame:
    """(keys, field_id, data, yoy) of reports with nested items."""
    return reports.select(*keys, F.inline_outer(items))


def statement_table(reports: DataFrame, structure: list[tuple[int, str]], keys: list[str]) -> DataFrame:
    """(keys, place, field_id, name, data): every field of the structure, (field_id, name) in order, in every
    period, null where a report lacks it, so no column slips."""
    facts = nested_facts(reports, keys).where("field_id is not null")
    rows = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(i).alias("field_id"), F.lit(n).alias("name")) for k, (i, n) in enumerate(structure)))
    frame = reports.select(*keys).distinct().select(*keys, F.inline(rows))
    return frame.join(facts.select(*keys, "field_id", "data"), [*keys, "field_id"], "left").select(*keys, "place", "field_id", "name", "data")


def returns_on(net_total: Column, net_owners: Column, assets: Column, equity: Column, factor: Column) -> dict[str, Column]:
    """Annualised returns in percent: total profit (owners' where there is none) on assets, owners' profit on equity."""
    on = lambda a, b: F.round(F.try_divide(a * factor, b) * 100, 2)
    return {"roa": on(F.coalesce(net_total, net_owners), assets), "roe": on(net_owners, equity)}


def gross_margin(revenue: Column, cost: Column) -> Column:
    """(revenue - cost) / revenue in percent."""
    return F.round(F.try_divide(revenue - cost, revenue) * 100, 2)


def cash_conversion(fcf: Column, total: Column, owners: Column) -> Column:
    """Free cash flow in percent of profit, the owners' where there is no total."""
    return F.round(F.try_divide(fcf, F.coalesce(total, owners)) * 100, 2)


def abs_sum(df: DataFrame, keys: list[str], names: list[str], name: str = "field_id", value: str = "value") -> DataFrame:
    """Sum of sizes over the named items; null where a key has none of them."""
    return df.groupBy(*keys).agg(F.sum(F.when(F.col(name).isin(names), F.abs(F.col(value)))).alias("total"))


def covered(df: DataFrame, keys: list[str], core: list[str], name: str = "metric", value: str = "value", least: int = 2) -> DataFrame:
    """Keys with ``least`` core metrics that aren't zero: keys, hits, covered."""
    hits = F.count_if(F.col(name).isin(core) & (F.coalesce(F.col(value), F.lit(0.0)) != 0))
    return df.groupBy(*keys).agg(hits.alias("hits")).withColumn("covered", F.col("hits") >= least)


def pick_column(columns: list[str], label: str) -> str:
    """The column of a label, else the first that begins with it."""
    if label in columns:
        return label
    found = [c for c in columns if c.startswith(label)]
    if not found:
        raise ValueError(f"no column {label!r} among {columns}")
    return found[0]


def latest_values(facts: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """The value of each key's last period: keys, period, value."""
    return facts.groupBy(*keys).agg(F.max_by(F.struct(period, value), F.col(period)).alias("x")).select(*keys, "x.*")


def with_estimates(actual: DataFrame, estimate: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Actual facts and estimates of one form; NaN is null, and ``kind`` tells them apart."""
    clean = F.when(~F.isnan(value), F.col(value))
    both = [df.select(*keys, clean.alias(value), F.lit(kind).alias("kind")) for df, kind in ((actual, "actual"), (estimate, "estimate"))]
    return both[0].unionByName(both[1])


def earnings_metrics(facts: DataFrame, keys: list[str], names: dict[str, str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row a key: each output column the value of its source metric; liabilities are assets less equity."""
    of = lambda m: F.first(F.when(F.col(name) == m, F.col(value)), ignorenulls=True)
    out = facts.groupBy(*keys).agg(*(of(m).alias(c) for c, m in names.items()))
    if {"total_assets", "shareholders_equity"} <= set(names):
        out = out.withColumn("total_liabilities", F.col("total_assets") - F.col("shareholders_equity"))
    return out


def column_lookup(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of the first row with the key (the smallest by value), 0 where there is none, as a sheet lookup."""
    one = right.groupBy(key).agg(*(F.min(f).alias(f) for f in fields))
    return left.join(one, key, "left").fillna(0, fields)


def looks_like_segments(table: Column) -> Column:
    """A table (array of rows of cells) of three rows or more, 4 to 10 columns, and five numbers of 100 or more."""
    numbers = F.flatten(F.transform(table, lambda r: F.transform(r, lambda c: F.regexp_extract(F.regexp_replace(c, ",", ""), r"(\d+(?:\.\d+)?)", 1).try_cast("double"))))
    return (F.size(table) >= 3) & F.size(table[0]).between(4, 10) & (F.size(F.filter(numbers, lambda x: x >= 100)) >= 5)
