"""The linked three-statement model: a company is a row, its years are arrays folded in one projection.

A forecast year depends on the one before (debt, cash, plant, equity), so the fold is sequential in
the years of a row and parallel in the rows; no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Opening balances and yearly drivers that a row must have. Fixed values.
OPENING = ["revenue", "cash", "receivables", "inventory", "payables", "plant", "debt"]
DRIVERS = ["gross_margin", "opex", "depreciation", "capex", "tax", "dso", "dio", "dpo", "issuance", "mandatory", "sweep", "rate"]
_YEAR = "struct<year:int,revenue:double,net_income:double,cfo:double,cfi:double,cff:double,cash:double,assets:double,claims:double,debt:double,gap:double>"


def three_statements(df: DataFrame, growth: str = "growth") -> DataFrame:
    """``df`` with ``years``: income, cash flow and balance of each year of the array ``growth``.

    Interest is on opening debt, the sweep is a share of opening debt, cash is the sum of the three
    flows, and equity opens as what balances the sheet; ``gap`` (assets less claims) stays 0."""
    d = {k: F.col(k).cast("double") for k in [*OPENING, *DRIVERS]}
    equity = d["cash"] + d["receivables"] + d["inventory"] + d["plant"] - d["payables"] - d["debt"]
    state = [*OPENING, "equity"]
    start = F.struct(*(d[k].alias(k) for k in OPENING), equity.alias("equity"), F.array().cast(f"array<{_YEAR}>").alias("rows"))

    def step(s: Column, i: Column) -> Column:
        revenue = s["revenue"] * (1 + F.element_at(growth, i))
        cogs = revenue * (1 - d["gross_margin"])
        da, capex, interest = revenue * d["depreciation"], revenue * d["capex"], s["debt"] * d["rate"]
        pretax = revenue - cogs - revenue * d["opex"] - da - interest
        income = pretax - F.greatest(F.lit(0.0), pretax) * d["tax"]
        receivables, inventory, payables = revenue * d["dso"] / 365, cogs * d["dio"] / 365, cogs * d["dpo"] / 365
        released = (s["receivables"] + s["inventory"] - s["payables"]) - (receivables + inventory - payables)
        debt = s["debt"] + d["issuance"] - d["mandatory"] - d["sweep"] * s["debt"]
        cfo, cfi, cff = income + da + released, -capex, debt - s["debt"]
        cash, plant, own = s["cash"] + cfo + cfi + cff, s["plant"] + capex - da, s["equity"] + income
        assets, claims = cash + receivables + inventory + plant, payables + debt + own
        year = F.struct(i.cast("int").alias("year"), revenue, income, cfo, cfi, cff, cash, assets, claims, debt, assets - claims).cast(_YEAR)
        now = [revenue, cash, receivables, inventory, payables, plant, debt, own]
        return F.struct(*(c.alias(k) for c, k in zip(now, state)), F.concat(s["rows"], F.array(year)).alias("rows"))

    years = F.aggregate(F.sequence(F.lit(1), F.size(growth)), start, step, lambda s: s["rows"])
    return df.withColumn("years", F.when(F.size(growth) > 0, years))


def back_solved_debt(balances: DataFrame, keys: list[str], order: str, debt: str) -> DataFrame:
    """Issuance and repayment of history: the rises and falls of the balance."""
    step = F.col(debt) - F.lag(debt).over(Window.partitionBy(*keys).orderBy(order))
    return balances.withColumns({"issuance": F.greatest(F.lit(0.0), step), "mandatory": F.greatest(F.lit(0.0), -step), "_step": step}).where("_step is not null").drop("_step")


def scenarios(df: DataFrame, cases: dict[str, tuple[float, float]], rate: str, years: int) -> DataFrame:
    """One row a case: ``rate`` scaled by the case's factor and decaying by its decay each year."""
    case = F.explode(F.array(*(F.struct(F.lit(n).alias("case"), F.lit(k).alias("factor"), F.lit(q).alias("decay")) for n, (k, q) in cases.items())))
    path = F.transform(F.sequence(F.lit(0), F.lit(years - 1)), lambda t: F.col(rate) * F.col("x.factor") * F.pow(F.col("x.decay"), t))
    return df.withColumn("x", case).select(*df.columns, F.col("x.case").alias("case"), path.alias("growth"))
