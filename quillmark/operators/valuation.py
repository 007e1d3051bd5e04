"""Valuation as Column expressions: WACC, DCF, sensitivity grids, LBO waterfall and statement rolls.

A scenario is a row; years are arrays of at most a handful of values, folded with ``aggregate``, so a
grid of any size is one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: LBO tranches: name, share of debt, rate, yearly amortisation. Fixed values.
TRANCHES = [("revolver", 0.0, 0.055, 0.0), ("tla", 0.25, 0.055, 0.10), ("tlb", 0.45, 0.065, 0.0), ("notes", 0.30, 0.08, 0.0)]
LEVERAGE, FEES, NWC = 0.5, 0.04, 0.10


def cost_of_equity(rf: Column, beta: Column, erp: Column) -> Column:
    return rf + F.coalesce(beta, F.lit(1.2)) * erp


def wacc(equity: Column, debt: Column, ke: Column, kd: Column, tax: Column) -> Column:
    """Weights over max(E + D, E / 2); almost no debt gives the cost of equity."""
    v = F.greatest(equity + debt, 0.5 * equity)
    return F.when(debt <= 0.001 * equity, ke).otherwise(equity / v * ke + debt / v * kd * (1 - tax))


def project(rev0: Column, growth: Column, margin: Column, tax: Column, da: Column, capex: Column, nwc: Column) -> Column:
    """array<struct(t, rev, fcf)> of the years: mid-year t, FCF = NOPAT + D&A - CapEx - NWC growth."""
    start = F.struct(rev0.cast("double").alias("prev"), F.array().cast("array<struct<t:double,rev:double,fcf:double>>").alias("rows"))

    def step(s: Column, i: Column) -> Column:
        rev = s["prev"] * (1 + F.element_at(growth, i))
        ebit = rev * F.element_at(margin, i)
        fcf = ebit - F.greatest(F.lit(0.0), ebit) * tax + rev * da - rev * capex - (rev - s["prev"]) * nwc
        return F.struct(rev.alias("prev"), F.concat(s["rows"], F.array(F.struct((i - 0.5).cast("double").alias("t"), rev.alias("rev"), fcf.alias("fcf")))).alias("rows"))

    return F.aggregate(F.sequence(F.lit(1), F.size(growth)), start, step)["rows"]


def dcf(rows: Column, w: Column, g: Column, net_debt: Column, shares: Column, price: Column) -> dict[str, Column]:
    """ev, equity, implied and upside; the terminal value takes the last mid-year factor."""
    pv = F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["fcf"] / F.pow(1 + w, r["t"]))
    last = F.element_at(rows, -1)
    ev = pv + F.try_divide(last["fcf"] * (1 + g), w - g) / F.pow(1 + w, last["t"])
    implied = F.try_divide(ev - net_debt, shares)
    return {"ev": ev, "equity": ev - net_debt, "implied": implied, "upside": F.try_divide(implied, price) - 1}


def axis(base: Column, step: float) -> Column:
    """base + {-2 .. 2} * step, as rows."""
    return F.explode(F.array(*(base + k * step for k in range(-2, 3))))


def grid(df: DataFrame, first: str, first_step: float, second: str, second_step: float) -> DataFrame:
    """Every row at 5 x 5 values of two of its columns."""
    return df.withColumn(first, axis(F.col(first), first_step)).withColumn(second, axis(F.col(second), second_step))


def debt_waterfall(original: list[Column], cash: Column) -> Column:
    """array<struct(ends, interest)> a year: beginning-balance interest, amortisation, and a sweep of
    what cash is left, tranche by tranche.  ``cash``: levered cash flow before interest, an array."""
    ends0 = F.array(*(o.cast("double") for o in original))
    start = F.struct(ends0.alias("ends"), F.array().cast("array<struct<ends:array<double>,interest:double>>").alias("rows"))

    def step(s: Column, i: Column) -> Column:
        beg = [F.element_at(s["ends"], k + 1) for k in range(len(original))]
        interest = sum((b * TRANCHES[k][2] for k, b in enumerate(beg)), F.lit(0.0))
        must = [F.least(b, TRANCHES[k][3] * original[k]) for k, b in enumerate(beg)]
        left = F.element_at(cash, i) - interest - sum(must, F.lit(0.0))
        ends = []
        for b, m in zip(beg, must):
            sweep = F.least(F.greatest(F.lit(0.0), b - m), F.greatest(F.lit(0.0), left))
            ends.append(F.greatest(F.lit(0.0), b - m - sweep))
            left = left - sweep
        now = F.array(*ends)
        return F.struct(now.alias("ends"), F.concat(s["rows"], F.array(F.struct(now.alias("ends"), interest.alias("interest")))).alias("rows"))

    return F.aggregate(F.sequence(F.lit(1), F.size(cash)), start, step)["rows"]


def lbo_returns(ebitda: Column, multiple: Column, end_debt: Column, equity: Column, years: int = 5) -> dict[str, Column]:
    """Exit equity, multiple of money, and IRR (no flows between, so a root)."""
    out = ebitda * multiple - end_debt
    moic = F.try_divide(out, equity)
    return {"exit_equity": out, "moic": moic, "irr": F.when(moic > 0, F.pow(moic, 1.0 / years) - 1)}


def debt_roll(beg: Column, issuance: Column, mandatory: Column, sweep: Column, rate: Column) -> dict[str, Column]:
    return {"end": beg + issuance - mandatory - sweep * beg, "interest": beg * rate}


def working_capital(base: Column, days: Column) -> Column:
    return base * days / 365


def plug(total: Column, buckets: list[Column]) -> Column:
    return total - sum((F.coalesce(b, F.lit(0.0)) for b in buckets), F.lit(0.0))


def checks(w: Column, g: Column, tv_share: Column) -> Column:
    """Names of the failed sanity checks of a DCF."""
    return F.filter(F.array(F.when(g >= w, "growth_not_below_wacc"), F.when(~w.between(0.05, 0.20), "wacc_range"), F.when(tv_share > 0.75, "terminal_share")), lambda x: x.isNotNull())


def lbo_grid(df: DataFrame, first: str, second: str, years: int = 5) -> DataFrame:
    """5 x 5 cells (i, j) of money multiple and IRR about a base case, in closed form: debt follows the entry
    price, and what is repaid over the hold stays that of the base.

    ``first`` and ``second`` are two of entry (step 1), exit (step 1) and leverage (step 0.1, held in
    0 to 0.9); columns: entry, exit, leverage, ebitda, exit_ebitda, repaid."""
    steps = {"entry": 1.0, "exit": 1.0, "leverage": 0.1}
    at = lambda name, k: F.col(name) + (F.col(k) - 2) * steps[name]
    cells = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4))))
    own = {n: at(n, k) for n, k in ((first, "i"), (second, "j"))}
    own = {n: F.greatest(F.lit(0.0), F.least(F.lit(0.9), c)) if n == "leverage" else c for n, c in own.items()}
    entry, exit_, lever = (own.get(n, F.col(n)) for n in ("entry", "exit", "leverage"))
    price = entry * F.col("ebitda")
    debt = lever * price
    moic = F.coalesce(F.try_divide(exit_ * F.col("exit_ebitda") - F.greatest(F.lit(0.0), debt - F.col("repaid")), price - debt), F.lit(0.0))
    return cells.withColumns({"moic": moic, "irr": F.when(moic > 0, F.pow(moic, 1.0 / years) - 1).otherwise(-1.0)})


def multiples(ev: Column, cap: Column, revenue: Column, ebit: Column, earnings: Column) -> dict[str, Column]:
    """EV / revenue, EV / EBIT and P / E; 0 where there is nothing to divide by."""
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {"ev_revenue": over(ev, revenue), "ev_ebit": over(ev, ebit), "pe": over(cap, earnings)}


def dcf_findings(cases: DataFrame) -> DataFrame:
    """Rows (name, check, level) of a DCF's sanity checks: growth below the rate, the rate inside 5 to 20 %,
    the terminal share inside 40 to 80 %."""
    rate = F.when(F.col("growth") >= F.col("wacc"), "error").when(~F.col("wacc").between(0.05, 0.20), "warning").otherwise("info")
    share = F.try_divide(F.col("pv_terminal"), F.col("ev"))
    level = F.when(share.isNull(), "info").when((share > 0.80) | (share < 0.40), "warning").otherwise("info")
    row = lambda name, c: F.struct(F.lit(name).alias("check"), c.alias("level"))
    return cases.select("name", F.inline(F.array(row("growth_below_wacc", rate), row("terminal_share", level))))


def model_audit(rows: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Rows (period, check, gap, ok) of a linked model: the sheet balances, cash ties out, and retained
    earnings and fixed assets roll forward."""
    gaps = {
        "balance": F.col("assets") - F.col("liabilities") - F.col("equity"),
        "cash": F.col("cash") - F.col("cash_begin") - F.col("net_cash_flow"),
        "retained": F.col("retained") - F.col("retained_begin") - F.col("net_income") + F.col("dividends"),
        "fixed_assets": F.col("ppe") - F.col("ppe_begin") - F.col("capex") + F.col("depreciation"),
    }
    checks = [F.struct(F.lit(k).alias("check"), v.alias("gap"), (F.abs(v) <= tolerance).alias("ok")) for k, v in gaps.items()]
    return rows.select("period", F.inline(F.array(*checks)))
