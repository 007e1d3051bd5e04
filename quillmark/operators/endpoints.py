"""Market and account endpoints by name.  Each is one of six shapes over a table of its records: a scan of some
securities, a page of a ranking, a range of times, a screen, a hierarchy, or an indicator calculation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.operators import market

#: Endpoint names by shape. Fixed values.
SCAN = {
    "quote": "get_broker_queue get_capital_distribution get_future_info get_global_state get_ipo_list get_orderbook get_rise_fall_distribution get_search_news get_search_quote get_snapshot get_stock_info get_stock_quote get_top_ten_buy_sell_brokers".split(),
    "company": "get_company_executive_background get_company_executives get_company_operational_efficiency get_company_profile get_corporate_actions_buybacks get_corporate_actions_dividends get_corporate_actions_stock_splits get_financials_earnings_price_move get_financials_revenue_breakdown get_financials_statements get_insider_trade_list get_valuation_detail".split(),
    "option": "get_option_event get_option_event_alert get_option_exercise_probability get_option_expiration_date get_option_quote get_option_strategy get_option_strategy_analysis get_option_strategy_spread get_option_underlying_overview get_option_zero_dte_contract get_warrant resolve_option_code".split(),
    "research": "get_fed_watch_dot_plot get_fed_watch_target_rate get_indicator_list get_macro_indicator_list get_price_reminder get_rating_change get_research_analyst_consensus get_research_morningstar_report get_research_rating_summary get_user_info get_user_security get_user_security_group".split(),
    "account": "comboorder_tradinginfo_query get_accounts get_all_portfolios get_crypto_accounts get_crypto_max_trd_qtys get_crypto_order_fee get_crypto_orders get_crypto_portfolio get_margin_ratio get_max_trd_qtys get_order_fee get_order_fill_list get_orders get_portfolio".split(),
}
RANK = "get_dividend_rank get_earnings_beat_rank get_heat_map_data get_high_dividend_soe_rank get_hot_list get_option_rank get_option_underlying_rank get_period_change_rank get_short_selling_rank get_top_movers_rank get_us_after_hours_rank get_us_overnight_rank get_us_pre_market_rank".split()
TIMES = "get_acc_cash_flow get_capital_flow get_crypto_cash_flow get_daily_short_volume get_dividend_calendar get_earnings_calendar get_economic_calendar get_financials_earnings_price_history get_history_kl_quota get_history_order_fill_list get_history_orders get_kline get_macro_indicator_history get_option_market_statistic get_option_underlying_his_statistic get_option_underlying_his_volatility get_option_volatility get_rehab get_rt_data get_short_interest get_ticker get_trading_days".split()
SCREEN = "get_option_earnings_screener get_option_screen get_option_seller_screener get_option_zero_dte_screener get_stock_filter get_stock_screen get_warrant_screen".split()
HIERARCHY = "get_ark_active_transaction get_ark_fund_holding get_ark_stock_dynamic get_industrial_chain_by_plate get_industrial_chain_detail get_industrial_chain_list get_industrial_plate_info get_industrial_plate_stock get_insider_holder_list get_institution_distribution get_institution_holding_change get_institution_holding_list get_institution_list get_institution_profile get_market_state get_option_chain get_owner_plate get_plate_list get_plate_stock get_referencestock_list get_shareholders_holder_detail get_shareholders_holding_changes get_shareholders_institutional get_shareholders_overview get_valuation_plate_stock_list".split()
CALCULATION = ["get_indicator_calc_result"]
#: Largest page of a ranking. Fixed value.
MAX_COUNT = 300


def shape(name: str) -> str:
    """scan, rank, times, screen, hierarchy or calculation."""
    if any(name in names for names in SCAN.values()):
        return "scan"
    for kind, names in (("rank", RANK), ("times", TIMES), ("screen", SCREEN), ("hierarchy", HIERARCHY), ("calculation", CALCULATION)):
        if name in names:
            return kind
    raise ValueError(f"no such endpoint: {name}")


def intervals(df: DataFrame, filters: list[dict]) -> DataFrame:
    """Rows inside every filter's interval_min .. interval_max and value_list of its indicator_type."""
    return market.screen(df, {"filters": [{"field": f["indicator_type"], "min": f.get("interval_min"), "max": f.get("interval_max"), "in": f.get("value_list")} for f in filters]})


def page(df: DataFrame, by: str, code: str, count: int = 10, offset: int = 0, ascending: bool = False, filters: list[dict] | None = None) -> DataFrame:
    """A page of a ranking, 1 to MAX_COUNT rows."""
    return market.ranked(intervals(df, filters or []), by, code, min(max(count, 1), MAX_COUNT), offset, ascending)


def series(df: DataFrame, code: str, codes: list | None, ts: str, start: str, end: str, last: int | None = None, tie: str | None = None) -> DataFrame:
    """Some codes' rows of a closed time range, at most the ``last`` of each."""
    rows = market.between_times(df.where(F.col(code).isin(codes)) if codes else df, ts, start, end)
    if last is None:
        return rows
    w = Window.partitionBy(code).orderBy(F.col(ts).desc(), *([F.col(tie).desc()] if tie else []))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last).drop("_n")


def scans(df: DataFrame, code: str, calls: dict[str, list], fields: list[str]) -> DataFrame:
    """Many scans as one: the rows of every call's codes beside the call's name (column ``endpoint``).  The table is read
    once; what is broadcast are the codes that were asked for."""
    asked = df.sparkSession.createDataFrame([(n, c) for n, codes in calls.items() for c in dict.fromkeys(codes)], T.StructType([T.StructField("endpoint", T.StringType()), T.StructField(code, df.schema[code].dataType)]))
    return df.join(F.broadcast(asked), code).select("endpoint", code, *fields)


def all_series(df: DataFrame, code: str, ts: str, tie: str, calls: dict[str, dict]) -> DataFrame:
    """Many ranges of times as one: each call is {code, start, end, last}.  The table is read once, for the times that any call
    asks for, and each call's rows are ranked where they meet."""
    kind = T.StructType([T.StructField("endpoint", T.StringType()), T.StructField(code, df.schema[code].dataType), T.StructField("_from", T.StringType()), T.StructField("_to", T.StringType()), T.StructField("_last", T.IntegerType())])
    asked = df.sparkSession.createDataFrame([(n, c["code"], c["start"], c["end"], c["last"]) for n, c in calls.items()], kind)
    asked = asked.withColumns({x: F.col(x).cast(df.schema[ts].dataType) for x in ("_from", "_to")})
    rows = market.between_times(df, ts, min(c["start"] for c in calls.values()), max(c["end"] for c in calls.values()))
    met = rows.join(F.broadcast(asked), code).where(F.col(ts).between(F.col("_from"), F.col("_to")))
    w = Window.partitionBy("endpoint").orderBy(F.col(ts).desc(), F.col(tie).desc())
    return met.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("_last")).drop("_n", "_from", "_to", "_last")


def hierarchy(edges: DataFrame, parents: DataFrame, parent: str, child: str, of: list | None = None, owners_of: list | None = None, aliases: dict[str, object] | None = None) -> DataFrame:
    """Members of some parents, or the parents that own some children; parents may go by an alias."""
    named = [(aliases or {}).get(p, p) for p in of or []]
    edges = edges.where(F.col(parent).isin(named)) if named else edges
    edges = edges.where(F.col(child).isin(owners_of)) if owners_of else edges
    return edges.join(parents, parent)


def moving(value: str, n: int, code: str, order: str) -> Column:
    """Mean of the last ``n`` values; null before there are as many."""
    w = Window.partitionBy(code).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def band(value: str, n: int, width: float, code: str, order: str) -> tuple[Column, Column]:
    """Mean of the last ``n`` values less and plus ``width`` deviations."""
    w = Window.partitionBy(code).orderBy(order).rowsBetween(-(n - 1), 0)
    spread = width * F.stddev_pop(value).over(w)
    return tuple(F.when(F.count(value).over(w) == n, F.avg(value).over(w) + s * spread) for s in (-1, 1))


def smoothed(value: str, span: int, code: str, order: str) -> Column:
    """Exponential mean of weight 2 / (span + 1): the recursion from a code's first value on.  What is older than the values
    summed weighs under 1e-18 of the whole, less than a double's last digit."""
    a = 2.0 / (span + 1)
    back = math.ceil(math.log(1e-18) / math.log(1 - a)) if span > 1 else 1
    w = Window.partitionBy(code).orderBy(order).rowsBetween(-back, 0)
    held = F.collect_list(value).over(w)
    return F.aggregate(F.slice(held, 2, back), held[0], lambda acc, x: acc * (1 - a) + x * a)


def call(name: str, table: DataFrame, **options) -> DataFrame:
    """An endpoint over a table of its records; the options are those of its shape's function."""
    run = {"scan": market.scan, "rank": page, "times": series, "screen": market.screen, "hierarchy": hierarchy, "calculation": calculate}[shape(name)]
    return run(table, **options)


def calculate(bars: DataFrame, code: str, order: str, value: str, short: int = 12, long: int = 26) -> DataFrame:
    """ma, lower and upper band, and the difference of two exponential means, beside the bars."""
    low, high = band(value, short, 2.0, code, order)
    return bars.withColumns({"ma": moving(value, short, code, order), "lower": low, "upper": high, "dif": smoothed(value, short, code, order) - smoothed(value, long, code, order)})
