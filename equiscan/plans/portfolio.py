"""Positions, their valuation, and the rules that watch them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiscan.functions import bar_gauge, basis_code, clip, safe_divide
from equiscan.operators.aggregates import latest_fx, mean_by_local_code
from equiscan.operators.filters import lookback
from equiscan.operators.joins import attach_single_row, join_by_prefix, join_where, left_on

# Yen per dollar when no rate is known, and the unit count fund prices refer to.
DEFAULT_FX = 150.0
FUND_UNIT = 10_000
# Foreign tickers, and funds with the listed ETF that follows the same index.
US_TICKERS = ["GOOGL", "TSLA"]
FX_TICKER = "USDJPY=X"
FUND_PROXIES = {
    "eMAXIS Slim 米国株式(S&P500)": "2558.T",
    "eMAXIS Slim 全世界株式(オール・カントリー)(オルカン)": "2559.T",
    "eMAXIS Slim 国内株式(TOPIX)": "1306.T",
    "eMAXIS Slim 新興国株式インデックス": "1681.T",
    "iFree 日経225インデックス": "1321.T",
    "楽天・全米株式インデックス・ファンド(楽天・VTI)": "2554.T",
    "楽天・全米株式インデックス・ファンド（楽天・バンガード・ファンド（全米株式））": "2554.T",
    "SBIインド＆ベトナム株ファンド": "1678.T",
}
# Stop-loss distance of the fixed rule, and the ATR multiple of the moving one.
FIXED_STOP = 0.92
ATR_MULTIPLE = 2


def positions(trades: DataFrame) -> DataFrame:
    """Purchases to one row per code (or name, where there is no code).

    Descriptive columns come from the earliest trade; the remaining columns settle trades of one day.
    """
    label = F.struct("code", "company_name", "product_type", "account_type")
    first_order = F.struct("trade_date", "account_type", "company_name", "product_type", "quantity", "unit_price")
    per_10k = F.col("amount_unit") == "per_10k"
    # Whole amounts are summed before the division, so the total does not depend on their order.
    plain, scaled = F.sum(F.when(~per_10k, F.col("amount_native"))), F.sum(F.when(per_10k, F.col("amount_native")))
    native = F.coalesce(plain + scaled / FUND_UNIT, plain, scaled / FUND_UNIT)
    grouped = trades.groupBy(basis_code("code", "company_name").alias("key")).agg(
        F.min_by(label, first_order).alias("first"),
        F.sum("quantity").alias("shares"),
        F.sum("amount").alias("purchase_amount"),
        native.alias("purchase_amount_native"),
        F.min("trade_date").alias("purchase_date"),
        F.max("trade_date").alias("latest_purchase_date"),
        F.count("*").alias("tx_count"),
    )
    price = F.when(
        (F.col("shares") > 0) & (F.col("purchase_amount") != 0),
        F.round(F.col("purchase_amount") / F.col("shares"), 2),
    )
    return grouped.filter(F.col("key").isNotNull()).select(
        "first.*",
        "shares",
        price.alias("purchase_price"),
        "purchase_date",
        "latest_purchase_date",
        "purchase_amount",
        "purchase_amount_native",
        F.when(F.col("first.product_type") == "us", "usd").otherwise("jpy").alias("amount_unit"),
        "tx_count",
    )


def native_cost() -> Column:
    """Cost in the currency of the holding; per-10,000-unit amounts are brought to yen."""
    return F.when(
        F.col("amount_unit") == "per_10k", F.col("purchase_amount_native") / FUND_UNIT
    ).otherwise(F.col("purchase_amount_native"))


def position_totals(holdings: DataFrame) -> DataFrame:
    """Shares, cost and dates by product, name, code and account; a NULL code is a group of its own."""
    return holdings.groupBy("product_type", "company_name", "code", "account_type").agg(
        F.sum("shares").alias("shares"),
        F.sum(native_cost()).alias("cost_native"),
        F.min("purchase_date").alias("first_buy_date"),
        F.max("latest_purchase_date").alias("last_buy_date"),
    )


def aggregate_positions(holdings: DataFrame) -> DataFrame:
    """Position totals with the average cost per share (per 10,000 units for funds)."""
    fund = F.col("product_type") == "fund"
    return position_totals(holdings).select(
        "product_type",
        "company_name",
        "code",
        "account_type",
        F.when(fund, F.round(F.col("shares") / FUND_UNIT, 4)).otherwise(F.col("shares")).alias("total_shares"),
        F.col("cost_native").alias("total_cost_orig"),
        F.when(fund, safe_divide(F.col("cost_native") * FUND_UNIT, F.col("shares")))
        .otherwise(safe_divide("cost_native", "shares"))
        .alias("avg_cost_orig"),
        "first_buy_date",
        "last_buy_date",
    )


def in_yen(totals: DataFrame, fx: DataFrame) -> DataFrame:
    """Convert dollar cost once, with the known rate or the default."""
    us, fund = F.col("product_type") == "us", F.col("product_type") == "fund"
    rate = F.coalesce(F.col("usdjpy_rate"), F.lit(DEFAULT_FX))
    return attach_single_row(totals, fx, required=False).withColumns(
        {
            "total_cost": F.when(us, F.round(F.col("total_cost_orig") * rate, 0))
            .when(fund, F.round("total_cost_orig", 0))
            .otherwise(F.col("total_cost_orig")),
            "avg_cost_per_share": F.when(us, F.round(F.col("avg_cost_orig") * rate, 0)).otherwise(
                F.col("avg_cost_orig")
            ),
        }
    )


SCORE_COLUMNS = [
    "kubota_signal",
    "kubota_trade_score",
    "growth_invest_score",
    "next_earnings_date",
    "days_to_earnings",
    "price_strength_score",
]


def holdings_summary(holdings: DataFrame, scores: DataFrame, external_prices: DataFrame) -> DataFrame:
    """Positions valued at the domestic, US or fund price, in that order of preference."""
    base = in_yen(aggregate_positions(holdings), latest_fx(external_prices))
    domestic = scores.select("code", F.col("latest_close").alias("px_domestic"), *SCORE_COLUMNS)
    us = external_prices.filter(F.col("asset_type") == "us").select("ticker", F.col("price_jpy").alias("px_us"))
    fund = external_prices.filter(F.col("asset_type") == "fund").select(
        "asset_name", F.col("price_jpy").alias("px_fund")
    )
    priced = join_by_prefix(base, domestic, only="domestic")
    priced = join_where(priced, us, "code", "ticker", only="us")
    priced = join_where(priced, fund, "company_name", "asset_name", only="fund")

    # A fund price is used only for funds, so one price serves all three results.
    price = F.coalesce("px_domestic", "px_us", "px_fund")
    value = F.col("total_shares") * price
    gain = value - F.col("total_cost")
    return priced.select(
        F.col("product_type").alias("product_category"),
        "company_name",
        "code",
        F.col("account_type").alias("account"),
        "total_shares",
        "total_cost",
        "avg_cost_per_share",
        "first_buy_date",
        "last_buy_date",
        price.alias("latest_close"),
        *SCORE_COLUMNS,
        F.round(value, 0).alias("current_value"),
        F.round(gain, 0).alias("unrealized_pnl"),
        F.when(
            F.col("total_cost") > 0, F.round(safe_divide(gain, F.col("total_cost")) * 100, 2)
        ).alias("return_pct"),
    )


def holdings_list(summary: DataFrame) -> DataFrame:
    """The summary under the column names the dashboard works with, sorted."""
    renamed = summary.withColumnsRenamed(
        {"total_shares": "shares", "avg_cost_per_share": "purchase_price", "total_cost": "purchase_amount"}
    )
    return renamed.orderBy(
        F.col("product_category").asc_nulls_first(), F.col("code").asc_nulls_first(), "company_name", "account"
    )


def with_atr(holdings: DataFrame, scores: DataFrame) -> DataFrame:
    """Holdings with the ATR of their stock: the mean over codes that share the four characters."""
    return left_on(holdings, mean_by_local_code(scores, "atr_pct"), "code")


# ---- prices from outside ----------------------------------------------------------------------


def last_quote(quotes: DataFrame, as_of: date, days: int = 5) -> DataFrame:
    """Newest close per ticker within the last few days."""
    return (
        lookback(quotes, as_of, days).groupBy("ticker").agg(F.max_by("close", "date").alias("close"))
    )


def external_us_price(quotes: DataFrame, tickers: DataFrame, as_of: date, fx_ticker: str = FX_TICKER) -> DataFrame:
    """Dollar prices of ``tickers`` and their yen value; NULL yen without a rate."""
    newest = last_quote(quotes, as_of)
    rate = newest.filter(F.col("ticker") == fx_ticker).agg(F.max("close").alias("usdjpy"))
    priced = newest.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    return attach_single_row(priced, rate, required=False).select(
        F.lit(as_of).alias("fetch_date"),
        "ticker",
        F.col("ticker").alias("asset_name"),
        F.lit("us").alias("asset_type"),
        F.round("close", 4).alias("price_original"),
        F.lit("USD").alias("currency"),
        F.round("usdjpy", 4).alias("usdjpy_rate"),
        F.round(F.col("close") * F.when(F.col("usdjpy") != 0, F.col("usdjpy")), 0).alias("price_jpy"),
    )


def fund_costs(holdings: DataFrame) -> DataFrame:
    """Average cost per 10,000 units and first purchase date by fund."""
    cost = F.when(F.col("amount_unit") == "per_10k", F.col("purchase_amount_native")).otherwise(
        F.col("purchase_amount_native") * FUND_UNIT
    )
    return (
        holdings.filter(F.col("product_type") == "fund")
        .groupBy("company_name")
        .agg(
            safe_divide(F.sum(cost), F.sum("shares")).alias("avg_cost"),
            F.min("purchase_date").alias("first_buy_date"),
        )
    )


def price_at(points: DataFrame, quotes: DataFrame, before: int = 10, after: int = 5) -> DataFrame:
    """As-of price for ``points(id, ticker, day)``: the first bar on or after the day within
    ``[day - before, day + after)``, else the last bar of that window.

    A merge of two sorted series: the days that are asked for are put among the quotes of their ticker, and one sort
    serves both frames, each a few calendar days long. A day of a ticker is asked for once, however many points
    share it, so a frame holds two rows a day at most. Points without any bar in the window keep a NULL price.

    Only quotes from the stretches of ``before + after`` days that a window reaches into, two of them, are merged.
    """
    def stretch(day: Column) -> Column:
        return F.floor(F.unix_date(day) / (before + after)).alias("_stretch")

    asked = points.select("ticker", F.col("day").alias("date")).distinct()
    reached = asked.select("ticker", stretch(F.date_sub("date", before))).union(
        asked.select("ticker", stretch(F.date_add("date", after - 1)))
    )
    near = quotes.select("ticker", "date", "close", stretch(F.col("date"))).join(reached.distinct(), ["ticker", "_stretch"], "left_semi")
    merged = near.select("ticker", "date", "close", F.lit(False).alias("asks")).union(
        asked.select("ticker", "date", F.lit(None).cast("double").alias("close"), F.lit(True).alias("asks"))
    )
    by_day = Window.partitionBy("ticker").orderBy(F.unix_date("date"))
    known = merged.filter(F.col("ticker").isNotNull() & F.col("date").isNotNull()).withColumns(
        {
            "_next": F.first("close", ignorenulls=True).over(by_day.rangeBetween(0, after - 1)),
            "_last": F.last("close", ignorenulls=True).over(by_day.rangeBetween(-before, -1)),
        }
    )
    found = known.filter("asks").select("ticker", F.col("date").alias("day"), F.coalesce("_next", "_last").alias("price"))
    return points.join(found, ["ticker", "day"], "left").select(*points.columns, "price")


def fund_nav(holdings: DataFrame, proxies: DataFrame, quotes: DataFrame, as_of: date) -> DataFrame:
    """Fund value estimated from its proxy: cost times the proxy's move since the first purchase."""
    costs = fund_costs(holdings).withColumnRenamed("company_name", "asset_name").join(proxies, "asset_name")
    points = costs.select(
        F.col("asset_name").alias("id"), F.col("proxy_ticker").alias("ticker"), F.col("first_buy_date").alias("day")
    )
    bought = price_at(points, quotes).select(F.col("id").alias("asset_name"), F.col("price").alias("at_buy"))
    now = last_quote(quotes, as_of).select(F.col("ticker").alias("proxy_ticker"), F.col("close").alias("proxy_now"))
    usable = (F.col("avg_cost") > 0) & (F.col("at_buy") != 0) & (F.col("proxy_now") != 0)
    nav = F.when(usable, F.round(F.col("avg_cost") * (F.col("proxy_now") / F.col("at_buy")), 1))
    return costs.join(bought, "asset_name", "left").join(now, "proxy_ticker", "left").select(
        F.lit(as_of).alias("fetch_date"),
        F.col("proxy_ticker").alias("ticker"),
        "asset_name",
        F.lit("fund").alias("asset_type"),
        nav.alias("price_original"),
        F.lit("JPY").alias("currency"),
        F.lit(None).cast("double").alias("usdjpy_rate"),
        nav.alias("price_jpy"),
    )


def external_prices(
    quotes: DataFrame, tickers: DataFrame, holdings: DataFrame, proxies: DataFrame, as_of: date
) -> DataFrame:
    """US and fund prices in one table."""
    return external_us_price(quotes, tickers, as_of).unionByName(fund_nav(holdings, proxies, quotes, as_of))


# ---- portfolio rules --------------------------------------------------------------------------


def _sum_or_zero(col: str, where: Column | None = None) -> Column:
    value = F.col(col) if where is None else F.when(where, F.col(col))
    return F.coalesce(F.sum(value), F.lit(0.0))


def portfolio_totals(summary: DataFrame) -> DataFrame:
    """One row. Sums and the mean return cover valued holdings, the count covers all."""
    valued = F.col("current_value").isNotNull()
    return summary.agg(
        _sum_or_zero("current_value", valued).alias("total_value"),
        _sum_or_zero("unrealized_pnl", valued).alias("total_pnl"),
        _sum_or_zero("total_cost", valued).alias("total_cost"),
        F.avg(F.when(valued, F.col("return_pct"))).alias("avg_return_pct"),
        F.count("*").alias("holding_count"),
    )


def category_totals(summary: DataFrame) -> DataFrame:
    """Sums per product category over valued holdings, with a return even where no row has one."""
    sums = (
        summary.filter(F.col("current_value").isNotNull())
        .groupBy("product_category")
        .agg(
            _sum_or_zero("current_value").alias("total_value"),
            _sum_or_zero("unrealized_pnl").alias("total_pnl"),
            _sum_or_zero("total_cost").alias("total_cost"),
            F.round(F.avg("return_pct"), 2).alias("mean_return"),
            F.count("*").alias("holding_count"),
        )
    )
    fallback = F.when(
        F.col("total_cost") > 0,
        F.round((F.col("total_value") - F.col("total_cost")) / F.col("total_cost") * 100, 2),
    )
    return sums.select(
        "product_category", "total_value", "total_pnl", "total_cost",
        F.coalesce("mean_return", fallback).alias("return_pct"), "holding_count",
    )


def action_rule() -> Column:
    """First rule that applies."""
    return (
        F.when(F.col("return_pct") < -8, "stop_loss")
        .when(F.col("days_to_earnings") <= 14, "earnings_caution")
        .when(F.col("return_pct") >= 20, "take_profit")
        .when(F.col("kubota_signal") == "buy_signal", "keep")
        .otherwise("watch")
    )


def holding_action(summary: DataFrame) -> DataFrame:
    return summary.withColumn("action", action_rule())


def stop_price(cost: Column, close: Column, atr_pct: Column | None) -> Column:
    """Moving stop where an ATR is given and positive, else the fixed one."""
    fixed = cost * FIXED_STOP
    known = cost.isNotNull() & close.isNotNull()
    if atr_pct is None:
        return F.when(known, fixed)
    moving = close * (1 - atr_pct / 100 * ATR_MULTIPLE)
    return F.when(known, F.when(atr_pct > 0, moving).otherwise(fixed))


def stop_distance(close: Column, stop: Column) -> Column:
    return F.when(stop > 0, (close - stop) / stop * 100)


def stop_status(close: Column, stop: Column) -> Column:
    distance = stop_distance(close, stop)
    return (
        F.when(distance.isNull(), "UNKNOWN")
        .when(close <= stop, "BREACHED")
        .when(distance <= 3, "CRITICAL")
        .when(distance <= 7, "WARNING")
        .otherwise("SAFE")
    )


def stop_loss(holdings: DataFrame, use_atr: bool = True) -> DataFrame:
    """Stop price, distance and status for rows with ``purchase_price``, ``latest_close`` and ``atr_pct``."""
    close = F.col("latest_close")
    stop = stop_price(F.col("purchase_price"), close, F.col("atr_pct") if use_atr else None)
    return holdings.withColumn("stop_price", stop).withColumns(
        {
            "distance_pct": stop_distance(close, F.col("stop_price")),
            "stop_status": stop_status(close, F.col("stop_price")),
        }
    )


def stop_loss_table(holdings: DataFrame, use_atr: bool = True) -> DataFrame:
    """Domestic holdings with cost and price, their stop and a 0–100 gauge."""
    domestic = holdings.filter(
        (F.col("product_category") == "domestic")
        & F.col("purchase_price").isNotNull()
        & F.col("latest_close").isNotNull()
    )
    return stop_loss(domestic, use_atr).withColumn("gauge", bar_gauge("distance_pct"))


def holding_alerts(holdings: DataFrame) -> DataFrame:
    """Holdings that need a decision, most urgent first; quiet holdings have no row."""
    cost, close, atr = F.col("purchase_price"), F.col("latest_close"), F.col("atr_pct")
    moving, fixed = stop_price(cost, close, atr), stop_price(cost, close, None)
    by_atr = atr.isNotNull() & stop_distance(close, moving).isNotNull()
    status = F.when(by_atr, stop_status(close, moving)).otherwise(stop_status(close, fixed))
    distance = F.when(by_atr, stop_distance(close, moving)).otherwise(stop_distance(close, fixed))
    priority = (
        F.when(F.col("effective_status") == "BREACHED", 0)
        .when(F.col("effective_status") == "CRITICAL", 1)
        .when(F.col("return_pct") >= 20, 2)
        .when(F.col("days_to_earnings") <= 7, 3)
        .when(F.col("days_to_earnings") <= 14, 4)
        .when(F.col("effective_status") == "WARNING", 5)
    )
    return (
        holdings.withColumns({"effective_status": status, "effective_distance_pct": distance})
        .withColumn("priority", priority)
        .filter(F.col("priority").isNotNull())
        .orderBy("priority", F.col("code").asc_nulls_last(), "company_name", "account")
    )


def pnl_band(pct: Column) -> Column:
    """Bands at 10, 0 and -5 percent."""
    return (
        F.when(pct.isNull(), "none").when(pct >= 10, "high").when(pct >= 0, "gain").when(pct >= -5, "dip").otherwise("loss")
    )


def price_vs_cost(holdings: DataFrame, bars: DataFrame, as_of: date, days: int = 400) -> DataFrame:
    """Newest close of each domestic holding against its cost."""
    newest = lookback(bars, as_of, days).groupBy("code").agg(F.max_by("close", "date").alias("last_close"))
    domestic = holdings.filter(F.col("product_category") == "domestic").withColumn(
        "product_type", F.col("product_category")
    )
    met = join_by_prefix(domestic, newest, only="domestic").drop("product_type")
    diff = F.col("last_close") - F.col("purchase_price")
    pct = safe_divide(diff, F.col("purchase_price")) * 100
    return met.select(
        "code", "company_name", "account", "purchase_price", "last_close",
        diff.alias("diff"), pct.alias("diff_pct"), pnl_band(pct).alias("band"),
    )


def goal_progress(totals: DataFrame, target: float = 10_000.0) -> DataFrame:
    """Share of the goal reached. Total and target are in units of 10,000 yen."""
    current = F.floor(F.col("total_value") / 10_000).cast("bigint")
    return totals.select(
        current.alias("current"),
        F.lit(float(target)).alias("target"),
        clip(current / F.lit(float(target)) * 100, high=100).alias("progress_pct"),
        F.greatest(F.lit(float(target)) - current, F.lit(0.0)).alias("remaining"),
    )


