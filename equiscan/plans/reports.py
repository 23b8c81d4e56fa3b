"""Report tables on top of the scores, the backtest and the price series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiscan.functions import append_market_digit, clip, safe_divide
from equiscan.operators.aggregates import backtest_dashboard, sector_scores, sector_signal_pivot, weighted_mean
from equiscan.operators.filters import active, lookback, signalled
from equiscan.operators.joins import attach_single_row, keep_listed
from equiscan.operators.ranking import score_order, top_per_class, top_scored
from equiscan.operators.windows import Slide, sliding, tail_rows
from equiscan.plans.integrate import RANKING_COLUMNS

# Report sizes.
SCREENING_ROWS = 200
DASHBOARD_ROWS = 300
MATRIX_STOCKS = 50
MATRIX_SESSIONS = 60
HISTORY_ROWS = 3000

SCREENING_COLUMNS = [
    "code", "company_name", "sector33_name", "latest_close", "avg_turnover_20d_oku", "liquidity_grade",
    "volatility_score", "chart_score", "kubota_trade_score", "sales_cagr_3y_pct", "op_cagr_3y_pct", "roe_pct",
    "roic_pct", "growth_invest_score", "per", "pbr", "market_phase", "kubota_signal", "screening_status",
    "next_earnings_date", "days_to_earnings",
]
DASHBOARD_COLUMNS = [
    "code", "company_name", "sector33_name", "latest_close", "avg_turnover_20d_oku", "liquidity_grade",
    "volatility_score", "chart_score", "kubota_trade_score", "sales_cagr_3y_pct", "op_cagr_3y_pct", "roe_pct",
    "roic_pct", "growth_invest_score", "per", "pbr", "market_phase", "kubota_signal", "signal_confidence",
    "screening_status", "next_earnings_date", "days_to_earnings", "atr_pct", "ma200_trend", "price_vs_ma200",
    "consolidation", "volume_surge", "volume_ratio", "hv_contraction", "price_strength_score",
]
SIGNAL_COLUMNS = [
    "code", "company_name", "sector33_name", "latest_close", "avg_turnover_20d_oku", "liquidity_grade",
    "volatility_score", "chart_score", "kubota_trade_score", "sales_cagr_3y_pct", "roe_pct",
    "growth_invest_score", "per", "pbr", "kubota_signal", "market_phase", "next_earnings_date", "days_to_earnings",
]
TREND_COLUMNS = [
    "snapshot_date", "code", "company_name", "sector33_name", "latest_close",
    "kubota_trade_score", "growth_invest_score", "kubota_signal", "market_phase",
]
BACKTEST_COLUMNS = [
    "signal_date", "code", "atr_pct", "hv_20d_pct", "hv_60d_pct", "range_contraction",
    "return_5d_pct", "return_10d_pct", "return_20d_pct", "win_5d", "win_10d", "win_20d",
]


def screening(scores: DataFrame) -> DataFrame:
    return top_scored(active(scores).select(*SCREENING_COLUMNS), SCREENING_ROWS)


def screening_dashboard(scores: DataFrame) -> DataFrame:
    return top_scored(active(scores).select(*DASHBOARD_COLUMNS), DASHBOARD_ROWS)


def signals(scores: DataFrame) -> DataFrame:
    return signalled(scores).select(*SIGNAL_COLUMNS).orderBy(*score_order())


def market(state: DataFrame) -> DataFrame:
    """Market state with the distance from its mean and a label per score."""
    diff = F.col("topix_close") - F.col("topix_ma200")
    score = F.col("environment_score")
    bull = (F.col("market_phase") == "BULL") & (score >= 3)
    bear = (F.col("market_phase") == "BEAR") | (score <= 1)
    return state.select(
        "date", "topix_close", "topix_ma200", "market_phase", "environment_score",
        diff.alias("ma200_diff"),
        (safe_divide(diff, F.col("topix_ma200")) * 100).alias("ma200_diff_pct"),
        F.when(score >= 3, "good").when(score >= 2, "neutral").otherwise("caution").alias("environment_label"),
        F.when(F.col("topix_close") > F.col("topix_ma200"), "above").otherwise("below").alias("position"),
        F.when(bull, "aggressive").when(bear, "careful").otherwise("selective").alias("stance"),
    )


def last_year(signals_: DataFrame, as_of: date) -> DataFrame:
    return lookback(signals_, as_of, 365, "signal_date")


def backtest_rows(signals_: DataFrame, as_of: date) -> DataFrame:
    return last_year(signals_, as_of).select(*BACKTEST_COLUMNS).orderBy(F.col("signal_date").desc(), "code")


def backtest_summary(signals_: DataFrame, as_of: date) -> DataFrame:
    return backtest_dashboard(last_year(signals_, as_of))


def score_trend(history: DataFrame, as_of: date) -> DataFrame:
    """Newest 30 days of snapshots, best scores first within a day."""
    return (
        lookback(history, as_of, 30, "snapshot_date").select(*TREND_COLUMNS)
        .orderBy(F.col("snapshot_date").desc(), *score_order()).limit(HISTORY_ROWS)
    )


def code_history(history: DataFrame, code: str | None = None) -> DataFrame:
    """Snapshots of one stock, or of all, in time order."""
    if code is not None:
        history = history.filter(F.col("code") == code)
    return history.select(
        "code", "snapshot_date", "kubota_trade_score", "growth_invest_score", "kubota_signal", "latest_close"
    ).orderBy("code", "snapshot_date")


def price_long(bars: DataFrame, master: DataFrame, scores: DataFrame, as_of: date) -> DataFrame:
    """Closes of the 50 best active stocks over 90 days."""
    best = top_scored(active(scores).select("code", "kubota_trade_score", "growth_invest_score"), MATRIX_STOCKS)
    recent = lookback(bars, as_of, 90).filter(F.col("close").isNotNull()).select("date", "code", "close")
    # Both the chosen codes and the master are keyed by code; semi-join first, so only chosen bars travel on.
    return keep_listed(recent, best).join(
        master.select("code", "company_name", "sector33_name"), "code"
    ).select("date", "code", "company_name", "sector33_name", F.round("close", 1).alias("close"))


def latest_dates(long_: DataFrame, n: int) -> list[date]:
    """The newest ``n`` dates, oldest first. At most ``n`` values reach the driver."""
    rows = long_.select("date").distinct().orderBy(F.col("date").desc()).limit(n).collect()
    return sorted(r["date"] for r in rows)


def pivot_close(long_: DataFrame, dates: list[date]) -> DataFrame:
    """Stock by date matrix of closes. The date list is given, so the pivot is one plain aggregate."""
    labelled = long_.filter(F.col("date").isin(dates)).select(
        F.concat_ws("_", "code", "company_name").alias("stock"),
        F.coalesce("sector33_name", F.lit("")).alias("sector"),
        F.date_format("date", "yyyy-MM-dd").alias("day"),
        "close",
    )
    return labelled.groupBy("stock", "sector").pivot("day", [d.isoformat() for d in dates]).agg(F.first("close"))


def price_matrix(bars: DataFrame, master: DataFrame, scores: DataFrame, as_of: date) -> DataFrame:
    long_ = price_long(bars, master, scores, as_of)
    return pivot_close(long_, latest_dates(long_, MATRIX_SESSIONS))


def return_histogram(signals_: DataFrame, bins: int = 40) -> DataFrame:
    """20-session returns in equal bins between the smallest and the largest.

    Returns are rounded to 0.01, so counting distinct values first leaves a small table that both the
    bounds and the bins are read from.
    """
    counts = (
        signals_.filter(F.col("return_20d_pct").isNotNull()).groupBy("return_20d_pct").agg(F.count("*").alias("n"))
    )
    bounds = counts.agg(F.min("return_20d_pct").alias("lo"), F.max("return_20d_pct").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    place = F.floor(F.coalesce(safe_divide((F.col("return_20d_pct") - lo) * bins, hi - lo), F.lit(0.0))) + 1
    return (
        attach_single_row(counts, bounds, required=False)
        .groupBy(F.least(place, F.lit(bins)).cast("int").alias("bin"), "lo", "hi")
        .agg(F.sum("n").alias("n"))
        .select(
            "bin",
            (lo + (F.col("bin") - 1) * (hi - lo) / bins).alias("bin_from"),
            (lo + F.col("bin") * (hi - lo) / bins).alias("bin_to"),
            "n",
        )
    )


def return_quartiles(signals_: DataFrame) -> DataFrame:
    """Quartiles of each horizon over signals that have all three returns.

    Counting per rounded value first keeps what the exact percentile has to hold small.
    """
    horizons = ["return_5d_pct", "return_10d_pct", "return_20d_pct"]
    complete = signals_.select(*horizons).dropna()
    counts = complete.unpivot([], horizons, "horizon", "value").groupBy("horizon", "value").agg(
        F.count("*").alias("n")
    )
    q = F.percentile("value", [0.25, 0.5, 0.75], F.col("n"))
    return counts.groupBy("horizon").agg(
        F.min("value").alias("min"), q.alias("q"), F.max("value").alias("max"), F.sum("n").alias("n")
    ).select(
        "horizon", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max", "n"
    )


def monthly_return(index_bars: DataFrame, months: int = 24) -> DataFrame:
    """Change between month-end closes, newest ``months`` per index.

    The month-end aggregate runs first, so the window sees one row per month.
    """
    w = Window.partitionBy("index_code").orderBy("m")
    back = Window.partitionBy("index_code").orderBy(F.col("m").desc())
    change = safe_divide("last_close", F.lag("last_close").over(w)) - 1
    return (
        index_bars.groupBy("index_code", F.trunc("date", "month").alias("m"))
        .agg(F.max_by("close", "date").alias("last_close"))
        .withColumn("monthly_return", change)
        .filter(F.col("monthly_return").isNotNull())
        .withColumn("r", F.row_number().over(back))
        .filter(F.col("r") <= months)
        .select("index_code", F.last_day("m").alias("month_end"), "monthly_return")
    )


def price_history(
    bars: DataFrame, as_of: date, code: str | None = None, days: int = 400, tail: int | None = None
) -> DataFrame:
    """Bars with full-window means and an up/down flag; of one stock, or of all.

    ``tail`` keeps the newest sessions first and averages only those, as a chart of a period does.
    """
    recent = lookback(bars, as_of, days)
    if code is not None:
        recent = recent.filter(F.col("code") == append_market_digit(F.lit(code)))
    recent = recent.select("code", "date", "open", "high", "low", "close", "volume", "turnover_value")
    if tail is not None:
        recent = tail_rows(recent, tail)
    framed = sliding(recent, {f"ma{k}": Slide("full_avg", "close", k) for k in (25, 75, 200)})
    return framed.withColumn("is_up", F.col("close") >= F.col("open"))


def index_history(index_bars: DataFrame, as_of: date, days: int = 500, tail: int | None = None) -> DataFrame:
    """Index bars with full-window means taken before the tail is cut."""
    recent = lookback(index_bars, as_of, days).select("index_code", "date", "open", "high", "low", "close")
    out = sliding(recent, {f"ma{k}": Slide("full_avg", "close", k) for k in (25, 75, 200)}, "index_code")
    if tail is not None:
        out = tail_rows(out, tail, "index_code")
    return out


def sector_signal_map(scores: DataFrame) -> DataFrame:
    return sector_signal_pivot(scores)


def sector_score_table(scores: DataFrame) -> DataFrame:
    return sector_scores(scores)


def heat_value(mode: str = "signal") -> Column:
    """Colour value of a stock: its signal, or one of the two scores."""
    if mode == "signal":
        signal = F.col("kubota_signal")
        # Colour levels.
        return F.when(signal == "buy_signal", 10.0).when(signal == "wait", 4.0).otherwise(-3.0)
    column = {"trade": "kubota_trade_score", "growth": "growth_invest_score"}[mode]
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def heatmap_cells(scores: DataFrame, mode: str = "signal") -> DataFrame:
    size = clip(F.coalesce("avg_turnover_20d_oku", F.lit(0.1)), low=0.1)
    return scores.select(
        "code",
        "company_name",
        F.coalesce("sector33_name", F.lit("その他")).alias("sector"),
        size.alias("size"),
        heat_value(mode).alias("color"),
        # Label sizes by turnover.
        F.when(size >= 50, 13).when(size >= 15, 11).when(size >= 4, 10).otherwise(9).alias("font_size"),
    )


def sector_heatmap(scores: DataFrame, mode: str = "signal") -> DataFrame:
    """Cells with the turnover-weighted colour of their sector.

    The sector means come from a grouped aggregate and a join, not from a window over the sector: one
    sector may hold a large share of all stocks.
    """
    cells = heatmap_cells(scores, mode)
    means = weighted_mean(cells, "sector", "color", "size", "sector_color")
    return cells.join(means, "sector", "left")


def trade_levels(scores: DataFrame) -> DataFrame:
    """Stop and target prices, the earnings flag and the stars of a buy candidate."""
    close = F.col("latest_close")
    atr = close * (F.col("atr_pct") / 100)
    days, score = F.col("days_to_earnings"), F.col("kubota_trade_score")
    return scores.select(
        "code",
        "kubota_signal",
        "latest_close",
        F.round(close - 2 * atr, 0).alias("stop_price"),
        F.round(close + 3 * atr, 0).alias("target_price"),
        F.when(days <= 10, "near").when(days <= 20, "soon").alias("earnings_flag"),
        F.when(score >= 9, 3).when(score >= 7, 2).otherwise(1).alias("stars"),
    )


def buy_checklist(scores: DataFrame) -> DataFrame:
    """Ten conditions per stock; an unknown value fails its check, except an unknown earnings date."""

    def yes(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    grade = F.col("liquidity_grade")
    checks = {
        "market_bull": yes(F.col("market_phase") == "BULL"),
        "trend_up": yes(F.col("ma200_trend") == "UP"),
        "above_ma200": yes(F.col("price_vs_ma200") == "ABOVE"),
        "consolidating": yes(F.col("consolidation")),
        "volume_surging": yes(F.col("volume_surge")),
        "liquid": yes(grade.isin("A", "B", "C", "PASS_A", "PASS_B", "PASS_C")),
        "sales_growing": yes(F.col("sales_cagr_3y_pct") >= 5),
        "roe_good": yes(F.col("roe_pct") >= 10),
        "healthy": yes(F.col("financial_health") == "PASS"),
        "earnings_far": F.col("days_to_earnings").isNull() | (F.col("days_to_earnings") > 20),
    }
    passed = sum((c.cast("int") for c in list(checks.values())[1:]), list(checks.values())[0].cast("int"))
    return scores.select("code", *[c.alias(n) for n, c in checks.items()], passed.alias("passed"))


def signal_counts(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("stock_count"),
        F.count_if(F.col("kubota_signal") == "buy_signal").alias("buy_count"),
        F.count_if(F.col("kubota_signal") == "wait").alias("wait_count"),
        F.avg("kubota_trade_score").alias("avg_trade_score"),
    )


def action_board(scores: DataFrame) -> DataFrame:
    """First five buys and the first three waiting stocks with a score of 7 or more."""
    board = scores.filter((F.col("kubota_signal") == "buy_signal") | (F.col("kubota_trade_score") >= 7))
    # Rows shown per class.
    return top_per_class(board, "kubota_signal", {"buy_signal": 5, "wait": 3})


def candidate_cards(scores: DataFrame) -> DataFrame:
    return top_per_class(scores, "kubota_signal", {"buy_signal": 9})


def cached_ranking(scores: DataFrame) -> DataFrame:
    """The 47 ranking columns, with the market column under its table name."""
    return scores.select(*RANKING_COLUMNS).withColumnRenamed("market_segment", "market_name")
