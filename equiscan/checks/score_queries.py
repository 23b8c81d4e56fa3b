"""Scores, signals and the reports on them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from equiscan.checks import job_queries
from equiscan.checks.ctes import AS_OF as AS_OF_SQL
from equiscan.checks.ctes import div, r
from equiscan.checks.desk import PREVIOUS
from equiscan.checks.registry import query, rounded
from equiscan.operators import aggregates, filters, joins, ranking, windows
from equiscan.plans import backtest, daily_state, fundamentals, indicators, integrate, reports
from equiscan.session import staged
from equiscan.sinks import tables
from equiscan.sources.derived import AS_OF

SCORE_ORDER = "ORDER BY kubota_trade_score DESC NULLS LAST, growth_invest_score DESC NULLS LAST, code"
YEAR = f"signal_date BETWEEN {AS_OF_SQL} - 365 AND {AS_OF_SQL}"


def columns(names: list[str]) -> str:
    return ", ".join(names)


# ---- 2.12 scores ------------------------------------------------------------------------------


@query("liquidity", "SELECT * FROM liquidity")
def _(d):
    return indicators.liquidity(d.daily_bars(), AS_OF)


@query("volatility", "SELECT * FROM volatility")
def _(d):
    return indicators.volatility(d.daily_bars(), AS_OF)


@query("chart", "SELECT * FROM chart")
def _(d):
    return indicators.chart(d.daily_bars(), AS_OF)


@query(
    "fundamental",
    f"SELECT * REPLACE ({r('eps', 4)} AS eps, {r('bps', 4)} AS bps) FROM fundamental",
)
def _(d):
    return rounded(fundamentals.fundamental(d.financial_summary()))


@query("valuation", f"SELECT * REPLACE ({r('sector_avg_per', 4)} AS sector_avg_per) FROM valuation")
def _(d):
    prices = indicators.latest_price(d.daily_bars(), AS_OF)
    return rounded(
        fundamentals.valuation(prices, fundamentals.fundamental(d.financial_summary()), d.equity_master())
    )


@query("market_environment", "SELECT * FROM market_environment")
def _(d):
    return indicators.market_environment(d.index_bars(), AS_OF)


@query("earnings_next", "SELECT * FROM earnings_next")
def _(d):
    return fundamentals.earnings_next(d.earnings_calendar(), AS_OF)


@query("integrated_score", f"SELECT {columns(integrate.RANKING_COLUMNS)}, signal_confidence FROM integrated")
def _(d):
    return d.integrated()


@query("integrated_score_daily", f"SELECT {columns(integrate.RANKING_COLUMNS)}, signal_confidence FROM integrated")
def _(d):
    """The state of an earlier day is stored, brought forward twice, and scored: the same rows as from all bars."""
    table = job_queries.scratch_table(d, "price_state")
    for day in (PREVIOUS, AS_OF - timedelta(days=2), AS_OF):
        state = daily_state.bring_forward(d.daily_bars(), table, day)
    return integrate.integrated(
        daily_state.all_indicators(state, AS_OF), daily_state.latest_price(state, AS_OF), d.financial_summary(), d.earnings_calendar(),
        d.index_bars(), d.equity_master(), AS_OF,
    )


@query("signal_rule", "SELECT code, kubota_signal, screening_status FROM integrated")
def _(d):
    return d.scores().select(
        "code", integrate.signal_rule().alias("kubota_signal"), integrate.status_rule().alias("screening_status")
    )


@query("backtest_signals", "SELECT * FROM backtest")
def _(d):
    return backtest.ordered(backtest.backtest_signals(d.daily_bars(), d.equity_master(), AS_OF))


@query(
    "score_history",
    "SELECT code, snapshot_date, kubota_trade_score, growth_invest_score, kubota_signal, latest_close FROM score_history",
)
def _(d):
    return reports.code_history(d.score_history())


# ---- 2.3 filters over scores -------------------------------------------------------------------


@query("status_filter", "SELECT code, screening_status, kubota_signal FROM integrated WHERE screening_status = 'ACTIVE' AND kubota_signal <> '-'")
def _(d):
    return filters.signalled(filters.active(d.scores())).select("code", "screening_status", "kubota_signal")


@query(
    "ui_filter",
    "SELECT code, sector33_name, kubota_trade_score FROM integrated WHERE kubota_trade_score >= 4 "
    "AND growth_invest_score >= 5 AND kubota_signal = 'wait'",
)
def _(d):
    return filters.screen(d.scores(), min_trade_score=4, min_growth_score=5, signal="wait").select(
        "code", "sector33_name", "kubota_trade_score"
    )


@query(
    "text_search",
    "SELECT code, company_name FROM equity_master WHERE regexp_matches(code, '(?i)SUPPLIER#0+[1-9]|50$') "
    "OR regexp_matches(company_name, '(?i)SUPPLIER#0+[1-9]|50$')",
)
def _(d):
    return filters.text_search(d.equity_master().select("code", "company_name"), "SUPPLIER#0+[1-9]|50$")


# ---- 2.4 joins ---------------------------------------------------------------------------------


@query(
    "join_inner",
    "SELECT b.code, b.date, b.close, m.sector33_name FROM daily_bars b JOIN equity_master m ON b.code = m.code "
    "WHERE m.market_name LIKE '%プライム%'",
)
def _(d):
    prime = d.equity_master().filter(F.col("market_name").contains(integrate.PRIME)).select("code", "sector33_name")
    return d.daily_bars().select("code", "date", "close").join(prime, "code")


@query(
    "join_left_1to1",
    "SELECT m.code, m.market_name, f.roe_score, e.days_to_earnings, p.close FROM equity_master m "
    "LEFT JOIN fundamental f ON f.code = m.code LEFT JOIN earnings_next e ON e.code = m.code "
    "LEFT JOIN latest_price p ON p.code = m.code",
)
def _(d):
    sides = [
        fundamentals.fundamental(d.financial_summary()).select("code", "roe_score"),
        fundamentals.earnings_next(d.earnings_calendar(), AS_OF).select("code", "days_to_earnings"),
        indicators.latest_price(d.daily_bars(), AS_OF).select("code", "close"),
    ]
    return joins.left_chain(d.equity_master().select("code", "market_name"), sides)


@query(
    "join_left_lag_year",
    "SELECT a.code, a.disc_year, a.net_sales, b.net_sales AS net_sales_3y_ago, b.operating_profit AS operating_profit_3y_ago "
    "FROM annual a LEFT JOIN annual b ON a.code = b.code AND a.disc_year = b.disc_year + 3",
)
def _(d):
    annual = fundamentals.annual_results(d.financial_summary()).select(
        "code", "disc_year", "net_sales", "operating_profit"
    )
    return joins.lag_year(annual, ["net_sales", "operating_profit"]).drop("operating_profit")


@query(
    "join_cross_1row",
    "SELECT m.code, e.market_phase, e.environment_score FROM equity_master m CROSS JOIN market_environment e",
)
def _(d):
    state = indicators.market_environment(d.index_bars(), AS_OF).select("market_phase", "environment_score")
    return joins.attach_single_row(d.equity_master().select("code"), state, required=True)


@query(
    "semi_topn",
    f"SELECT code, date, close FROM daily_bars WHERE code IN (SELECT code FROM integrated "
    f"WHERE screening_status = 'ACTIVE' {SCORE_ORDER} LIMIT 50)",
)
def _(d):
    best = ranking.top_scored(filters.active(d.scores()).select("code", "kubota_trade_score", "growth_invest_score"), 50)
    return joins.keep_listed(d.daily_bars().select("code", "date", "close"), best)


@query(
    "anti_once",
    "SELECT i.code, i.snapshot_date FROM (SELECT code, DATE '2001-06-30' AS snapshot_date FROM integrated "
    "UNION ALL SELECT code, DATE '2001-07-01' FROM integrated) i WHERE i.snapshot_date NOT IN "
    "(SELECT snapshot_date FROM score_history)",
)
def _(d):
    days = F.explode(F.array(F.lit(AS_OF), F.lit(AS_OF + timedelta(days=1))))
    due = d.scores().select("code", days.alias("snapshot_date"))
    return joins.drop_listed(due, d.score_history().select("snapshot_date").distinct(), ["snapshot_date"])


# ---- 2.5 aggregates over scores ----------------------------------------------------------------


@query("agg_sector_per", f"SELECT sector33_name, {r('sector_avg_per', 4)} AS sector_avg_per FROM sector_avg")
def _(d):
    prices = indicators.latest_price(d.daily_bars(), AS_OF)
    base = fundamentals.valued(prices, fundamentals.fundamental(d.financial_summary()), d.equity_master())
    return rounded(aggregates.sector_average_per(base.filter("listed")))


BACKTEST_SQL = f"""
    SELECT count(*) AS total_signals, min(signal_date) AS earliest_signal, max(signal_date) AS latest_signal,
           {r('avg(win_5d) * 100', 1)} AS win_rate_5d_pct, {r('avg(return_5d_pct)', 2)} AS avg_return_5d_pct,
           {r('avg(win_10d) * 100', 1)} AS win_rate_10d_pct, {r('avg(return_10d_pct)', 2)} AS avg_return_10d_pct,
           {r('avg(win_20d) * 100', 1)} AS win_rate_20d_pct, {r('avg(return_20d_pct)', 2)} AS avg_return_20d_pct,
           {r('min(return_20d_pct)', 2)} AS min_return_20d_pct, {r('max(return_20d_pct)', 2)} AS max_return_20d_pct,
           {r('stddev_samp(return_20d_pct)', 2)} AS std_return_20d_pct
    FROM backtest WHERE {YEAR}"""


@query("agg_backtest", BACKTEST_SQL)
def _(d):
    return aggregates.backtest_statistics(reports.last_year(d.signals(), AS_OF))


BACKTEST_UI_SQL = f"""
    SELECT count(*) AS total_signals,
           {r('avg(win_5d) * 100', 4)} AS win_rate_5d_pct, {r('avg(return_5d_pct)', 4)} AS avg_return_5d_pct,
           {r('avg(win_10d) * 100', 4)} AS win_rate_10d_pct, {r('avg(return_10d_pct)', 4)} AS avg_return_10d_pct,
           {r('avg(win_20d) * 100', 4)} AS win_rate_20d_pct, {r('avg(return_20d_pct)', 4)} AS avg_return_20d_pct,
           max(return_20d_pct) AS max_return_20d_pct, min(return_20d_pct) AS min_return_20d_pct,
           {r('stddev_samp(return_20d_pct)', 4)} AS std_return_20d_pct,
           {r("sum(return_20d_pct) FILTER (return_20d_pct > 0) / NULLIF(abs(sum(return_20d_pct) FILTER (return_20d_pct < 0)), 0)", 4)}
             AS profit_factor
    FROM backtest WHERE {YEAR}"""


@query("agg_backtest_ui", BACKTEST_UI_SQL)
def _(d):
    return rounded(aggregates.backtest_dashboard(reports.last_year(d.signals(), AS_OF)))


SECTOR_SCORES_SQL = f"""
    SELECT sector33_name, count(code) AS stock_count, {r('avg(kubota_trade_score)', 4)} AS avg_trade_score,
           {r('avg(growth_invest_score)', 4)} AS avg_growth_score,
           count(*) FILTER (kubota_signal = 'buy_signal') AS entry_count
    FROM integrated GROUP BY sector33_name"""


@query("agg_sector_scores", SECTOR_SCORES_SQL)
def _(d):
    return rounded(aggregates.sector_scores(d.scores()))


CELLS_SQL = """
    SELECT code, company_name, coalesce(sector33_name, 'その他') AS sector,
           greatest(coalesce(avg_turnover_20d_oku, 0.1), 0.1) AS size,
           CAST(CASE kubota_signal WHEN 'buy_signal' THEN 10 WHEN 'wait' THEN 4 ELSE -3 END AS DOUBLE) AS color
    FROM integrated"""


@query(
    "agg_weighted",
    f"SELECT sector, {r('sum(color * size) / sum(size)', 4)} AS sector_color FROM cells GROUP BY sector",
    {"cells": CELLS_SQL},
)
def _(d):
    return rounded(aggregates.weighted_mean(reports.heatmap_cells(d.scores()), "sector", "color", "size", "sector_color"))


PIVOT_SQL = f"""
    SELECT sector33_name, count(*) FILTER (kubota_signal = 'buy_signal') AS buy_signal,
           count(*) FILTER (kubota_signal = 'wait') AS wait, count(*) FILTER (kubota_signal = '-') AS other,
           count(*) AS total, {r("100.0 * count(*) FILTER (kubota_signal = 'buy_signal') / count(*)", 4)} AS buy_share_pct
    FROM integrated GROUP BY sector33_name"""


@query("pivot_sector_signal", PIVOT_SQL)
def _(d):
    return rounded(aggregates.sector_signal_pivot(d.scores()))


# ---- 2.7 top-k ---------------------------------------------------------------------------------


@query("topn_ranking", f"SELECT code, kubota_trade_score, growth_invest_score FROM integrated {SCORE_ORDER} LIMIT 50")
def _(d):
    return ranking.top_scored(d.scores().select("code", "kubota_trade_score", "growth_invest_score"), 50)


TREND_SQL = (
    f"SELECT {columns(reports.TREND_COLUMNS)} FROM score_history "
    f"WHERE snapshot_date BETWEEN {AS_OF_SQL} - 30 AND {AS_OF_SQL} "
    "ORDER BY snapshot_date DESC, kubota_trade_score DESC NULLS LAST, growth_invest_score DESC NULLS LAST, code LIMIT 3000"
)


@query("topn_history", TREND_SQL.replace(columns(reports.TREND_COLUMNS), "snapshot_date, code, kubota_trade_score"))
def _(d):
    return reports.score_trend(d.score_history(), AS_OF).select("snapshot_date", "code", "kubota_trade_score")


@query("sort_only", f"SELECT signal_date, code, return_20d_pct FROM backtest ORDER BY signal_date DESC, code")
def _(d):
    return backtest.ordered(d.signals()).select("signal_date", "code", "return_20d_pct")


@query(
    "sort_priority_first",
    "SELECT code, kubota_signal, row_number() OVER (ORDER BY (kubota_signal = 'wait') DESC NULLS LAST, "
    "kubota_trade_score DESC NULLS LAST, growth_invest_score DESC NULLS LAST, code) AS place FROM integrated",
)
def _(d):
    """The place of a row is read off the sorted result: rows of the partitions before it and its place in its own."""
    ordered = ranking.signals_first(d.scores().select("code", "kubota_signal", "kubota_trade_score", "growth_invest_score"), "wait")
    ordered = staged(ordered.select("code", "kubota_signal", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")), "sorted")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition of the sort
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_part = F.col("id") - F.shiftleft(F.col("part").cast("long"), 33)
    places = ordered.join(sizes.select("part", before.alias("before")), "part")
    return places.select("code", "kubota_signal", (F.col("before") + in_part + 1).alias("place"))


@query(
    "topn_by_class",
    f"(SELECT code, kubota_signal FROM integrated WHERE kubota_signal = 'buy_signal' {SCORE_ORDER} LIMIT 5) UNION ALL "
    f"(SELECT code, kubota_signal FROM integrated WHERE kubota_signal = 'wait' AND kubota_trade_score >= 7 {SCORE_ORDER} LIMIT 3)",
)
def _(d):
    return reports.action_board(d.scores()).select("code", "kubota_signal")


# ---- 2.14 reports ------------------------------------------------------------------------------


@query(
    "report_screening",
    f"SELECT {columns(reports.SCREENING_COLUMNS)} FROM integrated WHERE screening_status = 'ACTIVE' {SCORE_ORDER} LIMIT 200",
)
def _(d):
    return reports.screening(d.integrated())


@query(
    "report_screening_ui",
    f"SELECT {columns(reports.DASHBOARD_COLUMNS)} FROM integrated WHERE screening_status = 'ACTIVE' {SCORE_ORDER} LIMIT 300",
)
def _(d):
    return reports.screening_dashboard(d.scores())


@query("report_signals", f"SELECT {columns(reports.SIGNAL_COLUMNS)} FROM integrated WHERE kubota_signal <> '-' {SCORE_ORDER}")
def _(d):
    return reports.signals(d.scores())


@query(
    "report_market",
    f"""SELECT date, topix_close, topix_ma200, market_phase, environment_score,
           {r('topix_close - topix_ma200', 4)} AS ma200_diff,
           {r('(topix_close - topix_ma200) / topix_ma200 * 100', 4)} AS ma200_diff_pct,
           CASE WHEN environment_score >= 3 THEN 'good' WHEN environment_score >= 2 THEN 'neutral' ELSE 'caution' END
             AS environment_label,
           CASE WHEN topix_close > topix_ma200 THEN 'above' ELSE 'below' END AS position,
           CASE WHEN market_phase = 'BULL' AND environment_score >= 3 THEN 'aggressive'
                WHEN market_phase = 'BEAR' OR environment_score <= 1 THEN 'careful' ELSE 'selective' END AS stance
    FROM market_environment""",
)
def _(d):
    return rounded(reports.market(indicators.market_environment(d.index_bars(), AS_OF)))


@query("report_backtest", BACKTEST_UI_SQL)
def _(d):
    return rounded(reports.backtest_summary(d.signals(), AS_OF))


@query(
    "report_backtest_rows",
    f"SELECT {columns(reports.BACKTEST_COLUMNS)} FROM backtest WHERE {YEAR} ORDER BY signal_date DESC, code",
)
def _(d):
    return reports.backtest_rows(d.signals(), AS_OF)


@query("report_score_trend", TREND_SQL)
def _(d):
    return reports.score_trend(d.score_history(), AS_OF)


SESSION_DATES = [AS_OF - timedelta(days=i * 7 // 5) for i in range(reports.MATRIX_SESSIONS)]
LONG_SQL = f"""
    SELECT b.date, b.code, m.company_name, m.sector33_name, {r('b.close', 1)} AS close
    FROM daily_bars b JOIN equity_master m ON b.code = m.code
    WHERE b.code IN (SELECT code FROM integrated WHERE screening_status = 'ACTIVE' {SCORE_ORDER} LIMIT 50)
      AND b.date BETWEEN {AS_OF_SQL} - 90 AND {AS_OF_SQL} AND b.close IS NOT NULL"""
MATRIX_CELLS = ", ".join(
    f"max(close) FILTER (date = DATE '{day}') AS \"{day}\"" for day in sorted(SESSION_DATES)
)
MATRIX_SQL = f"""
    SELECT concat(code, '_', company_name) AS stock, coalesce(sector33_name, '') AS sector, {MATRIX_CELLS}
    FROM price_long GROUP BY 1, 2"""


@query("report_price_matrix", MATRIX_SQL, {"price_long": LONG_SQL})
def _(d):
    return reports.price_matrix(d.daily_bars(), d.equity_master(), d.scores(), AS_OF)


@query("pivot_price", MATRIX_SQL, {"price_long": LONG_SQL})
def _(d):
    long_ = reports.price_long(d.daily_bars(), d.equity_master(), d.scores(), AS_OF)
    return reports.pivot_close(long_, reports.latest_dates(long_, reports.MATRIX_SESSIONS))


@query(
    "return_histogram",
    f"""SELECT bin, {r('lo + (bin - 1) * (hi - lo) / 40', 6)} AS bin_from, {r('lo + bin * (hi - lo) / 40', 6)} AS bin_to, count(*) AS n
    FROM (SELECT lo, hi, CAST(least(floor((return_20d_pct - lo) * 40 / (hi - lo)) + 1, 40) AS INTEGER) AS bin
          FROM backtest, (SELECT min(return_20d_pct) AS lo, max(return_20d_pct) AS hi FROM backtest)
          WHERE return_20d_pct IS NOT NULL) GROUP BY bin, lo, hi""",
)
def _(d):
    return rounded(reports.return_histogram(d.signals()), 6)


@query(
    "return_quartiles",
    f"""SELECT horizon, min(v) AS min, {r('quantile_cont(v, 0.25)', 4)} AS q1, {r('quantile_cont(v, 0.5)', 4)} AS median,
           {r('quantile_cont(v, 0.75)', 4)} AS q3, max(v) AS max, count(*) AS n
    FROM (SELECT unnest(['return_5d_pct', 'return_10d_pct', 'return_20d_pct']) AS horizon,
                 unnest([return_5d_pct, return_10d_pct, return_20d_pct]) AS v
          FROM backtest WHERE return_5d_pct IS NOT NULL AND return_10d_pct IS NOT NULL AND return_20d_pct IS NOT NULL)
    GROUP BY horizon""",
)
def _(d):
    return rounded(reports.return_quartiles(d.signals()))


@query(
    "monthly_return",
    f"""SELECT index_code, month_end, {r('monthly_return', 6)} AS monthly_return FROM (
      SELECT *, row_number() OVER (PARTITION BY index_code ORDER BY month_end DESC) AS rn FROM (
        SELECT index_code, last_day(m) AS month_end,
               c / lag(c) OVER (PARTITION BY index_code ORDER BY m) - 1 AS monthly_return
        FROM (SELECT index_code, date_trunc('month', date) AS m, arg_max(close, date) AS c FROM index_bars GROUP BY 1, 2))
      WHERE monthly_return IS NOT NULL) WHERE rn <= 24""",
)
def _(d):
    return rounded(reports.monthly_return(d.index_bars()), 6)


def _full(k: int, x: str = "close", w: str = "w") -> str:
    return (
        f"CASE WHEN count({x}) OVER ({w} ROWS {k - 1} PRECEDING) = {k} "
        f"THEN {r(f'avg({x}) OVER ({w} ROWS {k - 1} PRECEDING)', 4)} END AS ma{k}"
    )


@query(
    "price_history",
    f"""SELECT code, date, {r('open', 4)} AS open, {r('high', 4)} AS high, {r('low', 4)} AS low, {r('close', 4)} AS close,
           volume, turnover_value, {_full(25)}, {_full(75)}, {_full(200)}, close >= open AS is_up
    FROM daily_bars WHERE date BETWEEN {AS_OF_SQL} - 400 AND {AS_OF_SQL} WINDOW w AS (PARTITION BY code ORDER BY date)""",
)
def _(d):
    return rounded(reports.price_history(d.daily_bars(), AS_OF))


@query(
    "index_history",
    f"""SELECT index_code, date, {r('open', 4)} AS open, {r('high', 4)} AS high, {r('low', 4)} AS low, {r('close', 4)} AS close,
           ma25, ma75, ma200 FROM (
      SELECT *, {_full(25)}, {_full(75)}, {_full(200)}, row_number() OVER (PARTITION BY index_code ORDER BY date DESC) AS rn
      FROM index_bars WHERE date BETWEEN {AS_OF_SQL} - 500 AND {AS_OF_SQL}
      WINDOW w AS (PARTITION BY index_code ORDER BY date)) WHERE rn <= 252""",
)
def _(d):
    return rounded(reports.index_history(d.index_bars(), AS_OF, tail=252))


@query("sector_signal_map", PIVOT_SQL)
def _(d):
    return rounded(reports.sector_signal_map(d.integrated()))


@query("sector_scores", SECTOR_SCORES_SQL)
def _(d):
    return rounded(reports.sector_score_table(d.integrated()))


@query(
    "sector_heatmap",
    f"""SELECT c.code, c.company_name, c.sector, c.size, c.color,
           CASE WHEN c.size >= 50 THEN 13 WHEN c.size >= 15 THEN 11 WHEN c.size >= 4 THEN 10 ELSE 9 END AS font_size,
           {r('s.sector_color', 4)} AS sector_color
    FROM cells c JOIN (SELECT sector, sum(color * size) / sum(size) AS sector_color FROM cells GROUP BY sector) s USING (sector)""",
    {"cells": CELLS_SQL},
)
def _(d):
    return rounded(reports.sector_heatmap(d.scores()))


@query(
    "trade_levels",
    f"""SELECT code, kubota_signal, latest_close, {r('latest_close - 2 * (latest_close * (atr_pct / 100))', 0)} AS stop_price,
           {r('latest_close + 3 * (latest_close * (atr_pct / 100))', 0)} AS target_price,
           CASE WHEN days_to_earnings <= 10 THEN 'near' WHEN days_to_earnings <= 20 THEN 'soon' END AS earnings_flag,
           CASE WHEN kubota_trade_score >= 9 THEN 3 WHEN kubota_trade_score >= 7 THEN 2 ELSE 1 END AS stars
    FROM integrated""",
)
def _(d):
    return reports.trade_levels(d.scores())


CHECKS = {
    "market_bull": "market_phase = 'BULL'",
    "trend_up": "ma200_trend = 'UP'",
    "above_ma200": "price_vs_ma200 = 'ABOVE'",
    "consolidating": "consolidation",
    "volume_surging": "volume_surge",
    "liquid": "liquidity_grade IN ('A', 'B', 'C')",
    "sales_growing": "sales_cagr_3y_pct >= 5",
    "roe_good": "roe_pct >= 10",
    "healthy": "financial_health = 'PASS'",
    "earnings_far": "days_to_earnings IS NULL OR days_to_earnings > 20",
}


@query(
    "buy_checklist",
    "SELECT code, "
    + ", ".join(f"coalesce({c}, FALSE) AS {n}" for n, c in CHECKS.items())
    + ", "
    + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in CHECKS.values())
    + " AS passed FROM integrated",
)
def _(d):
    return reports.buy_checklist(d.scores())


@query(
    "signal_counts",
    f"""SELECT count(*) AS stock_count, count(*) FILTER (kubota_signal = 'buy_signal') AS buy_count,
           count(*) FILTER (kubota_signal = 'wait') AS wait_count, {r('avg(kubota_trade_score)', 4)} AS avg_trade_score
    FROM integrated""",
)
def _(d):
    return rounded(reports.signal_counts(d.scores()))


@query(
    "cached_ranking",
    f"SELECT {columns(integrate.RANKING_COLUMNS).replace('market_segment', 'market_segment AS market_name')} FROM integrated",
)
def _(d):
    return reports.cached_ranking(d.scores())


# ---- 2.6 windows over whole series -------------------------------------------------------------

W = "WINDOW w AS (PARTITION BY code ORDER BY date)"


def _series(d, *extra: str):
    return d.daily_bars().select("code", "date", *extra)


@query(
    "win_avg_k",
    "SELECT code, date, "
    + ", ".join(f"{r(f'avg(close) OVER (w ROWS {k - 1} PRECEDING)', 4)} AS avg_{k}" for k in (14, 20, 25, 200))
    + f" FROM daily_bars {W}",
)
def _(d):
    slides = {f"avg_{k}": windows.Slide("avg", "close", k) for k in (14, 20, 25, 200)}
    return rounded(windows.sliding(_series(d, "close"), slides).drop("close"))


@query(
    "win_avg_lagged",
    f"SELECT code, date, {r('avg(close) OVER (w ROWS BETWEEN 219 PRECEDING AND 20 PRECEDING)', 4)} AS ma_lagged "
    f"FROM daily_bars {W}",
)
def _(d):
    framed = windows.sliding(_series(d, "close"), {"ma200": windows.Slide("avg", "close", 200)})
    # The mean as it stood twenty rows earlier.
    lagged = F.lag("ma200", 20).over(windows.series())
    return rounded(framed.select("code", "date", lagged.alias("ma_lagged")))


@query(
    "win_stddev_k",
    "SELECT code, date, "
    + ", ".join(f"{r(f'stddev_samp(close) OVER (w ROWS {k - 1} PRECEDING)', 4)} AS std_{k}" for k in (20, 60))
    + f" FROM daily_bars {W}",
)
def _(d):
    slides = {f"std_{k}": windows.Slide("stddev", "close", k) for k in (20, 60)}
    return rounded(windows.sliding(_series(d, "close"), slides).drop("close"))


@query(
    "win_max_min_k",
    "SELECT code, date, "
    + ", ".join(
        f"{r(f'max(high) OVER (w ROWS {k - 1} PRECEDING)', 4)} AS max_{k}, {r(f'min(low) OVER (w ROWS {k - 1} PRECEDING)', 4)} AS min_{k}"
        for k in (10, 22, 30, 250)
    )
    + f" FROM daily_bars {W}",
)
def _(d):
    slides = {}
    for k in (10, 22, 30, 250):
        slides[f"max_{k}"] = windows.Slide("max", "high", k)
        slides[f"min_{k}"] = windows.Slide("min", "low", k)
    return rounded(windows.sliding(_series(d, "high", "low"), slides).drop("high", "low"))


@query(
    "win_max_prior",
    f"SELECT code, date, {r('max(high) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)', 4)} AS max_prior FROM daily_bars {W}",
)
def _(d):
    out = _series(d, "high").withColumn("max_prior", windows.max_prior("high", 10, windows.series()))
    return rounded(out.drop("high"))


@query(
    "win_count_k",
    f"SELECT code, date, count(*) OVER (w ROWS 19 PRECEDING) AS n_20, count(*) OVER (w ROWS 199 PRECEDING) AS n_200 "
    f"FROM daily_bars {W}",
)
def _(d):
    w = windows.series()
    return _series(d).withColumns({"n_20": windows.count_last(20, w), "n_200": windows.count_last(200, w)})


@query("win_lag", f"SELECT code, date, lag(close) OVER w AS prev_close FROM daily_bars {W}")
def _(d):
    return _series(d, "close").withColumn("prev_close", F.lag("close").over(windows.series())).drop("close")


@query(
    "win_lead",
    f"SELECT code, date, lead(close, 5) OVER w AS close_5d, lead(close, 10) OVER w AS close_10d, "
    f"lead(close, 20) OVER w AS close_20d FROM daily_bars {W}",
)
def _(d):
    w = windows.series()
    out = _series(d, "close").withColumns({f"close_{h}d": F.lead("close", h).over(w) for h in (5, 10, 20)})
    return out.drop("close")


@query(
    "win_latest",
    "SELECT code, date, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn "
    "FROM daily_bars) WHERE rn = 1",
)
def _(d):
    return windows.latest(_series(d, "close", "volume"))


@query(
    "win_latest_in_year",
    f"SELECT code, disc_year, {r('net_sales', 2)} AS net_sales FROM (SELECT *, row_number() OVER (PARTITION BY code "
    "ORDER BY disc_year DESC) AS yr FROM annual) WHERE yr = 1",
)
def _(d):
    annual = fundamentals.annual_results(d.financial_summary()).select("code", "disc_year", "net_sales")
    return rounded(windows.latest(annual, order="disc_year"), 2)


@query("win_next", "SELECT code, next_earnings_date FROM earnings_next")
def _(d):
    return fundamentals.earnings_next(d.earnings_calendar(), AS_OF).select("code", "next_earnings_date")


@query(
    "win_global",
    f"SELECT index_code, date, {r('avg(close) OVER (w ROWS 199 PRECEDING)', 4)} AS ma200, "
    "row_number() OVER (PARTITION BY index_code ORDER BY date DESC) AS rn FROM index_bars "
    "WINDOW w AS (PARTITION BY index_code ORDER BY date)",
)
def _(d):
    from pyspark.sql import Window

    back = Window.partitionBy("index_code").orderBy(F.col("date").desc())
    out = d.index_bars().select(
        "index_code",
        "date",
        windows.avg_last("close", 200, windows.series("index_code")).alias("ma200"),
        F.row_number().over(back).cast("bigint").alias("rn"),
    )
    return rounded(out)


@query("rolling_full", f"SELECT code, date, {_full(25)}, {_full(75)}, {_full(200)} FROM daily_bars {W}")
def _(d):
    slides = {f"ma{k}": windows.Slide("full_avg", "close", k) for k in (25, 75, 200)}
    return rounded(windows.sliding(_series(d, "close"), slides).drop("close"))


@query(
    "tail_n",
    "SELECT code, date, close FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn "
    "FROM daily_bars) WHERE rn <= 90",
)
def _(d):
    return windows.tail_rows(_series(d, "close"), 90)


# ---- 2.3 filters over bars and statements ------------------------------------------------------


@query("lookback_filter", f"SELECT code, date, close FROM daily_bars WHERE date >= {AS_OF_SQL} - 120 AND date <= {AS_OF_SQL}")
def _(d):
    return filters.lookback(d.daily_bars(), AS_OF, 120).select("code", "date", "close")


@query("positive_filter", "SELECT code, date, close, volume FROM daily_bars WHERE close > 0 AND volume > 0")
def _(d):
    return filters.traded(d.daily_bars()).select("code", "date", "close", "volume")


@query(
    "doc_type_like",
    "SELECT code, disclosed_date, document_type FROM financial_summary WHERE (document_type LIKE '%FY%' "
    "OR document_type LIKE '%Annual%' OR document_type LIKE '%通期%') AND net_sales > 0",
)
def _(d):
    return filters.annual_statements(d.financial_summary()).select("code", "disclosed_date", "document_type")


@query(
    "case_grade",
    f"""SELECT code, disclosed_date,
           CASE WHEN margin >= 0.03 THEN 8 WHEN margin >= 0.02 THEN 6 WHEN margin >= 0.01 THEN 3 ELSE 0 END AS points
    FROM (SELECT code, disclosed_date, {div('operating_profit', 'net_sales')} AS margin FROM financial_summary)""",
)
def _(d):
    from equiscan.functions import safe_divide

    margin = safe_divide("operating_profit", "net_sales")
    return d.financial_summary().select(
        "code", "disclosed_date", fundamentals.ladder(margin, (0.03, 8), (0.02, 6), (0.01, 3)).alias("points")
    )


@query("latest_date_filtered", "SELECT max(date) AS latest FROM index_bars WHERE index_code <> '0000'")
def _(d):
    return tables.latest_other_index(d.index_bars())
