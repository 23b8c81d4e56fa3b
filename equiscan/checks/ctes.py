"""DuckDB building blocks: the derived tables and the scores as plain SQL, written with windows and self joins
so that they check the Spark plans rather than repeat them."""

from __future__ import annotations

import re

AS_OF = "DATE '2001-06-30'"
PREVIOUS = "DATE '2001-06-23'"


def r(x: str, n: int) -> str:
    """Decimal rounding of the shortest text of a double, half away from zero, as Spark's ``round`` does."""
    return f"CAST(round(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18)), {n}) AS DOUBLE)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF({b}, 0))"


def pad(x: str, n: int = 4) -> str:
    t = f"CAST({x} AS VARCHAR)"
    return f"CASE WHEN length({t}) < {n} THEN lpad({t}, {n}, '0') ELSE {t} END"


def code(x: str) -> str:
    return f"concat({pad(x)}, '0')"


def day(rank: str) -> str:
    return f"{AS_OF} - CAST(floor(({rank} - 1) * 7 / 5.0) AS INTEGER)"


def shifted(x: str) -> str:
    return f"CAST({x} AS DATE) - 127"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


CTES: dict[str, str] = {
    "bar_tick": """
        SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, l_tax, l_discount, l_quantity, l_extendedprice,
               1000 + (l_quantity - 25) * 2 * (l_suppkey % 10) AS px,
               (l_orderkey * 10 + l_linenumber) * 100 + l_quantity AS seq
        FROM lineitem""",
    "bar_day": """
        SELECT l_suppkey, d, arg_min(px, seq) AS o, max(px * (1 + l_tax / 8)) AS h, min(px * (1 - l_discount / 8)) AS l,
               arg_max(px, seq) AS c, CAST(sum(l_quantity) AS BIGINT) AS volume, sum(l_extendedprice) AS amount
        FROM bar_tick GROUP BY l_suppkey, d""",
    "bar_num": """
        SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY d DESC) AS rn FROM bar_day""",
    "bar_adj": """
        SELECT *, CAST((l_suppkey % 3 - 1) * (600 - rn) * 0.5 AS DOUBLE) AS drift,
               CAST(CASE WHEN rn % 50 < 20 THEN 0.25 ELSE 1 END AS DOUBLE) AS k
        FROM bar_num""",
    "daily_bars": f"""
        SELECT {code('l_suppkey')} AS code, {day('rn')} AS date,
               1000 + (o - 1000) * k + drift AS open, 1000 + (h - 1000) * k + drift AS high,
               1000 + (l - 1000) * k + drift AS low, 1000 + (c - 1000) * k + drift AS close, volume,
               round(amount * 20000 * (1 + l_suppkey % 5), 0) AS turnover_value
        FROM bar_adj""",
    "idx_line": """
        SELECT CAST(l_shipdate AS DATE) AS d, l_linenumber, sum(l_quantity) AS q, count(*) AS n
        FROM lineitem GROUP BY 1, 2""",
    "idx_day": f"""
        SELECT '0000' AS index_code, d, sum(q) AS q, CAST(sum(n) AS BIGINT) AS n FROM idx_line GROUP BY d
        UNION ALL SELECT {pad('l_linenumber')}, d, q, n FROM idx_line""",
    "idx_close": """
        SELECT *, CAST(2000 + (q / n - 25) * 4 + (1000 - rn) AS DOUBLE) AS close
        FROM (SELECT *, row_number() OVER (PARTITION BY index_code ORDER BY d DESC) AS rn FROM idx_day)""",
    "index_bars": f"""
        SELECT index_code, {day('rn')} AS date, close - 4 + n % 9 AS open,
               greatest(close - 4 + n % 9, close) + n % 5 AS high, least(close - 4 + n % 9, close) - n % 3 AS low, close
        FROM idx_close""",
    "quote_day": f"""
        SELECT CAST(CAST(floor(l_partkey / 100) AS BIGINT) AS VARCHAR) AS g, {shifted('l_shipdate')} AS date,
               sum(l_quantity) AS q, count(*) AS n
        FROM lineitem GROUP BY 1, 2""",
    "quotes": """
        SELECT concat('US', g) AS ticker, date, 100 + q / n AS close FROM quote_day
        UNION ALL SELECT concat('PX', g), date, 1500 + q / n * 10 FROM quote_day
        UNION ALL SELECT 'USDJPY=X', date, 100 + sum(q) / sum(n) FROM quote_day GROUP BY date""",
    "equity_master": f"""
        SELECT {code('s_suppkey')} AS code, s_name AS company_name, n_name AS sector33_name,
               CASE WHEN s_suppkey % 4 = 3 THEN 'スタンダード' ELSE 'プライム' END AS market_name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "fin_sums": """
        SELECT l_suppkey, year(l_shipdate) AS fy, quarter(l_shipdate) AS q, max(CAST(l_shipdate AS DATE)) AS disclosed_date,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS sales,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (CAST(round(l_discount * 100) AS BIGINT) - 3)) AS DOUBLE)
                 / 10000.0 AS op,
               CAST(1 + l_suppkey % 8 AS DOUBLE) / 10.0 AS ratio
        FROM lineitem GROUP BY 1, 2, 3""",
    "financial_summary": f"""
        SELECT {code('l_suppkey')} AS code, disclosed_date,
               CASE WHEN q = 4 THEN 'FYFinancialStatements' WHEN q = 2 THEN 'AnnualRevision'
                    ELSE '1QFinancialStatements' END AS document_type,
               sales AS net_sales, op AS operating_profit, op * 0.6 AS net_income, sales * 1.5 AS total_assets,
               sales * 1.5 * ratio AS equity, ratio AS equity_to_asset_ratio, op * 0.6 / 100 AS eps,
               sales * 1.5 * ratio / 500 AS bps
        FROM fin_sums""",
    "earnings_calendar": f"""
        SELECT {code('l_suppkey')} AS code, {AS_OF} + CAST(max(l_orderkey) % 360 - 100 AS INTEGER) AS date
        FROM lineitem GROUP BY l_suppkey, year(l_shipdate)""",
    "order_trades": f"""
        SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS traded_on,
               CASE o_orderstatus WHEN 'F' THEN 'domestic' WHEN 'O' THEN 'us' ELSE 'fund' END AS kind,
               CAST(CAST(floor(o_custkey / 75) AS BIGINT) AS VARCHAR) AS g,
               {pad('CAST(floor(o_custkey / 15) AS BIGINT)')} AS stock, o_orderpriority AS account,
               o_orderpriority <> '5-LOW' AS bought, 1 + o_orderkey % 100 AS qty,
               CAST(round(o_totalprice / 100) AS BIGINT) AS price, 100 + o_orderkey % 50 AS fx
        FROM orders""",
    "ledger_domestic": """
        SELECT traded_on AS trade_date, stock AS code, concat('Company ', stock) AS company_name,
               'domestic' AS product_type, account AS account_type, CAST(qty AS DOUBLE) AS quantity,
               CAST(price AS DOUBLE) AS unit_price, CAST(NULLIF(qty * price, 0) AS DOUBLE) AS amount,
               CAST(NULLIF(qty * price, 0) AS DOUBLE) AS amount_native, 'jpy' AS amount_unit, CAST(NULL AS DOUBLE) AS fx_rate
        FROM order_trades WHERE kind = 'domestic' AND bought""",
    "us_rows": """
        SELECT *, CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(fx AS DOUBLE) END AS rate, CAST(NULLIF(qty * price, 0) AS DOUBLE) AS usd
        FROM order_trades WHERE kind = 'us' AND bought""",
    "ledger_us": """
        SELECT traded_on AS trade_date, concat('US', g) AS code, concat('Company US', g) AS company_name,
               'us' AS product_type, account AS account_type, CAST(qty AS DOUBLE) AS quantity,
               CAST(price AS DOUBLE) AS unit_price, coalesce(round(usd * rate, 0), usd) AS amount, usd AS amount_native,
               'usd' AS amount_unit, rate AS fx_rate
        FROM us_rows""",
    "fund_rows": """
        SELECT *, qty * 1000 AS units, CASE WHEN k % 4 = 0 THEN NULL ELSE NULLIF(CAST(price AS DOUBLE), 0) END AS settled
        FROM order_trades WHERE kind = 'fund' AND bought""",
    "ledger_fund": """
        SELECT traded_on AS trade_date, CAST(NULL AS VARCHAR) AS code, concat('Fund ', g) AS company_name,
               'fund' AS product_type, account AS account_type, CAST(units AS DOUBLE) AS quantity,
               CAST(price AS DOUBLE) AS unit_price, coalesce(settled, NULLIF(CAST(units * price AS DOUBLE), 0)) AS amount,
               coalesce(settled, NULLIF(CAST(units * price AS DOUBLE), 0)) AS amount_native,
               CASE WHEN settled IS NOT NULL THEN 'jpy' ELSE 'per_10k' END AS amount_unit, CAST(NULL AS DOUBLE) AS fx_rate
        FROM fund_rows""",
    "trades": """
        SELECT * FROM ledger_domestic UNION ALL SELECT * FROM ledger_us UNION ALL SELECT * FROM ledger_fund""",
    "keyed_trades": """
        SELECT *, CASE WHEN trim(code) <> '' THEN code ELSE company_name END AS pos_key,
               CASE WHEN amount_unit <> 'per_10k' THEN amount_native END AS plain,
               CASE WHEN amount_unit = 'per_10k' THEN amount_native END AS scaled
        FROM trades""",
    "first_trades": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos_key
          ORDER BY trade_date, account_type, company_name, product_type, quantity, unit_price) AS rn FROM keyed_trades)
        WHERE rn = 1""",
    "position_sums": """
        SELECT pos_key, sum(quantity) AS shares, sum(amount) AS purchase_amount, coalesce(sum(plain) + sum(scaled) / 10000, sum(plain), sum(scaled) / 10000) AS purchase_amount_native,
               min(trade_date) AS purchase_date, max(trade_date) AS latest_purchase_date, count(*) AS tx_count
        FROM keyed_trades GROUP BY pos_key""",
    "holdings": f"""
        SELECT f.code, f.company_name, f.product_type, f.account_type, s.shares,
               CASE WHEN s.shares > 0 AND s.purchase_amount <> 0 THEN {r('s.purchase_amount / s.shares', 2)} END AS purchase_price,
               s.purchase_date, s.latest_purchase_date, s.purchase_amount, s.purchase_amount_native,
               CASE WHEN f.product_type = 'us' THEN 'usd' ELSE 'jpy' END AS amount_unit, s.tx_count
        FROM position_sums s JOIN first_trades f USING (pos_key)""",
    "fund_proxies": """
        SELECT DISTINCT concat('Fund ', g) AS asset_name, concat('PX', g) AS proxy_ticker
        FROM order_trades WHERE kind = 'fund'""",
    "last_quote": f"""
        SELECT ticker, arg_max(close, date) AS close FROM quotes
        WHERE date BETWEEN {AS_OF} - 5 AND {AS_OF} GROUP BY ticker""",
    "us_price": f"""
        SELECT {AS_OF} AS fetch_date, q.ticker, q.ticker AS asset_name, 'us' AS asset_type, {r('q.close', 4)} AS price_original,
               'USD' AS currency, {r('fx.close', 4)} AS usdjpy_rate, {r('q.close * NULLIF(fx.close, 0)', 0)} AS price_jpy
        FROM last_quote q LEFT JOIN (SELECT close FROM last_quote WHERE ticker = 'USDJPY=X') fx ON TRUE
        WHERE q.ticker IN (SELECT code FROM holdings WHERE product_type = 'us')""",
    "fund_costs": f"""
        SELECT company_name, {div('sum(purchase_amount_native * 10000)', 'sum(shares)')} AS avg_cost,
               min(purchase_date) AS first_buy_date
        FROM holdings WHERE product_type = 'fund' GROUP BY company_name""",
    "fund_points": """
        SELECT c.*, p.proxy_ticker FROM fund_costs c JOIN fund_proxies p ON p.asset_name = c.company_name""",
    "fund_at_buy": """
        SELECT p.company_name,
               coalesce((SELECT arg_min(q.close, q.date) FROM quotes q WHERE q.ticker = p.proxy_ticker
                           AND q.date >= p.first_buy_date AND q.date < p.first_buy_date + 5),
                        (SELECT arg_max(q.close, q.date) FROM quotes q WHERE q.ticker = p.proxy_ticker
                           AND q.date >= p.first_buy_date - 10 AND q.date < p.first_buy_date)) AS at_buy
        FROM fund_points p""",
    "fund_nav_raw": f"""
        SELECT p.proxy_ticker, p.company_name,
               CASE WHEN p.avg_cost > 0 AND b.at_buy <> 0 AND n.close <> 0
                    THEN {r('p.avg_cost * (n.close / b.at_buy)', 1)} END AS nav
        FROM fund_points p LEFT JOIN fund_at_buy b USING (company_name) LEFT JOIN last_quote n ON n.ticker = p.proxy_ticker""",
    "fund_nav": f"""
        SELECT {AS_OF} AS fetch_date, proxy_ticker AS ticker, company_name AS asset_name, 'fund' AS asset_type,
               nav AS price_original, 'JPY' AS currency, CAST(NULL AS DOUBLE) AS usdjpy_rate, nav AS price_jpy
        FROM fund_nav_raw""",
    "external_prices": "SELECT * FROM us_price UNION ALL SELECT * FROM fund_nav",
    "position_totals": """
        SELECT product_type, company_name, code, account_type, sum(shares) AS shares, sum(purchase_amount_native) AS cost,
               min(purchase_date) AS first_buy_date, max(latest_purchase_date) AS last_buy_date
        FROM holdings GROUP BY product_type, company_name, code, account_type""",
    "aggregate_positions": f"""
        SELECT product_type, company_name, code, account_type,
               CASE WHEN product_type = 'fund' THEN {r('shares / 10000', 4)} ELSE shares END AS total_shares,
               cost AS total_cost_orig,
               CASE WHEN product_type = 'fund' THEN {div('cost * 10000', 'shares')} ELSE {div('cost', 'shares')} END AS avg_cost_orig,
               first_buy_date, last_buy_date
        FROM position_totals""",
    "positions_yen": f"""
        SELECT a.*, fx.usdjpy_rate,
               CASE product_type WHEN 'us' THEN {r('total_cost_orig * coalesce(fx.usdjpy_rate, 150)', 0)}
                    WHEN 'fund' THEN {r('total_cost_orig', 0)} ELSE total_cost_orig END AS total_cost,
               CASE product_type WHEN 'us' THEN {r('avg_cost_orig * coalesce(fx.usdjpy_rate, 150)', 0)}
                    ELSE avg_cost_orig END AS avg_cost_per_share
        FROM aggregate_positions a LEFT JOIN (SELECT max(usdjpy_rate) AS usdjpy_rate FROM external_prices) fx ON TRUE""",
    "priced_positions": """
        SELECT p.*, s.kubota_signal, s.kubota_trade_score, s.growth_invest_score, s.next_earnings_date, s.days_to_earnings,
               s.price_strength_score, coalesce(s.latest_close, u.price_jpy, f.price_jpy) AS price
        FROM positions_yen p
        LEFT JOIN integrated s
          ON left(s.code, 4) = p.code
         AND p.product_type = 'domestic'
        LEFT JOIN external_prices u ON u.ticker = p.code AND p.product_type = 'us' AND u.asset_type = 'us'
        LEFT JOIN external_prices f
          ON f.asset_name = p.company_name AND p.product_type = 'fund' AND f.asset_type = 'fund'""",
    "holdings_summary": f"""
        SELECT product_type AS product_category, company_name, code, account_type AS account, total_shares, total_cost,
               avg_cost_per_share, first_buy_date, last_buy_date, price AS latest_close, kubota_signal, kubota_trade_score,
               growth_invest_score, next_earnings_date, days_to_earnings, price_strength_score,
               {r('total_shares * price', 0)} AS current_value, {r('total_shares * price - total_cost', 0)} AS unrealized_pnl,
               CASE WHEN total_cost > 0 THEN {r('(total_shares * price - total_cost) / total_cost * 100', 2)} END AS return_pct
        FROM priced_positions""",
    "watched": """
        SELECT h.* EXCLUDE (total_shares, avg_cost_per_share, total_cost), h.total_shares AS shares,
               h.avg_cost_per_share AS purchase_price, h.total_cost AS purchase_amount, a.atr_pct
        FROM holdings_summary h LEFT JOIN (
          SELECT left(code, 4) AS code4,
                 avg(atr_pct) AS atr_pct FROM integrated GROUP BY 1) a ON a.code4 = h.code""",
    "backtest_lag": f"""
        SELECT b.code, b.date, b.high, b.low, b.close, b.volume,
               lag(b.close) OVER (PARTITION BY b.code ORDER BY b.date) AS pc
        FROM daily_bars b JOIN equity_master m ON m.code = b.code
        WHERE m.market_name LIKE '%プライム%' AND b.date BETWEEN {AS_OF} - 500 AND {AS_OF} AND b.close > 0 AND b.volume > 0""",
    "backtest_tr": f"""
        SELECT *, CASE WHEN high IS NOT NULL AND low IS NOT NULL THEN
                 greatest(high - low, abs(high - coalesce(pc, high)), abs(low - coalesce(pc, low))) END AS tr,
               {div('close - pc', 'pc')} AS ret
        FROM backtest_lag""",
    "backtest_all": f"""
        SELECT *, avg(close) OVER (w ROWS 199 PRECEDING) AS ma200, avg(volume) OVER (w ROWS 19 PRECEDING) AS av20,
               avg(tr) OVER (w ROWS 13 PRECEDING) AS atr, stddev_samp(ret) OVER (w ROWS 19 PRECEDING) * sqrt(250) AS hv20,
               stddev_samp(ret) OVER (w ROWS 59 PRECEDING) * sqrt(250) AS hv60,
               (max(high) OVER (w ROWS 9 PRECEDING) - min(low) OVER (w ROWS 9 PRECEDING))
                 / NULLIF(max(high) OVER (w ROWS 29 PRECEDING) - min(low) OVER (w ROWS 29 PRECEDING), 0) AS contraction,
               count(*) OVER (w ROWS 199 PRECEDING) AS n, lead(close, 5) OVER w AS c5, lead(close, 10) OVER w AS c10,
               lead(close, 20) OVER w AS c20
        FROM backtest_tr WINDOW w AS (PARTITION BY code ORDER BY date)""",
    "backtest": f"""
        SELECT code, date AS signal_date, {r('close', 0)} AS entry_price, {r(div('volume', 'av20'), 2)} AS volume_ratio,
               {r('atr / close * 100', 2)} AS atr_pct, {r('hv20 * 100', 1)} AS hv_20d_pct, {r('hv60 * 100', 1)} AS hv_60d_pct,
               {r('contraction', 3)} AS range_contraction, {r('(c5 - close) / close * 100', 2)} AS return_5d_pct,
               {r('(c10 - close) / close * 100', 2)} AS return_10d_pct, {r('(c20 - close) / close * 100', 2)} AS return_20d_pct,
               CASE WHEN c5 > close THEN 1 ELSE 0 END AS win_5d, CASE WHEN c10 > close THEN 1 ELSE 0 END AS win_10d,
               CASE WHEN c20 IS NULL THEN NULL WHEN c20 > close THEN 1 ELSE 0 END AS win_20d
        FROM backtest_all
        WHERE n >= 150 AND close > ma200 AND atr / close >= 0.015 AND hv20 < hv60 AND contraction < 0.5
          AND volume / NULLIF(av20, 0) >= 1.5 AND c5 IS NOT NULL""",
    "annual": """
        SELECT * FROM (
          SELECT *, CAST(year(disclosed_date) AS INTEGER) AS disc_year, row_number() OVER (
            PARTITION BY code, year(disclosed_date) ORDER BY disclosed_date DESC, document_type DESC) AS rn
          FROM financial_summary
          WHERE (document_type LIKE '%FY%' OR document_type LIKE '%Annual%' OR document_type LIKE '%通期%') AND net_sales > 0)
        WHERE rn = 1""",
    "fund_rates": f"""
        SELECT a.code, a.disc_year AS latest_year, a.eps, a.bps, a.equity_to_asset_ratio,
               CASE WHEN b.net_sales > 0 AND a.net_sales > 0
                    THEN pow(a.net_sales / b.net_sales, CAST(1.0 AS DOUBLE) / 3) - 1 END AS sc,
               CASE WHEN b.operating_profit > 0 AND a.operating_profit > 0
                    THEN pow(a.operating_profit / b.operating_profit, CAST(1.0 AS DOUBLE) / 3) - 1 END AS oc,
               {div('a.net_income', 'a.equity')} AS roe,
               {div('a.operating_profit * 0.7', 'a.total_assets - a.equity')} AS roic,
               {div('a.operating_profit', 'a.net_sales')} AS om
        FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY disc_year DESC) AS yr FROM annual) a
        LEFT JOIN annual b ON a.code = b.code AND a.disc_year = b.disc_year + 3
        WHERE a.yr = 1""",
    "fundamental": f"""
        SELECT code, latest_year, eps, bps, {r('sc * 100', 1)} AS sales_cagr_3y_pct, {r('oc * 100', 1)} AS op_cagr_3y_pct,
               {r('roe * 100', 1)} AS roe_pct, {r('roic * 100', 1)} AS roic_pct, {r('om * 100', 1)} AS op_margin_pct,
               {r('equity_to_asset_ratio * 100', 1)} AS equity_ratio_pct,
               CASE WHEN sc >= 0.15 THEN 8 WHEN sc >= 0.10 THEN 6 WHEN sc >= 0.05 THEN 3 ELSE 0 END AS sales_cagr_score,
               CASE WHEN oc >= 0.20 THEN 8 WHEN oc >= 0.10 THEN 6 WHEN oc >= 0.05 THEN 3 ELSE 0 END AS op_cagr_score,
               CASE WHEN roe >= 0.15 THEN 7 WHEN roe >= 0.10 THEN 5 WHEN roe >= 0.08 THEN 3 ELSE 0 END AS roe_score,
               CASE WHEN roic >= 0.12 THEN 6 WHEN roic >= 0.08 THEN 4 WHEN roic >= 0.05 THEN 2 ELSE 0 END AS roic_score,
               CASE WHEN equity_to_asset_ratio < 0.20 THEN 'FAIL' WHEN om < 0 THEN 'FAIL' ELSE 'PASS' END AS financial_health
        FROM fund_rates""",
    "score_history": """
        SELECT * REPLACE (CAST(volatility_score AS BIGINT) AS volatility_score, CAST(chart_score AS BIGINT) AS chart_score,
                          CAST(kubota_trade_score AS BIGINT) AS kubota_trade_score,
                          CAST(growth_invest_score AS BIGINT) AS growth_invest_score)
        FROM (SELECT DATE '2001-06-23' AS snapshot_date, * FROM integrated_prev WHERE screening_status = 'ACTIVE'
              UNION ALL SELECT DATE '2001-06-30', * FROM integrated WHERE screening_status = 'ACTIVE')""",
}


def _scores(as_of: str, x: str) -> dict[str, str]:
    """Score tables as of one day; ``x`` is appended to their names."""
    prev = f"lag(close) OVER (PARTITION BY code ORDER BY date)"
    return {
        f"liq_roll{x}": f"""
            SELECT code, date, turnover_value, avg(turnover_value) OVER w AS av, stddev_samp(turnover_value) OVER w AS sd,
                   count(*) OVER w AS n
            FROM daily_bars WHERE date BETWEEN {as_of} - 60 AND {as_of}
            WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
        f"liquidity{x}": f"""
            SELECT code, date, turnover_value AS latest_turnover, {r('av / 100000000', 2)} AS avg_turnover_20d_oku,
                   {r(div('sd', 'av'), 3)} AS cv_value,
                   CASE WHEN av >= 5000000000 THEN 'PASS_A' WHEN av >= 3000000000 THEN 'PASS_B'
                        WHEN av >= 1000000000 THEN 'PASS_C' ELSE 'FAIL' END AS liquidity_grade,
                   CASE WHEN sd / NULLIF(av, 0) < 1.0 THEN 'PASS' WHEN sd / NULLIF(av, 0) < 1.5 THEN 'WARN'
                        ELSE 'FAIL' END AS cv_grade
            FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM liq_roll{x} WHERE n >= 15)
            WHERE rn = 1""",
        f"vol_lag{x}": f"""
            SELECT code, date, high, low, close, {prev} AS pc FROM daily_bars
            WHERE date BETWEEN {as_of} - 120 AND {as_of}""",
        f"vol_tr{x}": f"""
            SELECT *, CASE WHEN high IS NOT NULL AND low IS NOT NULL THEN
                     greatest(high - low, abs(high - coalesce(pc, high)), abs(low - coalesce(pc, low))) END AS tr,
                   {div('close - pc', 'pc')} AS ret
            FROM vol_lag{x}""",
        f"vol_roll{x}": f"""
            SELECT code, date, close, avg(tr) OVER (w ROWS 13 PRECEDING) AS atr, max(high) OVER (w ROWS 21 PRECEDING) AS hi,
                   min(low) OVER (w ROWS 21 PRECEDING) AS lo, stddev_samp(ret) OVER (w ROWS 19 PRECEDING) * sqrt(250) AS hv20,
                   stddev_samp(ret) OVER (w ROWS 59 PRECEDING) * sqrt(250) AS hv60,
                   row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn
            FROM vol_tr{x} WINDOW w AS (PARTITION BY code ORDER BY date)""",
        f"volatility{x}": f"""
            SELECT code, date, close, {r('atr', 1)} AS atr_14, {r(div('atr', 'close') + ' * 100', 2)} AS atr_pct,
                   {r(div('hi - lo', 'lo') + ' * 100', 1)} AS range_1m_pct, {r('hv20 * 100', 1)} AS hv_20d_pct,
                   {r('hv60 * 100', 1)} AS hv_60d_pct,
                   CASE WHEN atr / NULLIF(close, 0) >= 0.015 THEN 2 ELSE 0 END + CASE WHEN hv20 < hv60 THEN 2 ELSE 0 END
                     + CASE WHEN (hi - lo) / NULLIF(lo, 0) BETWEEN 0.15 AND 0.80 THEN 1 ELSE 0 END AS volatility_score,
                   CASE WHEN hv20 < hv60 THEN TRUE ELSE FALSE END AS hv_contraction
            FROM vol_roll{x} WHERE rn = 1""",
        f"chart_roll{x}": f"""
            SELECT code, date, close, volume, avg(close) OVER (w ROWS 199 PRECEDING) AS ma200,
                   avg(close) OVER (w ROWS BETWEEN 219 PRECEDING AND 20 PRECEDING) AS ma200b,
                   avg(close) OVER (w ROWS 24 PRECEDING) AS ma25, avg(volume) OVER (w ROWS 19 PRECEDING) AS av,
                   max(high) OVER (w ROWS 9 PRECEDING) AS h10, min(low) OVER (w ROWS 9 PRECEDING) AS l10,
                   max(high) OVER (w ROWS 29 PRECEDING) AS h30, min(low) OVER (w ROWS 29 PRECEDING) AS l30,
                   max(high) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h10p,
                   max(high) OVER (w ROWS 249 PRECEDING) AS h52, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn
            FROM daily_bars WHERE date BETWEEN {as_of} - 300 AND {as_of} WINDOW w AS (PARTITION BY code ORDER BY date)""",
        f"chart_one{x}": f"""
            SELECT *, {div('ma200 - ma200b', 'ma200b')} AS slope, {div('volume', 'av')} AS vr,
                   {div('h10 - l10', 'h30 - l30')} AS rc
            FROM chart_roll{x} WHERE rn = 1""",
        f"chart{x}": f"""
            SELECT code, date, close, {r('ma200', 1)} AS ma_200, {r('ma25', 1)} AS ma_25,
                   CASE WHEN slope > 0.005 THEN 'UP' WHEN slope < -0.005 THEN 'DOWN' ELSE 'FLAT' END AS ma200_trend,
                   CASE WHEN close > ma200 THEN 'ABOVE' ELSE 'BELOW' END AS price_vs_ma200, {r('vr', 2)} AS volume_ratio,
                   CASE WHEN vr >= 1.5 THEN TRUE ELSE FALSE END AS volume_surge, {r('rc', 3)} AS range_contraction,
                   CASE WHEN rc < 0.5 THEN TRUE ELSE FALSE END AS consolidation,
                   CASE WHEN close >= h10p AND h10p IS NOT NULL THEN TRUE ELSE FALSE END AS breakout,
                   CASE WHEN close >= h52 * 0.98 THEN TRUE ELSE FALSE END AS near_52w_high,
                   CASE WHEN slope > 0.005 THEN 1 ELSE 0 END + CASE WHEN close > ma200 THEN 1 ELSE 0 END
                     + CASE WHEN rc < 0.5 THEN 2 ELSE 0 END + CASE WHEN vr >= 1.5 THEN 1 ELSE 0 END AS chart_score
            FROM chart_one{x}""",
        f"env_roll{x}": f"""
            SELECT date, close, avg(close) OVER (ORDER BY date ROWS 199 PRECEDING) AS ma,
                   avg(close) OVER (ORDER BY date ROWS BETWEEN 219 PRECEDING AND 20 PRECEDING) AS mab,
                   row_number() OVER (ORDER BY date DESC) AS rn
            FROM index_bars WHERE index_code = '0000' AND date BETWEEN {as_of} - 300 AND {as_of}""",
        f"market_environment{x}": f"""
            SELECT date, {r('close', 2)} AS topix_close, {r('ma', 2)} AS topix_ma200,
                   CASE WHEN (ma - mab) / NULLIF(mab, 0) > 0.005 THEN 'BULL'
                        WHEN (ma - mab) / NULLIF(mab, 0) < -0.005 THEN 'BEAR' ELSE 'NEUTRAL' END AS market_phase,
                   CASE WHEN close > ma AND (ma - mab) / NULLIF(mab, 0) > 0.005 THEN 3 WHEN close > ma THEN 2 ELSE 1 END
                     AS environment_score
            FROM env_roll{x} WHERE rn = 1""",
        f"latest_price{x}": f"""
            SELECT code, date, close FROM (
              SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM daily_bars
              WHERE date BETWEEN {as_of} - 10 AND {as_of}) WHERE rn = 1""",
        f"valued{x}": f"""
            SELECT p.code, p.date, p.close, CASE WHEN f.eps > 0 THEN {r('p.close / f.eps', 1)} END AS per,
                   CASE WHEN f.bps > 0 THEN {r('p.close / f.bps', 2)} END AS pbr
            FROM latest_price{x} p LEFT JOIN fundamental f ON p.code = f.code""",
        f"sector_avg{x}": f"""
            SELECT m.sector33_name, avg(v.per) AS sector_avg_per FROM valued{x} v JOIN equity_master m ON v.code = m.code
            WHERE v.per > 0 AND v.per < 200 GROUP BY m.sector33_name""",
        f"valuation{x}": f"""
            SELECT v.code, v.date, v.close, v.per, v.pbr, a.sector_avg_per,
                   CASE WHEN v.per > 0 AND v.per < a.sector_avg_per * 0.8 THEN 5
                        WHEN v.per > 0 AND v.per <= a.sector_avg_per THEN 3
                        WHEN v.per > 0 AND v.per <= a.sector_avg_per * 1.3 THEN 1 ELSE 0 END AS per_score,
                   CASE WHEN v.pbr > 0 AND v.pbr < 1.5 THEN 3 ELSE 0 END + CASE WHEN v.pbr > 0 AND v.pbr < 1.0 THEN 2 ELSE 0 END
                     AS pbr_score
            FROM valued{x} v LEFT JOIN equity_master m ON v.code = m.code
            LEFT JOIN sector_avg{x} a ON m.sector33_name = a.sector33_name""",
        f"earnings_next{x}": f"""
            SELECT code, date AS next_earnings_date, CAST(date - {as_of} AS INTEGER) AS days_to_earnings FROM (
              SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) AS rn FROM earnings_calendar
              WHERE date >= {as_of}) WHERE rn = 1""",
        f"integrated_base{x}": f"""
            SELECT m.code, m.company_name, m.sector33_name, m.market_name AS market_segment, l.avg_turnover_20d_oku, l.cv_value,
                   CASE l.liquidity_grade WHEN 'PASS_A' THEN 'A' WHEN 'PASS_B' THEN 'B' WHEN 'PASS_C' THEN 'C'
                        WHEN 'FAIL' THEN 'D' END AS liquidity_grade, l.cv_grade,
                   v.atr_pct, v.range_1m_pct, v.hv_contraction, v.volatility_score, c.close AS latest_close, c.ma200_trend,
                   c.price_vs_ma200, c.volume_ratio, c.volume_surge, c.consolidation, c.breakout, c.near_52w_high, c.chart_score,
                   f.sales_cagr_3y_pct, f.op_cagr_3y_pct, f.roe_pct, f.roic_pct, f.equity_ratio_pct, f.sales_cagr_score,
                   f.op_cagr_score, f.roe_score, f.roic_score, f.financial_health,
                   coalesce(f.sales_cagr_score, 0) + coalesce(f.op_cagr_score, 0) + coalesce(f.roe_score, 0)
                     + coalesce(f.roic_score, 0) AS fundamental_total,
                   w.per, w.pbr, w.per_score, w.pbr_score, coalesce(w.per_score, 0) + coalesce(w.pbr_score, 0) AS valuation_total,
                   e.topix_close, e.market_phase, e.environment_score, n.next_earnings_date, n.days_to_earnings,
                   coalesce(v.volatility_score, 0) + coalesce(c.chart_score, 0) AS kubota_trade_score
            FROM equity_master m LEFT JOIN liquidity{x} l ON l.code = m.code LEFT JOIN volatility{x} v ON v.code = m.code
            LEFT JOIN chart{x} c ON c.code = m.code LEFT JOIN fundamental f ON f.code = m.code
            LEFT JOIN valuation{x} w ON w.code = m.code LEFT JOIN earnings_next{x} n ON n.code = m.code
            CROSS JOIN market_environment{x} e WHERE m.market_name = 'プライム'""",
        f"integrated{x}": f"""
            SELECT *, fundamental_total + valuation_total AS growth_invest_score,
                   CASE WHEN financial_health = 'FAIL' THEN 'FAIL_FINANCIAL' WHEN liquidity_grade = 'D' THEN 'FAIL_LIQUIDITY'
                        ELSE 'ACTIVE' END AS screening_status,
                   CASE WHEN liquidity_grade IN ('A', 'B') AND volatility_score >= 3 AND breakout AND volume_surge
                             AND (ma200_trend = 'UP' OR price_vs_ma200 = 'ABOVE') AND market_phase = 'BULL' THEN 'buy_signal'
                        WHEN liquidity_grade IN ('A', 'B', 'C') AND volatility_score >= 2 AND consolidation AND NOT breakout
                        THEN 'wait' ELSE '-' END AS kubota_signal,
                   CASE WHEN near_52w_high THEN 2 ELSE 0 END + CASE WHEN volume_ratio >= 1.5 THEN 1 ELSE 0 END
                     AS price_strength_score,
                   CAST(NULL AS BIGINT) AS signal_confidence
            FROM integrated_base{x}""",
    }


CTES.update(_scores(AS_OF, ""))
CTES.update(_scores(PREVIOUS, "_prev"))


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the tables it names, and those they name, in order of need."""
    known = {**CTES, **(extra or {})}
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if name in known and name not in ordered and name not in stack:
                stack.append(name)
                need(known[name])
                stack.remove(name)
                ordered.append(name)

    stack: list[str] = []
    need(body)
    if not ordered:
        return body
    # Hand the shared tables out once instead of inlining them at every use.
    tables = ",\n".join(f"{name} AS MATERIALIZED ({known[name]})" for name in ordered)
    return f"WITH {tables}\n{body}"
