"""Ledgers, positions, valuation and portfolio rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiscan.checks.ctes import AS_OF as AS_OF_SQL
from equiscan.checks.ctes import r
from equiscan.checks.registry import query, rounded
from equiscan.operators import aggregates, joins
from equiscan.plans import portfolio
from equiscan.sources import ledger
from equiscan.sources.derived import AS_OF

SUMMARY_NUMBERS = ("total_shares", "total_cost", "avg_cost_per_share")


def replaced(names: tuple[str, ...], digits: int = 4) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


@query("ledger_domestic", "SELECT * FROM ledger_domestic")
def _(d):
    return d.ledger("domestic")


@query("ledger_us", "SELECT * FROM ledger_us")
def _(d):
    return d.ledger("us")


@query("ledger_fund", "SELECT * FROM ledger_fund")
def _(d):
    return d.ledger("fund")


@query("union_ledgers", "SELECT * FROM trades")
def _(d):
    return d.trades()


@query("positions", f"SELECT * REPLACE ({r('purchase_amount_native', 4)} AS purchase_amount_native) FROM holdings")
def _(d):
    return rounded(portfolio.positions(d.trades()))


@query("agg_ledger", "SELECT code, company_name, shares, purchase_amount, purchase_price, tx_count FROM holdings")
def _(d):
    return portfolio.positions(d.trades()).select(
        "code", "company_name", "shares", "purchase_amount", "purchase_price", "tx_count"
    )


@query(
    "agg_position",
    f"SELECT * REPLACE ({r('total_cost_orig', 4)} AS total_cost_orig, {r('avg_cost_orig', 4)} AS avg_cost_orig) FROM aggregate_positions",
)
def _(d):
    return rounded(portfolio.aggregate_positions(d.holdings()))


@query("agg_fx", "SELECT max(usdjpy_rate) AS usdjpy_rate FROM external_prices")
def _(d):
    return aggregates.latest_fx(d.external_prices())


@query("agg_fund_cost", f"SELECT company_name, {r('avg_cost', 4)} AS avg_cost, first_buy_date FROM fund_costs")
def _(d):
    return rounded(portfolio.fund_costs(d.holdings()))


@query(
    "join_left_true",
    f"SELECT product_type, company_name, code, {r('total_cost', 4)} AS total_cost, usdjpy_rate FROM positions_yen",
)
def _(d):
    totals = portfolio.in_yen(portfolio.aggregate_positions(d.holdings()), aggregates.latest_fx(d.external_prices()))
    return rounded(totals.select("product_type", "company_name", "code", "total_cost", "usdjpy_rate"))


@query(
    "join_prefix",
    """SELECT p.product_type, p.company_name, p.code, s.latest_close, s.kubota_signal
    FROM aggregate_positions p LEFT JOIN integrated s
      ON left(s.code, 4) = p.code
     AND p.product_type = 'domestic'""",
)
def _(d):
    held = portfolio.aggregate_positions(d.holdings()).select("product_type", "company_name", "code")
    return joins.join_by_prefix(held, d.scores().select("code", "latest_close", "kubota_signal"), only="domestic")


@query(
    "join_conditional",
    """SELECT p.product_type, p.company_name, p.code, u.price_jpy AS us_price, f.price_jpy AS fund_price
    FROM aggregate_positions p
    LEFT JOIN external_prices u ON u.ticker = p.code AND p.product_type = 'us' AND u.asset_type = 'us'
    LEFT JOIN external_prices f ON f.asset_name = p.company_name AND p.product_type = 'fund' AND f.asset_type = 'fund'""",
)
def _(d):
    held = portfolio.aggregate_positions(d.holdings()).select("product_type", "company_name", "code")
    prices = d.external_prices()
    us = prices.filter(F.col("asset_type") == "us").select("ticker", F.col("price_jpy").alias("us_price"))
    fund = prices.filter(F.col("asset_type") == "fund").select("asset_name", F.col("price_jpy").alias("fund_price"))
    met = joins.join_where(held, us, "code", "ticker", only="us")
    return joins.join_where(met, fund, "company_name", "asset_name", only="fund")


@query(
    "join_atr",
    f"SELECT product_category, company_name, code, {r('atr_pct', 4)} AS atr_pct FROM watched",
)
def _(d):
    return rounded(d.watched().select("product_category", "company_name", "code", "atr_pct"))


@query(
    "lookup_map",
    """SELECT h.company_name, p.proxy_ticker FROM holdings h LEFT JOIN fund_proxies p ON p.asset_name = h.company_name""",
)
def _(d):
    proxies = d.fund_proxies().withColumnRenamed("asset_name", "company_name")
    return joins.left_on(d.holdings().select("company_name"), proxies, "company_name")


@query("external_us_price", "SELECT * FROM us_price")
def _(d):
    return portfolio.external_us_price(d.quotes(), d.us_tickers(), AS_OF)


@query("fund_nav", "SELECT * FROM fund_nav")
def _(d):
    return portfolio.fund_nav(d.holdings(), d.fund_proxies(), d.quotes(), AS_OF)


@query("holdings_summary", f"SELECT * REPLACE ({replaced(SUMMARY_NUMBERS)}) FROM holdings_summary")
def _(d):
    return rounded(portfolio.holdings_summary(d.holdings(), d.scores(), d.external_prices()))


@query(
    "portfolio_totals",
    f"""SELECT coalesce(sum(current_value), 0) AS total_value,
           coalesce(sum(unrealized_pnl) FILTER (current_value IS NOT NULL), 0) AS total_pnl,
           {r('coalesce(sum(total_cost) FILTER (current_value IS NOT NULL), 0)', 2)} AS total_cost,
           {r('avg(return_pct) FILTER (current_value IS NOT NULL)', 2)} AS avg_return_pct, count(*) AS holding_count
    FROM holdings_summary""",
)
def _(d):
    return rounded(portfolio.portfolio_totals(d.summary()), 2)


@query(
    "category_totals",
    f"""SELECT product_category, {r('v', 2)} AS total_value, {r('p', 2)} AS total_pnl, {r('c', 2)} AS total_cost,
           coalesce({r('m', 2)}, CASE WHEN c > 0 THEN {r('(v - c) / c * 100', 2)} END) AS return_pct, holding_count
    FROM (SELECT product_category, coalesce(sum(current_value), 0) AS v, coalesce(sum(unrealized_pnl), 0) AS p,
                 coalesce(sum(total_cost), 0) AS c, avg(return_pct) AS m, count(*) AS holding_count
          FROM holdings_summary WHERE current_value IS NOT NULL GROUP BY product_category)""",
)
def _(d):
    return rounded(portfolio.category_totals(d.summary()), 2)


ACTION_SQL = """CASE WHEN return_pct < -8 THEN 'stop_loss' WHEN days_to_earnings <= 14 THEN 'earnings_caution'
    WHEN return_pct >= 20 THEN 'take_profit' WHEN kubota_signal = 'buy_signal' THEN 'keep' ELSE 'watch' END"""


@query("holding_action", f"SELECT product_category, company_name, code, account, {ACTION_SQL} AS action FROM holdings_summary")
def _(d):
    return portfolio.holding_action(d.summary()).select("product_category", "company_name", "code", "account", "action")


@query("agg_value_counts", f"SELECT {ACTION_SQL} AS action, count(*) AS n FROM holdings_summary GROUP BY 1")
def _(d):
    return aggregates.value_counts(portfolio.holding_action(d.summary()), "action")


STOPS = {
    "stops": """
        SELECT *, CASE WHEN purchase_price IS NOT NULL AND latest_close IS NOT NULL THEN
                 CASE WHEN atr_pct > 0 THEN latest_close * (1 - atr_pct / 100 * 2) ELSE purchase_price * 0.92 END END AS atr_stop,
               CASE WHEN purchase_price IS NOT NULL AND latest_close IS NOT NULL THEN purchase_price * 0.92 END AS fixed_stop
        FROM watched""",
    "stop_states": """
        SELECT *, CASE WHEN atr_stop > 0 THEN (latest_close - atr_stop) / atr_stop * 100 END AS atr_dist,
               CASE WHEN fixed_stop > 0 THEN (latest_close - fixed_stop) / fixed_stop * 100 END AS fixed_dist
        FROM stops""",
}


def status(stop: str, dist: str) -> str:
    return f"""CASE WHEN {dist} IS NULL THEN 'UNKNOWN' WHEN latest_close <= {stop} THEN 'BREACHED' WHEN {dist} <= 3 THEN 'CRITICAL'
        WHEN {dist} <= 7 THEN 'WARNING' ELSE 'SAFE' END"""


@query(
    "stop_loss",
    f"""SELECT company_name, code, account, {r('atr_stop', 4)} AS stop_price, {r('atr_dist', 4)} AS distance_pct,
           {status('atr_stop', 'atr_dist')} AS stop_status FROM stop_states""",
    STOPS,
)
def _(d):
    out = portfolio.stop_loss(d.watched())
    return rounded(out.select("company_name", "code", "account", "stop_price", "distance_pct", "stop_status"))


@query(
    "stop_loss_table",
    f"""SELECT company_name, code, account, {r('fixed_stop', 4)} AS stop_price, {r('fixed_dist', 4)} AS distance_pct,
           {status('fixed_stop', 'fixed_dist')} AS stop_status,
           {r('least(greatest(fixed_dist, 0), 20) / 20 * 100', 4)} AS gauge FROM stop_states
    WHERE product_category = 'domestic' AND purchase_price IS NOT NULL AND latest_close IS NOT NULL""",
    STOPS,
)
def _(d):
    out = portfolio.stop_loss_table(d.watched(), use_atr=False)
    return rounded(out.select("company_name", "code", "account", "stop_price", "distance_pct", "stop_status", "gauge"))


@query(
    "holding_alerts",
    f"""SELECT code, company_name, account, effective_status, {r('dist', 4)} AS effective_distance_pct, priority FROM (
      SELECT *, CASE WHEN effective_status = 'BREACHED' THEN 0 WHEN effective_status = 'CRITICAL' THEN 1
                     WHEN return_pct >= 20 THEN 2 WHEN days_to_earnings <= 7 THEN 3 WHEN days_to_earnings <= 14 THEN 4
                     WHEN effective_status = 'WARNING' THEN 5 END AS priority
      FROM (SELECT *, CASE WHEN atr_pct IS NOT NULL AND atr_dist IS NOT NULL THEN {status('atr_stop', 'atr_dist')}
                           ELSE {status('fixed_stop', 'fixed_dist')} END AS effective_status,
                   CASE WHEN atr_pct IS NOT NULL AND atr_dist IS NOT NULL THEN atr_dist ELSE fixed_dist END AS dist
            FROM stop_states)) WHERE priority IS NOT NULL""",
    STOPS,
)
def _(d):
    out = portfolio.holding_alerts(d.watched())
    return rounded(
        out.select("code", "company_name", "account", "effective_status", "effective_distance_pct", "priority")
    )


@query(
    "price_vs_cost",
    f"""SELECT h.code, h.company_name, h.account, {r('h.avg_cost_per_share', 4)} AS purchase_price, c.close AS last_close,
           {r('c.close - h.avg_cost_per_share', 4)} AS diff,
           {r('(c.close - h.avg_cost_per_share) / h.avg_cost_per_share * 100', 4)} AS diff_pct,
           CASE WHEN c.close IS NULL OR h.avg_cost_per_share IS NULL THEN 'none'
                WHEN (c.close - h.avg_cost_per_share) / h.avg_cost_per_share * 100 >= 10 THEN 'high'
                WHEN (c.close - h.avg_cost_per_share) / h.avg_cost_per_share * 100 >= 0 THEN 'gain'
                WHEN (c.close - h.avg_cost_per_share) / h.avg_cost_per_share * 100 >= -5 THEN 'dip' ELSE 'loss' END AS band
    FROM holdings_summary h LEFT JOIN (SELECT code, arg_max(close, date) AS close FROM daily_bars
      WHERE date BETWEEN {AS_OF_SQL} - 400 AND {AS_OF_SQL} GROUP BY code) c
      ON left(c.code, 4) = h.code
    WHERE h.product_category = 'domestic'""",
)
def _(d):
    return rounded(portfolio.price_vs_cost(portfolio.holdings_list(d.summary()), d.daily_bars(), AS_OF))


@query(
    "goal_progress",
    f"""SELECT cur AS current, CAST(10000000 AS DOUBLE) AS target, {r('least(cur / 10000000.0 * 100, 100)', 4)} AS progress_pct,
           CAST(greatest(10000000 - cur, 0) AS DOUBLE) AS remaining
    FROM (SELECT CAST(floor(coalesce(sum(current_value), 0) / 10000) AS BIGINT) AS cur FROM holdings_summary)""",
)
def _(d):
    return rounded(portfolio.goal_progress(portfolio.portfolio_totals(d.summary()), target=10_000_000))


@query("job_holdings", "SELECT code, company_name, product_type, account_type, shares, purchase_date, tx_count FROM holdings")
def _(d):
    from equiscan.checks.job_queries import scratch_table
    from equiscan.plans import jobs

    table = scratch_table(d, "holdings")
    jobs.run_holdings(ledger.union_ledgers(*[d.ledger(k) for k in ("domestic", "us", "fund")]), table)
    return d.spark.table(table).select(
        "code", "company_name", "product_type", "account_type", "shares", "purchase_date", "tx_count"
    )


@query("job_external_prices", "SELECT * FROM external_prices")
def _(d):
    from equiscan.checks.job_queries import scratch_table
    from equiscan.plans import jobs

    table = scratch_table(d, "external_prices")
    jobs.run_external_prices(d.quotes(), d.us_tickers(), d.holdings(), d.fund_proxies(), AS_OF, table)
    return d.spark.table(table)
