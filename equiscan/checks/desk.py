"""Stored intermediate results for the report queries.

Reports read stored scores, signals and positions, as they would in production; the operators that compute
those are registered on their own and run from the bars.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiscan.plans import backtest, integrate, portfolio
from equiscan.sinks.tables import snapshot
from equiscan.sources import ledger
from equiscan.sources.derived import AS_OF, Market

PREVIOUS = AS_OF - timedelta(days=7)


class Desk(Market):
    def integrated(self, as_of: date = AS_OF) -> DataFrame:
        return integrate.integrated_score(
            self.daily_bars(), self.financial_summary(), self.earnings_calendar(), self.index_bars(),
            self.equity_master(), as_of,
        )

    def scores(self) -> DataFrame:
        return self._table("scores", self.integrated)

    def signals(self) -> DataFrame:
        return self._table(
            "signals", lambda: backtest.backtest_signals(self.daily_bars(), self.equity_master(), AS_OF)
        )

    def score_history(self) -> DataFrame:
        def build() -> DataFrame:
            return snapshot(self.integrated(PREVIOUS), PREVIOUS).unionByName(snapshot(self.scores(), AS_OF))

        return self._table("score_history", build, by_month="snapshot_date", sort=("snapshot_date", "code"))

    def ledger(self, kind: str) -> DataFrame:
        parse = {"domestic": ledger.ledger_domestic, "us": ledger.ledger_us, "fund": ledger.ledger_fund}[kind]
        return parse(self.ledger_rows(kind))

    def trades(self) -> DataFrame:
        return ledger.union_ledgers(*[self.ledger(k) for k in ("domestic", "us", "fund")])

    def holdings(self) -> DataFrame:
        return self._table("holdings", lambda: portfolio.positions(self.trades()))

    def us_tickers(self) -> DataFrame:
        return self.holdings().filter(F.col("product_type") == "us").select(F.col("code").alias("ticker"))

    def external_prices(self) -> DataFrame:
        return self._table(
            "external_prices",
            lambda: portfolio.external_prices(
                self.quotes(), self.us_tickers(), self.holdings(), self.fund_proxies(), AS_OF
            ),
        )

    def summary(self) -> DataFrame:
        return self._table(
            "summary", lambda: portfolio.holdings_summary(self.holdings(), self.scores(), self.external_prices())
        )

    def watched(self) -> DataFrame:
        """Holdings as the dashboard sees them, with the ATR of their stock."""
        return portfolio.with_atr(portfolio.holdings_list(self.summary()), self.scores())
