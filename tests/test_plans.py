"""What the physical plans must and must not contain."""

import re

import pytest

from equiscan.checks.registry import REGISTRY
from equiscan.checks import catalog  # noqa: F401
from equiscan.plans import indicators
from equiscan.sources.derived import AS_OF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("operator", [indicators.liquidity, indicators.volatility, indicators.chart, indicators.all_indicators])
def test_indicators_scan_once_and_shuffle_once(desk, operator):
    text = plan(operator(desk.daily_bars(), AS_OF))
    assert text.count("FileScan parquet") == 1
    assert text.count("Exchange hashpartitioning(code") == 1 and text.count("Exchange") == 1
    assert text.count("Sort [") == 1
    assert re.search(r"PartitionFilters: \[[^\]]*month", text) and re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(date", text)


def test_indicator_scans_read_only_their_columns(desk):
    text = plan(indicators.liquidity(desk.daily_bars(), AS_OF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"code", "date", "close", "turnover_value"} - ({"close"} if "close" not in schema else set())


@pytest.mark.parametrize(
    "key",
    ["integrated_score", "backtest_signals", "holdings_summary", "fund_nav", "valuation", "report_price_matrix", "sector_heatmap",
     "return_histogram", "catchup_window", "join_cross_1row", "join_left_true"],
)
def test_no_product_joins_and_no_python(desk, key):
    text = plan(REGISTRY[key].run(desk))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert banned not in text, banned


def test_backtest_sorts_its_series_once(desk):
    text = plan(REGISTRY["backtest_signals"].run(desk))
    assert text.count("Sort [code") == 1


def test_windows_over_bucketed_bars_need_no_exchange(desk):
    df = REGISTRY["series_buckets"].run(desk)
    df.collect()
    text = plan(df)
    assert "Exchange" not in text and "Bucketed: true" in text
