from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from equiscan.plans import indicators as ind
from equiscan.plans.integrate import integrated_score

AS_OF = date(2024, 6, 28)
SCHEMA = "code string, date date, open double, high double, low double, close double, volume bigint, turnover_value double"


def bars(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def flat(code, n, close=100.0, high=101.0, low=99.0, volume=1000, turnover=6e9, end=AS_OF):
    return [(code, end - timedelta(days=i), close, high, low, close, volume, turnover) for i in range(n)]


def one(df, code="A"):
    rows = df.filter(F.col("code") == code).collect()
    return rows[0] if rows else None


def test_liquidity_needs_fifteen_sessions_in_sixty_days(spark):
    df = bars(spark, flat("A", 14) + flat("B", 15) + flat("C", 30, end=AS_OF - timedelta(days=70)))
    assert {r.code for r in ind.liquidity(df, AS_OF).collect()} == {"B"}


@pytest.mark.parametrize(
    "turnover, grade", [(5e9, "PASS_A"), (4.999e9, "PASS_B"), (3e9, "PASS_B"), (1e9, "PASS_C"), (0.99e9, "FAIL")]
)
def test_liquidity_grade_thresholds_are_inclusive(spark, turnover, grade):
    row = one(ind.liquidity(bars(spark, flat("A", 20, turnover=turnover)), AS_OF))
    assert (row.liquidity_grade, row.cv_value, row.cv_grade) == (grade, 0.0, "PASS")


def test_liquidity_zero_turnover_has_no_cv_and_fails(spark):
    row = one(ind.liquidity(bars(spark, flat("A", 20, turnover=0.0)), AS_OF))
    assert (row.cv_value, row.cv_grade, row.liquidity_grade) == (None, "FAIL", "FAIL")


def test_one_row_series(spark):
    df = bars(spark, flat("A", 1))
    vol = one(ind.volatility(df, AS_OF))
    assert (vol.atr_14, vol.atr_pct, vol.hv_20d_pct, vol.hv_contraction) == (2.0, 2.0, None, False)
    cht = one(ind.chart(df, AS_OF))
    assert (cht.ma200_trend, cht.price_vs_ma200, cht.breakout, cht.volume_ratio) == ("FLAT", "BELOW", False, 1.0)
    assert ind.liquidity(df, AS_OF).count() == 0


def test_atr_threshold_equality_scores(spark):
    # true range 1.5 at a close of 100 is exactly 1.5 %
    row = one(ind.volatility(bars(spark, flat("A", 20, high=100.75, low=99.25)), AS_OF))
    assert row.atr_pct == 1.5 and row.volatility_score == 2


def test_missing_high_leaves_the_session_out_of_the_range(spark):
    rows = flat("A", 3)
    rows[1] = rows[1][:3] + (None,) + rows[1][4:]
    row = one(ind.volatility(bars(spark, rows), AS_OF))
    assert row.atr_14 == 2.0


def test_zero_range_has_no_contraction(spark):
    row = one(ind.chart(bars(spark, flat("A", 40, high=100.0, low=100.0)), AS_OF))
    assert (row.range_contraction, row.consolidation) == (None, False)


def test_breakout_counts_an_equal_close(spark):
    rows = flat("A", 12, close=100.0, high=100.0)
    assert one(ind.chart(bars(spark, rows), AS_OF)).breakout is True
    rows[5] = rows[5][:3] + (100.5,) + rows[5][4:]
    assert one(ind.chart(bars(spark, rows), AS_OF)).breakout is False


def test_shared_pass_equals_the_single_operators(spark, desk):
    """The lookbacks differ, so the shared pass must cut every score's frames at its own start."""
    from equiscan.sources.derived import AS_OF as DAY

    b = desk.daily_bars().drop("month")
    # One stock stops 20 days early, one 80 days, one 150 days before the end.
    late = {"00000": 20, "00010": 80, "00020": 150}
    for code, days in late.items():
        b = b.filter((F.col("code") != code) | (F.col("date") <= F.lit(DAY - timedelta(days=days))))
    wide = ind.all_indicators(b, DAY)
    for name, frame in (
        ("liq", ind.liquidity(b, DAY)), ("vol", ind.volatility(b, DAY)), ("cht", ind.chart(b, DAY)),
        ("px", ind.latest_price(b, DAY)),
    ):
        expected = {r.code: r.asDict() for r in frame.collect()}
        got = {r.code: r[name] for r in wide.select("code", name).collect() if r[name] is not None}
        assert set(got) == set(expected), name
        for code, row in got.items():
            for field, value in row.asDict().items():
                assert value == expected[code][field], (name, code, field)


def test_no_market_state_means_no_scores(spark, desk):
    from equiscan.sources.derived import AS_OF as DAY

    empty = desk.index_bars().filter("false")
    df = integrated_score(
        desk.daily_bars(), desk.financial_summary(), desk.earnings_calendar(), empty, desk.equity_master(), DAY
    )
    assert df.count() == 0


def test_score_bounds(desk):
    row = desk.scores().agg(
        F.min("kubota_trade_score").alias("a"), F.max("kubota_trade_score").alias("b"),
        F.min("growth_invest_score").alias("c"), F.max("growth_invest_score").alias("d"),
    ).first()
    assert 0 <= row.a <= row.b <= 10 and 0 <= row.c <= row.d <= 39


def test_unpriced_stock_keeps_null_points(spark, desk):
    from equiscan.sources.derived import AS_OF as DAY

    b = desk.daily_bars().filter((F.col("code") != "00000") | (F.col("date") < F.lit(DAY - timedelta(days=40))))
    df = integrated_score(
        b, desk.financial_summary(), desk.earnings_calendar(), desk.index_bars(), desk.equity_master(), DAY
    )
    row = one(df, "00000")
    assert (row.per_score, row.pbr_score, row.valuation_total, row.per) == (None, None, 0, None)
    assert row.liquidity_grade in (None, "A", "B", "C", "D") and row.latest_close is not None
