from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from equiscan.plans import portfolio as pf
from equiscan.sources import ledger

DAY = date(2024, 6, 28)


def test_read_ledger_sheet(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "更新日,,\n2024/6/28,https://example.org\n約定日,銘柄コード,銘柄名,口座区分,売買区分,数量[株],単価[円]\n"
        '2024/1/5,7203,トヨタ,特定,買付,"1,900株","¥2,500"\n,,,,,,\n2024-1-6,7203,トヨタ,特定,売付,100,1\n1/7/2024,6758,ソニー,NISA,買付,0,100\n'
        "2024/1/8,9999\nいつか,1,x,x,買付,1,1\n"
    )
    rows = ledger.read_ledger(spark, str(tmp_path / "a.csv"))
    assert rows.columns[0] == "約定日" and rows.count() == 5
    got = {r.code: r for r in ledger.ledger_domestic(rows).collect()}
    assert set(got) == {"7203", "6758"}
    assert (got["7203"].quantity, got["7203"].unit_price, got["7203"].amount) == (1900.0, 2500.0, 4_750_000.0)
    assert (got["6758"].trade_date, got["6758"].amount) == (date(2024, 1, 7), None)


def test_missing_required_column_gives_no_ledger(spark):
    assert ledger.ledger_us(spark.createDataFrame([("a",)], "`約定日` string")) is None


def trades(spark, rows):
    schema = (
        "trade_date date, code string, company_name string, product_type string, account_type string, quantity double, "
        "unit_price double, amount double, amount_native double, amount_unit string, fx_rate double"
    )
    return spark.createDataFrame(rows, schema)


def test_positions(spark):
    rows = [
        (date(2024, 1, 5), "7203", "late", "domestic", "b", 10.0, 5.0, 50.0, 50.0, "jpy", None),
        (date(2024, 1, 2), "7203", "early", "domestic", "a", 30.0, 1.0, None, None, "jpy", None),
        (date(2024, 1, 3), None, "Fund", "fund", "a", 20000.0, 1.5, 30000.0, 30000.0, "per_10k", None),
        (date(2024, 1, 4), " ", "Fund", "fund", "a", 10000.0, 1.5, 7.0, 7.0, "jpy", None),
        (date(2024, 1, 4), "X", "Unpriced", "us", "a", None, None, None, None, "usd", None),
    ]
    got = {r.company_name: r for r in pf.positions(trades(spark, rows)).collect()}
    assert (got["early"].shares, got["early"].purchase_amount, got["early"].purchase_price) == (40.0, 50.0, 1.25)
    assert (got["early"].purchase_date, got["early"].latest_purchase_date, got["early"].tx_count) == (
        date(2024, 1, 2), date(2024, 1, 5), 2,
    )
    assert got["Fund"].purchase_amount_native == 10.0 and got["Fund"].tx_count == 2
    assert got["Unpriced"].shares is None and got["Unpriced"].purchase_price is None


def test_price_at_takes_the_next_bar_else_the_last_before(spark):
    quotes = spark.createDataFrame(
        [("T", DAY + timedelta(days=n), float(100 + n)) for n in (-11, -10, -3, 2, 4, 5)]
        + [("U", DAY - timedelta(days=1), 7.0), ("V", DAY + timedelta(days=5), 9.0), ("W", DAY - timedelta(days=11), 3.0)],
        "ticker string, date date, close double",
    )
    points = spark.createDataFrame([(t, t, DAY) for t in "TUVWX"], "id string, ticker string, day date")
    got = {r.id: r.price for r in pf.price_at(points, quotes).collect()}
    assert got == {"T": 102.0, "U": 7.0, "V": None, "W": None, "X": None}


def test_price_at_against_brute_force(spark):
    import random

    rng = random.Random(3)
    bars = {(t, DAY + timedelta(days=d)): float(rng.randint(1, 99)) for t in "AB" for d in range(-60, 60) if rng.random() < 0.12}
    points = [(f"{i}", rng.choice("AB"), DAY + timedelta(days=rng.randint(-50, 50))) for i in range(80)]
    expected = {}
    for i, t, day in points:
        window = sorted((d, c) for (u, d), c in bars.items() if u == t and day - timedelta(days=10) <= d < day + timedelta(days=5))
        after = [c for d, c in window if d >= day]
        expected[i] = after[0] if after else (window[-1][1] if window else None)
    quotes = spark.createDataFrame([(t, d, c) for (t, d), c in bars.items()], "ticker string, date date, close double")
    frame = spark.createDataFrame(points, "id string, ticker string, day date")
    assert {r.id: r.price for r in pf.price_at(frame, quotes).collect()} == expected


def holding(spark, **values):
    row = {
        "product_category": "domestic", "code": "7203", "company_name": "n", "account": "a", "purchase_price": 100.0,
        "latest_close": 100.0, "atr_pct": None, "return_pct": None, "days_to_earnings": None, "kubota_signal": None,
        **values,
    }
    schema = (
        "product_category string, code string, company_name string, account string, purchase_price double, latest_close double, "
        "atr_pct double, return_pct double, days_to_earnings int, kubota_signal string"
    )
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)


@pytest.mark.parametrize(
    "close, atr, status",
    [(92.0, None, "BREACHED"), (94.75, None, "CRITICAL"), (98.44, None, "WARNING"), (99.0, None, "SAFE"),
     (100.0, 1.0, "CRITICAL"), (100.0, 3.0, "WARNING"), (100.0, 60.0, "UNKNOWN"), (None, None, "UNKNOWN")],
)
def test_stop_status(spark, close, atr, status):
    assert pf.stop_loss(holding(spark, latest_close=close, atr_pct=atr)).first().stop_status == status


@pytest.mark.parametrize(
    "values, priority",
    [
        ({"latest_close": 90.0}, 0), ({"latest_close": 93.0}, 1), ({"return_pct": 20.0}, 2), ({"days_to_earnings": 7}, 3),
        ({"days_to_earnings": 14}, 4), ({"latest_close": 98.0}, 5), ({"latest_close": 120.0}, None),
        # A stop below zero says nothing, so the fixed rule decides.
        ({"latest_close": 90.0, "atr_pct": 60.0}, 0),
    ],
)
def test_alert_priority(spark, values, priority):
    rows = pf.holding_alerts(holding(spark, **values)).collect()
    assert [r.priority for r in rows] == ([] if priority is None else [priority])


@pytest.mark.parametrize(
    "values, action",
    [
        ({"return_pct": -8.1, "days_to_earnings": 1}, "stop_loss"), ({"return_pct": -8.0, "days_to_earnings": 14}, "earnings_caution"),
        ({"return_pct": 20.0, "days_to_earnings": 15}, "take_profit"), ({"kubota_signal": "buy_signal"}, "keep"), ({}, "watch"),
    ],
)
def test_action(spark, values, action):
    assert pf.holding_action(holding(spark, **values)).first().action == action


def test_totals_of_nothing_are_zero(spark, desk):
    row = pf.portfolio_totals(desk.summary().filter("false")).first()
    assert (row.total_value, row.total_pnl, row.total_cost, row.avg_return_pct, row.holding_count) == (0.0, 0.0, 0.0, None, 0)
    progress = pf.goal_progress(pf.portfolio_totals(desk.summary().filter("false"))).first()
    assert (progress.progress_pct, progress.remaining) == (0.0, 10_000.0)


def test_default_rate_without_external_prices(spark, desk):
    empty = desk.external_prices().filter("false")
    out = pf.holdings_summary(desk.holdings(), desk.scores(), empty)
    us = out.filter(F.col("product_category") == "us").first()
    native = desk.holdings().filter((F.col("product_type") == "us") & (F.col("code") == us.code)).first()
    assert us.total_cost == round(native.purchase_amount_native * 150) and us.latest_close is None
    assert out.count() == desk.holdings().count()


def test_as_of_prices_equal_a_search_of_every_window_and_nothing_is_multiplied(spark):
    import random
    from datetime import timedelta

    draw, start = random.Random(2), date(2024, 1, 1)
    quotes = {(t, start + timedelta(days=d)): float(draw.randint(1, 99)) for t in "ABC" for d in range(120) if draw.random() < 0.25}
    points = [(i, draw.choice(["A", "B", "C", "Z", None]), start + timedelta(days=draw.randint(-20, 140))) for i in range(300)]
    points += [(1000 + i, "A", start + timedelta(days=50)) for i in range(200)] + [(2000, "A", None)]  # many funds with one proxy
    q = spark.createDataFrame([(t, d, c) for (t, d), c in quotes.items()], "ticker string, date date, close double")
    p = spark.createDataFrame(points, "id int, ticker string, day date")

    def searched(ticker, day):
        if day is None:
            return None
        after = [quotes[ticker, day + timedelta(days=k)] for k in range(5) if (ticker, day + timedelta(days=k)) in quotes]
        before = [quotes[ticker, day - timedelta(days=k)] for k in range(1, 11) if (ticker, day - timedelta(days=k)) in quotes]
        return (after or before or [None])[0]

    found = pf.price_at(p, q)
    assert found.columns == ["id", "ticker", "day", "price"]
    assert {r.id: r.price for r in found.collect()} == {i: searched(t, d) for i, t, d in points}
    text = pf.price_at(p, q)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and text.count("Window [") == 1
