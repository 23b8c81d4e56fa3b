"""A day added to the stored state gives what all bars give, and reads no more than that day and the state."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from equiscan.plans import daily_state, indicators
from equiscan.sources.derived import AS_OF


def plain(df):
    def value(v):
        return tuple(map(value, v)) if isinstance(v, tuple) else round(v, 3) if isinstance(v, float) else v

    return sorted((value(tuple(r)) for r in df.select(sorted(df.columns)).collect()), key=str)


def sessions(state):
    return sorted(((r.code, [tuple(s) for s in r.sessions]) for r in state.collect()), key=lambda r: r[0])


@pytest.fixture(scope="module")
def bars(desk):
    return desk.daily_bars()


def test_scores_of_a_built_state_are_those_of_the_bars(bars):
    state = daily_state.built(bars, AS_OF)
    assert plain(daily_state.all_indicators(state, AS_OF)) == plain(indicators.all_indicators(bars, AS_OF))
    assert plain(daily_state.latest_price(state, AS_OF)) == plain(indicators.latest_price(bars, AS_OF))


def test_days_added_one_by_one_give_the_state_of_the_whole(bars):
    start = AS_OF - timedelta(days=9)
    state = daily_state.built(bars, start)
    for i in range(1, 10):
        day = start + timedelta(days=i)
        state = daily_state.advanced(state, bars.where(F.col("date") == F.lit(day)), day)
    assert sessions(state) == sessions(daily_state.built(bars, AS_OF))


def test_new_codes_gone_codes_and_a_day_that_comes_again(spark):
    columns = "code string, date date, high double, low double, close double, volume long, turnover_value double"
    row = lambda code, day, close: (code, date.fromisoformat(day), close, close, close, 1, close)
    old = spark.createDataFrame([row("A", "2024-01-05", 1.0), row("B", "2024-01-04", 2.0), row("C", "2023-03-20", 3.0)], columns)
    state = daily_state.built(old, date(2024, 1, 5))
    new = spark.createDataFrame([row("A", "2024-01-08", 4.0), row("D", "2024-01-08", 5.0)], columns)
    once = daily_state.advanced(state, new, date(2024, 1, 8))
    closes = lambda s: {c: [x[3] for x in rows] for c, rows in sessions(s)}
    assert closes(once) == {"A": [4.0, 1.0], "B": [2.0], "C": [3.0], "D": [5.0]}
    assert sessions(daily_state.advanced(once, new, date(2024, 1, 8))) == sessions(once)
    corrected = daily_state.advanced(once, new.where("code = 'A'").withColumn("close", F.lit(6.0)), date(2024, 1, 8))
    assert closes(corrected)["A"] == [6.0, 1.0]
    # C leaves the lookback with the next days, also without bars.
    assert set(closes(daily_state.advanced(once, new.limit(0), date(2024, 1, 20)))) == {"A", "B", "D"}
    assert daily_state.built(old.limit(0), AS_OF).count() == 0


def test_the_stored_state_is_brought_forward_and_old_ones_go(spark, bars, database):
    table = f"{database}.price_state"
    days = [AS_OF - timedelta(days=d) for d in (8, 5, 2, 0)]
    for day in days:
        state = daily_state.bring_forward(bars, table, day)
    assert daily_state.stored_days(spark, table) == days[-2:]
    first = sessions(state)
    assert first == sessions(daily_state.built(bars, AS_OF))
    again = daily_state.bring_forward(bars, table, AS_OF)  # the run of a day is repeated
    assert sessions(again) == first and daily_state.stored_days(spark, table) == days[-2:]


def test_a_day_reads_its_bars_and_the_state_and_moves_no_history(spark, bars, database):
    table = f"{database}.price_state"
    before = daily_state.bring_forward(bars, table, AS_OF - timedelta(days=1))
    since = bars.where((F.col("date") > F.lit(AS_OF - timedelta(days=1))) & (F.col("month") == AS_OF.strftime("%Y-%m")))
    text = daily_state.advanced(before, since, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in text
    moved = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) <= 2  # the rows of the new day: to their codes, then to the buckets of the state
    state_branch = text[: text.index("Exchange hashpartitioning")]
    assert "Bucketed: true" in state_branch or "Bucketed: true" in text[text.rindex("Exchange hashpartitioning") :]
    scores = daily_state.all_indicators(before, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in scores and "Sort [" not in scores
