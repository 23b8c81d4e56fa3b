import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from equiscan.operators.windows import Slide, count_last, series, sliding


def brute(values, i, k, how):
    frame = [v for v in values[max(0, i - k + 1) : i + 1] if v is not None]
    if how == "max":
        return max(frame, default=None)
    if how == "min":
        return min(frame, default=None)
    if how == "avg":
        return sum(frame) / len(frame) if frame else None
    if how == "full_avg":
        return sum(frame) / k if len(frame) == k else None
    if len(frame) < 2:
        return None
    mean = sum(frame) / len(frame)
    return math.sqrt(sum((v - mean) ** 2 for v in frame) / (len(frame) - 1))


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(7)
    data = {}
    for code, n in (("A", 300), ("B", 1), ("C", 37), ("D", 130)):
        level, values = 1000.0, []
        for _ in range(n):
            level += rng.uniform(-5, 5)
            values.append(None if rng.random() < 0.1 else level)
        data[code] = values
    rows = [(c, date(2020, 1, 1) + timedelta(days=i), v) for c, vs in data.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    return data, spark.createDataFrame(rows, "code string, date date, x double")


@pytest.mark.parametrize("k", [1, 2, 3, 8, 10, 25, 60, 100, 200])
def test_sliding_matches_brute_force(walk, k):
    data, df = walk
    out = sliding(df, {h: Slide(h, "x", k) for h in ("avg", "full_avg", "stddev", "max", "min")})
    got = {(r.code, r.date): r for r in out.collect()}
    assert len(got) == sum(len(v) for v in data.values())
    for code, values in data.items():
        for i in range(len(values)):
            row = got[code, date(2020, 1, 1) + timedelta(days=i)]
            for how in ("avg", "full_avg", "stddev", "max", "min"):
                expected = brute(values, i, k, how)
                assert (row[how] is None) == (expected is None), (code, i, how)
                if expected is not None:
                    assert row[how] == pytest.approx(expected, rel=1e-9, abs=1e-9), (code, i, how)


def test_constant_series_has_no_spread(spark):
    rows = [("A", date(2020, 1, 1) + timedelta(days=i), 1234.56) for i in range(90)]
    out = sliding(spark.createDataFrame(rows, "code string, date date, x double"), {"s": Slide("stddev", "x", 60)})
    assert {r.s for r in out.collect()} == {None, 0.0}


def test_several_columns_share_one_exchange_and_one_sort(walk):
    _, df = walk
    out = sliding(df.withColumn("y", F.col("x") * 2), {"a": Slide("avg", "x", 200), "b": Slide("max", "y", 250)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_count_last_is_capped(walk):
    _, df = walk
    counts = df.select("code", count_last(20, series()).alias("n")).groupBy("code").agg(F.max("n").alias("n"))
    assert {r.code: r.n for r in counts.collect()} == {"A": 20, "B": 1, "C": 20, "D": 20}
