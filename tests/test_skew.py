"""One key, or one group of copies, holding a third of all rows."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from equiscan.operators import aggregates, joins, ranking
from equiscan.plans import portfolio as pf
from equiscan.plans import reports

N = 30_000


def hot(spark, name="k"):
    return spark.range(N).withColumn(name, F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 997)))


def test_first_per_key_with_a_hot_key(spark):
    out = ranking.first_per_key(hot(spark).withColumn("_o", F.col("id")), ["k"], "_o").collect()
    assert len(out) == 998 and {r.k: r.id for r in out}["hot"] == 0


def test_first_per_key_combines_before_the_shuffle(spark):
    plan = ranking.first_per_key(hot(spark).withColumn("_o", F.col("id")), ["k"], "_o")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_positions_with_a_hot_code(spark):
    t = hot(spark, "code").select(
        F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 300).cast("int")).alias("trade_date"), "code",
        F.col("code").alias("company_name"), F.lit("domestic").alias("product_type"), F.lit("a").alias("account_type"),
        F.lit(1.0).alias("quantity"), F.lit(2.0).alias("unit_price"), F.lit(2.0).alias("amount"), F.lit(2.0).alias("amount_native"),
        F.lit("jpy").alias("amount_unit"),
    )
    got = {r.code: r for r in pf.positions(t).collect()}
    assert got["hot"].shares == N / 3 and sum(r.tx_count for r in got.values()) == N


def test_prefix_join_spreads_rows_without_a_code(spark):
    held = hot(spark, "x").select(
        F.when(F.col("x") != "hot", F.lpad((F.col("id") % 997).cast("string"), 4, "0")).alias("code"),
        F.when(F.col("x") == "hot", "fund").otherwise("domestic").alias("product_type"),
        "id",
    )
    scores = spark.range(997).select(F.concat(F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("0")).alias("code"), F.col("id").alias("s"))
    out = joins.join_by_prefix(held, scores, only="domestic")
    assert out.count() == N and out.filter("s is not null").count() == N - N // 3
    keys = joins._scattered_key(held, "code", "domestic").filter("product_type = 'fund'")
    assert keys.groupBy("_key").count().agg(F.max("count")).first()[0] < N / 100


def test_hot_sector(spark):
    scores = hot(spark, "sector33_name").select(
        F.col("id").cast("string").alias("code"), F.col("id").cast("string").alias("company_name"), "sector33_name",
        F.lit(10.0).alias("avg_turnover_20d_oku"), F.when(F.col("id") % 2 == 0, "buy_signal").otherwise("-").alias("kubota_signal"),
        (F.col("id") % 10).alias("kubota_trade_score"), F.lit(1).alias("growth_invest_score"),
    )
    cells = reports.sector_heatmap(scores)
    assert cells.count() == N
    assert cells.filter("sector = 'hot'").first().sector_color == 3.5
    assert {r.sector33_name: r.total for r in aggregates.sector_signal_pivot(scores).collect()}["hot"] == N / 3


def test_upsert_profile_of_a_hot_duplicate(spark, database):
    import pytest

    from equiscan.sinks.tables import profile_batch

    batch = hot(spark, "code").withColumn("date", F.lit(date(2024, 1, 1)))
    with pytest.raises(ValueError, match=str(N // 3)):
        profile_batch(batch, ["date", "code"], "date")


def test_price_points_on_one_ticker_and_day(spark):
    day = date(2024, 1, 10)
    points = hot(spark, "ticker").select(F.col("id").cast("string").alias("id"), "ticker", F.lit(day).alias("day"))
    quotes = spark.createDataFrame([("hot", day + timedelta(days=1), 5.0), ("hot", day - timedelta(days=1), 4.0)], "ticker string, date date, close double")
    out = pf.price_at(points, quotes)
    assert out.count() == N and out.filter("price = 5").count() == N / 3 and out.filter("price is null").count() == N - N / 3
