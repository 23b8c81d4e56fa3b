"""What stays on disk between the steps of a job: pages, copies and shuffle files."""

import gzip
import json
import time
from datetime import date, timedelta

from pyspark.sql import functions as F

from equiscan.checks import job_queries
from equiscan.sources.derived import Market


def test_pages_are_packed_and_their_records_stay_in_their_task(spark, tmp_path):
    rows = spark.range(0, 2_500, 1, 2).select(
        F.col("id").cast("string").alias("Code"),
        F.when(F.col("id") % 2 == 0, F.struct(F.lit("1").alias("x"), F.lit(None).cast("string").alias("y"))).alias("Reason"),
    )
    job_queries.write_pages(rows, str(tmp_path / "pages"))
    files = sorted((tmp_path / "pages").glob("part-*"))
    assert [f.name.endswith(".json.gz") for f in files] == [True, True]
    pages = [[json.loads(line) for line in gzip.open(f, "rt")] for f in files]
    assert [[len(p["data"]) for p in found] for found in pages] == [[1_000, 250], [1_000, 250]]
    records = [r for found in pages for p in found for r in p["data"]]
    assert [r["Code"] for r in records] == [str(i) for i in range(2_500)]
    assert records[0] == {"Code": "0", "Reason": {"x": "1"}} and records[1] == {"Code": "1"}
    assert {p["pagination_key"] for found in pages for p in found} == {"next"}


def shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name for name in found.split("\n") if "shuffle_" in name}


def test_shuffle_files_go_when_a_derived_table_is_stored(spark, tmp_path):
    lines = spark.createDataFrame(
        [(date(2001, 1, 1) + timedelta(days=i % 50), 1 + i % 3, float(i)) for i in range(300)], "l_shipdate date, l_linenumber int, l_quantity double"
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    before = shuffle_files(spark)
    bars = Market(spark, str(tmp_path)).index_bars()
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.5)  # the cleaner works on its own
    assert not left
    assert bars.count() == 200
