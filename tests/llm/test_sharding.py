import math
import numpy as np
from pyspark.sql import functions as F

from equiscan.llm import sharding


def test_matrix_has_the_rows_and_columns_asked_for():
    counts = [0, 5, 17, 100, 1]
    sizes = sharding.shard_sizes(sum(counts), 8)
    matrix = sharding.communication_matrix(counts, sizes, 3)
    assert matrix.sum(1).tolist() == counts and matrix.sum(0).tolist() == sizes.tolist() and (matrix >= 0).all()
    huge = sharding.communication_matrix([10**9, 2 * 10**9], sharding.shard_sizes(3 * 10**9, 8), 3)
    assert huge.sum(1).tolist() == [10**9, 2 * 10**9] and huge.min() > 0


def test_counts_follow_the_hypergeometric_law():
    sizes = sharding.shard_sizes(40, 4)
    drawn = np.array([sharding.communication_matrix([10, 30], sizes, seed)[0, 0] for seed in range(3000)])
    assert abs(drawn.mean() - 2.5) < 0.1
    assert abs(drawn.var() - 10 * 0.25 * 0.75 * 30 / 39) < 0.15


def placed(spark, path, **kw):
    return sharding.shard_rows(sharding.read_located(spark, path), **kw)


def test_every_row_once_with_gapless_slots(spark, small, documents):
    got = placed(spark, f"{small}/documents.parquet", block_rows=16)
    assert got.columns == [*documents.columns, "shard", "slot"]
    assert got.drop("shard", "slot").exceptAll(documents).isEmpty() and got.count() == documents.count()
    by_shard = got.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("d")).collect()
    sizes = [r.n for r in by_shard]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    assert all(r.a == 0 and r.b == r.n - 1 and r.d == r.n for r in by_shard)


def test_same_seed_same_result_and_another_one_differs(spark, small):
    path = f"{small}/documents.parquet"
    key = lambda seed: sorted((r.doc_id, r.shard, r.slot) for r in placed(spark, path, seed=seed).select("doc_id", "shard", "slot").collect())
    assert key(1) == key(1) != key(2)


def test_awkward_rows(spark, messy, no_documents, tmp_path):
    messy.write.parquet(str(tmp_path / "m"))
    got = placed(spark, str(tmp_path / "m"), shards=3).collect()
    assert len(got) == messy.count() and {r.shard for r in got} == {0, 1, 2}
    assert sorted((r.shard, r.slot) for r in got) == sorted({(r.shard, r.slot) for r in got})
    assert placed(spark, str(tmp_path / "m"), shards=3).columns == [c for c in messy.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    odd = messy.withColumnsRenamed({"_row": "__ROW", "words": "_file", "key": "_"})
    odd.write.parquet(str(tmp_path / "o"))
    got = placed(spark, str(tmp_path / "o"), shards=3)
    assert {"__ROW", "_file", "_"} <= set(got.columns) and {(r["__ROW"], r["_file"], r["_"]) for r in got.collect()} == {("r", "w", "k")}
    no_documents.write.parquet(str(tmp_path / "n"))
    assert placed(spark, str(tmp_path / "n")).collect() == []


def test_counts_follow_the_hypergeometric_law_at_every_size():
    random = np.random.Generator(np.random.PCG64(5))
    n = 20_000
    # Beyond a billion rows, few marked: close to Poisson with mean 1/2, which a normal law would miss by far.
    few = [sharding._without_replacement(random, 10**6, 2 * 10**9, 1000) for _ in range(n)]
    for k in range(4):
        expected = math.exp(-0.5) * 0.5**k / math.factorial(k)
        assert abs(few.count(k) / n - expected) < 0.015
    # The law itself, against exact binomials.
    for marked, rest, drawn in ((5, 7, 6), (30, 10, 25), (3, 40, 20), (40, 3, 41)):
        got = [sharding._hypergeometric(random, marked, rest, drawn) for _ in range(n)]
        for k in range(max(0, drawn - rest), min(marked, drawn) + 1):
            expected = math.comb(marked, k) * math.comb(rest, drawn - k) / math.comb(marked + rest, drawn)
            assert abs(got.count(k) / n - expected) < 0.015
    large = np.array([sharding._hypergeometric(random, 10**11, 7 * 10**11, 10**9) for _ in range(200)])
    assert abs(large.mean() - 10**9 / 8) < 5 * 10_459 / 200**0.5 and 0.8 < large.std() / 10_451 < 1.2
