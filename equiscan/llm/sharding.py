"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Partition ``p`` holds ``n_p`` rows. One draw without replacement gives the matrix: how many rows each partition sends to
each shard, row sums ``n_p``, column sums the exact shard sizes, distributed as in a uniform shuffle of all rows. Each
partition then deals its row of the matrix by a random permutation, rows are exchanged, and each shard is permuted again.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equiscan.session import staged

#: Above this many rows numpy draws no hypergeometric counts.
_NUMPY_ROWS = 10**9 - 1
#: Partitions of the input whose counts the driver reads, 8 bytes a cell of the matrix.
MAX_PARTITIONS = 2_000_000
#: Files whose row of the matrix, some 200 bytes, is still broadcast.
BROADCAST_FILES = 100_000
#: Rows that one task permutes.
BLOCK_ROWS = 4_096


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def _hypergeometric(random: np.random.Generator, marked: int, rest: int, drawn: int) -> int:
    """Inversion of the hypergeometric law from its mode, by the ratios of neighbouring weights; any number of balls."""
    low, high, total = max(0, drawn - rest), min(marked, drawn), marked + rest
    mode = min(high, max(low, (drawn + 1) * (marked + 1) // (total + 2)))
    step = 64 + int(12 * math.sqrt(drawn * (marked / total) * (rest / total) * ((total - drawn) / total)))

    def weights(up: bool) -> np.ndarray:
        """Relative to the mode's, from its neighbour outwards as far as a double can tell them from nothing."""
        parts, at, last = [], mode, 1.0
        while last > 1e-30 and at != (high if up else low):
            if up:
                k = np.arange(at, min(high, at + step), dtype=np.float64)
                ratio = (marked - k) / (k + 1) * ((drawn - k) / (rest - drawn + k + 1))
            else:
                k = np.arange(at, max(low, at - step), -1, dtype=np.float64)
                ratio = k / (marked - k + 1) * ((rest - drawn + k) / (drawn - k + 1))
            parts.append(last * np.cumprod(ratio))
            at, last = at + (len(k) if up else -len(k)), float(parts[-1][-1])
        return np.concatenate(parts) if parts else np.zeros(0)

    below, above = weights(False), weights(True)
    sums = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return mode - len(below) + min(int(np.searchsorted(sums, random.random() * sums[-1], side="right")), len(sums) - 1)


def _without_replacement(random: np.random.Generator, marked: int, rest: int, drawn: int) -> int:
    """Marked balls among ``drawn`` from an urn: hypergeometric at every size."""
    low, high = max(0, drawn - rest), min(marked, drawn)
    if low >= high:
        return low
    if marked + rest <= _NUMPY_ROWS:
        return int(random.hypergeometric(marked, rest, drawn))
    return _hypergeometric(random, marked, rest, drawn)


def communication_matrix(counts: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows of partition x rows to shard; partitions one after the other draw from what the shards have left."""
    random = np.random.Generator(np.random.PCG64(seed))
    left = sizes.astype(np.int64).copy()
    matrix = np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts):
        rest = int(left.sum())
        for s in range(len(sizes)):
            rest -= int(left[s])
            matrix[p, s] = got = _without_replacement(random, int(left[s]), rest, n)
            n -= got
        left -= matrix[p]
    return matrix


def _dealt(seed: int):
    """Shard of the row at ``position`` of partition ``part``: its row of the matrix, permuted.

    A task keeps the permuted row of the part it is in, so it is dealt once a task and not once a batch.
    """

    @F.pandas_udf("int")
    def shard(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held, labels = None, np.zeros(0, np.int32)
        for part, position, row in batches:
            out = np.zeros(len(part), np.int32)
            for p in part.unique():
                here = (part == p).to_numpy()
                if p != held:
                    counts = np.asarray(row[here].iloc[0], np.int64)
                    held, labels = p, np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                    np.random.Generator(np.random.PCG64([seed, int(p)])).shuffle(labels)
                out[here] = labels[position[here].to_numpy()]
            yield pd.Series(out)

    return shard


def _named(columns: list[str], name: str) -> str | None:
    """The column ``name`` of :func:`read_located`: the one with the most underscores before it."""
    return max((c for c in columns if re.fullmatch(f"_+{name}", c)), key=len, default=None)


def read_located(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with ``_file`` and ``_row``: where each row is stored, the same in every read.

    Where the table has a column of such a name, the new one gets one underscore more than that.
    """
    table = spark.read.parquet(path)
    names = []
    for name in ("file", "row"):
        taken = [len(c) - len(name) for c in table.columns if re.fullmatch(f"_+{name}", c.lower())]
        names.append("_" * (max(taken, default=0) + 1) + name)
    return table.select("*", F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1]))


def shard_rows(
    docs: DataFrame, shards: int = 8, seed: int = 1, file: str | None = None, row: str | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All columns of ``docs`` and shard (0 to ``shards`` - 1) and slot (gapless from 0 in a shard).

    ``file`` and ``row`` say where a row is stored, row from 0 without gaps; by default they are the columns that
    :func:`read_located` added. They are not returned. Shard sizes differ by one row at most, and every arrangement is equally likely. The result depends on the
    stored files and ``seed`` only, so a task that runs again deals the same rows. Texts move once, in the exchange.

    Rows are told apart by their place, so nulls, repeated rows and texts of any length are ordinary rows. An empty
    table gives no rows. Columns of ``docs`` that are themselves named shard or slot give way to the new ones.
    """
    file, row = file or _named(docs.columns, "file"), row or _named(docs.columns, "row")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (file, row) and c.lower() not in ("shard", "slot")]
    spark, docs = docs.sparkSession, docs.select(F.struct(*kept or [F.lit(0).alias("_")]).alias("_doc"), F.col(file).alias("_file"), F.col(row).alias("_row"))
    file, row = "_file", "_row"
    counts = docs.groupBy(F.col(file).alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.orderBy("_f").limit(MAX_PARTITIONS + 1).collect()
    if len(counts) > MAX_PARTITIONS:
        raise ValueError(f"more than {MAX_PARTITIONS} files; write the table in larger ones")
    rows = sum(c["_n"] for c in counts)
    sizes = shard_sizes(rows, shards)
    matrix = communication_matrix([c["_n"] for c in counts], sizes, seed)
    plan = spark.createDataFrame(
        [(c["_f"], p, matrix[p].tolist()) for p, c in enumerate(counts)], "_f string, _part int, _counts array<long>"
    )
    blocks = max(1, -(-int(sizes.max(initial=0)) // block_rows))

    def placed(table: DataFrame) -> DataFrame:
        at = table.join(F.broadcast(plan) if len(counts) <= BROADCAST_FILES else plan, F.col(file) == F.col("_f"))
        at = at.withColumn("_shard", _dealt(seed)("_part", F.col(row), "_counts"))
        at = at.withColumn("_key", F.xxhash64(F.lit(seed), "_part", F.col(row)))
        return at.withColumn("_block", F.pmod(F.shiftright("_key", 20), F.lit(blocks)).cast("int"))

    # The sizes of the blocks follow from where rows are stored alone: this pass reads no column of the table.
    in_block = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        staged(placed(docs.select(file, row)).groupBy(F.col("_shard").alias("_s"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_n")), "shard-blocks")
        .select("_s", "_b", F.coalesce(F.sum("_n").over(in_block), F.lit(0)).alias("_before"))
    )
    order = Window.partitionBy("_shard", "_block").orderBy("_key", "_part", row)
    dealt = placed(docs).withColumn("_rank", F.row_number().over(order) - 1)
    return dealt.join(before, (F.col("_shard") == F.col("_s")) & (F.col("_block") == F.col("_b"))).select(
        *(["_doc.*"] if kept else []), F.col("_shard").alias("shard"), (F.col("_before") + F.col("_rank")).alias("slot")
    )
