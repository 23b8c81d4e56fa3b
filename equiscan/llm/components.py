"""Connected components of a graph of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiscan.session import staged


#: Rows, some 16 bytes each, that a round still takes in one task, which spares its shuffles; more are shuffled.
ONE_TASK_EDGES = 500_000


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """One partition for a table of few rows: what groups or joins it then needs no shuffle."""
    return df.coalesce(1) if rows <= ONE_TASK_EDGES else df


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b); component is the smallest node reachable.

    Alternating star rounds: every node sends its larger neighbours to its smallest one, then its smaller neighbours,
    until the edges are stars around the smallest nodes. Rounds grow with the logarithm of the longest path; each is
    written to the shared folder. A node with many neighbours is a grouped minimum and a join that may be split.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = staged(in_few_tasks(edges, links.count()).distinct(), "components-links")
    before = None
    while (now := _digest(edges)) != before:
        before = now
        # Each step has at most twice as many rows as there are edges; where these are few, all of a round is one task.
        edges = in_few_tasks(edges, now[0])
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = edges.join(least, F.col("u") == F.col("w")).where("m < u").select("u", F.col("m").alias("v"))
        large = in_few_tasks(staged(in_few_tasks(large.union(own), now[0]).distinct(), "components-large"), now[0])
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        edges = staged(small.select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct(), "components-small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
