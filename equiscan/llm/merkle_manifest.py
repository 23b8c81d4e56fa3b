"""Merkle manifest of a dataset with checkpoint-and-recompute proofs.

Every row is a leaf; the leaves of a source, in order, are one tree whose runs of ``ARITY`` nodes hash into one, and the
roots of the sources, in order, are the leaves of a last tree. Of a tree only every ``KEPT``-th level is stored, as a table.
Between two stored levels lie aligned subtrees of ``ARITY`` ** ``KEPT`` stored nodes at most. To prove a leaf, the interior
of its subtree is computed again from the stored nodes below, the siblings on the path are emitted, and the interior is
discarded. The path above a subtree is the same for all its nodes: it comes down with the subtree's root, once.

Rows are ranked by one range partitioning of the whole order, so a source may be as large as it likes; subtrees are groups
of bounded size. Texts are read once, where the leaves are hashed, and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from equiscan.session import broadcast_up_to, staged

#: Nodes that hash into one, and levels from one stored level to the next.
ARITY, KEPT = 3, 6
SUBTREE = ARITY**KEPT
#: Nodes of one partition of the ranking.
RANGE_ROWS = 250_000
#: Partitions of the ranking, some 50 bytes each, that are still broadcast.
BROADCAST_RANGES = 200_000
#: Rows of one Arrow batch of results.
BATCH_ROWS = 5_000
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def recomputed(nodes: list[str], alone: bool) -> list[list[str]]:
    """The levels of an aligned subtree from its stored nodes up to its root: ``KEPT`` above them, or, of a subtree that
    is ``alone`` in its tree, as many as leave one node."""
    levels = [nodes]
    while len(levels[-1]) > 1 if alone else len(levels) <= KEPT:
        below = levels[-1]
        levels.append([digest(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def siblings(levels: list[list[str]], i: int) -> list[str]:
    """``left,right`` on each level from node ``i`` to the root: the digests beside its ancestors, joined."""
    path = []
    for level in levels[:-1]:
        run = i - i % ARITY
        path.append(f"{''.join(level[run:i])},{''.join(level[i + 1 : run + ARITY])}")
        i //= ARITY
    return path


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and the siblings on its path give."""
    for beside in path:
        left, _, right = beside.partition(",")
        leaf = digest(left, leaf, right)
    return leaf


def _alone(block: int, nodes: list[str]) -> bool:
    """A subtree that is not full is the last of its tree; if it is the first as well, it is the whole of what is left."""
    return block == 0 and len(nodes) < SUBTREE


def _by_subtree(schema: T.StructType, work: Callable[[str, int, list[tuple]], Iterator[tuple]]):
    """Function of Arrow batches sorted by tree and block, their first columns: ``work`` gets one subtree at a time."""
    fields = to_arrow_schema(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for tree, block, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tree, block) != key:
                    if held:
                        out += work(*key, held)
                        if len(out) >= BATCH_ROWS:
                            yield batch_of(out)
                            out = []
                    key, held = (tree, block), []
                held.append(rest)
        if held:
            out += work(*key, held)
        if out:
            yield batch_of(out)

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each row in its tree within the partition, and whether that tree is the partition's first."""
    part, now, at, first = TaskContext.get().partitionId(), None, 0, True
    for batch in batches:
        places, firsts = [], []
        for tree in batch.column("tree").to_pylist():
            if tree != now:
                first = now is None
                now, at = tree, 0
            places.append(at)
            firsts.append(first)
            at += 1
        added = [pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()), pa.array(firsts, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "part", "at", "first"])


def ranked(nodes: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``nodes`` (tree, not null, and others) with place: from 0 without gaps by ``order`` in each tree."""
    ranges = max(1, -(-nodes.count() // RANGE_ROWS))
    schema = T.StructType([*nodes.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("first", T.BooleanType())])
    numbered = staged(nodes.repartitionByRange(ranges, "tree", *order).sortWithinPartitions("tree", *order).mapInArrow(_numbered, schema), name)
    # Only the first tree of a partition can have rows in earlier ones, and those end with it: one row a partition.
    runs = numbered.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("first"))
    edges = runs.groupBy("part").agg(F.min("tree").alias("begins"), F.max("tree").alias("ends"), F.max_by("n", "tree").alias("n"))
    ends = edges.select("part", F.col("ends").alias("of"), "n", F.lit(1).alias("adds"))
    begins = edges.select("part", F.col("begins").alias("of"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("adds"))
    before = Window.partitionBy("of").orderBy("part", "adds").rowsBetween(Window.unboundedPreceding, -1)
    offsets = begins.union(ends).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("adds = 0")
    offsets = broadcast_up_to(staged(offsets.select(F.col("part").alias("of_part"), "before"), f"{name}-offsets"), BROADCAST_RANGES)
    place = (F.col("at") + F.when(F.col("first"), F.col("before")).otherwise(0)).alias("place")
    return numbered.join(offsets, F.col("part") == F.col("of_part")).select(*nodes.columns, place)


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / SUBTREE).cast("long"))


def _together(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of a subtree in one task, in order; ``tree`` and ``block`` first."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place").select("tree", "block", *columns)


_ROOT = T.StructType(
    [T.StructField("tree", T.StringType()), T.StructField("place", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("alone", T.BooleanType())]
)


def _root_of(tree: str, block: int, rows: list[tuple]) -> Iterator[tuple]:
    nodes = [r[0].hex() for r in rows]
    alone = _alone(block, nodes)
    yield tree, block, bytes.fromhex(recomputed(nodes, alone)[-1][0]), alone


def stored_levels(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Every ``KEPT``-th level of each tree of ``leaves`` (tree, place, node), and its root: (tree, level, node).

    ``level`` is the last stored one, on which a single subtree is left.
    """
    levels, roots = [leaves], None
    while True:
        above = staged(_together(_in_blocks(levels[-1]), "node").mapInArrow(_by_subtree(_ROOT, _root_of), _ROOT), f"{name}-level")
        found = above.where("alone").select("tree", F.lit(len(levels) - 1).alias("level"), "node")
        roots = found if roots is None else roots.union(found)
        going_on = above.where("NOT alone").select("tree", "place", "node")
        if going_on.isEmpty():
            return levels, roots
        levels.append(going_on)


_PATH = T.StructType(
    [T.StructField(n, t) for n, t in (("tree", T.StringType()), ("place", T.LongType()), ("node", T.BinaryType()), ("path", T.ArrayType(T.StringType())), ("subroot", T.StringType()), ("root", T.StringType()))]
)


def _opened(block: int, rows: list[tuple]) -> tuple[list[tuple], list[list[str]], tuple]:
    """The nodes of a subtree, its interior computed again, and what came down with its root."""
    *_, path, subroot, root = rows[0]
    nodes = [r[1].hex() for r in rows[1:]]
    return rows[1:], recomputed(nodes, _alone(block, nodes)), (path, subroot, root)


def _paths(tree: str, block: int, rows: list[tuple]) -> Iterator[tuple]:
    nodes, levels, (path, subroot, root) = _opened(block, rows)
    for i, (place, node, *_) in enumerate(nodes):
        yield tree, place, node, siblings(levels, i) + path, subroot, root


def _proofs(tree: str, block: int, rows: list[tuple]) -> Iterator[tuple]:
    nodes, levels, (above, subroot, root) = _opened(block, rows)
    for i, (_, node, doc_id, tampered, *_) in enumerate(nodes):
        path = siblings(levels, i) + above
        found = folded((tampered or node).hex(), path)
        yield doc_id, node.hex(), subroot, root, digest("".join(path).replace(",", "")), path, found, found == root


def _downwards(levels: list[DataFrame], tops: DataFrame, carried: list[str], result: T.StructType, work: Callable, name: str) -> DataFrame:
    """From the top subtrees to the lowest stored level, each with the path above it: ``work`` at the lowest, paths before.

    ``tops`` is (tree, level, path, subroot, root). What comes down is a row before the nodes of its subtree.
    """
    blank = [F.lit(None).cast(levels[0].schema[c].dataType).alias(c) for c in carried]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        lowest = k == 0
        extra = carried if lowest else []
        down = tops.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        if above is not None:
            down = down.union(above.select("tree", F.col("place").alias("block"), "path", "subroot", "root"))
        head = down.select("tree", "block", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("node"), *(blank if lowest else []), "path", "subroot", "root")
        none = [F.lit(None).cast(_PATH[c].dataType).alias(c) for c in ("path", "subroot", "root")]
        rows = head.union(_in_blocks(levels[k]).select("tree", "block", "place", "node", *extra, *none))
        schema = result if lowest else _PATH
        spread = _together(rows, "place", "node", *extra, "path", "subroot", "root").mapInArrow(_by_subtree(schema, work if lowest else _paths), schema)
        above = spread if lowest else staged(spread, f"{name}-paths")
    return above


def hashed_leaves(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, group: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(tree, doc, node, changed): the leaf of every row, and the leaf that the text ``tampered`` gives where it differs."""

    def part(value: Column) -> Column:
        written = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))

    def leaf(text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*(part(text if c == text_col else F.col(c)) for c in fields)), 256))

    source = F.col(group).cast("string")
    changed = F.lit(None).cast("binary") if tampered is None else F.when(~tampered.eqNullSafe(F.col(text_col)), leaf(tampered))
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("tree"),  # "n" sorts before every "s..."
        F.col(id_col).alias("doc"),
        leaf(F.col(text_col)).alias("node"),
        changed.alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot (of its source), root, proof_sha256 (of the siblings on its path
    to the root), proof (they themselves, ``left,right`` a level), folded_root and verified.

    A leaf is the SHA-256 of doc_id, source, lang, n_chars and text, each written as ``-`` if null, else as its length in
    UTF-8 bytes, a colon and the value. Leaves of a source ascend by doc_id, null first, then by digest; sources by their
    bytes, null first. ``tampered`` is a text to verify in place of the stored one (null where that is null): its proof
    folds the leaf of the tampered row with the siblings of the original.

    Rows of equal content are leaves of their own, whichever of them comes first. Null and empty texts are distinct
    leaves. Columns other than the five named are not read. An empty table gives no rows.
    """
    leaves = staged(hashed_leaves(docs, tampered), "merkle-leaves")
    placed = staged(ranked(leaves, [F.col("doc").asc_nulls_first(), F.col("node"), F.col("row")], "merkle-ranked").drop("row"), "merkle-placed")
    levels, subroots = stored_levels(placed, "merkle")
    subroots = staged(subroots.withColumnRenamed("tree", "source_tree"), "merkle-subroots")

    sources = subroots.select(F.lit("").alias("tree"), "source_tree", "node")
    sources = staged(ranked(sources, [F.col("source_tree")], "merkle-sources"), "merkle-sources-placed")
    source_levels, roots = stored_levels(sources, "merkle-top")
    top = roots.select("tree", "level", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("node")).alias("root"))
    paths = staged(_downwards(source_levels, top, [], _PATH, _paths, "merkle-top"), "merkle-top-paths")

    named = sources.select("source_tree", F.col("place").alias("at"))
    begun = paths.join(named, F.col("place") == F.col("at")).select("source_tree", "path", F.lower(F.hex("node")).alias("subroot"), "root")
    tops = begun.join(subroots.select("source_tree", "level"), "source_tree").select(F.col("source_tree").alias("tree"), "level", "path", "subroot", "root")
    result = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(n, T.StringType()) for n in ("leaf", "subroot", "root", "proof_sha256")]
        + [T.StructField("proof", T.ArrayType(T.StringType())), T.StructField("folded_root", T.StringType()), T.StructField("verified", T.BooleanType())]
    )
    return _downwards(levels, staged(tops, "merkle-tops"), ["doc", "changed"], result, _proofs, "merkle")


def without_line_breaks(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Text without line feeds where 2 divides the CRC-32 of the id in decimals, else as it is."""
    struck = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return F.when(struck, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))
