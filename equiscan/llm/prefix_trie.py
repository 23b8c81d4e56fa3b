"""Prefix trie of conversations by ternary search trees over range shards.

A turn is encoded as 16 bytes of the SHA-256 of its role and text, so texts are read once and never shuffled. Conversations
are rows of such codes, range-partitioned by their first codes and id: a shard holds neighbouring sequences in order. It
dictionary-encodes its codes, inserts its distinct sequences into a ternary search tree, the median first, and walks the
tree without recursion to sum members, leaves and savings. A node on the path of a shard's first or last sequence may go on
in a neighbouring shard: such boundary nodes are partial sums, few a shard, and are merged afterwards by the hash of their
path. All other nodes are final in their shard.

A shard holds about ``SHARD_TURNS`` turns. The codes of one conversation are held by one task, some 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiscan.session import broadcast_up_to, release_shuffles, staged

#: Turns of one shard.
SHARD_TURNS = 200_000
#: Codes of a sequence that decide its shard.
KEY_TURNS = 32
#: Bytes of a code.
CODE = 16
#: Ids of the conversations that end at a boundary node go on in rows of so many.
CHUNK_IDS = 400
#: Boundary nodes of shards, some 50 bytes each, that are still broadcast to their children.
BROADCAST_PARENTS = 200_000
#: Rows of one Arrow batch of nodes.
BATCH_NODES = 20_000

_FINAL, _FRINGE, _BOUNDARY, _ENDS = range(4)
_NODE = (
    "kind int, key binary, parent binary, shard int, chunk int, depth long, conv long, parent_conv long, n_convs long, n_children long, "
    "n_leaves long, spent long, once long, words long, ends binary"
)
_NODE_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), ("shard", pa.int32()), ("chunk", pa.int32())]
    + [(n, pa.int64()) for n in ("depth", "conv", "parent_conv", "n_convs", "n_children", "n_leaves", "spent", "once", "words")]
    + [("ends", pa.binary())]
)
_ROOT_KEY = bytes(CODE)


def _path_key(parent: bytes, code: bytes) -> bytes:
    return hashlib.blake2b(parent + code, digest_size=CODE).digest()


def _joined(ids: array) -> bytes:
    return ",".join(map(str, ids)).encode()


class TernaryTree:
    """Ternary search tree of sequences of code ids; flat columns, node 0 is the root of all sequences.

    ``low`` and ``high`` lead to siblings of smaller and larger code, ``below`` to the children, 0 where there is none.
    """

    def __init__(self) -> None:
        self.code, self.low, self.high, self.below = (array("q", [0]) for _ in range(4))
        self.members, self.smallest, self.words = array("q", [0]), array("q", [-1]), array("q", [0])
        #: Node to the place of its sequence among those inserted.
        self.ends: dict[int, int] = {}

    def _new(self, code: int, words: int, smallest: int) -> int:
        for column, value in ((self.code, code), (self.low, 0), (self.high, 0), (self.below, 0), (self.members, 0), (self.smallest, smallest), (self.words, words)):
            column.append(value)
        return len(self.code) - 1

    def insert(self, place: int, codes: list[int], words: list[int], members: int, smallest: int) -> None:
        """One sequence that ``members`` conversations have, the smallest id among them ``smallest``."""
        code, low, high, below, count, least = self.code, self.low, self.high, self.below, self.members, self.smallest
        if not count[0] or smallest < least[0]:
            least[0] = smallest
        count[0] += members
        node = 0
        for x, w in zip(codes, words, strict=True):
            at = below[node]
            if not at:
                at = below[node] = self._new(x, w, smallest)
            else:
                while code[at] != x:
                    side = low if x < code[at] else high
                    following = side[at]
                    if not following:
                        following = side[at] = self._new(x, w, smallest)
                    at = following
            count[at] += members
            if smallest < least[at]:
                least[at] = smallest
            node = at
        self.ends[node] = place

    def walk(self) -> Iterator[tuple[int, int, int]]:
        """(node, parent, depth), parents first; -1 is the parent of the root."""
        yield 0, -1, 0
        stack = [(self.below[0], 0, 1)]
        while stack:
            at, parent, depth = stack.pop()
            if at:
                yield at, parent, depth
                stack += ((self.low[at], parent, depth), (self.high[at], parent, depth), (self.below[at], at, depth + 1))


def median_first(n: int) -> Iterator[int]:
    """0 to n - 1 in the order that keeps a search tree of sorted keys balanced."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            yield (middle := (a + b) // 2)
            stack += ((middle + 1, b), (a, middle))


def shard_nodes(shard: int, ids: list[int], sequences: list[bytes], words: list[list[int]], key_turns: int = KEY_TURNS) -> Iterator[tuple]:
    """Rows of ``_NODE`` of one shard: its conversations sorted by sequence, then id."""
    codes = [[s[i : i + CODE] for i in range(0, len(s), CODE)] for s in sequences]
    flat = np.array([c for row in codes for c in row], dtype=f"S{CODE}")
    dictionary, encoded = np.unique(flat, return_inverse=True)
    bounds = np.cumsum([0] + [len(row) for row in codes])
    first, last = codes[0][:key_turns], codes[-1][:key_turns]
    starts = [i for i in range(len(ids)) if not i or sequences[i] != sequences[i - 1]] + [len(ids)]
    runs = list(pairwise(starts))

    tree = TernaryTree()
    for run in median_first(len(runs)):
        a, b = runs[run]
        tree.insert(run, encoded[bounds[a] : bounds[a + 1]].tolist(), words[a], b - a, ids[a])

    n = len(tree.code)
    order = list(tree.walk())
    parents, depths = array("q", bytes(8 * n)), array("q", bytes(8 * n))
    children, leaves, spent, once, inner = (array("q", bytes(8 * n)) for _ in range(5))
    on_first, on_last = bytearray(n), bytearray(n)
    names = [x.ljust(CODE, b"\0") for x in dictionary.tolist()]  # numpy strips zero bytes at the end
    for node, parent, depth in order:
        parents[node], depths[node] = parent, depth
        if parent < 0:
            on_first[node] = on_last[node] = 1
            continue
        name = names[tree.code[node]]
        for on, path in ((on_first, first), (on_last, last)):
            on[node] = on[parent] and (depth > key_turns or (depth <= len(path) and path[depth - 1] == name))
    shared = lambda node: on_first[node] or on_last[node]
    for node, parent, _ in reversed(order):
        cost = tree.words[node]
        spent[node] += tree.members[node] * cost
        if not shared(node):
            inner[node] = 1
            once[node] += cost
            leaves[node] += not children[node]
        if parent >= 0:
            children[parent] += inner[node]
            spent[parent] += spent[node]
            once[parent] += once[node]
            leaves[parent] += leaves[node]

    keys: dict[int, bytes] = {0: _ROOT_KEY}
    for node, parent, depth in order:
        parent_key = keys.get(parent)  # a node below a final one needs none
        if shared(node) and parent >= 0:
            keys[node] = _path_key(parent_key, names[tree.code[node]])
        parent_conv = tree.smallest[parent] if parent >= 0 else None
        numbers = (depth, tree.smallest[node], parent_conv, tree.members[node], children[node], leaves[node], spent[node], once[node], tree.words[node])
        ended = runs[tree.ends[node]] if node in tree.ends else (0, 0)
        if shared(node):
            yield (_BOUNDARY, keys[node], parent_key, shard, 0, *numbers, None)
            for chunk, a in enumerate(range(ended[0], ended[1], CHUNK_IDS)):
                yield (_ENDS, keys[node], None, shard, chunk, *[None] * 9, _joined(ids[a : min(a + CHUNK_IDS, ended[1])]))
        else:
            digest = hashlib.sha256(_joined(ids[slice(*ended)])).hexdigest().encode()
            fringe = bool(shared(parent))
            yield (_FRINGE if fringe else _FINAL, None, parent_key if fringe else None, shard, 0, *numbers, digest)


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, sequences, words = array("q"), [], []
    for batch in batches:
        ids.extend(batch.column(0).to_pylist())
        sequences += batch.column(1).to_pylist()
        words += batch.column(2).to_pylist()
    if not ids:
        return
    for rows in batched(shard_nodes(TaskContext.get().partitionId(), ids, sequences, words), BATCH_NODES):
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE_SCHEMA, strict=True)], schema=_NODE_SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, digest) from chunks of ids sorted by key, shard and chunk; holds one batch at a time."""
    key, digest = None, None
    for batch in batches:
        out = []
        for k, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ends)
            else:
                digest.update(b"," + ends)
        if out:
            yield pa.RecordBatch.from_pydict({"e_key": pa.array([x for x, _ in out], pa.binary()), "e_digest": pa.array([x for _, x in out], pa.string())})
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"e_key": pa.array([key], pa.binary()), "e_digest": [digest.hexdigest()]})


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the boundary nodes that a shard owns add to themselves and to those above; rows sorted by shard, deepest first."""
    shard, sums = None, {}

    def out() -> pa.RecordBatch:
        keys = list(sums)
        return pa.RecordBatch.from_pydict(
            {"o_key": pa.array(keys, pa.binary()), "o_once": pa.array([sums[k][0] for k in keys], pa.int64()), "o_leaves": pa.array([sums[k][1] for k in keys], pa.int64())}
        )

    for batch in batches:
        for s, key, parent, words, leaf, mine in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != shard:
                if sums:
                    yield out()
                shard, sums = s, {}
            own = sums.setdefault(key, [0, 0])
            own[0] += words * mine
            own[1] += leaf * mine
            if parent is not None:
                above = sums.setdefault(parent, [0, 0])
                above[0] += own[0]
                above[1] += own[1]
    if sums:
        yield out()


def rebuilt_conversations(turns: DataFrame) -> DataFrame:
    """(conv, codes, words): every conversation as the codes of its rebuilt turns, 16 bytes each, and their word counts.

    Turns are ordered by turn, null first; turns of equal number by their code.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    coded = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").alias("turn"),
        F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, CODE).alias("code"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    # The window, the grouping and the second window share one exchange on the base conversation.
    base = F.col("conv") - F.col("conv") % 20
    at = F.row_number().over(Window.partitionBy("base", "conv").orderBy(F.col("turn").asc_nulls_first(), "code"))
    placed = coded.withColumn("base", base).repartition("base").withColumn("at", at)
    held = placed.groupBy("base", "conv").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("code").alias("code"), "words"))).alias("own"))
    head = F.max(F.when(F.col("conv") == F.col("base"), F.slice("own", 1, 3))).over(Window.partitionBy("base"))
    kept = (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).cast("int")
    rebuilt = held.withColumn("h", kept).withColumn("head", F.coalesce(head, F.slice("own", 1, 0))).select(
        "conv", F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own"))).alias("turns")
    )
    return rebuilt.select("conv", F.unhex(F.array_join("turns.code", "")).alias("codes"), F.col("turns.words").alias("words"))


def conversation_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: ``turns`` has conv_id, turn, role and text.

    A conversation c starts with the first h turns of conversation c - c % 20 (h = CRC-32 of c in decimals, modulo 4; all
    turns if fewer, none if absent) and goes on with its own turns after its first h. Each distinct sequence of first
    turns (role, text) is a node, the root the empty one. Returns conv_id (smallest member), depth, parent_conv_id,
    n_convs (members), n_children, n_leaves (childless nodes of its subtree), saved_tokens (sum over its subtree of
    (n_convs - 1) x words of the last turn) and ends_sha256 (of the ids of the conversations that end at the node).

    Null roles and texts are empty; equal turn numbers are ordered by the hash of role and text; repeated rows are
    turns of their own. Rows without conv_id belong to no conversation. Columns other than the four named are not read.
    An empty table gives no rows, otherwise there is a root. Turns are compared by 128 bits of their SHA-256.
    """
    spark = turns.sparkSession
    rebuilt = staged(rebuilt_conversations(turns), "trie-conversations")
    total = rebuilt.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = max(1, -(-total // shard_turns))
    key = F.substring("codes", 1, CODE * KEY_TURNS)
    nodes = staged(rebuilt.repartitionByRange(shards, key, "conv").sortWithinPartitions("codes", "conv").mapInArrow(_grown, _NODE), "trie-nodes")
    release_shuffles(spark)

    # Boundary nodes: sums over the shards; a node that several shards have counts once, in the first of them.
    boundary = nodes.where(F.col("kind") == _BOUNDARY)
    sums = boundary.groupBy("key").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.first("words").alias("words"),
        F.min("conv").alias("conv"),
        F.min("shard").alias("owner"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "spent", "once")),
    )
    sums = staged(sums, "trie-boundary")
    children = sums.groupBy(F.col("parent").alias("c_key")).agg(F.count(F.lit(1)).alias("c_n"))
    merged = staged(
        sums.join(children, F.col("key") == F.col("c_key"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("c_n", F.lit(0))).drop("c_key", "c_n"),
        "trie-merged",
    )
    about = merged.select(F.col("key").alias("m_key"), "owner", (F.col("n_children") == 0).cast("int").alias("leaf"))
    of_shards = boundary.select("shard", "key", "parent", "words", "depth").join(about, F.col("key") == F.col("m_key"))
    owned = (
        of_shards.select("shard", "key", "parent", "words", "leaf", (F.col("shard") == F.col("owner")).cast("int").alias("mine"), "depth")
        .repartition("shard")
        .sortWithinPartitions("shard", F.col("depth").desc())
        .drop("depth")
        .mapInArrow(_owned, "o_key binary, o_once long, o_leaves long")
        .groupBy("o_key")
        .agg(F.sum("o_once").alias("o_once"), F.sum("o_leaves").alias("o_leaves"))
    )
    ends = (
        nodes.where(F.col("kind") == _ENDS)
        .select("key", "ends", "shard", "chunk")
        .repartition("key")
        .sortWithinPartitions("key", "shard", "chunk")
        .select("key", "ends")
        .mapInArrow(_digests, "e_key binary, e_digest string")
    )
    above = merged.select(F.col("key").alias("p_key"), F.col("conv").alias("p_conv"))

    def nodes_of(df: DataFrame, leaves: Column, once: Column, digest: Column) -> DataFrame:
        return df.select(
            F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
            leaves.alias("n_leaves"), (F.col("spent") - once).alias("saved_tokens"), digest.alias("ends_sha256"),
        )

    def inside(df: DataFrame) -> DataFrame:
        return nodes_of(df, F.col("n_leaves"), F.col("once"), F.col("ends").cast("string"))

    # Of the children of a boundary node a shard has a bounded number, however many there are in all.
    parents = boundary.select(F.col("shard").alias("p_shard"), F.col("key").alias("b_key")).join(above, F.col("b_key") == F.col("p_key"))
    parents = broadcast_up_to(staged(parents.select("p_shard", "p_key", "p_conv"), "trie-parents"), BROADCAST_PARENTS)
    fringe = nodes.where(F.col("kind") == _FRINGE).join(parents, (F.col("shard") == F.col("p_shard")) & (F.col("parent") == F.col("p_key")))
    shared = (
        merged.join(owned, F.col("key") == F.col("o_key"))
        .join(above, F.col("parent") == F.col("p_key"), "left")
        .join(ends, F.col("key") == F.col("e_key"), "left")
        .withColumn("parent_conv", F.col("p_conv"))
    )
    no_ends = F.sha2(F.lit("").cast("binary"), 256)
    return (
        inside(nodes.where(F.col("kind") == _FINAL))
        .unionByName(inside(fringe.withColumn("parent_conv", F.col("p_conv"))))
        .unionByName(nodes_of(shared, F.col("n_leaves") + F.col("o_leaves"), F.col("once") + F.col("o_once"), F.coalesce("e_digest", no_ends)))
    )
