import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from equiscan.llm import prefix_trie
from equiscan.llm.prefix_trie import TernaryTree, conversation_trie, median_first

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows):
    """The nodes by the definition: every prefix of every rebuilt conversation in a dictionary."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, code, (role, text)))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        spent = (len(convs) - 1) * len(WORDS.findall(path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += spent
    return sorted(
        (
            (
                min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children[path]), leaves[path], saved[path],
                hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest(),
            )
            for path, convs in members.items()
        ),
        key=str,
    )


def nodes(df, **settings):
    return sorted((tuple(r) for r in conversation_trie(df, **settings).select(COLUMNS).collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_given_conversations(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    expected = brute_force(rows)
    assert nodes(df) == expected
    assert nodes(df, shard_turns=40) == expected  # many shards: most nodes are merged


@pytest.mark.parametrize("shard_turns", [25, 10_000])
def test_hot_turns_copies_and_deep_conversations(spark, shard_turns):
    draw = random.Random(3)
    rows = [(c, t, "user" if t % 2 else None, draw.choice(["yes", "no  way", None])) for c in range(150) for t in range(draw.randint(0, 5))]
    rows += [(c, t, "system", "one and the same") for c in range(200, 320) for t in range(4)]  # a third are copies
    rows += [(c, t, "user", f"turn {t}") for c in (400, 401, 402) for t in range(90 + c % 2)]  # deeper than the shard key
    rows += [(c, 0, "user", f"alone {c}") for c in range(500, 540)]
    assert nodes(table(spark, rows), shard_turns=shard_turns) == brute_force(rows)


def test_awkward_rows(spark):
    rows = [
        (0, None, "user", "before the first"), (0, 0, "user", "a b"), (0, 1, None, None), (0, 1, None, None), (0, 1, "user", ""), (0, 1, "", "x"),
        (1, 5, "user", "a b"), (2, 0, "user", "a b"), (21, 0, "user", "base is absent"), (41, 0, "assistant", "w " * 200_000), (-3, 0, "user", "a b"),
        (None, 0, "user", "of no conversation"), (7, 0, "us", "era b"), (8, 0, "user", "a b"), (19, 0, "user", "\n\x00\t"), (60, 0, "user", "naïve 漢字 😀"),
    ]
    df = table(spark, rows)
    assert nodes(df) == nodes(df, shard_turns=3) == brute_force(rows)
    clashing = df.selectExpr("*", "1 AS conv", "'c' AS codes", "2 AS base", "3 AS key", "4 AS depth", "5 AS kind", "6 AS words")
    assert nodes(clashing) == brute_force(rows)


def test_empty_table_has_no_nodes_and_a_turnless_conversation_is_at_the_root(spark):
    assert nodes(table(spark, [])) == []
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 1)
    rows = [(alone, 0, "user", "goes, for its base is absent")]
    assert nodes(table(spark, rows)) == brute_force(rows) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


@given(st.integers(0, 200))
def test_median_first_visits_each_once_and_balances(n):
    order = list(median_first(n))
    assert sorted(order) == list(range(n))
    tree = TernaryTree()
    for i in order:
        tree.insert(i, [i], [1], 1, i)
    deepest = 0
    for i in range(n):
        at, steps = tree.below[0], 0
        while tree.code[at] != i:
            at, steps = tree.low[at] if i < tree.code[at] else tree.high[at], steps + 1
        deepest = max(deepest, steps)
    assert deepest <= max(0, n.bit_length())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=5), min_size=1, max_size=30), st.integers(1, 3))
def test_any_cut_into_shards_gives_the_same_members(sequences, shards):
    """Sums over the rows of shards equal the sums over one shard, whatever a shard holds."""
    rows = sorted((b"".join(bytes([x + 1]) * 16 for x in s), i, [1] * len(s)) for i, s in enumerate(sequences))
    size = -(-len(rows) // shards)

    def summed(parts):
        total = defaultdict(int)
        for k, part in enumerate(parts):
            for row in prefix_trie.shard_nodes(k, [r[1] for r in part], [r[0] for r in part], [r[2] for r in part]):
                if row[0] != prefix_trie._ENDS:
                    total[row[5]] += row[8]
        return total

    assert summed([rows]) == summed([rows[i : i + size] for i in range(0, len(rows), size)])
