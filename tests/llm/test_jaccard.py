import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from equiscan.llm import components, jaccard_join
from equiscan.llm.components import connected_components
from equiscan.session import staged

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = WORDS.findall((text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, percent):
    """Size of the set and smallest id reachable, of (id, text) rows; every pair that shares a shingle is compared."""
    sets = [shingles(t, k) for _, t in rows]
    holders, root = defaultdict(list), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        for j, common in Counter(j for x in s for j in holders[x]).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)), key=lambda n: rows[n][0])
                root[b] = a
        for x in s:
            holders[x].append(i)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[find(i)] = min(smallest.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), smallest[find(i)]) for i, (doc, _) in enumerate(rows) if doc is not None)


def got(df, k, percent):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.linked_documents(df, k, percent).collect() if r.doc_id is not None)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_equals_brute_force(documents, texts, k, percent):
    assert got(documents, k, percent) == brute(sorted(texts.items()), k, percent)


@pytest.mark.parametrize("pairs_a_row", [0, 4])
def test_large_group_of_copies_at_the_threshold(spark, monkeypatch, pairs_a_row):
    monkeypatch.setattr(jaccard_join, "PAIRS_A_ROW", pairs_a_row)
    draw = random.Random(4)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(draw.choice([1, 2, 2, 3, 4])):
            words[draw.randrange(120)] = f"v{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[3][1]) for i in range(20)]
    assert got(frame(spark, rows), 4, 85) == brute(rows, 4, 85)


def test_pairs_exactly_at_the_threshold_and_of_unequal_sizes(spark):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for n in (5, 7, 9, 12, 20, 43, 97, 203):
        for extra in range(n // 2):
            rows.append((1000 * n + extra, " ".join(words[: n + extra])))
    assert got(frame(spark, rows), 1, 80) == brute(rows, 1, 80)
    assert got(frame(spark, rows), 4, 85) == brute(rows, 4, 85)


def test_sketch_differs_in_no_more_words_than_the_sets(spark):
    draw = np.random.Generator(np.random.PCG64(8))
    low, high, differ = jaccard_join.bands(85)
    for n in (6, 10, 40, 300):
        band = np.searchsorted(low, n, "right") - 1
        a = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
        for changed in range(differ[band] // 2 + 1):
            b = np.unique(np.concatenate([a[changed:], draw.integers(0, 2**64, changed, dtype=np.uint64)]))
            if len(a) + len(b) - 2 * len(np.intersect1d(a, b)) <= len(a) * 15 // 85:
                assert np.intersect1d(jaccard_join.signatures(a, 85), jaccard_join.signatures(b, 85)).size


def test_awkward_rows(spark, messy, no_documents):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert got(messy, 5, 80) == brute(rows, 5, 80)
    found = jaccard_join.linked_documents(messy, 5, 80).collect()
    assert len(found) == len(rows)
    assert all(r.component_id is None for r in found if r.doc_id is None)
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in found if r.doc_id in (2, 3, 4, 11))
    assert jaccard_join.linked_documents(no_documents).collect() == []


def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7), (3, 2)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200 + i: 200 for i in range(9)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_round_of_a_small_graph_needs_no_exchange(spark, monkeypatch):
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(components, "staged", kept)
    links = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long").repartition(3)
    assert {r.component for r in connected_components(links).collect()} == {0}
    assert len(plans) > 3 and not any("Exchange hashpartitioning" in p for p in plans)


def test_sets_of_first_ends_are_not_moved(spark, monkeypatch):
    """Of the two sets of a pair one is moved to the other, by the key of the second end."""
    plans = []

    def kept(df, name):
        if name == "jaccard-links":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(jaccard_join, "staged", kept)
    monkeypatch.setattr(jaccard_join, "PAIRS_A_ROW", 10**6)
    words = [f"w{i}" for i in range(40)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, " ".join([*words, f"x{i}"])) for i in range(6)]
        assert got(frame(spark, rows), 4, 85) == brute(rows, 4, 85)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plans and all(p.count("Exchange hashpartitioning") == 2 for p in plans)


def test_a_worker_holds_one_megabyte_of_text_and_its_arrays():
    import pyarrow as pa

    from equiscan.llm.textbytes import slices

    texts = ["word " * 10_000] * 60 + [None, "x" * 3_000_000]
    parts = list(slices(iter([pa.RecordBatch.from_pydict({"text": texts})]), 0))
    assert [v for b in parts for v in b.column(0).to_pylist()] == texts
    assert max(sum(len(v or "") for v in b.column(0).to_pylist()) for b in parts[:-1]) <= 1_000_000 and parts[-1].num_rows == 1


def test_wide_sketches_never_reject_a_pair_within_their_distance():
    rng = np.random.default_rng(5)
    for n, gone, more in ((1030, 30, 0), (3000, 400, 100), (513, 0, 2), (5000, 0, 900)):
        whole = rng.integers(0, 2**63, n + more, dtype=np.uint64)
        a, b = jaccard_join.wide_parity(whole[:n]), jaccard_join.wide_parity(whole[gone:])
        longs = min(len(a), len(b))
        folded = [w if len(w) == longs else w[:longs] ^ w[longs:] for w in (a, b)]
        assert longs * 64 >= n - gone and np.bitwise_count((folded[0] ^ folded[1]).view(np.uint64)).sum() <= gone + more
    assert [len(jaccard_join.wide_parity(whole[:n])) for n in (0, 1, 512, 513, 1024, 1025)] == [0, 0, 0, 16, 16, 32]


def test_sets_of_long_texts_move_only_for_pairs_that_wide_sketches_leave(spark, monkeypatch):
    """Long texts that share half of their words have join keys in common, and more shingles than the short sketch has bits."""
    pairs = {}

    def kept(df, name):
        out = staged(df, name)
        pairs[name] = pairs.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "staged", kept)
    common = [f"c{i}" for i in range(1000)]
    texts = [" ".join([*common, *(f"t{k}_{i}" for i in range(1000))]) for k in range(8)]
    # Two that link, with sketches of 1024 and 2048 bits.
    long = [f"l{i}" for i in range(1010)]
    texts += [" ".join(long), " ".join([*long, *(f"m{i}" for i in range(60))])]
    rows = list(enumerate(texts))
    assert got(frame(spark, rows), 4, 85) == brute(rows, 4, 85)
    assert pairs["jaccard-near"] >= 8 and pairs["jaccard-close"] == pairs["jaccard-links"] == 1
