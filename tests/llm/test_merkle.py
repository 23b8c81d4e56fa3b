import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from equiscan.llm import merkle_manifest
from equiscan.llm.merkle_manifest import FIELDS, manifest, without_line_breaks

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def climb(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        levels.append(nodes)
    return levels


def proof(levels, i):
    """(left, right) of each level."""
    out = []
    for level in levels[:-1]:
        run = i - i % 3
        out.append((level[run:i], level[i + 1 : run + 3]))
        i //= 3
    return out


def brute_force(rows):
    """Every tree whole, by the definition."""
    trees = defaultdict(list)
    for row in rows:
        text = row["text"]
        if text is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        trees[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row), leaf_of(row | {"text": text}), row["doc_id"]))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: climb([t[2] for t in sorted(trees[s], key=lambda t: t[:3])]) for s in sources}
    top = climb([levels[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (*_, leaf, given, doc_id) in enumerate(sorted(trees[s], key=lambda t: t[:3])):
            path = proof(levels[s], i) + proof(top, k)
            at = given
            for left, right in path:
                at = sha(*left, at, *right)
            out.append((doc_id, leaf, levels[s][-1][0], top[-1][0], sha(*(x for side in path for part in side for x in part)), at, at == top[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    return [r.asDict() for r in df.select(*FIELDS).collect()]


def proved(df):
    return sorted((tuple(r) for r in manifest(df, without_line_breaks()).select(COLUMNS).collect()), key=str)


def test_given_documents(documents):
    assert proved(documents) == brute_force(rows_of(documents))


@pytest.mark.parametrize("kept,ranges", [(1, 30), (2, 11)])
def test_several_stored_levels(spark, kept, ranges, monkeypatch):
    # Functions of this module run in Python workers, so the stored levels are set where they are called.
    monkeypatch.setattr(merkle_manifest, "RANGE_ROWS", ranges)
    rows = [(i, f"line {i}\nline", "en", f"s{i % 5}" if i % 3 else "hot", i) for i in range(160)]
    rows += [(1000 + i, None, None, None, None) for i in range(9)] + [(2000 + i, "", "", "", 0) for i in range(27)] + [(3000, "x", "en", "alone", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = brute_force(rows_of(df))
    assert proved(df) == expected
    nodes = [leaf for _, leaf, *_ in expected]
    monkeypatch.setattr(merkle_manifest, "KEPT", kept)
    for n in (1, 2, 3, 4, 9, 10, 26, 27, 28, 100):
        whole = climb(nodes[:n])
        stored, size = [nodes[:n]], 3**kept
        while len(stored[-1]) >= size:
            stored.append([merkle_manifest.recomputed(stored[-1][i : i + size], False)[-1][0] for i in range(0, len(stored[-1]), size)])
        assert merkle_manifest.recomputed(stored[-1], True)[-1] == whole[-1]
        for i in range(n):
            path, at = [], i
            for k, level in enumerate(stored):
                block = at // size
                alone = k == len(stored) - 1
                path += merkle_manifest.siblings(merkle_manifest.recomputed(level[block * size : (block + 1) * size], alone), at % size)
                at = block
            assert [tuple(x.split(",")) for x in path] == [("".join(a), "".join(b)) for a, b in proof(whole, i)]
            assert merkle_manifest.folded(nodes[i], path) == whole[-1][0]


def test_a_source_beyond_one_stored_level(spark):
    """3 ** 6 leaves exactly, one less and one more, and two stored levels above the leaves."""
    rows = [(i, f"t{i}\n", "en", "one", 1) for i in range(729)] + [(i, "t", "en", "less", 1) for i in range(728)] + [(i, "t\n", "en", "more", 1) for i in range(730)]
    rows += [(i, f"u{i}", "en", "large", i) for i in range(3_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert proved(df) == brute_force(rows_of(df))


def test_many_sources(spark):
    df = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text"), F.lit("en").alias("lang"), F.col("id").cast("string").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    assert proved(df) == brute_force(rows_of(df))


def test_awkward_rows(messy, no_documents, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "RANGE_ROWS", 3)
    extra = messy.withColumns({c: F.lit("clash") for c in ("tree", "place", "node", "block", "path", "root", "level", "changed")})
    assert proved(extra) == brute_force(rows_of(messy))
    assert proved(no_documents) == []


def test_equal_rows_are_leaves_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "RANGE_ROWS", 10)
    df = spark.createDataFrame([(5, "same\nrow", "en", "s", 8)] * 70 + [(None, "no id", None, None, None)] * 3, SCHEMA)
    assert proved(df) == brute_force(rows_of(df))


def test_only_changed_texts_fail(documents):
    for r in manifest(documents, without_line_breaks()).join(documents, "doc_id").collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (r.text or "")
        assert r.verified == (not changed)
    assert {r.verified for r in manifest(documents).select("verified").collect()} == {True}
