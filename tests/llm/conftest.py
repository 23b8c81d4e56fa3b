from pathlib import Path

import pytest

SMALL = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside, besides those of documents.
CLASHING = "shard int, slot int, words string, key string, node long, row long, doc string, bin long, pattern long, pii_counts string, _row string"


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).exists():
        pytest.skip("test data is not here")
    return SMALL


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak near the mill"
MESSY = [
    (1, PROSE),
    (1, PROSE),  # a repeated row
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (None, PROSE),
    (None, None),
    (5, "word"),
    (6, "Word"),
    (7, PROSE.upper()),
    (8, "x" * 300_000),
    (9, " ".join(f"w{i}" for i in range(40_000))),
    (10, "naïve café 漢字 😀 — «ça»"),
    (11, "\n\n\n"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with every awkward case, and columns named like the operators' own."""
    extra = (0, 0, "w", "k", 1, 1, "d", 1, 1, "p", "r")
    rows = [(i, t, "en", "src0", len(t or "")) + extra for i, t in MESSY]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
