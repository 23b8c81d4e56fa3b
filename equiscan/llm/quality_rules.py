"""Quality verdicts by weak supervision.

Each rule looks at the statistics of a document and votes good, votes bad or abstains. No rule is trusted by itself: votes
are counted over the whole corpus by pattern (there are at most 3 to the number of rules), and expectation maximisation on
those counts estimates how often each rule votes which way on good and on bad documents. The posterior of a document's
pattern decides, instead of a demand that all rules pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiscan.llm.textbytes import Texts, slices
from equiscan.llm.textstats import Statistics, share
from equiscan.session import staged

#: Rule: (name, figure of the document, bad from, good from); None where a rule never votes that way, between the two it
#: abstains. Most rules look for one kind of junk: not finding it says
#: little, so they abstain.
RULES: list[tuple[str, Callable[[Statistics], np.ndarray], float | None, float | None]] = [
    ("symbols a word", lambda s: share(s.n_symbols, s.n_words), 0.15, None),
    ("upper-case letters", lambda s: share(s.n_upper, s.n_upper + s.n_lower), 0.30, None),
    ("exclamation marks a word", lambda s: share(s.n_of("!?"), s.n_words), 0.20, None),
    ("repeated lines", lambda s: share(s.n_dup_lines, s.n_lines), 0.30, None),
    ("words in repeated windows", lambda s: share(s.n_repeat_words, s.n_words), 0.30, None),
    ("words equal to the last", lambda s: share(s.n_same_as_last, s.n_words), 0.10, None),
    ("commonest word", lambda s: np.where(s.n_words >= 30, share(s.most_frequent, s.n_words), 0), 0.25, None),
    ("letters and digits in words", lambda s: share(s.n_upper + s.n_lower + s.n_beyond_ascii + s.n_digits, s.word_chars), 0.65, 0.88),
    ("distinct words", lambda s: share(s.n_distinct, np.minimum(s.n_words, 1000)), 0.20, 0.40),
    ("words", lambda s: s.n_words.astype(float), 20, 60),
]
#: Rules where small figures are bad.
SMALL_IS_BAD = {"letters and digits in words", "distinct words", "words"}
#: Share of good documents, and chances of a bad, no and good vote on bad and on good documents, before the first round.
START_GOOD = 0.8
START_CHANCES = [[0.30, 0.40, 0.30], [0.02, 0.28, 0.70]]
ROUNDS, STOP = 200, 1e-7

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def votes(s: Statistics) -> np.ndarray:
    """One column a rule: 0 bad, 1 abstains, 2 good."""
    out = np.ones((len(s.texts), len(RULES)), np.int64)
    for j, (name, figure, bad, good) in enumerate(RULES):
        x = figure(s)
        small = name in SMALL_IS_BAD
        if bad is not None:
            out[(x < bad) if small else (x >= bad), j] = 0
        if good is not None:
            out[(x >= good) if small else (x < good), j] = 2
    return out


def fit(patterns: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Expectation maximisation over vote patterns: the share of good documents, and chances [class, rule, vote]."""
    vote = np.eye(3)[patterns]
    good = START_GOOD
    chance = np.repeat(np.array(START_CHANCES)[:, None, :], patterns.shape[1], 1)
    for _ in range(ROUNDS):
        p = posterior(patterns, good, chance)
        weight = np.stack([1 - p, p]) * counts
        last, good = good, float(weight[1].sum() / max(counts.sum(), 1))
        totals = np.einsum("cn,nrv->crv", weight, vote) + 0.5
        chance = totals / totals.sum(2, keepdims=True)
        if abs(good - last) < STOP:
            break
    return good, chance


def posterior(patterns: np.ndarray, good: float, chance: np.ndarray) -> np.ndarray:
    """Chance that a document with this pattern is good."""
    rules = np.arange(patterns.shape[1])
    with np.errstate(divide="ignore"):
        prior = np.log([1 - good, good])
    logs = prior[:, None] + np.log(chance[:, rules, patterns]).sum(2)
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        s = Statistics(Texts(batch.column(1)))
        pattern = votes(s) @ (3 ** np.arange(len(RULES)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(getattr(s, name), pa.int64()) for name in STATISTICS), pa.array(pattern, pa.int64())],
            names=["doc", *STATISTICS, "pattern"],
        )


def rate_documents(docs: DataFrame, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the five statistics, base_failed, p_good (posterior that the document is good) and kept, one row a row.

    The texts are read once; votes are counted over all documents, and only the pattern counts reach the driver.

    Null and empty texts have no words: they fail the base rules, and the rules about shares vote good on nothing.
    Repeated rows and rows without id are rated each by itself. Columns other than the two named are not read. An empty
    table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    measured = staged(
        docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            _measured, f"doc {id_type}, " + ", ".join(f"{n} long" for n in STATISTICS) + ", pattern long"
        ),
        "rules-measured",
    )
    counted = np.array(measured.groupBy("pattern").count().orderBy("pattern").collect(), np.int64).reshape(-1, 2)
    patterns = counted[:, :1] // 3 ** np.arange(len(RULES)) % 3
    p = posterior(patterns, *fit(patterns, counted[:, 1]))
    # At most 3 ** len(RULES) rows, by construction.
    ratings = docs.sparkSession.createDataFrame(
        [(int(code), float(x)) for code, x in zip(counted[:, 0], p, strict=True)], "pattern long, p_good double"
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.join(F.broadcast(ratings), "pattern", "left").select(
        F.col("doc").alias(id_col), *STATISTICS, failed.alias("base_failed"), "p_good", (~failed & (F.col("p_good") >= keep_from)).alias("kept")
    )
