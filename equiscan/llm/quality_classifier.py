"""Document quality by histogram gradient-boosted trees.

Statistics of every document are computed once and staged. A bounded, hash-chosen sample of labelled rows is binned and
boosted: each level of a tree needs one histogram of gradients for every feature. The trees are complete binary trees laid
out as flat arrays, so scoring a batch is ``depth`` gathers over (rows x trees) in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiscan.llm.textbytes import Texts, slices
from equiscan.llm.textstats import Statistics, share
from equiscan.session import staged

#: Labelled rows the trees are fitted on, chosen by a hash of the id; about 100 bytes each on the driver.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 60, 4, 64, 0.2, 1.0
#: A document is predicted good from this score on.
GOOD_FROM = 0.3

FEATURES = {
    "words": lambda s: np.log1p(s.n_words),
    "word length": lambda s: share(s.word_chars, s.n_words),
    "symbols": lambda s: share(s.n_symbols, s.n_words),
    "bars": lambda s: share(s.n_of("|"), s.n_words),
    "upper": lambda s: share(s.n_upper, s.n_upper + s.n_lower),
    "exclamations": lambda s: share(s.n_of("!?"), s.n_words),
    "stops": lambda s: share(s.n_of(".,;:"), s.n_words),
    "digits": lambda s: share(s.n_digits, s.word_chars),
    "letters": lambda s: share(s.n_upper + s.n_lower + s.n_beyond_ascii, s.word_chars),
    "beyond ascii": lambda s: share(s.n_beyond_ascii, s.word_chars),
    "lines": lambda s: share(s.n_lines, s.n_words),
    "repeated lines": lambda s: share(s.n_dup_lines, s.n_lines),
    "repeated windows": lambda s: share(s.n_repeat_words, s.n_words),
    "repeated triples": lambda s: share(s.repeated_words(3), s.n_words),
    "distinct": lambda s: share(s.n_distinct, s.n_words),
    "commonest": lambda s: share(s.most_frequent, s.n_words),
    "same as last": lambda s: share(s.n_same_as_last, s.n_words),
    "short": lambda s: share(s.n_short, s.n_words),
    "long": lambda s: share(s.n_long, s.n_words),
}


@dataclass(frozen=True)
class Trees:
    """Flat trees: node ``i`` of a tree has children ``2i + 1`` and ``2i + 2``; leaves follow the inner nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.start + self.leaf[trees, node - (2**self.depth - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boost on the logistic loss. Without rows every score is 0.5; with one class, every score is near that class."""
    n, width = x.shape
    inner = 2**depth - 1
    good = float(y.mean()) if n else 0.5
    start = float(np.log((good * n + 0.5) / ((1 - good) * n + 0.5)))
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    model = Trees(feature, threshold, leaf, start, depth)
    if not n:
        return model
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], 1) + np.arange(width) * bins
    raw = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            size = width * bins
            at = ((node - (2**level - 1))[:, None] * size + binned).ravel()
            shape = (2**level, width, bins)
            g = np.bincount(at, np.repeat(gradient, width), 2**level * size).reshape(shape).cumsum(2)
            h = np.bincount(at, np.repeat(weight, width), 2**level * size).reshape(shape).cumsum(2)
            gain = g**2 / (h + RIDGE) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + RIDGE) - g[..., -1:] ** 2 / (h[..., -1:] + RIDGE)
            best = gain.reshape(2**level, -1).argmax(1)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), bins)
                i = 2**level - 1 + k
                if cut < len(edges[f]) and gain[k, f, cut] > 1e-6:
                    feature[t, i], threshold[t, i] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        ends = node - inner
        leaf[t] = -rate * np.bincount(ends, gradient, inner + 1) / (np.bincount(ends, weight, inner + 1) + RIDGE)
        raw += leaf[t, ends]
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        s = Statistics(Texts(batch.column(1)))
        figures = np.stack([f(s) for f in FEATURES.values()], 1).astype(np.float32)
        column = pa.ListArray.from_arrays(np.arange(0, figures.size + 1, len(FEATURES), dtype=np.int32), pa.array(figures.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["doc", "figures"])


def _scored(model: Trees):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc", "score"])

    return score


def held_out(id_col: str):
    """Whether a row is kept from the fit: one in five ids, by a checksum of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id_col``, held_out, score (0 to 1) and predicted (1 from :data:`GOOD_FROM` on), one row for every row of ``docs``.

    The texts are read once. Labels are learned only from rows that are not held out and never enter a score; ids that
    carry both labels are left out of the fit, labels other than 0 and 1 and null too.

    Null and empty texts have figures of 0 and a score like any other. Repeated rows and rows without id are scored each
    by itself. Columns other than those named are not read. Without labels every score is 0.5; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    measured = staged(
        docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            _measured, f"doc {id_type}, figures array<float>"
        ),
        "classifier-figures",
    )
    one = (
        labels.select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc").isNotNull() & ~held_out("doc"))
        .groupBy("doc")
        .agg(F.min("label").alias("label"), F.max("label").alias("_other"))
        .where(F.col("label") == F.col("_other"))
    )
    chosen = measured.join(one, "doc").orderBy(F.xxhash64("doc"), "doc", "figures").limit(SAMPLE_ROWS).select("figures", "label").toArrow()
    x = np.array(chosen["figures"].to_pylist(), np.float32).reshape(-1, len(FEATURES))
    model = fit(x, chosen["label"].to_numpy().astype(float))
    return measured.mapInArrow(_scored(model), f"doc {id_type}, score double").select(
        F.col("doc").alias(id_col), held_out("doc").alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted")
    )
