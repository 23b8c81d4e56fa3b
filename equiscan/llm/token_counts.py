"""Token counts of a unigram tokenizer without building the tokens.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at each character of a word; a dynamic
program over the ends carries the best score and the number of pieces of the best path, nothing else. Ties follow the
tokenizer: of equal scores the piece that starts first stays, and the unknown character, tried last, must be better to win.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiscan.session import ship_package

#: Words whose counts a worker remembers.
CACHED_WORDS = 500_000
#: The mark of a word's begin, and how far an unknown character scores below the worst piece.
MARK, UNKNOWN_PENALTY = "▁", 10.0


class PieceCounter(dict):
    """Word (without its mark) to its number of pieces, remembered up to :data:`CACHED_WORDS` words."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool) -> None:
        import ahocorasick

        super().__init__()
        # Unknown characters become byte pieces only in a vocabulary that has them all.
        self.byte_fallback = byte_fallback and {f"<0x{b:02X}>" for b in range(256)} <= {piece for piece, _ in vocabulary}
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}

    def __missing__(self, word: str) -> int:
        n = self.pieces(MARK + word)
        if len(self) < CACHED_WORDS:
            self[word] = n
        return n

    def pieces(self, word: str) -> int:
        """Number of pieces of the best path through ``word``."""
        return self._known(word) if self.single.issuperset(word) else self._general(word)

    def _known(self, word: str) -> int:
        """Where every character is a piece there are no unknown ones, and matches come in the order of their ends."""
        score, count = [0.0] + [-math.inf] * len(word), [0] * (len(word) + 1)
        for last, (length, value) in self.automaton.iter(word):
            begin = last + 1 - length
            x = score[begin] + value
            if x > score[last + 1]:  # the longest match of an end, so the first to start, comes first
                score[last + 1], count[last + 1] = x, count[begin] + 1
        return count[-1]

    def _general(self, word: str) -> int:
        ends: list[list[tuple[int, float]]] = [[] for _ in range(len(word) + 1)]
        for last, piece in self.automaton.iter(word):
            ends[last + 1].append(piece)
        score, count, unknown = [0.0], [0], [False]
        for end in range(1, len(word) + 1):
            best, n, single = None, 0, False
            for length, value in ends[end]:  # longest, so first to start, first
                x = score[end - length] + value
                if best is None or x > best:
                    best, n = x, count[end - length] + 1
                single = single or length == 1
            lost = False
            if not single:
                x = score[end - 1] + self.unknown
                if best is None or x > best:
                    best, lost = x, True
                    n = count[end - 1] + (len(word[end - 1].encode()) if self.byte_fallback else not unknown[end - 1])
            score.append(best)
            count.append(n)
            unknown.append(lost)
        return count[-1]

    def of_text(self, text: str) -> int:
        """Blanks and marks begin words; a text that does not begin with one gets one in front."""
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        return sum(map(self.__getitem__, words[1:] if not words[0] else words))


def read_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@cache
def _counter(model_path: str, byte_fallback: bool) -> PieceCounter:
    return PieceCounter(read_vocabulary(model_path), byte_fallback)


def _counted(model_path: str, byte_fallback: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path, byte_fallback)
        for batch in batches:
            counts = [counter.of_text(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, model_path: str, byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and n_tokens, one row for every row of ``docs``: the length of the best segmentation of each text.

    The vocabulary at ``model_path`` (on every executor) is read as a unigram model: scores add up along a path. Words
    are cut at blanks; no piece of such a vocabulary has a mark behind another character, so words are independent.

    Null and empty texts have 0 tokens. Repeated rows and rows without id are counted each by itself. Columns other than
    the two named are not read. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(_counted(model_path, byte_fallback), f"doc {id_type}, n_tokens long")
        .withColumnRenamed("doc", id_col)
    )
