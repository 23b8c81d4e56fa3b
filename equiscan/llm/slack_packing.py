"""Packing of tokenised documents by minimum bin slack.

Each task tokenises its documents and holds what is left of them as a multiset of remaining lengths. A sequence is begun with
the longest remainder; a subset-sum dynamic program over the multiset, one bit for each sum, finds the sum closest to the
free space, and the counts of each length are tracked back from the sums that were reachable before each step. Where no
subset fills a sequence to its end, the last free places take the beginning of one more document, which goes on elsewhere.

A task packs in windows and carries a reserve of short remainders from one to the next, so that subsets stay easy to find.
What is left at its end, less than one sequence, is cut at powers of two. No rows are exchanged between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from equiscan.llm.packing import END_OF_DOCUMENT, _encoder

CAPACITY = 1024
#: Tokens that a task holds before it packs, and those that it keeps back for the next window.
WINDOW_TOKENS, RESERVE_TOKENS = 1_000_000, 60_000
#: Pieces of one Arrow batch, some 4 KB each at most.
BATCH_PIECES = 4_096


def closest_subset(counts: dict[int, int], lengths: list[int], space: int) -> dict[int, int]:
    """How many of each length, of those that ``counts`` offers, come closest to ``space`` without exceeding it.

    ``lengths`` are the keys to be tried, in that order; the search ends when ``space`` itself is reached.
    """
    mask, reach = (1 << (space + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        left = min(counts[length], space // length)
        take = 1
        while left:
            take = min(take, left)
            more = reach | (reach << (length * take)) & mask
            if more != reach:
                steps.append((length, take, reach))
                reach = more
            left -= take
            take *= 2
        if reach >> space & 1:
            break
    best = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + take
            best -= length * take
    return used


class Remainders:
    """Remaining parts of documents by length; each is (document, its tokens, start, ids of the part)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.tokens = capacity, 0
        self.parts: dict[int, list[tuple]] = {}

    def add(self, doc: object, n: int, start: int, ids: memoryview) -> None:
        length = len(ids) // 4
        self.parts.setdefault(length, []).append((doc, n, start, ids))
        self.tokens += length

    def take(self, length: int) -> tuple:
        held = self.parts[length]
        part = held.pop()
        if not held:
            del self.parts[length]
        self.tokens -= length
        return part

    def sequence(self) -> list[tuple]:
        """The parts of one sequence: full, unless fewer tokens are left than it takes."""
        longest = max(self.parts)
        chosen = [self.take(longest)]
        space = self.capacity - longest
        if space and self.parts:
            lengths = sorted((x for x in self.parts if x <= space), reverse=True)
            for length, n in closest_subset({x: len(self.parts[x]) for x in lengths}, lengths, space).items():
                chosen += [self.take(length) for _ in range(n)]
                space -= length * n
        while space and self.parts:
            # No part left is as short as the space: the longest begins here and goes on in another sequence.
            doc, n, start, ids = self.take(max(self.parts))
            chosen.append((doc, n, start, ids[: 4 * space]))
            self.add(doc, n, start + space, ids[4 * space :])
            space = 0
        return chosen


def _powers_of_two(parts: list[tuple], tokens: int) -> Iterator[list[tuple]]:
    """``parts`` dealt to sequences whose lengths are the powers of two that add up to ``tokens``, largest first."""
    parts = parts[::-1]
    for bit in range(tokens.bit_length() - 1, -1, -1):
        space, chosen = tokens & 1 << bit, []
        while space:
            doc, n, start, ids = parts.pop()
            if len(ids) > 4 * space:
                parts.append((doc, n, start + space, ids[4 * space :]))
                ids = ids[: 4 * space]
            chosen.append((doc, n, start, ids))
            space -= len(ids) // 4
        if chosen:
            yield chosen


def sequences(documents: Iterator[tuple[object, bytes]], capacity: int = CAPACITY, window: int = WINDOW_TOKENS, reserve: int = RESERVE_TOKENS) -> Iterator[list[tuple]]:
    """The sequences of ``documents`` (id, ids as bytes): lists of parts (id, tokens of the document, start, ids)."""
    rest = Remainders(capacity)
    for doc, ids in documents:
        n, view = len(ids) // 4, memoryview(ids)
        whole = n - n % capacity
        for start in range(0, whole, capacity):
            yield [(doc, n, start, view[4 * start : 4 * (start + capacity)])]
        if whole < n:
            # A copy, so that a short remainder doesn't keep a long document in memory.
            rest.add(doc, n, whole, memoryview(ids[4 * whole :]))
        if rest.tokens >= window:
            while rest.tokens >= max(reserve, capacity):
                yield rest.sequence()
    while rest.tokens >= capacity:
        yield rest.sequence()
    if rest.tokens:
        tokens, last = rest.tokens, rest.sequence()
        yield from _powers_of_two(last, tokens)


def _pack(ranks_path: str, capacity: int, schema: pa.Schema):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks_path)
        end = END_OF_DOCUMENT.to_bytes(4, "little")
        documents = (
            (doc.as_py(), encode(text.as_py() or "") + end) for batch in batches for doc, text in zip(batch.column(0), batch.column(1), strict=True)
        )

        def pieces() -> Iterator[tuple]:
            for name, parts in enumerate(sequences(documents, capacity), TaskContext.get().partitionId() << 36):
                offset = 0
                for doc, n, start, ids in parts:
                    yield doc, start, len(ids) // 4, bytes(ids), n, name, offset
                    offset += len(ids) // 4

        for rows in batched(pieces(), BATCH_PIECES):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return pack


def pack_with_little_slack(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise ``docs`` and pack them: one row per piece with its ids and its place.

    ``ranks_path`` is the vocabulary; beside it lies the tokenizer's file of the same name, .json. Returns ``id_col``, start
    (ids of the document before the piece), length, ids (binary, little-endian unsigned 32-bit), doc_tokens (ids of the
    document), sequence_id and offset; the pieces of a sequence fill it from 0 without gaps. A document is its ids and one
    end id. Every sequence holds ``capacity`` tokens but for those that a task ends with, whose lengths are distinct powers
    of two: none needs padding. Documents longer than a sequence are cut into full ones and a remainder; shorter parts are
    cut only where no subset of what a task holds fills a sequence.

    Null and empty texts are documents of the end id alone. Repeated rows and rows without id are packed each by itself.
    Columns other than the two named are not read, so their names do not matter. An empty table gives no rows.
    """
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length")]
        + [T.StructField("ids", T.BinaryType())]
        + [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")]
    )
    narrow = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_pack(ranks_path, capacity, to_arrow_schema(schema)), schema)
