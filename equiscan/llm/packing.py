"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Hierarchical residual packing. Each input partition tokenises its documents and packs the pieces best-fit in windows of
``WINDOW_TOKENS``; bins that are nearly full are final. The bins left underfull become items themselves: they are dealt
into groups, packed best-fit against each other, and the result goes into the next round with fewer, larger groups, until
a round in one group is done or a round brings almost nothing.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiscan.session import broadcast_up_to, staged

CAPACITY = 2048
#: Tokens a task holds while it packs; bounds the memory of a task whatever the size of its partition.
WINDOW_TOKENS = 3_000_000
#: Underfull bins that one task merges.
GROUP_BINS = 50_000
#: Words whose ids a worker remembers.
CACHED_WORDS = 300_000
#: Bins in a merge table that is still broadcast, about 40 bytes each.
BROADCAST_BINS = 1_000_000
END_OF_DOCUMENT = 0

#: The tokenizer's split into words, for texts of the characters below, where the classes of the re module
#: agree with the Unicode classes letter, number and white space but for the six numbers named.
_ORDINARY = re.compile("[^\t\n\r -ɏ–—‘’“”…]")
_WORDS = re.compile(
    " ?[^\\W\\d_²³¹¼½¾]+|'s|'t|'re|'ve|'m|'ll|'d| ?[\\d²³¹¼½¾]+| ?(?:[^\\s\\w]|_)+|\\s+(?!\\S)|\\s+"
)


class _WordIds(dict):
    """Word to the bytes of its ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(word)).tobytes()
        if len(self) < CACHED_WORDS:
            self[word] = ids
        return ids


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """The texts that the tokenizer file knows as tokens by themselves, wherever they stand in a text, and their ids."""
    with open(tokenizer_path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(token[k] for token in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"added tokens of {tokenizer_path} that depend on what stands beside them are not supported")
    return {token["content"]: token["id"] for token in added}


@cache
def _encoder(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = _WordIds(encoding.encode_ordinary)

    added = {token: array("I", [i]).tobytes() for token, i in added_tokens(str(Path(ranks_path).with_suffix(".json"))).items()}
    # The longest of those that begin at one place counts.
    marks = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})") if added else None

    def encode_ordinary(text: str) -> bytes:
        if _ORDINARY.search(text):
            return array("I", encoding.encode_ordinary(text)).tobytes()
        return b"".join(map(words.__getitem__, _WORDS.findall(text)))

    def encode(text: str) -> bytes:
        if marks is None or not marks.search(text):
            return encode_ordinary(text)
        return b"".join(added[part] if i % 2 else encode_ordinary(part) for i, part in enumerate(marks.split(text)))

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: all full but the first, which takes the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(start, capacity) for start in range(first, n, capacity)]


def best_fit(sizes: Iterable[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit, largest first: bin and offset of each item in the given order, and the fill of each bin.

    Open bins are kept by free space; the bits of one integer say which free spaces exist, so the tightest bin that
    still takes an item is the lowest bit at or above its size.
    """
    sizes = list(sizes)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    exists = 0
    bins, offsets, fills = [0] * len(sizes), [0] * len(sizes), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = exists >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                exists ^= 1 << space
        else:
            space, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        space -= size
        if space:
            free[space].append(b)
            exists |= 1 << space
    return bins, offsets, fills


def _pack_pieces(ranks_path: str, capacity: int, schema: pa.Schema):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks_path)
        next_bin = TaskContext.get().partitionId() << 36
        rows: list[list] = [[] for _ in range(5)]
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal rows, held, next_bin
            bins, offsets, fills = best_fit(rows[3], capacity)
            columns = [*rows, [next_bin + b for b in bins], offsets, [fills[b] for b in bins]]
            next_bin += len(fills)
            rows, held = [[] for _ in range(5)], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + bytes(4)  # END_OF_DOCUMENT
                doc = doc.as_py()
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, value in zip(rows, (doc, piece, start, length, ids[4 * start : 4 * (start + length)]), strict=True):
                        column.append(value)
                    held += length
                    if held >= WINDOW_TOKENS:
                        yield packed()
        if held:
            yield packed()

    return pack


def _merge_bins(capacity: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None:
            return
        # Largest first, so the first item of a merged bin, which names it, is its largest; bin numbers break ties.
        table = table.sort_by([("fill", "descending"), ("bin", "ascending")])
        names = table["bin"].to_pylist()
        bins, offsets, fills = best_fit(table["fill"].to_pylist(), capacity)
        first: dict[int, int] = {}
        for name, b in zip(names, bins, strict=True):
            first.setdefault(b, name)
        yield pa.RecordBatch.from_pydict(
            {"bin": names, "parent": [first[b] for b in bins], "shift": pa.array(offsets, pa.int64()), "total": pa.array([fills[b] for b in bins], pa.int64())}
        )

    return merge


def merged_bins(bins: DataFrame, capacity: int, nearly_full: int, group_bins: int = GROUP_BINS) -> DataFrame:
    """(bin, parent, shift) for every bin of ``bins`` (bin, fill): where tree merging puts it.

    A round deals the bins by hash into groups of about ``group_bins`` and packs each group best-fit; merged bins that
    are still underfull go on. Every row reaches one task of bounded size; groups hold a hash share, so no key can be hot.
    """
    place, open_bins, round_no = None, bins, 0
    n_open = open_bins.count()
    while n_open > 1:
        groups = -(-n_open // group_bins)
        step = staged(
            open_bins.select("bin", "fill")
            .repartition(groups, F.xxhash64("bin", F.lit(round_no)))
            .mapInArrow(_merge_bins(capacity), "bin long, parent long, shift long, total long"),
            "packing-round",
        )
        moved = step.select(F.col("bin").alias("_at"), F.col("parent").alias("_to"), F.col("shift").alias("_by"))
        place = (
            step.select("bin", "parent", "shift")
            if place is None
            else place.join(moved, place["parent"] == moved["_at"], "left").select(
                "bin", F.coalesce("_to", "parent").alias("parent"), (F.col("shift") + F.coalesce("_by", F.lit(0))).alias("shift")
            )
        )
        open_bins = step.where((F.col("bin") == F.col("parent")) & (F.col("total") < nearly_full)).select("bin", F.col("total").alias("fill"))
        before, n_open = n_open, open_bins.count()
        if groups == 1 or n_open > 0.99 * before:
            break
        round_no += 1
    return place if place is not None else bins.select("bin", F.col("bin").alias("parent"), F.lit(0).cast("long").alias("shift"))


def pack_documents(
    docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, nearly_full: float = 0.998, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenise ``docs`` and pack them: one row per piece with its ids and its place.

    ``ranks_path`` is the vocabulary; beside it lies the tokenizer's file of the same name, .json, whose added tokens are
    recognised in texts.

    Returns ``id_col``, piece (from 0), start (ids of the document before it), length, ids (binary, little-endian unsigned
    32-bit), sequence_id and offset; the pieces of a sequence fill it from 0 without gaps. A document is its ids and one
    end id; only documents longer than ``capacity`` are cut, into full pieces after a first piece with the remainder.

    Null and empty texts are documents of the end id alone. Repeated rows and rows without id are packed each by itself.
    Columns other than the two named are not read, so their names do not matter. An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("doc", id_type), T.StructField("piece", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("start", "length")]
        + [T.StructField("ids", T.BinaryType())]
        + [T.StructField(n, T.LongType()) for n in ("bin", "at", "fill")]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    pieces = staged(
        docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            _pack_pieces(ranks_path, capacity, to_arrow_schema(schema)), schema
        ),
        "packing-pieces",
    )
    limit = int(nearly_full * capacity)
    open_bins = pieces.where((F.col("at") == 0) & (F.col("fill") < limit)).select("bin", "fill")
    place = broadcast_up_to(staged(merged_bins(open_bins, capacity, limit), "packing-places"), BROADCAST_BINS)
    return pieces.join(place, "bin", "left").select(
        F.col("doc").alias(id_col),
        "piece",
        "start",
        "length",
        "ids",
        F.coalesce("parent", "bin").alias("sequence_id"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
