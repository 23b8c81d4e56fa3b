import struct
from collections import defaultdict

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from equiscan.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]
    return struct.pack(f"<{len(ids)}I", *ids)


def check(rows, expected, capacity):
    """Every document comes back from its pieces, and every sequence is filled from 0 without gaps."""
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, bytes(r.ids)))
        places[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and r.length <= capacity
    got = sorted(x for found in pieces.values() for x in [b"".join(p[2] for p in sorted(found))])
    if expected is not None:
        assert got == sorted(b"".join(v) for v in expected)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return places


def test_round_trip(documents, texts):
    rows = packing.pack_documents(documents, RANKS).collect()
    places = check(rows, [[ids_of(t)] for t in texts.values()], 2048)
    tokens = sum(r.length for r in rows)
    assert len(places) <= 1.02 * tokens / 2048 + 1


def test_long_documents_are_cut_after_a_shorter_first_piece():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)]


@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_never_overfills_and_leaves_no_two_half_empty_bins(sizes):
    bins, offsets, fills = packing.best_fit(sizes, 50)
    for b in range(len(fills)):
        spans = sorted((offsets[i], sizes[i]) for i in range(len(sizes)) if bins[i] == b)
        assert sum(s for _, s in spans) == fills[b] <= 50
        assert all(x + s == y for (x, s), (y, _) in zip(spans, spans[1:], strict=False))
    assert sum(f <= 25 for f in fills) <= 1


def test_underfull_bins_merge_over_groups_and_rounds(spark):
    bins = spark.range(500).selectExpr("id AS bin", "CAST(100 + id % 700 AS LONG) AS fill")
    moved = packing.merged_bins(bins, 2048, 2040, group_bins=60).collect()
    assert sorted(r.bin for r in moved) == list(range(500))
    fills = {r.bin: r.fill for r in bins.collect()}
    places = defaultdict(list)
    for r in moved:
        places[r.parent].append((r["shift"], fills[r.bin]))
    for spans in places.values():
        assert all(x + s == y for (x, s), (y, _) in zip(sorted(spans), sorted(spans)[1:], strict=False))
        assert sum(s for _, s in spans) <= 2048
    assert len(places) <= sum(fills.values()) / 2048 * 1.03 + 1


def test_characters_of_the_short_way_split_like_the_tokenizer():
    encode = packing._encoder(RANKS)
    letters = [chr(i) for i in range(0x250) if not packing._ORDINARY.search(chr(i))] + list("–—‘’“”…")
    for c in letters:
        for text in (f"a{c}b", f" {c}", f"{c}{c} {c}1", f"'{c}s\n {c}"):
            assert encode(text) == ids_of(text)[:-4], text
    for text in ("don't  'll it's\n\n x'", "漢字 \x1c x", "a　b"):
        assert encode(text) == ids_of(text)[:-4], text


def test_added_tokens_of_the_tokenizer_are_recognised(spark):
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, mark * 3, f"{mark}  x\n\n{mark}\n", f"don{mark}'t 漢字{mark}  漢", "<|endoftext|", "<|ENDOFTEXT|>", f"<|{mark}|>", f"{mark} " * 3000]
    assert packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")) == {mark: 50256}
    encode = packing._encoder(RANKS)
    for text in texts:
        assert encode(text) == ids_of(text)[:-4], text
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(packing.pack_documents(docs, RANKS).collect(), [[ids_of(t)] for t in texts], 2048)


@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "a", "'s", "é", "漢", "1"]), max_size=12).map("".join))
def test_texts_with_added_tokens_split_like_the_tokenizer(text):
    assert packing._encoder(RANKS)(text) == ids_of(text)[:-4]


def test_awkward_rows(messy, no_documents):
    rows = packing.pack_documents(messy, RANKS).collect()
    check(rows, None, 2048)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sorted(r.length for r in rows if r.doc_id in (2, 3)) == [1, 1]
    assert sum(r.piece == 0 for r in rows) == messy.count()
    assert packing.pack_documents(no_documents, RANKS).collect() == []
