import random
import struct
from collections import Counter, defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from equiscan.llm import slack_packing
from equiscan.llm.slack_packing import closest_subset, pack_with_little_slack, sequences

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]
    return struct.pack(f"<{len(ids)}I", *ids)


def padding(lengths, capacity):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)


def check(pieces, expected, capacity):
    """``pieces`` (doc, start, ids, doc_tokens, sequence, offset): every id lies in one piece, sequences have no gaps."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for doc, start, ids, n, sequence, offset in pieces:
        assert 0 < len(ids) <= 4 * capacity
        of_doc[doc, n].append((start, bytes(ids)))
        of_sequence[sequence].append((offset, len(ids) // 4))
    for (doc, n), found in of_doc.items():
        at = 0
        for start, ids in sorted(found):
            assert start == at
            at += len(ids) // 4
        assert at == n and b"".join(ids for _, ids in sorted(found)) == expected[doc]
    assert {doc for doc, _ in of_doc} == set(expected)
    for spans in of_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return [sum(x for _, x in spans) for spans in of_sequence.values()]


def test_round_trip_without_padding(documents, texts):
    rows = pack_with_little_slack(documents, RANKS).collect()
    expected = {i: ids_of(t) for i, t in texts.items()}
    lengths = check([(r.doc_id, r.start, r.ids, r.doc_tokens, r.sequence_id, r.offset) for r in rows], expected, 1024)
    assert padding(lengths, 1024) == 0
    needed = sum(-(-len(ids) // 4 // 1024) for ids in expected.values())
    assert len(rows) <= 1.25 * needed  # of so few documents; see below for more


def packed(sizes, capacity, **settings):
    documents = {i: struct.pack(f"<{n}I", *range(n)) for i, n in enumerate(sizes)}
    made = list(sequences(iter(documents.items()), capacity, **settings))
    pieces = []
    for k, parts in enumerate(made):
        offset = 0
        for doc, n, start, ids in parts:
            pieces.append((doc, start, ids, n, k, offset))
            offset += len(ids) // 4
    return pieces, check(pieces, documents, capacity)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=80), st.sampled_from([16, 64, 50]), st.sampled_from([(1, 0), (300, 40), (10**6, 100)]))
def test_any_lengths(sizes, capacity, window):
    pieces, lengths = packed(sizes, capacity, window=window[0], reserve=window[1])
    short = [n for n in lengths if n < capacity]
    assert all(n & (n - 1) == 0 for n in short) and len(short) == len(set(short))
    assert sum(lengths) == sum(sizes)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=12), st.integers(1, 120))
def test_the_subset_is_the_closest(items, space):
    counts = Counter(items)
    lengths = sorted((x for x in counts if x <= space), reverse=True)
    used = closest_subset(counts, lengths, space)
    assert all(used[x] <= counts[x] for x in used)
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= space}
    assert sum(x * n for x, n in used.items()) == max(sums)


def test_documents_are_seldom_cut():
    draw = random.Random(1)
    sizes = [min(1024, int(draw.lognormvariate(5.5, 1)) + 1) for _ in range(20_000)]
    pieces, lengths = packed(sizes, 1024)
    assert padding(lengths, 1024) == 0 and len(pieces) <= 1.01 * len(sizes)
    # Nothing but halves and a bit: no subset fills a sequence, so parts are cut to fill it.
    pieces, lengths = packed([600] * 1000, 1024)
    assert padding(lengths, 1024) == 0 and len(pieces) <= 2 * len(lengths) + 10


def test_awkward_rows(spark, messy, no_documents):
    rows = pack_with_little_slack(messy, RANKS).collect()
    assert sum(r.length for r in rows if r.doc_id == 8) == len(ids_of("x" * 300_000)) // 4
    assert Counter(r.doc_id for r in rows if r.start == 0)[1] == 2 and Counter(r.doc_id for r in rows if r.start == 0)[None] == 2
    assert [(r.length, bytes(r.ids)) for r in rows if r.doc_id == 2] == [(1, bytes(4))]
    places = defaultdict(int)
    for r in rows:
        places[r.sequence_id] += r.length
    assert padding(places.values(), 1024) == 0
    assert pack_with_little_slack(no_documents, RANKS).collect() == []
    marked = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert b"".join(bytes(r.ids) for r in pack_with_little_slack(marked, RANKS).orderBy("start").collect()) == ids_of("a <|endoftext|> b")


def test_a_task_that_runs_again_gives_the_same_rows(documents):
    one, two = (sorted(map(str, pack_with_little_slack(documents, RANKS).collect())) for _ in range(2))
    assert one == two


def test_windows_hold_little(monkeypatch):
    held = []
    plain = slack_packing.Remainders.add

    def add(self, *args):
        plain(self, *args)
        held.append(self.tokens)

    monkeypatch.setattr(slack_packing.Remainders, "add", add)
    packed([700] * 3_000, 1024, window=50_000, reserve=5_000)
    assert max(held) <= 51_024
