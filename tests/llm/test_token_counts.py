import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from equiscan.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def exact(vocabulary, byte_fallback):
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_counts_equal_the_tokenizer(texts, byte_fallback):
    vocabulary = token_counts.read_vocabulary(MODEL)
    counter, tokenizer = token_counts.PieceCounter(vocabulary, byte_fallback), exact(vocabulary, byte_fallback)
    draw = random.Random(1)
    made = ["".join(draw.choices("abcthe éü▁ \n漢字😀.,|12 in er <s> <0x0A>", k=draw.randrange(60))) for _ in range(1500)]
    for text in [*list(texts.values())[:100], *made, "", " ", "  a", "▁", "a  b", " "]:
        assert counter.of_text(text) == tokenizer(text), text


def test_ties_go_to_the_piece_that_starts_first():
    draw = random.Random(2)
    for _ in range(40):
        pieces = {"▁", *("".join(draw.choices("ab▁", k=draw.randint(1, 4))) for _ in range(12))}
        pieces = [p for p in pieces if "▁" not in p[1:]]
        vocabulary = [("<unk>", -9.0)] + [(p, -float(draw.randint(1, 3))) for p in sorted(pieces)]
        for fallback in (True, False):
            counter, tokenizer = token_counts.PieceCounter(vocabulary, fallback), exact(vocabulary, fallback)
            for _ in range(40):
                text = "".join(draw.choices("abc ", k=draw.randint(1, 12)))
                assert counter.of_text(text) == tokenizer(text), (vocabulary, text)


def test_awkward_rows(messy, no_documents):
    rows = token_counts.count_tokens(messy, MODEL).collect()
    assert len(rows) == messy.count() and all(r.n_tokens == 0 for r in rows if r.doc_id in (2, 3))
    assert token_counts.count_tokens(no_documents, MODEL).collect() == []
