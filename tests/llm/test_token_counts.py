import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewell.llm.token_counts import resynchronised_ids, token_counts
from tidewell.llm.wordbpe import WordEncoder, encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = ["the", "The", "END", "'s", "I'll", "don't", "é", "É", "J̌", "İ", "ß", "漢字", "1234", "3.14", "...", "!?", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|startoftext|>y", " ", " ", "\u0085", "\x1c", "a,b", "foo.", "fé.", "€.", "x€,", "😀", "😀!", "\x00", "ſ", "K", "_", "a_b", "ﬁ", "Σ", "ΟΔΟΣ", "'", "'S.", "`", "ñ,", "٣", "٣."]


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def random_text(seed, n=60):
    r = random.Random(seed)
    return "".join(r.choice(PIECES) + r.choice(["", "", " ", "\n", "\t ", "\r\n", "\x0b"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(60))
def test_ids_equal_the_library(seed):
    texts = [random_text(seed * 100 + i) for i in range(20)]
    for enc in (encoder(PATH), WordEncoder(PATH, capacity=3)):
        for t, ids in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == expected(t), repr(t)


@pytest.mark.parametrize("seed", range(30))
def test_spliced_chunks_equal_the_whole(seed):
    t = random_text(seed, 400) + "q" * (seed * 40) + random_text(seed + 1, 100)
    got = resynchronised_ids(encoder(PATH), t.encode(), chunk=100 + seed, overlap=1 + seed % 7)
    assert np.frombuffer(b"".join(got), "<u4").tolist() == expected(t)
    assert len(got) > 3


def test_no_boundary_at_all_widens_to_the_end():
    t = "abc" * 5000
    got = resynchronised_ids(encoder(PATH), t.encode(), chunk=100, overlap=4)
    assert len(got) == 1 and np.frombuffer(got[0], "<u4").tolist() == expected(t)


def test_digits_part_a_text_without_white_space():
    r = random.Random(3)
    t = "".join(r.choice(["abc", "X", "7", "42", "é", "e\u0301", "'s", "-", "J̌", "9a", "٣"]) for _ in range(20_000))
    got = resynchronised_ids(encoder(PATH), t.encode(), chunk=1000, overlap=16)
    assert len(got) > 30 and np.frombuffer(b"".join(got), "<u4").tolist() == expected(t)


def test_query_rows(spark, awkward):
    rows = token_counts(awkward, chunk=500, overlap=16).collect()
    texts = [r.text or "" for r in awkward.collect()]
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((len(t.encode()), len(expected(t)), len(expected(t)) > 2048) for t in texts)
    assert token_counts(awkward.limit(0)).count() == 0
