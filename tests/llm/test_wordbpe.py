import random
from bisect import bisect_right

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tidewell.llm.packing import pair_fit
from tidewell.llm.wordbpe import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_letters_go_to_the_model_alone():
    """Words of letters cost no pass through the normaliser, and their ids are the library's."""
    enc = WordEncoder(PATH)
    r, letters = random.Random(0), [chr(c) for c in range(256) if chr(c).isalpha() and chr(c) not in "ªµº"]
    words = letters + ["".join(r.choices(letters, k=r.randint(2, 12))) for _ in range(3000)]
    assert enc.library_ids([w.encode() for w in words]) == [library_ids(w) for w in words]

    class Closed:
        def encode_batch_fast(self, texts, **how):
            raise AssertionError(texts)

    enc.library = Closed()
    assert enc.encode(["Straße NAÏVE x".encode()]) == [library_ids("Straße NAÏVE x")]


def test_columns_of_texts():
    texts = ["The cat's  hat.", None, "", " \t\n", "The the THE", "x́ É Ü", "<|EndOfText|> <|endoftext|> A", "a b ªµº İI ﬁ 漢字 12.5!!"]
    for some in (texts, texts[:5], texts[2:4], texts[1:2], texts[4:], []):
        column = pa.array([None, *some], pa.string()).slice(1)
        assert WordEncoder(PATH).encode(column) == [library_ids(t or "") for t in some]


def plain_pair_fit(sizes, items, capacity, rng=None):
    """Pairs from both ends of the sorted sizes."""
    left, bins = sorted(items, key=lambda i: (sizes[i], i)), []
    while left:
        held = [left.pop(rng.randrange(len(left)) if rng else -1)]
        free = capacity - sizes[held[0]]
        while left and sizes[left[0]] <= free:
            top = high = bisect_right([sizes[i] for i in left], free) - 1
            best, at, low = sizes[left[high]], (high,), 0
            while low < top and best < free:
                both = sizes[left[low]] + sizes[left[top]]
                if both > free:
                    top -= 1
                else:
                    if both > best:
                        best, at = both, (top, low)
                    low += 1
            held += [left.pop(k) for k in at]
            free -= best
        bins.append(held)
    return bins


def test_pairs_by_bits_are_those_from_both_ends():
    for seed in range(60):
        r = random.Random(seed)
        sizes = [r.randint(1, r.choice([3, 20, 64])) for _ in range(r.randint(0, 90))]
        for rng in (lambda: None, lambda: random.Random(seed)):
            assert pair_fit(sizes, list(range(len(sizes))), 64, rng()) == plain_pair_fit(sizes, list(range(len(sizes))), 64, rng())
