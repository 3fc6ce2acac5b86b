"""Exact ids of the word-level BPE file at the speed of a dictionary.

The tokenizer normalises (NFC, white space to a space, lower case), splits at white space, and then at changes
between letters, digits and other signs; BPE runs inside those pieces. None of these steps looks across white
space, so a text's ids are those of its parts between ASCII white space, one after another. Parts repeat, so the
library encodes each one once per worker and a bounded dictionary answers the rest. A part of nothing but ASCII and
Latin-1 letters goes straight to the library's BPE model: it is one piece, normalising only lowers it, and its bytes are
written as the signs that stand for bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import gathered, kept_by_worker, words_by_text

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts longer than this are encoded but not remembered.
MAX_CACHED_BYTES = 64
#: Most parts a worker remembers (about 200 bytes each).
CACHE_PARTS = 400_000
#: Signs that form a piece of their own behind a letter or digit.
TRAILING_SIGNS = b".,;:!?*#&%$"
VOCABULARY = "word_bpe_49k.json"
#: Letters that are in normal form, lowered one by one and of one piece.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The signs of bytes in those letters: the model's vocabulary has printable ones in place of others.
_BYTES = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


class WordEncoder:
    """Encodes UTF-8 texts to little-endian unsigned 32-bit ids, equal to the library's."""

    def __init__(self, path: str, capacity: int = CACHE_PARTS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.capacity = capacity
        self.known: dict[bytes, bytes] = {}

    def library_ids(self, parts: list[bytes]) -> list[bytes]:
        texts = [p.decode("utf-8", "replace") for p in parts]
        of_letters = [LETTERS.fullmatch(t) is not None for t in texts]
        found = [[x.id for x in self.tokenize(t.lower() if t.isascii() else t.lower().encode().decode("latin-1").translate(_BYTES))] for t, own in zip(texts, of_letters, strict=True) if own]
        others = [t for t, own in zip(texts, of_letters, strict=True) if not own]
        rest = iter([e.ids for e in self.library.encode_batch_fast(others, add_special_tokens=False)] if others else [])
        first = iter(found)
        found = [next(first if own else rest) for own in of_letters]
        data, ends = np.fromiter(chain.from_iterable(found), "<u4").tobytes(), (np.cumsum(list(map(len, found)), dtype=np.int64) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]  # there is one end less

    def _learn(self, parts: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of parts that aren't known yet; trailing signs are looked up by themselves."""
        known, split = self.known, []
        wanted: dict[bytes, None] = {}
        for part in parts:
            stem = part.rstrip(TRAILING_SIGNS)
            if len(stem) < len(part) and stem[-1:].isalnum():
                signs = part[len(stem) :]
                split.append((part, stem, signs))
                for x in (stem, signs):
                    if x not in known:
                        wanted[x] = None
            else:
                wanted[part] = None
        fresh = dict(zip(wanted, self.library_ids(list(wanted)), strict=True))
        for part, stem, signs in split:
            fresh[part] = (known[stem] if stem in known else fresh[stem]) + (known[signs] if signs in known else fresh[signs])
        if len(known) < self.capacity:
            known.update(islice(((part, ids) for part, ids in fresh.items() if len(part) <= MAX_CACHED_BYTES), self.capacity - len(known)))
        return fresh

    #: Texts with these aren't lowered.
    MARKED = re.compile(rb"<\||[\xcc\xcd]")

    @staticmethod
    def lowered(text: bytes) -> bytes:
        """The text with ASCII capitals lowered where that can't change the ids: not beside combining marks (NFC runs
        before the lower-casing) nor near special tokens' strings."""
        return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()

    def ids_of(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part."""
        found = list(map(self.known.get, parts))
        if missing := [p for p, x in zip(parts, found, strict=True) if x is None]:
            fresh = self._learn(missing)
            found = [fresh[p] if x is None else x for p, x in zip(parts, found, strict=True)]
        return found

    def encode(self, texts: pa.Array | list[bytes]) -> list[bytes]:
        """The ids of each text; a null is empty."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.binary()).cast(pa.string())
        lower = pc.ascii_lower(texts)
        if self.MARKED.search(lower.cast(pa.binary()).buffers()[-1] or b""):  # rarely: text by text
            lower = pa.array([t and self.lowered(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())
        distinct, which, words = words_by_text(lower)
        ids = self.ids_of(distinct)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        data = gathered(np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(sizes) - sizes)[which], sizes[which]).tobytes()
        ends = (np.concatenate([[0], np.cumsum(sizes[which])])[np.cumsum(words)] * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]  # there is one end less


_ENCODERS: dict[str, WordEncoder] = kept_by_worker()


def encoder(path: str | None = None) -> WordEncoder:
    """This worker's encoder for a vocabulary file; every worker finds the file at its own path."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
