import resource

import numpy as np
import pyarrow as pa

from tidewell.llm import attention, common
from tidewell.llm import lm_score as L
from tidewell.llm.wordbpe import encoder


def packed(words):
    ids = encoder(None).library_ids(words)
    table = pa.table({"word": pa.array(words, pa.binary()).cast(pa.string()), "c": pa.array([9] * len(words), pa.int64()), "ids": pa.array(ids, pa.binary()), "plain": pa.array([L.is_plain(w, x, None) for w, x in zip(words, ids)], pa.bool_())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def test_common_words_are_looked_up():
    own = L.Common(packed([b"the", b"cat", "naïve".encode()]))
    number, others = own.numbers(pa.array(["mat", "cat", "naïve", "x", "the"], pa.large_string()))
    assert number.tolist() == [3, 1, 2, 4, 0] and others == [b"mat", b"x"]
    symbols, sizes = own.with_symbols(*L.to_symbols(encoder(None).ids_of(others)))
    want = encoder(None).library_ids([b"the", b"cat", "naïve".encode(), b"mat", b"x"])
    assert (sizes * 4).tolist() == list(map(len, want)) and ((symbols // 2).astype("<u4").tobytes()) == b"".join(want)
    none = L.Common(None)
    assert none.numbers(pa.array(["a"], pa.large_string()))[1] == [b"a"] and none.numbers(pa.array([], pa.large_string()))[1] == []


def test_coded_texts_hold_every_word(monkeypatch):
    """Each batch's other words are encoded once, and neither training nor scoring encodes them again."""
    known = L.Common(packed([b"the", b"cat", "naïve".encode()]))
    texts = ["The cat x the Mat x", None, "", " the ", "\u00a0 mat É naïve É x"]
    columns = L.coded(pa.array(texts), known, None)
    monkeypatch.setattr(L, "encoder", None)
    which, per_text, symbols, sizes, plain = L.uncoded(columns, known)
    words = ["the", "cat", "naïve", *(w for t in columns[1].to_pylist() for w in t.split(" ") if w)]
    lower = [w.decode() for t in texts for w in L.words_of((t or "").encode())]
    assert [words[i] for i in which] == lower and per_text.tolist() == [6, 0, 0, 1, 6]
    rare = [w.encode() for w in words[3:]]
    assert rare == [w.encode() for w in ("x", "mat", "\u00a0", "mat", "É", "x")]
    want = encoder(None).library_ids(rare)
    assert (sizes * 4).tolist() == list(map(len, want)) and (symbols // 2).astype("<u4").tobytes() == b"".join(want)
    assert plain.tolist() == [True, True, False, True, False, True]


def test_words_of_latin_letters_need_no_normalizer(monkeypatch):
    """They are plain exactly if the library's normalizer leaves them as they are, and it isn't asked."""
    signs = [*map(chr, range(0x21, 0x7F)), *(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]
    r = np.random.default_rng(0)
    words = [x + y for x in signs[94:] for y in ("", "a", "'", *r.choice(signs, 8))] + ["".join(r.choice(signs, 6)).lower() for _ in range(500)]
    words = [w.encode().lower().decode() for w in words]  # as texts are lowered: ASCII only
    want = [w.isascii() or encoder(None).library.normalizer.normalize_str(w) == w for w in words]
    assert True in want and False in want
    monkeypatch.setattr(L, "encoder", None)
    assert [L.is_plain(w.encode(), b"1234", None) for w in words] == want


def test_earlier():
    r = np.random.default_rng(0)
    text, word = np.sort(r.integers(0, 9, 500)), r.integers(0, 40, 500)
    assert L.earlier(text, word).tolist() == [int(((text[:i] == text[i]) & (word[:i] == word[i])).sum()) for i in range(500)]


def test_arrays_of_a_step_take_no_new_pages():
    """A step's arrays come from the heap, not from the system again and again."""
    common.keep_memory()
    r = np.random.default_rng(0)
    p, logs = attention.initial(), attention.transitions(r.integers(0, 50, (attention.CLASSES + 1, attention.CLASSES)).astype(float))
    x, at = r.integers(0, attention.CLASSES, (257, attention.BLOCK)), np.arange(256 * attention.BLOCK)
    step = lambda: attention.block_gradients(p, logs, x, at, x[1:].ravel(), np.full(len(at), 1 / len(at), np.float32))
    for _ in range(5):
        step()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(20):
        step()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 20 * 300  # 1,281 a step before
