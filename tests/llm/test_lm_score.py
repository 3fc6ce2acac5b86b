import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import attention
from tidewell.llm import lm_score as L
from tidewell.llm.wordbpe import encoder


def brute(rows, folds=5):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % folds == 1
    c = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted(((d, held(d), len(w := tokens(t)), sum(c[x] > 0 for x in w), n, pytest.approx(sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)) for d, t in rows), key=lambda x: str(x[:5]) + str(round(x[5].expected)))


def plain(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=lambda x: str(x[:5]) + str(round(x[5])))


def some_logs(seed=0):
    return attention.transitions(np.random.default_rng(seed).integers(0, 50, (attention.CLASSES + 1, attention.CLASSES)).astype(float))


def some_weights(seed=1):
    r = np.random.default_rng(seed)
    return {n: (r.standard_normal(s) * 0.3).astype(np.float32) for n, s in attention.shapes().items()}


def test_gradients():
    r = np.random.default_rng(0)
    p = {n: r.standard_normal(s) * 0.3 for n, s in attention.shapes().items()}
    logs = tuple(x.astype(float) for x in some_logs())
    x, t = r.integers(0, attention.CLASSES + 1, (3, attention.CONTEXT)), r.integers(0, attention.CLASSES, (3, attention.BLOCK))
    w = (r.random((3, attention.BLOCK)) < 0.7).astype(float)
    _, g = attention.gradients(p, logs, x, t, w)
    for n in [*p] * 5:
        at = tuple(r.integers(0, s) for s in p[n].shape)
        old = p[n][at]
        p[n][at] = old + 1e-5
        up = attention.gradients(p, logs, x, t, w)[0]
        p[n][at] = old - 1e-5
        down = attention.gradients(p, logs, x, t, w)[0]
        p[n][at] = old
        assert g[n][at] == pytest.approx((up - down) / 2e-5, abs=1e-6), n


def test_windows_score_each_symbol_once():
    lengths = np.array([1, 5, 16, 17, 57, 200])
    place, size = attention.windows(lengths)
    assert len(set(place.tolist())) == lengths.sum() and place.max() < size and place.min() == attention.BLOCK
    begins = np.cumsum(1 + -(-lengths // attention.BLOCK)) - 1 - -(-lengths // attention.BLOCK)
    assert not set((place // attention.BLOCK).tolist()) & set(begins.tolist())


def plain_log(p, logs, before, target):
    """ln of the class's probability behind the inputs ``before`` (the last is the one asked from), one at a time."""
    x = [attention.PAD] * 40 + list(before)
    e = p["embed"].astype(float)
    i = len(x) - 1
    low = (len(before) - 1) // attention.BLOCK * attention.BLOCK - attention.BLOCK + 40  # the block before the asking one
    q = e[x[i]] @ p["query"]
    seen = range(low, i + 1)
    a = np.array([q @ (e[x[j]] @ p["key"]) / np.sqrt(e.shape[1]) + p["near"][i - j] for j in seen])
    a = np.exp(a - a.max())
    a /= a.sum()
    state = e[x[i]] + sum(w * (e[x[j]] @ p["value"]) for w, j in zip(a, seen)) @ p["out"]
    group = target // attention.GROUP
    g = state @ p["groups"] + logs[0][x[i]]
    c = state @ p["head"][group] + logs[1][x[i], group]
    return g[group] - np.logaddexp.reduce(g) + c[target % attention.GROUP] - np.logaddexp.reduce(c)


def plain_score(texts, words, p, logs, group, share, tokens):
    """By the definition, word by word; ``words``: training counts, ``tokens``: training words and texts."""
    enc, out = encoder(None), []
    n = sum(tokens)
    for t in texts:
        own = L.words_of(t)
        classes, logs10 = [attention.PAD], []
        for i, w in enumerate([*own, None]):
            ids = np.frombuffer(enc.library_ids([w])[0], "<u4").tolist() if w is not None else []
            symbols = [2 * x + (k == len(ids) - 1) for k, x in enumerate(ids)] if w is not None else [L.END]
            m = 0.0
            for s in symbols:
                m += plain_log(p, logs, classes, group[s]) + share[s]
                classes.append(int(group[s]))
            plain = w is None or L.is_plain(w, enc.library_ids([w])[0], None)
            m = np.log(1 - L.ESCAPE) + m if plain else np.log(L.ESCAPE) - np.log(257) * (len(w) + 1)
            c = tokens[1] if w is None else words.get(w, 0)
            a = L.MODEL + (L.REPEATED if i == 0 else 0)
            logs10.append(log10(a * np.exp(m) + L.REMEMBERED * c / n + (L.REPEATED * own[:i].count(w) / i if i else 0)))
        out.append(sum(logs10))
    return out


def scorer(words, p, logs, group, share, documents, common):
    coded = encoder(None).library_ids(common)
    table = pa.table({"word": pa.array(common, pa.binary()).cast(pa.string()), "c": pa.array([words[w] for w in common], pa.int64()), "ids": pa.array(coded, pa.binary()), "plain": pa.array([L.is_plain(w, x, None) for w, x in zip(common, coded)], pa.bool_())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return L.Scorer(L.pack_weights(p), logs, group, share, sink.getvalue().to_pybytes(), (sum(words.values()), documents, 1.0))


def test_scores_by_the_definition():
    texts = ["the cat sat on the mat, the Cat's hat " * 4, "", "a", "Élan ÉLAN \u00a0 na\u00efve x\u2003y 漢字 don't!", "zzz " * 30]
    texts = [t.encode() for t in texts]
    words = Counter(w for t in texts[:3] for w in L.words_of(t))
    counts = np.random.default_rng(3).integers(0, 100, L.END + 1)
    group, share = L.classes_of(counts)
    p, logs = some_weights(), some_logs()
    want = plain_score(texts, words, p, logs, group, share, (sum(words.values()), 3))
    for common in (sorted(words), sorted(words)[::2]):
        got = scorer(words, p, logs, group, share, 3, common).score(texts, None)
        n = sum(words.values()) + 3
        whole = [f[3] + sum(log10(L.REMEMBERED * words.get(w, 0) / n + rest) for w, rest in f[4]) for f in got]
        assert whole == pytest.approx(want, rel=1e-4)
        assert [f[0] for f in got] == [len(L.words_of(t)) + 1 for t in texts]


def test_different_words_have_different_symbols():
    """At most one of the words that the tokenizer makes equal is told by its symbols, the others are spelled."""
    for same in (["é", "É", "e\u0301"], ["a\u00a0", "a", "\u00a0a"], ["ß"], ["\u00a0"], ["i\u0307", "İ"]):
        ids = encoder(None).library_ids([w.encode() for w in same])
        plain = [x for w, x in zip(same, ids) if L.is_plain(w.encode(), x, None)]
        assert len(set(plain)) == len(plain) and b"" not in plain


def test_probabilities_sum_to_one():
    counts = np.zeros(L.END + 1, np.int64)
    counts[:5000] = np.random.default_rng(0).integers(0, 1000, 5000)
    group, share = L.classes_of(counts)
    assert np.allclose(np.bincount(group, np.exp(share.astype(float)), attention.CLASSES), 1, atol=1e-3)
    tables = attention.Tables(some_weights(), some_logs())
    x = np.random.default_rng(1).integers(0, attention.CLASSES + 1, (2, attention.BLOCK))
    state = np.repeat(tables.contexts(x)[-1:], attention.CLASSES, 0)
    total = np.exp(tables.log_probabilities(state, np.full(attention.CLASSES, x[-1, -1]), np.arange(attention.CLASSES))).sum()
    assert total == pytest.approx(1, abs=1e-4)
    assert L.MODEL + L.REMEMBERED + L.REPEATED <= 1 and L.MODEL >= 0.5


def test_real_texts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.lm_scores(docs).collect()
    assert plain(got) == brute([(r.doc_id, r.text) for r in docs.collect()])
    # the same, however few words travel to the workers, and again
    monkeypatch.setattr(L, "TOP_WORDS", 3000)
    assert {r.doc_id: r.score for r in L.lm_scores(docs).collect()} == {r.doc_id: pytest.approx(r.score, rel=1e-9) for r in got}
    # training counts: without it, held-out texts are less likely
    monkeypatch.setattr(L, "RATES", ())
    out = lambda rows: sum(r.score for r in rows if r.held_out) / sum(r.n_tokens for r in rows if r.held_out)
    assert out(L.lm_scores(docs).collect()) < out(got) < 0


def test_awkward_rows(spark, awkward, make_docs):
    got = L.lm_scores(awkward).collect()
    assert plain(got) == brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert L.lm_scores(awkward.limit(0)).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = L.lm_scores(make_docs([(only, "no training at all", "en", "s", 5)])).collect()
    assert (row.held_out, row.n_known, row.train_tokens) == (True, 0, 0) and np.isfinite(row.score)
