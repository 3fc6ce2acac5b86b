import hashlib
import random
import re
import time

import numpy as np
import pytest

from tidewell.llm.pii import FEATURES, KINDS, RIDGE, estimate_reliabilities, features_of, find_personal_data, learn, pattern_of, proposals, redact, train_classifier, votes

ALPHABET = ["a@b.c", "a.b%", "@", "d-e.f", "_", ".", "-", "+1 (017) 555-7713", "+", "1.2.3.4", "256.1.1.1", "007.08.1.255", "4111 1111 1111 1111", "4111111111111112", "4111-1111-1111-1111-", "5", "12", " ", "(", ")", "é", "٣", "\n", "x"]


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


@pytest.mark.parametrize("seed", range(400))
def test_base_spans_equal_the_rules(seed):
    r = random.Random(seed)
    text = "".join(r.choice(ALPHABET) for _ in range(30))
    assert sorted((a, k, b) for a, k, b, base in proposals(text) if base) == brute(text)


def test_expectation_maximisation_separates_supported_spans():
    strict = {pattern_of(2, [2, 2, 2, 0, 2, 0]): 500, pattern_of(0, [2, 0, 2, 0, 2, 0]): 500}
    good, bad = pattern_of(7, [0, 2, 0, 2, 2, 0]), pattern_of(4, [0, 1, 0, 1, 1, 0])
    posterior, _ = estimate_reliabilities(strict | {good: 40, bad: 400})
    assert posterior[good] > 0.5 > posterior[bad] and all(posterior[c] > 0.5 for c in strict)


def test_classifier_learns_from_signs_and_context(spark):
    """Spans of one vote pattern are told apart by what is in and beside them, as a plain fit on all rows says."""
    r = random.Random(2)
    rows, label = [], {1: 0.9, 2: 0.1}
    for _ in range(400):
        p = r.choice([1, 2])
        text = r.choice(["call", "please call", "order"] if p == 1 else ["order", "page", "item number"]) + " 555-867-5309 x"
        at = text.index("555")
        rows.append((p, features_of(text, at, 5, at + 12)))
    got = train_classifier(spark.createDataFrame(rows, "pattern int, features array<int>"), label)
    x, y = np.zeros((len(rows), FEATURES)), np.array([label[p] for p, _ in rows])
    for i, (_, f) in enumerate(rows):
        x[i, f] = 1
    w = np.zeros(FEATURES)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(FEATURES), x.T @ (p - y) + RIDGE * w)
    assert np.allclose(got, w, atol=1e-3)
    score = lambda t: sum(got[i] for i in features_of(t, t.index("555"), 5, t.index("555") + 12))
    assert score("call 555-867-5309 x") > 0 > score("page 555-867-5309 x")
    assert not train_classifier(spark.createDataFrame([], "pattern int, features array<int>"), {}).any()


def test_many_numbers_take_linear_time():
    text = "12-34 555-867-5309 4111 1111 1111 1112, " * 30_000
    began = time.process_time()
    assert len(proposals(text)) >= 30_000 and time.process_time() - began < 20


def test_added_spans_equal_a_plain_run(spark, make_docs):
    """The query's added spans are those that the weights, learnt from all spans, take."""
    lines = ["call 555-867-%04d now", "order 555-867-%04d", "ssn 123-45-%04d", "Dr Anna Weber%d", "card 4111 1111 1111 %04d", "mail a%d@b.com"]
    docs = make_docs([(i, ". ".join(x % (1000 + i) for x in lines), "en", "s", 1) for i in range(60)])
    found = [(d.doc_id, d.text, proposals(d.text)) for d in docs.collect()]
    spans = [(pattern_of(k, votes(t, a, k, b, base)), features_of(t, a, k, b)) for _, t, p in found for a, k, b, base in p]
    weights = learn(spark.createDataFrame(spans, "pattern int, features array<int>"))
    want = {d: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, base in sorted(p) if base or sum(weights[i] for i in features_of(t, a, k, b)) >= 0) for d, t, p in found}
    assert {r.doc_id: r.spans for r in find_personal_data(docs).collect()} == want


def test_rows_and_redaction(spark, make_docs, awkward):
    texts = ["é mail x.y@z.org or +1 (017) 555-7713 from 10.0.0.1 card 4111 1111 1111 1111.", "clean words only", None, ""]
    docs = make_docs([(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    rows = {r.doc_id: r for r in find_personal_data(docs).collect()}
    for i, t in enumerate(texts):
        base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in brute(t or ""))
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and rows[i].spans == base
    assert (rows[0].n_email, rows[0].n_ip, rows[0].n_card, rows[0].n_phone) == (1, 1, 1, 1)
    clean = {r.doc_id: r for r in redact(docs).collect()}
    assert clean[0].text == "é mail [email] or [phone] from [ip] card [card]." and clean[0].n_chars == len(clean[0].text)
    assert clean[1].text == texts[1] and clean[1].n_chars == 1 and clean[2].text is None
    assert redact(docs).columns == docs.columns
    assert find_personal_data(awkward).count() == redact(awkward).count() == awkward.count()
    assert find_personal_data(awkward.limit(0)).count() == 0
