import hashlib
import random
import re
import string

import pytest

from tidewell.llm.secret_scan import base_spans, discovery_levels, find_secrets, inferred_encoding, structured_p

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ALPHABET = ["token", "SECRET", "apikey", "Api_Key", "ſecret", "toKen", "AKIA", "AKIA" + "B" * 12, "0123456789abcdef" * 2, "f", "a", "0", "=", ":", " ", '"', "'", "é", "\n", "Zz9/", "..", "x" * 9, "--"]


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


@pytest.mark.parametrize("seed", range(300))
def test_base_spans_equal_the_rules(seed):
    r = random.Random(seed)
    text = "".join(r.choice(ALPHABET) for _ in range(40))
    assert sorted(base_spans(text)) == brute(text)


def test_random_strings_get_small_p_and_structured_ones_do_not():
    r = random.Random(1)
    for alphabet, n in (("0123456789abcdef", 64), (string.ascii_letters + string.digits + "+/", 64)):
        ps = sorted(structured_p(s, inferred_encoding(s)) for s in ("".join(r.choice(alphabet) for _ in range(n)) for _ in range(200)) if inferred_encoding(s))
        assert ps[len(ps) // 2] < 1e-4
    for s in ("0123456789abcdef" * 4, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1111111111111111111111111", "ThisIsALongIdentifierName2WithWordsInIt", "a1b2" * 12, "version20240101release20240102build20240103"):
        assert structured_p(s, inferred_encoding(s)) > 0.01, s
    assert inferred_encoding("onlylowercaseletters") is None


def test_false_discovery_control_counts_all_candidates():
    assert discovery_levels({0: {20: 10, 0: 90}}, 0.01) == {0: 20}
    assert discovery_levels({0: {0: 100}}, 0.01) == {}
    assert discovery_levels({0: {8: 1, 0: 1000}}, 0.01) == {}


def test_rows(spark, make_docs, awkward):
    r = random.Random(5)
    key = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(64))
    docs = make_docs([(1, f"x {key} y", None, None, 0), (2, f"é token = '{key}' AKIA{'Q7' * 8} {'0af' * 12}", None, None, 0)])
    rows = {x.doc_id: x for x in find_secrets(docs).collect()}
    assert rows[1].spans == "random:2:66" and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    names = ["assign", "access", "hex"]
    text = docs.collect()[1].text
    base = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in brute(text))
    assert rows[2].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and rows[2].spans == base
    assert (rows[2].n_assign, rows[2].n_access, rows[2].n_hex) == (1, 1, 1)
    got = find_secrets(awkward).collect()
    assert len(got) == awkward.count() and all(x.spans == "" for x in got)
    assert find_secrets(awkward.limit(0)).count() == 0
