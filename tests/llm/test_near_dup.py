import random
import re

import numpy as np
import pytest

from tidewell.llm.components import connected_components
from tidewell.llm.near_dup import near_duplicates
from tidewell.llm.shingles import shingle_set


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * min(len(x), len(y)) >= 85 * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= 85 * (len(x) + len(y) - common):
                    lo, hi = sorted((find(a), find(b)))
                    root[hi] = lo
    return sorted((d, len(x), find(d), find(d) == d) for d, x in sets)


@pytest.mark.parametrize("seed", range(40))
def test_shingle_sets(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a", "B", "c", " ", "\n", "é", "ab", "\x0b ", "É", "\x85", "\xa0"]) for _ in range(r.choice([0, 1, 5, 60])))
    assert len(shingle_set(text.encode())) == len(shingles(text))
    assert np.array_equal(shingle_set(text.encode()), shingle_set(text.encode().lower()))


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 200)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert got == root
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(map(tuple, near_duplicates(docs).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(not k for *_, k in got) > 20


def test_large_groups_and_common_passages(spark, make_docs):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, original = [], [word() for _ in range(200)]
    for i in range(150):  # near copies: most pairs are linked, all through the original
        w = list(original)
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(200)] = word()
        rows.append((i, " ".join(w)))
    passage = [word() for _ in range(70)]
    for i in range(150, 300):  # a passage of many documents
        rows.append((i, " ".join([word() for _ in range(40)] + passage + [word() for _ in range(r.randrange(20, 80))])))
    rows += [(i, rows[i - 300][1]) for i in range(300, 340)]  # exact copies
    rows += [(i, "a few words") for i in range(340, 420)] + [(420, "few"), (421, "Few"), (422, "")]
    for i in range(423, 430):  # chains of edits
        w = rows[-1][1].split() if i > 423 else [word() for _ in range(150)]
        w[r.randrange(150)] = word()
        rows.append((i, " ".join(w)))
    docs = make_docs([(d, t, "en", "s", len(t)) for d, t in rows])
    assert sorted(map(tuple, near_duplicates(docs).collect())) == brute(rows)


def test_copies_that_only_the_original_links(spark, make_docs):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    original = [word() for _ in range(300)]
    rows = [(0, " ".join(word() for _ in range(50))), (77, " ".join(original))]
    for i in range(100, 200):  # three edits each: 0.9 to the original, 0.82 to one another
        w = list(original)
        for at in (10 + r.randrange(80), 110 + r.randrange(80), 210 + r.randrange(80), 150 + r.randrange(4)):
            w[at] = word()
        rows.append((i, " ".join(w)))
    docs = make_docs([(d, t, "en", "s", len(t)) for d, t in rows])
    assert sorted(map(tuple, near_duplicates(docs).collect())) == brute(rows)


def test_links_between_members_of_long_lists(spark, make_docs):
    """Groups under one template: families of an original and its edits, and a chain of edits, of which no two share
    more than the template with another. Each is found whole, none is joined with another."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    template = [word() for _ in range(260)]
    rows, d = [], 0
    order = list(range(600))
    r.shuffle(order)
    for _ in range(120):  # J = 0.84 or less between families, 0.9 within
        own = template[:] + [word() for _ in range(24)]
        for _ in range(4):
            w = own[:]
            w[-1 - r.randrange(20)] = word()
            rows.append((order[d], " ".join(w)))
            d += 1
    w = template[:] + [word() for _ in range(40)]
    for _ in range(120):  # neighbours are linked, far ones are not
        w = w[:]
        w[260 + r.randrange(40)] = word()
        rows.append((order[d], " ".join(w)))
        d += 1
    docs = make_docs([(d, t, "en", "s", len(t)) for d, t in rows])
    assert sorted(map(tuple, near_duplicates(docs).collect())) == brute(rows)


def test_near_copies_inside_a_population_that_shares_most_text(spark, make_docs):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage, rows = [word() for _ in range(184)], []
    for i in range(0, 160, 2):
        own = [word() for _ in range(22)]
        edited = own[:]
        edited[-1] = word()
        rows += [(i, " ".join(passage + own)), (i + 1, " ".join(passage + edited))]
    docs = make_docs([(d, t, "en", "s", len(t)) for d, t in rows])
    assert sorted(map(tuple, near_duplicates(docs).collect())) == brute(rows)


def test_awkward_rows(spark, awkward):
    rows = near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].component_id == 1 and by[1].kept
    assert by[4].n_shingles == 1 and by[6].n_shingles == 1 and by[7].component_id == 7
    assert by[None].component_id is None
    assert near_duplicates(awkward.limit(0)).collect() == []


def test_sql_tells_the_same():
    import duckdb

    from tidewell.llm.queries import NEAR_DUPLICATES_SQL

    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    rows = c.execute("SELECT doc_id, text FROM documents").fetchall()
    assert sorted(c.execute(NEAR_DUPLICATES_SQL).fetchall()) == brute(rows)
