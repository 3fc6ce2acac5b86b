import re
from collections import defaultdict

import pytest

from tidewell.llm.mixing import landing, mix, take


def targets(sizes, weights=(3, 1, 2)):
    """By the rule: share out by weight, stop at twice the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    got = {s: 0.0 for s in names}
    rest = 1.5 * sum(sizes.values())
    while rest > 1e-9:
        room = [s for s in names if got[s] < 2 * sizes[s] - 1e-9]
        if not room:
            break
        part, total = rest, sum(weight[s] for s in room)
        rest = 0.0
        for s in room:
            new = got[s] + part * weight[s] / total
            rest += max(0.0, new - 2 * sizes[s])
            got[s] = min(new, 2 * sizes[s])
    return got


def check(docs, rows, near=None):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for d in docs:
        sizes[d.source] += size(d.text)
    want = targets(sizes)
    source = {d.doc_id: d.source for d in docs}
    taken, biggest = defaultdict(int), defaultdict(int)
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(d.doc_id), size(d.text)) for d in docs)
    for r in rows:
        s = source[r.doc_id]
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= (biggest[s] if near is None else max(1, near * want[s])), s


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = mix(docs).collect()
    check(docs.collect(), first, near=0.01)
    assert sorted(map(tuple, first)) == sorted(map(tuple, mix(docs).collect()))


def test_several_levels(spark, monkeypatch):
    import tidewell.llm.mixing as m

    monkeypatch.setattr(m, "BLOCK_DOCUMENTS", 120)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("source", __import__("pyspark").sql.functions.expr("if(doc_id % 3 = 0, source, 'hot')"))
    check(docs.collect(), m.mix(docs).collect(), near=0.005)


def test_awkward_rows(spark, awkward, make_docs):
    check(awkward.collect(), mix(awkward).collect())
    assert mix(awkward.limit(0)).collect() == []
    empty = mix(make_docs([(1, None, "a", None, 0), (2, "", None, None, 0)])).collect()
    assert [(r.target, r.taken) for r in empty] == [(0.0, 0), (0.0, 0)]


def test_take_repeats_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    taken = take(docs)
    assert taken.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 2 and taken.count() > docs.count()


def test_repeated_rows_are_spread(spark, make_docs, monkeypatch):
    """Equal rows without ids fall into many blocks, and are taken as the target says."""
    import tidewell.llm.mixing as m

    monkeypatch.setattr(m, "BLOCK_DOCUMENTS", 100)
    docs = make_docs([(None, "four words of text", "en", "hot", 1) for _ in range(3000)] + [(i, "other words " * (i % 7), "en", "b", 1) for i in range(300)])
    seen = []
    real = m.cut
    monkeypatch.setattr(m, "cut", lambda df, label: (seen.append(df.groupBy("source_key", "key").count().agg({"count": "max"}).first()[0]) if label == "mix-sizes" else None, real(df, label))[1])
    check(docs.collect(), m.mix(docs).collect())
    assert seen == [1]


def test_landing_evens_out_a_large_document():
    import numpy as np

    sizes = np.array([9000.0, 10, 12, 9] + [100 + i for i in range(200)])
    chance = np.array([0.4, 0.5, 0.5, 0.2] + [float(i % 2) for i in range(200)])
    out = landing(sizes, chance, float((chance * sizes)[:4].sum()))
    assert set(out.tolist()) <= {0.0, 1.0} and abs((out * sizes).sum() - (chance * sizes).sum()) <= 60
