from collections import Counter

import pytest

import corpus_pipeline as P
from tests.llm.test_mixing import targets
from tests.llm.test_near_dup import brute
from tests.llm.test_packing import check
from tidewell.llm.common import cut
from tidewell.llm.pii import proposals


def test_every_stage_on_its_own_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    data = {"in": docs.collect()}
    frames = {"in": docs}
    at = docs
    for name, stage in P.STAGES:
        at = cut(stage(spark, at, ""), name)
        frames[name], data[name] = at, at.collect()
        if name != "packing":
            assert at.columns == docs.columns
    told = {r.doc_id for r in data["language_id"]}
    assert len(told) >= 0.97 * len(data["in"])
    assert sorted(r.doc_id for r in data["near_duplicates"]) == [d for d, _, _, kept in brute([(r.doc_id, r.text) for r in data["language_id"]]) if kept]
    before = {r.doc_id: r for r in data["near_duplicates"]}
    assert sorted(before) == sorted(r.doc_id for r in data["personal_data"])
    for r in data["personal_data"]:
        assert not any(base for *_, base in proposals(r.text))
        if not any(base for *_, base in proposals(before[r.doc_id].text)):
            assert r.text == before[r.doc_id].text
    copies = Counter(r.doc_id for r in data["mixing"])
    assert max(copies.values()) <= 2
    sizes, taken = Counter(), Counter()
    for r in data["personal_data"]:
        n = len(r.text.encode().split())
        sizes[r.source] += n
        taken[r.source] += n * copies[r.doc_id]
    for s, t in targets(dict(sizes)).items():
        assert taken[s] == pytest.approx(t, rel=0.35)
    check(frames["mixing"], data["packing"], 2048)


def test_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidewell.llm.common.shared_dir", lambda _: str(tmp_path))
    assert P.run(spark, "/root/testdata/sf0.001").count() > 150
    left = sorted(p.name.rpartition("-")[0] for p in (tmp_path / "tidewell").iterdir())
    assert [n for n in left if not n.startswith("packing")] == sorted(f"pipeline-{n}" for n, _ in P.STAGES[:-1])


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from tidewell.llm.common import shared_dir

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077", None))
    assert shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y" and shared_dir(session("local[4]", None))


def test_awkward_rows(spark, awkward):
    at = awkward
    for _, stage in P.STAGES:
        at = cut(stage(spark, at, ""), "awkward")
    at.collect()
    at = awkward.limit(0)
    for _, stage in P.STAGES:
        at = cut(stage(spark, at, ""), "empty")
    assert at.count() == 0


def test_repeated_ids_leave_one_row(spark, make_docs):
    from tidewell.llm.near_dup import drop_near_duplicates

    docs = make_docs([(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (1, "h i j k l m", "en", "s", 11), (2, "h i j k l m", "en", "s", 11), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1)])
    assert sorted(str(r.doc_id) for r in drop_near_duplicates(docs).collect()) == ["1", "None", "None"]
