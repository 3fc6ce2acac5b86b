import numpy as np

from tidewell.llm import attention
from tidewell.llm import lm_score as L
from tidewell.llm.wordbpe import encoder


def classes_of_text(text, group):
    ids = [np.frombuffer(encoder(None).library_ids([w])[0], "<u4") for w in L.words_of((text or "").encode())]
    return [int(group[2 * x + (k == len(i) - 1)]) for i in ids for k, x in enumerate(i.tolist())] + [int(group[L.END])]


def test_training_looks_at_every_symbol_of_every_text_once(spark, make_docs, monkeypatch):
    """Each symbol and each end is a target once, behind the symbols that are before it when it is scored."""
    monkeypatch.setattr(L, "RUN_BLOCKS", 3)
    texts = ["", None, "One word", "the cat sat on the mat; " * 40, "Élan   naïve 漢字 don't! " * 30, "x " * 15, "y " * 47]
    group = L.classes_of(np.random.default_rng(0).integers(0, 100, L.END + 1))[0]
    docs = make_docs([(i, t, "en", "s", 1) for i, t in enumerate(texts)]).coalesce(1)
    rows = L.training_runs(docs.select("text"), group, None).orderBy("nth").collect()
    want = [c for t in texts for c in classes_of_text(t, group)]
    inputs, target = L.blocks_of([bytes(r.run) for r in rows])
    assert target[target >= 0].tolist() == want and sum(r.targets for r in rows) == len(want)
    # scoring puts a text into blocks alike: the same inputs answer
    seen = []
    for t in texts:
        own = classes_of_text(t, group)
        padded = [attention.PAD] * (attention.BLOCK + 1) + own
        for i in range(len(own)):
            first = i // attention.BLOCK * attention.BLOCK
            seen.append(padded[first : i + attention.BLOCK + 1])
    block, place = np.nonzero(target >= 0)
    assert [inputs[b - 1 : b + 1].ravel()[: attention.BLOCK + i + 1].tolist() for b, i in zip(block.tolist(), place.tolist())] == seen
