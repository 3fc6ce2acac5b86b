import random
import zlib
from collections import defaultdict
from math import ceil

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewell.llm.packing import _islands, _load, best_fit, pack

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(docs, rows, capacity):
    ids = [(r.doc_id, LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs.collect()]
    want = sorted(((d, k, k * capacity, len(x[k * capacity : (k + 1) * capacity]), zlib.crc32(np.array(x[k * capacity : (k + 1) * capacity], "<u4").tobytes())) for d, x in ids for k in range(ceil(len(x) / capacity))), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held), ceil(sum(len(x) for _, x in ids) / capacity)


@pytest.mark.parametrize("shard", [4096, 40])
def test_real_texts(spark, shard):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    used, least = check(docs, pack(docs, shard_pieces=shard).collect(), 2048)
    assert used <= least * 1.02 + 1


def test_awkward_rows(spark, awkward):
    check(awkward, pack(awkward, capacity=64, shard_pieces=3).collect(), 64)
    assert pack(awkward.limit(0)).collect() == []


def hard(kind, seed, bins=60, capacity=2048):
    """Sizes that best fit packs badly: three that fill a bin exactly, or thirds plus or minus a little."""
    r, out = random.Random(seed), []
    for _ in range(bins):
        if kind == "triplets":
            a = r.randint(int(0.38 * capacity), int(0.49 * capacity))
            b = r.randint(capacity // 4, (capacity - a) // 2)
            out += [a, b, capacity - a - b]
        else:
            out += [capacity // 3 + r.randint(-60, 60) for _ in range(3)]
    return out


@pytest.mark.parametrize("kind", ["triplets", "thirds"])
def test_islands_pack_what_best_fit_does_not(spark, kind):
    all_sizes = [hard(kind, seed) for seed in range(3)]
    shards = spark.createDataFrame([(i, bytearray(np.array(s, "<i4").tobytes())) for i, s in enumerate(all_sizes)], "shard long, sizes binary")
    for r in _islands(shards, 2048, 2, 2, 6, 20).collect():
        sizes, bins = all_sizes[r.shard], _load(bytes(r.elite))
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(0 < sum(sizes[i] for i in b) <= 2048 for b in bins)
        assert len(bins) + 2 <= len(best_fit(sizes, list(range(len(sizes))), [], 2048))


def test_repeated_rows_are_spread(spark, make_docs):
    """Thousands of equal rows, most without an id: no shard holds many of them."""
    docs = make_docs([(None if i % 3 else 5, "seven words that are all the same", "en", "s", 1) for i in range(6000)])
    rows = pack(docs, capacity=64, shard_pieces=200).collect()
    check(docs, rows, 64)
    shards = defaultdict(int)
    for r in rows:
        shards[(r.sequence_id >> 56, r.sequence_id >> 24 & 0xFFFFFFFF)] += 1
    assert max(n for (level, _), n in shards.items() if level == 1) < 400
