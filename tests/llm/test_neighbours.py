import numpy as np

from tidewell.llm.neighbours import cells_of, chi_squared_at, chi_squared_below, fit_cells, nearest_neighbours, search_block, unit_rows


def brute(rows, step=50, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % step == 0:
            near = sorted((-float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), i) for i, b in good if i != q and len(b) == len(a))
            out[q] = [(i, -c) for c, i in near[:k]]
    return out


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q, near in want.items():
        mine = sorted(got.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(near)
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(mine, mine[1:]))
        ids = {i for i, _ in near}
        hits += sum(r.vec_id in ids for r in mine)
        total += len(near)
    assert set(got) == {q for q, n in want.items() if n}
    return hits / total


def test_distribution_function():
    assert abs(chi_squared_below(15.507, 8) - 0.95) < 1e-4 and chi_squared_below(0.0, 8) == 0 and abs(chi_squared_at(0.95, 8) - 15.507) < 1e-3


def test_recall_on_real_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(rows)
    got = nearest_neighbours(table).collect()
    assert recall(got, want) >= 0.93
    exact = dict(((q, i), c) for q, near in want.items() for i, c in near)
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12 for r in got if (r.query_id, r.vec_id) in exact)


def test_the_stopping_test_leaves_vectors_out():
    r = np.random.default_rng(0)
    centres = r.standard_normal((40, 32))
    x = np.repeat(centres, 50, 0) + 0.1 * r.standard_normal((2000, 32))
    found, verified = search_block(x, [[i] for i in range(2000)], x[:20], np.arange(20))
    want = brute([(i, v) for i, v in enumerate(x)], step=1)
    assert sum(i in {j for j, _ in want[q]} for q, i, _ in found) / 100 >= 0.93
    assert verified < 0.2 * 20 * 2000


def test_recall_and_share_verified_on_a_whole_block():
    """Vectors without clusters, the hardest case: what the test leaves out costs no more recall than it may."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/check_s/embeddings.parquet")
    x = np.array(table.column("embedding").to_pylist(), float)
    x = np.concatenate([x, x[:, ::-1] * np.where(np.arange(x.shape[1]) % 2, 1, -1)])[:16384]
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 100)
    found, verified = search_block(x, [[i] for i in ids.tolist()], x[asked], asked)
    unit = unit_rows(x)
    cosine = unit[asked] @ unit.T
    cosine[np.arange(len(asked)), asked] = -2
    want = np.argsort(-cosine, 1)[:, :5]
    got = {(q, i) for q, i, _ in found}
    assert sum((int(q), int(i)) in got for q, near in zip(asked, want) for i in near) / want.size >= 0.9
    assert verified < 0.65 * len(asked) * len(x)


def test_several_cells_are_routed(spark):
    """Clusters in many cells and blocks: a query that goes to few of them finds what a search of all does."""
    r = np.random.default_rng(4)
    centres = r.standard_normal((30, 24))
    rows = [(i, [float(v) for v in centres[i % 30] + 0.15 * r.standard_normal(24)]) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(nearest_neighbours(table, block_points=150).collect(), brute(rows)) >= 0.9


def test_cells_are_even_and_whole():
    points = np.random.default_rng(1).standard_normal((5000, 16))
    cell = cells_of(fit_cells(points, 7), points)
    assert set(cell.tolist()) == set(range(7)) and np.bincount(cell).max() < 1.3 * 5000 / 7
    same = np.ones((50, 16))
    assert cells_of(fit_cells(same, 4), same).tolist() == [0] * 50


def test_copies_and_awkward_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(i, one) for i in range(40)] + [(50, one), (100, [2.0, 4.0, 6.0]), (150, None), (200, [0.0, 0.0, 0.0]), (250, [1.0, None, 2.0]), (300, [float("nan"), 1.0, 1.0]), (350, [float("inf"), 1.0, 1.0]), (400, [1.0, 2.0]), (450, []), (None, one), (7, one), (500, [-1.0, 0.0, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest_neighbours(table).collect()
    want = brute(rows[:-2] + rows[-1:])
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in want if want[q]} == {q: [i for i, _ in n] for q, n in want.items() if n}
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 50] == [0, 1, 2, 3, 4]
    assert nearest_neighbours(table.limit(0)).collect() == []
