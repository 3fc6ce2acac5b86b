"""Operator 1: approximate nearest neighbours by stable projections.

Unit vectors are projected onto a few Gaussian directions; Gaussians are 2-stable, so the squared distance of two
projections over that of the vectors is chi-squared distributed. The projections are indexed by a kd-tree. Its upper
part, fitted on a bounded sample, deals all vectors to cells; its lower part is built over each block of a cell. A
query meets the projected neighbours in order of their distance and verifies each by its true cosine, until the
chi-squared test holds: a vector as near as the worst of the best found would, with the probability asked for, have
had a smaller projected distance than any vector left.

A query first asks the cell that it would be in. With what it finds there it goes on to those other cells only whose
box of projections the test doesn't rule out. Equal vectors are one point that keeps as many of their smallest ids as a
result can need.
"""

from __future__ import annotations

import math
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches

NEAREST = 5
QUERY_STEP = 50
DIRECTIONS = 16
LEAF = 64
CONFIDENCE = 0.91
#: Points of a block, most cells of the upper tree, points of the sample that it is fitted on (expected number).
BLOCK_POINTS, MOST_CELLS, SAMPLE_POINTS = 16384, 4096, 1 << 16
#: Queries that meet a block at once; shares of the limit up to which neighbours are verified in turn.
BLOCK_QUERIES = 2048
RINGS = (0.3, 0.5, 0.7, 0.85, 1.0)
SPREAD = 64
SEED = 20240817


def usable(vector: Column) -> Column:
    """Not null, not zero, every component present and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def chi_squared_below(x: np.ndarray | float, m: int = DIRECTIONS) -> np.ndarray | float:
    """The chi-squared distribution function for an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for j in range(1, m // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


def chi_squared_at(share: float, m: int = DIRECTIONS) -> float:
    """Its quantile, by bisection."""
    low, high = 0.0, 100.0 * m
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared_below(middle, m) < share else (low, middle)
    return high


def directions(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, DIRECTIONS))


def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points by leaf, leaf bounds in that order, and the leaves' boxes (low, high): a kd-tree split at
    medians of the widest side."""
    order, bounds, low, high = np.arange(len(points)), [0], [], []
    stack = [(0, len(points))]
    while stack:
        a, b = stack.pop()
        own = points[order[a:b]]
        lo, hi = own.min(0), own.max(0)
        if b - a <= LEAF:
            bounds.append(b)
            low.append(lo)
            high.append(hi)
            continue
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, int((hi - lo).argmax())], middle)]
        stack += [(a + middle, b), (a, a + middle)]  # the left half first, so leaves come in order
    return order, np.array(bounds), np.array(low), np.array(high)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.abs(vectors).max(1, keepdims=True)
    return unit / np.sqrt((unit * unit).sum(1, keepdims=True))


def search_block(vectors: np.ndarray, ids: list[list[int]], queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray | None = None, nearest: int = NEAREST, confidence: float = CONFIDENCE) -> tuple[list[tuple[int, int, float]], int]:
    """(query id, vector id, cosine): the best found of each query, without itself; and how many vectors were verified.
    ``bounds``: cosines that as many as asked for are known to reach (-2 where there are none yet)."""
    unit, asked = unit_rows(vectors), unit_rows(queries)
    axes, factor = directions(vectors.shape[1]), chi_squared_at(confidence)
    points = unit @ axes
    order, ends, low, high = build_tree(points)
    unit, points, ids = unit[order], points[order], [ids[i] for i in order]
    lead = np.array([x[0] for x in ids])
    square, leaf = (points * points).sum(1), np.repeat(np.arange(len(low)), np.diff(ends))
    out: list[tuple[int, int, float]] = []
    verified = 0
    for q, me, at, bound in zip(asked, query_ids.tolist(), asked @ axes, [-2.0] * len(asked) if bounds is None else bounds.tolist(), strict=True):
        gap = np.maximum(np.maximum(low - at, at - high), 0.0)
        reach = (gap * gap).sum(1)
        best: list[tuple[float, int]] = []

        def verify(rows: np.ndarray, q: np.ndarray = q, me: int = me) -> None:
            nonlocal best, verified
            verified += len(rows)
            cosine = unit[rows] @ q
            if len(rows) > 2 * nearest + 2:  # a point's smallest id decides ties, and a query's own point may give no other
                least = np.partition(cosine, len(cosine) - nearest - 1)[len(cosine) - nearest - 1]
                kept = np.flatnonzero(cosine >= least)
                if len(kept) > 8 * nearest:
                    kept = kept[np.lexsort((lead[rows[kept]], -cosine[kept]))[: 8 * nearest]]
                rows, cosine = rows[kept], cosine[kept]
            best = sorted(best + [(-float(c), i) for r, c in zip(rows.tolist(), cosine.tolist(), strict=True) for i in ids[r] if i != me])[:nearest]

        def limit(bound: float = bound) -> float:
            """The projected distance, squared, from which the test holds."""
            worst = max(-best[nearest - 1][0] if len(best) >= nearest else -2.0, bound)
            return math.inf if worst < -1 else factor * max(2 - 2 * worst, 0.0) + 1e-12

        opened = np.zeros(len(reach), bool)
        if limit() == math.inf:  # nothing known yet: the nearest leaves
            first = np.argsort(reach, kind="stable")[:2]
            verify(np.concatenate([np.arange(ends[x], ends[x + 1]) for x in first]))
            opened[first] = True
        while len(leaves := np.flatnonzero((reach <= limit()) & ~opened)):
            fresh = np.zeros(len(reach), bool)
            fresh[leaves] = opened[leaves] = True
            if len(leaves) * 4 > len(reach):
                rows = np.flatnonzero(fresh[leaf])
                apart = (square - 2 * (points @ at))[rows] + at @ at
            else:
                rows = np.concatenate([np.arange(ends[x], ends[x + 1]) for x in leaves])
                apart = square[rows] - 2 * (points[rows] @ at) + at @ at
            waiting = apart <= limit()
            rows, apart = rows[waiting], apart[waiting]
            for ring in RINGS:  # each ring shrinks the limit of the next
                near = apart <= ring * limit()
                if near.any():
                    verify(rows[near])
                    rows, apart = rows[~near], apart[~near]
        out += [(me, i, min(1.0, max(-1.0, -c))) for c, i in best]
    return out, verified


# --- the upper tree


def fit_cells(sample: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, threshold, left, right) of a tree that splits the sample's widest sides at medians; a child below
    0 is cell -1 - child. Cells are as even as the sample tells."""
    nodes: list[tuple[int, float, int, int]] = []
    made = 0

    def grow(rows: np.ndarray, n: int) -> int:
        nonlocal made
        own = sample[rows]
        width = own.max(0) - own.min(0) if len(rows) else np.zeros(1)
        if n <= 1 or len(rows) < 2 or not width.any():
            made += 1
            return -made
        axis, left = int(width.argmax()), n // 2
        threshold = float(np.quantile(own[:, axis], left / n))
        at, below = len(nodes), own[:, axis] < threshold
        nodes.append((axis, threshold, 0, 0))
        a, b = grow(rows[below], left), grow(rows[~below], n - left)
        nodes[at] = (axis, threshold, a, b)
        return at

    grow(np.arange(len(sample)), cells)
    return nodes


def cells_of(nodes: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    out = np.zeros(len(points), np.int64)
    waiting = [(0, np.arange(len(points)))] if nodes else []
    while waiting:
        at, rows = waiting.pop()
        axis, threshold, left, right = nodes[at]
        below = points[rows, axis] < threshold
        for child, part in ((left, rows[below]), (right, rows[~below])):
            if child < 0:
                out[part] = -1 - child
            elif len(part):
                waiting.append((child, part))
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in chunks]).reshape(-1, dims)


def _with_cell(rows: DataFrame, trees: dict[int, list]) -> DataFrame:
    """``rows`` with the cell of their vector, by the tree for its length; lengths without one are one cell."""
    sent = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell = np.zeros(batch.num_rows, np.int64)
        dims = batch.column("dims").to_numpy()
        for size, nodes in sent.value.items():
            here = np.flatnonzero(dims == size)
            if len(here) and nodes:
                cell[here] = cells_of(nodes, unit_rows(_matrix(batch.column("vector").take(pa.array(here)), size)) @ directions(size))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names], pa.array(cell)], [*batch.schema.names, "cell"])

    return map_batches(rows, run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", cell long", rows=4096)


def _gathered(rows: DataFrame) -> DataFrame:
    """One row for each (dims, cell, part): vectors as float64 bytes, their ids, the box of their projections."""

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        values = _matrix(table.column("vector"), key[0].as_py())
        points = unit_rows(values) @ directions(key[0].as_py())
        ids = table.column("ids").to_pylist()
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))
        one = (key[0].as_py(), key[1].as_py(), key[2].as_py(), values.astype("<f8").tobytes(), [i for x in ids for i in x], [len(x) for x in ids], points.min(0).tolist(), points.max(0).tolist())
        return pa.table({n: pa.array([x], k) for n, x, k in zip(("dims", "cell", "part", "vectors", "ids", "lengths", "low", "high"), one, kinds, strict=True)})

    return rows.groupBy("dims", "cell", "part").applyInArrow(gather, "dims int, cell long, part long, vectors binary, ids array<long>, lengths array<int>, low array<double>, high array<double>")


def _searched(index: DataFrame, asked: DataFrame, nearest: int, confidence: float) -> DataFrame:
    """query_id, vec_id, score: the best of each block that a query (query_id, vector, bound) is sent to (dims, cell)."""

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        values = _matrix(table.column("vector"), key[0].as_py())
        one = (key[0].as_py(), key[1].as_py(), values.astype("<f8").tobytes(), table.column("query_id").to_pylist(), table.column("bound").to_pylist())
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()))
        return pa.table({n: pa.array([x], k) for n, x, k in zip(("dims", "cell", "query_vectors", "query_ids", "bounds"), one, kinds, strict=True)})

    groups = asked.groupBy("dims", "cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("groups"))
    dealt = asked.join(groups, ["dims", "cell"]).withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")))
    queries = dealt.groupBy("dims", "cell", "group").applyInArrow(gather, "dims int, cell long, query_vectors binary, query_ids array<long>, bounds array<double>")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[tuple[int, int, float]] = []
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            own = np.frombuffer(r["vectors"], "<f8").reshape(-1, r["dims"])
            ends = np.cumsum(r["lengths"]).tolist()
            ids = [r["ids"][b - n : b] for b, n in zip(ends, r["lengths"], strict=True)]
            found += search_block(own, ids, np.frombuffer(r["query_vectors"], "<f8").reshape(-1, r["dims"]), np.array(r["query_ids"]), np.array(r["bounds"]), nearest, confidence)[0]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["query_id", "vec_id", "score"])

    pairs = index.select("dims", "cell", "vectors", "ids", "lengths").join(queries, ["dims", "cell"])
    return map_batches(pairs, run, "query_id long, vec_id long, score double", rows=1)


def nearest_neighbours(vectors: DataFrame, query_step: int = QUERY_STEP, nearest: int = NEAREST, confidence: float = CONFIDENCE, block_points: int = BLOCK_POINTS) -> DataFrame:
    """query_id, rank, vec_id, score: for every usable row of ``vectors`` (vec_id, embedding) whose id is divisible by
    ``query_step``, its nearest others by cosine, ties to the smaller id; fewer if there are fewer.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id; only
    vectors of one length are compared. A repeated row is one candidate. Other columns are left out.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("dims", F.size("vector"))
    kept = nearest + 1
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD))
    first = rows.dropDuplicates(["vec_id", "vector"]).withColumn("salt", salt).withColumn("n", F.row_number().over(Window.partitionBy("vector", "salt").orderBy("vec_id"))).filter(F.col("n") <= kept)
    second = first.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("n") <= kept)
    points = cut(second.groupBy("vector", "dims").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "points")
    sizes = {r["dims"]: r["n"] for r in points.groupBy("dims").agg(F.count("*").alias("n")).filter(F.col("n") > block_points).collect()}  # lengths that need a tree
    drawn = F.pmod(F.xxhash64("vector", F.lit(SEED)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE_POINTS / max(1, sum(sizes.values())))))
    sample: dict[int, list] = {}
    for r in points.filter(F.col("dims").isin(list(sizes)) & drawn).select("dims", "vector").collect():  # SAMPLE_POINTS or so
        sample.setdefault(r["dims"], []).append(r["vector"])
    trees = {d: fit_cells(unit_rows(np.array(v)) @ directions(d), min(MOST_CELLS, ceil(sizes[d] / block_points))) for d, v in sample.items()}
    placed = cut(_with_cell(points, trees), "points-placed")
    parts = placed.groupBy("dims", "cell").agg(F.ceil(F.count("*") / block_points).alias("parts"))
    index = cut(_gathered(placed.join(parts, ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts"))).select("vector", "dims", "ids", "cell", "part")), "index")
    asked = rows.filter(F.col("vec_id") % query_step == 0).dropDuplicates(["vec_id", "vector"]).select(F.col("vec_id").alias("query_id"), "vector", "dims")
    asked = cut(_with_cell(asked, trees), "queries")
    home = cut(_searched(index, asked.withColumn("bound", F.lit(-2.0)), nearest, confidence), "found-home")
    if not trees:
        return _best(home, nearest)
    ends = [f(F.col(side)[i]).alias(f"{side}{i}") for side, f in (("low", F.min), ("high", F.max)) for i in range(DIRECTIONS)]
    boxes = index.filter(F.col("dims").isin(list(trees))).groupBy("dims", "cell").agg(*ends).collect()  # MOST_CELLS at most a length
    sent = vectors.sparkSession.sparkContext.broadcast({d: tuple(np.array([[r[f"{side}{i}"] for i in range(DIRECTIONS)] for r in boxes if r["dims"] == d]) for side in ("low", "high")) + (np.array([r["cell"] for r in boxes if r["dims"] == d]),) for d in trees})
    known = home.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    bound = F.when(F.size("scores") >= nearest, F.col("scores")[nearest - 1]).otherwise(F.lit(-2.0))

    def admitted(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The other cells of each query that the test doesn't rule out."""
        factor, dims, out = chi_squared_at(confidence), batch.column("dims").to_numpy(), [[] for _ in range(batch.num_rows)]
        worst, own = batch.column("bound").to_numpy(), batch.column("cell").to_numpy()
        for d, (low, high, cells) in sent.value.items():
            for i in np.flatnonzero(dims == d).tolist():
                at = (unit_rows(np.array(batch.column("vector")[i].as_py())[None, :]) @ directions(d))[0]
                gap = np.maximum(np.maximum(low - at, at - high), 0.0)
                limit = math.inf if worst[i] < -1 else factor * max(2 - 2 * worst[i], 0.0) + 1e-12
                out[i] = cells[((gap * gap).sum(1) <= limit) & (cells != own[i])].tolist()
        return pa.RecordBatch.from_arrays([batch.column(c) for c in ("query_id", "vector", "dims", "bound")] + [pa.array(out, pa.list_(pa.int64()))], ["query_id", "vector", "dims", "bound", "cells"])

    waiting = asked.join(known, "query_id", "left").withColumn("bound", F.coalesce(bound, F.lit(-2.0))).select("query_id", "vector", "dims", "cell", "bound")
    onward = map_batches(waiting, admitted, "query_id long, vector array<double>, dims int, bound double, cells array<long>").withColumn("cell", F.explode("cells")).drop("cells")
    return _best(home.unionByName(_searched(index, onward, nearest, confidence)), nearest)


def _best(found: DataFrame, nearest: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
