"""Operator 8: best-fit packing by a grouping genetic algorithm.

Documents become pieces of at most ``CAPACITY`` tokens. Whole pieces fill a sequence each. The rest are dealt by hash
to shards of about ``SHARD_PIECES``; for each shard several islands evolve populations of packings in parallel tasks.
Crossover injects whole well-filled bins of one parent into another, removes the bins that hold duplicates of what
came in, and best-fits the documents so displaced. Between epochs each island's elite migrates to the next island.
The sequences that shards leave badly filled are pooled over shards and packed once more.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, needs
from .wordbpe import encoder

CAPACITY = 2048
SHARD_PIECES = 2048
ISLANDS = 2
EPOCHS = 3
POPULATION = 8
GENERATIONS = 40
#: Populations that a task evolves.
TASK_POPULATIONS = 4
#: A shard's sequence filled less than this goes to the common pool.
CLOSED_SHARE = 0.97
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document (a null text is empty: one piece with the closing id 0)."""

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, piece, length, crc = [], [], [], []
        for i, ids in enumerate(encoder(vocabulary).encode(batch.column("text"))):
            ids += b"\0\0\0\0"
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                row.append(i)
                piece.append(k)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        piece = np.array(piece, dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row)), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return map_batches(needs(docs, "doc_id", "text"), split, PIECE)


# --- the genetic algorithm on one shard; a packing is a list of bins, a bin a list of item numbers


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Put items, largest first, where the least room stays free; open bins as needed. ``bins`` is extended."""
    room: dict[int, list[int]] = {}
    mask = 0
    for b, held in enumerate(bins):
        if free := capacity - sum(sizes[i] for i in held):
            room.setdefault(free, []).append(b)
            mask |= 1 << free
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        if fits := mask >> size:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if free := free - size:
            room.setdefault(free, []).append(b)
            mask |= 1 << free
    return bins


def pair_fit(sizes: list[int], items: list[int], capacity: int, rng: random.Random | None = None) -> list[list[int]]:
    """Bins one after another: the largest item left (or a random one), then again and again the item or the pair that
    leaves the least room free."""
    left = sorted(items, key=lambda i: (sizes[i], i))
    length = [sizes[i] for i in left]
    bins: list[list[int]] = []
    # the sizes left as bits, from below and from above: two that make up a sum are a bit of both, shifted by the sum
    below = above = 0
    for size in set(length):
        below |= 1 << size
        above |= 1 << (capacity - size)

    def take(at: int) -> int:
        nonlocal below, above
        size = length.pop(at)
        if not (at < len(length) and length[at] == size or at and length[at - 1] == size):
            below ^= 1 << size
            above ^= 1 << (capacity - size)
        return left.pop(at)

    def pair(free: int, least: int) -> tuple[int, ...]:
        """Places of two whose sizes come nearest to ``free`` from below and make up more than ``least``."""
        for both in range(free, max(least, length[0] + length[1] - 1), -1):
            if found := below & above >> (capacity - both):
                top = found.bit_length() - 1
                high, low = bisect_right(length, top) - 1, bisect_left(length, both - top)
                if low < high:
                    return high, low
        return ()

    while left:
        held = [take(rng.randrange(len(left)) if rng else len(left) - 1)]
        free = capacity - sizes[held[0]]
        while left and length[0] <= free:
            high = bisect_right(length, free) - 1
            best = length[high]
            for at in (pair(min(free, 2 * best), best) if high and best < free else ()) or (high,):
                free -= length[at]
                held.append(take(at))
        bins.append(held)
    return bins


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then Falkenauer's measure: uneven fill is better than even fill."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(sizes: list[int], donor: list[list[int]], receiver: list[list[int]], rng: random.Random, capacity: int) -> list[list[int]]:
    full = [b for b in donor if sum(sizes[i] for i in b) >= 0.98 * capacity] or donor
    injected = [list(b) for b in full if rng.random() < 0.3]
    taken = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in receiver:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    return refit(sizes, displaced, injected + kept, capacity, rng)


def refit(sizes: list[int], displaced: list[int], bins: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """Best fit of the displaced into ``bins``; what would open new ones is packed by pairs where that takes fewer."""
    kept = len(bins)
    bins = best_fit(sizes, displaced, bins, capacity)
    opened = [i for b in bins[kept:] for i in b]
    by_pairs = pair_fit(sizes, opened, capacity, rng if rng.random() < 0.5 else None)
    return bins[:kept] + by_pairs if len(by_pairs) <= len(bins) - kept else bins


def mutate(sizes: list[int], bins: list[list[int]], rng: random.Random, capacity: int) -> list[list[int]]:
    """Dissolve the worst-filled bins and a few others."""
    order = sorted(range(len(bins)), key=lambda b: sum(sizes[i] for i in bins[b]))
    gone = set(order[: 2 + len(bins) // 20]) | {rng.randrange(len(bins)) for _ in range(max(1, len(bins) // 20))}
    return refit(sizes, [i for b in gone for i in bins[b]], [list(b) for k, b in enumerate(bins) if k not in gone], capacity, rng)


def founders(sizes: list[int], rng: random.Random, capacity: int, count: int) -> list[list[list[int]]]:
    """Best fit of all; where that can be better, packings by pairs, and best fit of random halves one behind the other."""
    out = [best_fit(sizes, list(range(len(sizes))), [], capacity)]
    while len(out) < count and len(out[0]) > ceil(sum(sizes) / capacity):
        if len(out) % 2:
            out.append(pair_fit(sizes, list(range(len(sizes))), capacity, rng if len(out) > 1 else None))
            continue
        first = [i for i in range(len(sizes)) if rng.random() < 0.5]
        chosen = set(first)
        out.append(best_fit(sizes, [i for i in range(len(sizes)) if i not in chosen], best_fit(sizes, first, [], capacity), capacity))
    return out


def evolve(sizes: list[int], population: list[list[list[int]]], rng: random.Random, capacity: int, generations: int) -> list[list[list[int]]]:
    """Steady state: each child replaces the worst if it is better. Stops at the lower bound."""
    least = ceil(sum(sizes) / capacity)
    rated = lambda p: (fitness(sizes, p, capacity), p)
    ranked = sorted(map(rated, population), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if len(ranked[0][1]) <= least:
            break
        # tournaments of two; a parent alone is its own mate
        donor, receiver = (min(rng.sample(range(len(ranked)), 2)) if len(ranked) > 1 else 0 for _ in range(2))
        child = crossover(sizes, ranked[donor][1], ranked[receiver][1], rng, capacity)
        if donor == receiver or rng.random() < 0.6:
            child = mutate(sizes, child, rng, capacity)
        child = rated(child)
        if child[0] > ranked[-1][0]:
            ranked[-1] = child
            ranked.sort(key=lambda x: x[0], reverse=True)
    return [p for _, p in ranked]


def _dump(bins: list[list[int]], n: int) -> bytes:
    out = np.empty(n, dtype="<i4")
    for b, held in enumerate(bins):
        out[held] = b
    return out.tobytes()


def _load(data: bytes) -> list[list[int]]:
    of = np.frombuffer(data, "<i4")
    bins: list[list[int]] = [[] for _ in range(int(of.max()) + 1 if len(of) else 0)]
    for i, b in enumerate(of.tolist()):
        bins[b].append(i)
    return bins


# --- the algorithm over all shards


def _islands(shards: DataFrame, capacity: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """shard, elite: the best packing that any island found. ``shards``: shard, sizes (binary of int32)."""
    state = shards.select("shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "sizes", F.lit(None).cast("array<binary>").alias("bred"), F.lit(None).cast("binary").alias("immigrant"))

    def epoch(number: int):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            bred, elite, bins, shape = [], [], [], []
            for r in batch.to_pylist():
                rng = random.Random(f"{r['shard']} {r['island']} {number}")
                sizes = np.frombuffer(r["sizes"], "<i4").tolist()
                people = [_load(x) for x in r["bred"]] if r["bred"] else founders(sizes, rng, capacity, population)
                if r["immigrant"]:
                    people[-1] = _load(r["immigrant"])
                people = evolve(sizes, people, rng, capacity, generations)
                bred.append([_dump(p, len(sizes)) for p in people])
                elite.append(bred[-1][0])
                best = fitness(sizes, people[0], capacity)
                bins.append(-best[0])
                shape.append(best[1])
            return pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("island"), batch.column("sizes"), pa.array(bred, pa.list_(pa.binary())), pa.array(elite, pa.binary()), pa.array(bins, pa.int64()), pa.array(shape, pa.float64())],
                ["shard", "island", "sizes", "bred", "elite", "bins", "shape"],
            )

        return run

    tasks = max(1, ceil(shards.count() * islands / TASK_POPULATIONS))  # small rows of much work: not to be joined by size
    for number in range(epochs):
        state = cut(map_batches(state.repartition(tasks, "shard", "island"), epoch(number), "shard long, island int, sizes binary, bred array<binary>, elite binary, bins long, shape double"), "packing-epoch")
        if number + 1 < epochs:
            moved = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("immigrant"))
            state = state.select("shard", "island", "sizes", "bred").join(moved, ["shard", "island"])
    return state.groupBy("shard").agg(F.min(F.struct("bins", (-F.col("shape")).alias("shape"), "island", "elite")).alias("best")).select("shard", "best.elite")


def _gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
    return pd.DataFrame(
        {
            "shard": [key[0]],
            "sizes": [rows["length"].to_numpy("<i4").tobytes()],
            "items": [_table_bytes(rows)],
        }
    )


def _table_bytes(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].convert_dtypes(), preserve_index=False)
    with pa.BufferOutputStream() as sink:
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()


def _pack(pieces: DataFrame, shards: int, level: int, capacity: int, **how: int) -> DataFrame:
    """Pack pieces by shards; adds sequence_id, offset and filled (tokens in the sequence)."""
    by = F.pmod(F.xxhash64("nth", F.lit(level)), F.lit(shards))
    gathered = cut(pieces.withColumn("shard", by).groupBy("shard").applyInPandas(_gather, "shard long, sizes binary, items binary"), "packing-shards")
    best = _islands(gathered.select("shard", "sizes"), capacity, **how)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in batch.to_pylist():
            items = pa.ipc.open_stream(r["items"]).read_all()
            of = np.frombuffer(r["elite"], "<i4").astype(np.int64)
            sizes = np.frombuffer(r["sizes"], "<i4").astype(np.int64)
            order = np.argsort(of, kind="stable")
            ends = np.cumsum(sizes[order])
            first = np.concatenate([[True], np.diff(of[order]) > 0])
            begun = (ends - sizes[order])[first]
            group = np.cumsum(first) - 1
            offset, filled = np.empty(len(of), np.int64), np.bincount(of, sizes).astype(np.int64)
            offset[order] = ends - sizes[order] - begun[group]
            table = pa.table({name: items.column(name).cast(kind) for name, kind in (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))})
            table = table.append_column("sequence_id", pa.array((level << 56) + (r["shard"] << 24) + of)).append_column("offset", pa.array(offset)).append_column("filled", pa.array(filled[of]))
            out.append(table.combine_chunks())
        return pa.concat_tables(out).combine_chunks().to_batches()[0]

    return map_batches(gathered.join(best, "shard"), place, f"{PIECE}, sequence_id long, offset long, filled long")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, generations: int = GENERATIONS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` needs doc_id and text. Null and empty texts are one piece of the closing id. Repeated rows are packed
    each. An empty table gives no rows. Numbers of sequences differ between runs only where the input does.
    """
    how = {"islands": islands, "epochs": epochs, "population": population, "generations": generations}
    # pieces are dealt to shards by a number that is written once, so that repeated rows are spread as others are
    pieces = cut(pieces_of(docs, vocabulary, capacity).withColumn("nth", F.monotonically_increasing_id()), "packing-pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = pieces.filter(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity)
    shards = max(1, ceil(rest.count() / shard_pieces))
    packed = _pack(rest, shards, 1, capacity, **how)
    columns = [*names, "sequence_id", "offset"]
    if shards == 1:
        return whole.select(columns).unionByName(packed.select(columns))
    packed = cut(packed, "packing-first")
    closed = F.col("filled") >= F.lit(CLOSED_SHARE * capacity)
    pooled = packed.filter(~closed).select(*names, F.xxhash64("sequence_id", "offset").alias("nth"))
    again = _pack(pooled, max(1, ceil(pooled.count() / shard_pieces)), 2, capacity, **how)
    return whole.select(columns).unionByName(packed.filter(closed).select(columns)).unionByName(again.select(columns))
