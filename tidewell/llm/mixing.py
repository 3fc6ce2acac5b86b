"""Operator 3: mixing sources to target weights by cube-method balanced sampling.

Every source's share of the mix becomes an inclusion rate for its documents: whole copies for all, and a fractional
probability for one more. The cube method rounds the probabilities so that the totals of words and of documents stay
what they were: in the flight, three documents at a time move along the null vector of both constraints until one of
them is settled. Flights run in blocks of each source; the few documents that a block leaves open meet in blocks of
the next level, until one small landing problem for each source is solved by enumeration, and evened out by single documents.
"""

from __future__ import annotations

import random
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
BLOCK_DOCUMENTS = 4096
#: Open documents that a block leaves; 2 ** LANDING subsets are tried in the end.
LANDING = 10
MOST_TURNS = 64
EPSILON = 1e-9
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """has_source, source_key, source_size, documents, target; one row a source. ``sized``: has_source, source_key, size.

    Sources are ranked by code point, null last, in a range-partitioned sort; the level to which targets fill up is
    found from sums over the sources.
    """
    spark = sized.sparkSession
    sources = sized.groupBy("has_source", "source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    ranged = cut(sources.repartitionByRange(F.desc("has_source"), "source_key").withColumn("part", F.spark_partition_id()), "mix-sources")
    before, offsets = 0, []
    for r in ranged.groupBy("part").count().orderBy("part").collect():  # one row a partition
        offsets.append((r["part"], before))
        before += r["count"]
    if not offsets:
        return ranged.drop("part").withColumn("target", F.lit(0.0))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("has_source"), "source_key"))
    place = within + F.col("before") - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = cut(ranged.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part").withColumn("weight", weight), "mix-ranked")
    cap = F.col("source_size") * float(most)
    total = ranked.agg(F.sum("source_size")).first()[0]
    level = None
    while True:
        full = F.lit(False) if level is None else cap <= F.col("weight") * level
        r = ranked.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (share * total - r[0]) / r[1] if r[1] else level
        if level is not None and (not r[1] or new <= level * (1 + 1e-12)):
            break
        level = new
    return ranked.select("has_source", "source_key", "source_size", "documents", F.least(cap, F.col("weight") * level).alias("target"))


def flight(sizes: np.ndarray, chance: np.ndarray, rng: random.Random, leave: int) -> np.ndarray:
    """Move probabilities through the null space of (sizes, 1) until at most ``leave`` (2 at least) are fractional."""
    p, w = chance.tolist(), sizes.tolist()
    waiting = [i for i in range(len(p)) if EPSILON < p[i] < 1 - EPSILON]
    rng.shuffle(waiting)
    active: list[int] = []
    while len(active) + len(waiting) > max(2, leave):
        while len(active) < 3:
            active.append(waiting.pop())
        a, b, c = active
        v = (w[b] - w[c], w[c] - w[a], w[a] - w[b])
        if v == (0, 0, 0):
            v = (1, -1, 0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(active, v, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(active, v, strict=True) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(active, v, strict=True):
            p[i] += step * x
        settled = [i for i in active if not EPSILON < p[i] < 1 - EPSILON]
        for i in settled:
            p[i] = float(round(p[i]))
        active = [i for i in active if i not in settled]
    return np.array(p)


def landing(sizes: np.ndarray, chance: np.ndarray, owed: float) -> np.ndarray:
    """Settle the fractional documents by the subset whose words come nearest to what is owed, then whose number does.
    What a single large document leaves over is made up by turning settled ones, the best one at a time."""
    open_ = np.flatnonzero((chance > EPSILON) & (chance < 1 - EPSILON))
    if not len(open_):
        return chance
    choice = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words = np.abs(choice @ sizes[open_] - owed)
    number = np.abs(choice.sum(1) - chance[open_].sum())
    out = chance.copy()
    out[open_] = chosen = choice[np.lexsort((number, words))[0]]
    rest = owed - float(chosen @ sizes[open_])
    for _ in range(MOST_TURNS):
        change = np.where(out > 0.5, -sizes, sizes)
        best = int(np.argmin(np.abs(rest - change)))
        if abs(rest - change[best]) >= abs(rest):
            break
        out[best], rest = 1 - out[best], rest - change[best]
    return out


def _round_probabilities(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (has_source, source_key, target, documents, size, copies, chance, key...) with chance 0 or 1."""
    columns, schema = rows.columns, rows.schema

    def settle_at(level: int, last: bool):
        def settle(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["key", "size", "chance"], kind="stable").reset_index(drop=True)
            sizes, chance = group["size"].to_numpy(), group["chance"].to_numpy()
            rounded = flight(sizes, chance, random.Random(f"{level} {key}"), LANDING)
            if last:
                still = (rounded > EPSILON) & (rounded < 1 - EPSILON)
                rounded = landing(sizes, rounded, float((chance * sizes).sum() - (rounded * sizes)[~still].sum()))
            group["chance"] = rounded
            return group[columns]

        return settle

    # a block leaves LANDING documents, so a block of the next level can stand for this many
    merged, level, settled = BLOCK_DOCUMENTS // (4 * LANDING), 0, []
    while True:
        last = ceil(blocks / merged**level) <= 1
        number = F.ceil(F.col("documents") / (BLOCK_DOCUMENTS * merged**level)).cast("long")
        block = F.pmod(F.xxhash64("key", F.lit(level)), number)
        out = cut(rows.groupBy("has_source", "source_key", block.alias("block")).applyInPandas(settle_at(level, last), schema), "mix-level")
        fractional = (F.col("chance") > EPSILON) & (F.col("chance") < 1 - EPSILON)
        settled.append(out if last else out.filter(~fractional))
        if last:
            break
        rows, level = out.filter(fractional), level + 1
    result = settled[0]
    for x in settled[1:]:
        result = result.unionByName(x)
    return result


def sizes_of(docs: DataFrame, *kept: str) -> DataFrame:
    """has_source, source_key, size (words; null text: 0) and the kept columns."""
    return docs.select(
        *kept,
        F.col("source").isNotNull().alias("has_source"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
    )


def copies_of(sized: DataFrame) -> DataFrame:
    """``sized`` (has_source, source_key, size, key, others) with source_size, target and copies of each row."""
    targets = cut(source_targets(sized), "mix-targets")
    blocks = targets.agg(F.max(F.ceil(F.col("documents") / BLOCK_DOCUMENTS))).first()[0] or 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(targets, ["has_source", "source_key"]).withColumn("rate", F.least(rate, F.lit(float(MOST_COPIES)))).withColumn("copies", F.floor("rate")).withColumn("chance", F.col("rate") - F.col("copies")).drop("rate")
    rounded = _round_probabilities(rows, int(blocks))
    return rounded.withColumn("copies", (F.col("copies") + F.col("chance")).cast("long")).drop("chance", "documents")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of ``docs`` (doc_id, text, source).

    Null texts have size 0 and take 0; a null source is a source, ranked last. Repeated rows are taken each. If all
    sizes are 0 all targets are. An empty table gives no rows. Other columns are left out.
    """
    # rows are dealt to blocks by a number that is written once, so that repeated rows are spread as others are
    sized = cut(sizes_of(docs, "doc_id").withColumn("key", F.xxhash64(F.monotonically_increasing_id())), "mix-sizes")
    return copies_of(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken. Rows equal in id, source and text are one item.
    Other columns stay as they are, whatever their names."""
    columns = docs.columns
    identity = F.xxhash64("doc_id", "text")
    one = sizes_of(docs.select("doc_id", "text", "source", identity.alias("mix_identity")), "doc_id", "mix_identity")
    items = cut(one.groupBy("has_source", "source_key", "doc_id", "mix_identity").agg(F.sum("size").alias("size")).withColumn("key", F.col("mix_identity")), "mix-items")
    copies = copies_of(items).filter("copies > 0").select(F.struct("has_source", "source_key", F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "mix_identity").alias("item"), F.col("copies").cast("int").alias("times"))
    item = F.struct(F.col("source").isNotNull().alias("has_source"), F.coalesce("source", F.lit("")).alias("source_key"), F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), identity.alias("mix_identity"))
    rows = docs.select(F.struct(*columns).alias("row"), item.alias("item"))
    return rows.join(copies, "item").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))).select([F.col("row")[c].alias(c) for c in columns])
