"""Operator 9: near-duplicates by bottom-k sketches.

One hash function maps every shingle to 64 bits; a document's sketch is the ``SKETCH`` smallest values of its set.
Documents of equal sets are one class, and only its first document goes on. Inverted lists of the ``KEYS`` smallest
values generate overlaps; of two sets with a Jaccard similarity of 0.85, a given retained value of one is in the other
with probability 0.92, so both share a list almost surely. A list that is too long to pair up (a passage of thousands
of documents) is left out for documents that have enough shorter lists. Documents that don't look deeper into their
sketch. The union-sketch estimate filters candidates, and exact Jaccard similarity on full sets verifies them: first
the best candidate of each document, then only candidates that would still join two components.

Documents whose values are nearly all common - large groups of near copies or long templates - are compared exactly:
of their sketch they keep so many of the rarest values that two linked ones have one in common. Every list of such a
value that still holds several components is cut into bands of size and blocks; large parts of a list that meet in
another one, the first of all their lists, are only compared with the rest. Each cell, a pair of blocks, counts the
common shingles of all its pairs of full sets at once and passes on a spanning forest of the links it finds.
"""

from __future__ import annotations

import hashlib
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, needs, utf8
from .components import connected_components
from .shingles import shingle_set

WIDTH = 5
SKETCH = 64
#: Values that make inverted lists at first; documents that lack short lists look at the whole sketch, in parts.
KEYS, SKETCH_PARTS = 12, 16
SIMILAR_PERCENT = 85
#: Share of retained values that a linked document may lack: up to 1 - J at the threshold, as for a part of a text.
LACKING = 1 - SIMILAR_PERCENT / 100
#: Longest list that is paired up by a join. Longer ones are compared in cells.
LONGEST_LIST = 32
#: Base of the bands of size: linked sets are in the same or in neighbouring ones, as it is over 1 / J.
BAND = 1.18
#: Documents and shingles in a block of a long list; lists up to WHOLE documents aren't cut into bands.
BLOCK, BLOCK_SHINGLES, WHOLE = 1024, 1 << 21, 128
#: Common shingles are counted one by one where few pairs have them, else by products of so many columns.
FEW_PAIRS, COLUMNS = 64, 2048
#: Candidates whose estimate is this many standard deviations below the threshold are dropped.
DEVIATIONS = 4.0
#: Bits of the filter that keeps the second pass over the texts to documents with candidates.
FILTER_BITS = 1 << 24


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, identity (digest of the set), sketch (its smallest values as ordered longs)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, identity, sketch = [], [], []
        for t in utf8(batch.column("text")):
            s = shingle_set(t, WIDTH)
            n.append(len(s))
            identity.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sketch.append((s[:SKETCH] ^ np.uint64(1 << 63)).view(np.int64))  # the order of unsigned values, as signed
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(identity, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "identity", "sketch"])

    return map_batches(needs(docs, "doc_id", "text"), run, "doc_id long, n_shingles long, identity binary, sketch array<long>")


def _may_lack(values: Column) -> Column:
    """So many of its values a linked document may lack, at four standard deviations."""
    return F.ceil(values * LACKING + DEVIATIONS * F.sqrt(values * (LACKING * (1 - LACKING))))


def _too_few_short(values: Column, common: Column) -> Column:
    """Whether a linked document might lack all of the values with short lists."""
    return values - common <= _may_lack(values)


def _long_enough(a: Column, b: Column) -> Column:
    """Sets of these sizes can be similar enough at all."""
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * SIMILAR_PERCENT)


def _pairs(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a value of ``entries`` (value, rep, n) and whose sizes allow a link."""
    other = entries.select("value", F.col("rep").alias("b"), F.col("n").alias("n_b"))
    return entries.join(other, "value").filter((F.col("rep") > F.col("b")) & _long_enough(F.col("n"), F.col("n_b"))).select(F.col("rep").alias("a"), "b").distinct()


def _with_length(entries: DataFrame, times: str = "1") -> DataFrame:
    """``entries`` (value, ...) with df: the length of the value's list, null where it is short enough to pair up."""
    long = cut(entries.groupBy("value").agg(F.sum(F.expr(times)).alias("df")).filter(F.col("df") > LONGEST_LIST), "lists-long")
    return entries.join(long, "value", "left")


def _parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches of ``docs`` (rep, n, sketch) in ``PARTS`` parts by the value: rep, n, part (its digest); and part,
    times, values of each different one. Near copies share most parts, so a large group of them has few."""
    number = lambda v: F.pmod(F.xxhash64(v), F.lit(SKETCH_PARTS))
    own = F.transform(F.sequence(F.lit(0), F.lit(SKETCH_PARTS - 1)), lambda k: F.filter("sketch", lambda v: number(v) == k))
    held = cut(docs.select("rep", "n", F.explode(F.filter(own, lambda p: F.size(p) > 0)).alias("values")).withColumn("part", F.md5(F.array_join("values", " "))), "sketch-parts")
    return held.select("rep", "n", "part"), cut(held.groupBy("part").agg(F.count("*").alias("times"), F.any_value("values").alias("values")), "sketch-parts-different")


def _cells(keys: DataFrame) -> DataFrame:
    """value, band, next, i, j, right, rep: the cells that each member of a list (rep, n, value, first) is in. Any two
    members whose sizes allow a link, and that don't have the same other first list, in which they meet as well, meet
    in one cell: two blocks of a band (i <= j), or one of a band and one of the next."""
    whole = keys.groupBy("value").agg((F.count("*") <= WHOLE).alias("small"), F.sum("n").alias("all_n"))
    band = F.when(F.col("small") & (F.col("all_n") <= BLOCK_SHINGLES), F.lit(-1)).otherwise(F.floor(F.log("n") / F.log(F.lit(BAND)))).cast("int")
    banded = keys.join(whole, "value").select("value", "rep", "n", band.alias("band"), F.when(F.col("first") != F.col("value"), F.col("first")).alias("first"))
    # many with one other first list keep to themselves: no cell of theirs holds two of them
    own = banded.filter("first is not null").groupBy("value", "band", "first").agg(F.count("*").alias("m")).filter(F.col("m") >= BLOCK // 2).select("value", "band", "first", F.col("first").alias("settled"))
    banded = banded.join(own, ["value", "band", "first"], "left").select("value", "band", "rep", "n", F.struct(F.col("settled").isNotNull().alias("yes"), F.coalesce("settled", F.lit(0)).alias("list")).alias("settled"))
    m = F.count("*")
    blocks = F.greatest(F.ceil(m / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    kinds = banded.groupBy("value", "band", "settled").agg(blocks.alias("own"))
    of_band = kinds.groupBy("value", "band").agg(F.sum("own").cast("int").alias("blocks"))
    beside = lambda name, step: of_band.select("value", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
    around = of_band.join(beside("above", 1), ["value", "band"], "left").join(beside("below", -1), ["value", "band"], "left").na.fill(0, ["above", "below"])
    upto_here = F.sum("own").over(Window.partitionBy("value", "band").orderBy("settled"))
    numbered = kinds.withColumn("low", (upto_here - F.col("own")).cast("int")).join(around, ["value", "band"])
    placed = banded.join(numbered, ["value", "band", "settled"]).withColumn("block", F.col("low") + F.pmod(F.xxhash64("rep"), F.col("own")).cast("int"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.col(n)), lambda k: k < F.col(n))
    cell = lambda band, next_, i, j, right: F.struct(band.alias("band"), F.lit(next_).alias("next"), i.alias("i"), j.alias("j"), right.alias("right"))
    at, here = F.col("block"), F.col("band")
    others = F.filter(upto("blocks"), lambda k: ~F.col("settled.yes") | (k < F.col("low")) | (k >= F.col("low") + F.col("own")))
    cells = F.concat(
        F.transform(others, lambda k: cell(here, False, F.least(at, k), F.greatest(at, k), k < at)),
        F.transform(upto("above"), lambda k: cell(here, True, at, k, F.lit(False))),
        F.transform(upto("below"), lambda k: cell(here - 1, True, k, at, F.lit(True))),
    )
    return placed.select("value", "rep", F.explode(cells).alias("c")).select("value", "c.*", "rep")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``left`` shares with each of ``right``."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    row_l, row_r = (np.repeat(np.arange(len(n)), n) for n in sizes)
    _, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    col_l, col_r = column[: len(row_l)], column[len(row_l) :]
    columns = int(column.max()) + 1
    in_l, in_r = np.bincount(col_l, minlength=columns), np.bincount(col_r, minlength=columns)
    few = in_l * in_r <= FEW_PAIRS
    out = np.zeros((len(left), len(right)))
    order = np.argsort(col_r, kind="stable")
    begin, rows = np.cumsum(in_r) - in_r, row_r[order]
    chosen = np.flatnonzero(few[col_l] & (in_r[col_l] > 0))
    for k in range(0, len(chosen), 1 << 17):  # at most FEW_PAIRS pairs each
        c = chosen[k : k + (1 << 17)]
        times = in_r[col_l[c]]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pair = np.repeat(row_l[c], times) * len(right) + rows[np.repeat(begin[col_l[c]], times) + nth]
        out += np.bincount(pair, minlength=out.size).reshape(out.shape)
    number = np.cumsum(~few) - 1  # the others, as columns of zeros and ones
    many_l, many_r = ~few[col_l], ~few[col_r]
    at_l, at_r, row_l, row_r = number[col_l[many_l]], number[col_r[many_r]], row_l[many_l], row_r[many_r]
    for k in range(0, int((~few).sum()), COLUMNS):
        x, y = (np.zeros((len(s), COLUMNS), np.float32) for s in (left, right))
        for dense, at, row in ((x, at_l, row_l), (y, at_r, row_r)):
            here = (at >= k) & (at < k + COLUMNS)
            dense[row[here], at[here] - k] = 1
        out += x @ y.T
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that tie together what the symmetric ``linked`` does."""
    left, edges = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        waiting = [start] if left[start] else []
        left[start] = False
        while waiting:
            x = waiting.pop()
            found = np.flatnonzero(linked[x] & left)
            left[found] = False
            edges += [(x, y) for y in found.tolist()]
            waiting += found.tolist()
    return edges


def _settled(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join all members of a list of ``keys`` (rep, n, value, first) whose full sets are similar enough."""

    def run(cell: pa.Table) -> pa.Table:
        ids, right = cell.column("rep").to_numpy(), cell.column("right").to_numpy()
        full = [np.frombuffer(x, np.uint64) for x in cell.column("shingles").to_pylist()]
        n = np.array([len(x) for x in full])
        sides = [np.arange(len(ids))] * 2 if cell.column("i")[0].equals(cell.column("j")[0]) and not cell.column("next")[0].as_py() else [np.flatnonzero(~right), np.flatnonzero(right)]
        edges = []
        if len(ids) > 1 and len(sides[0]) and len(sides[1]):
            l, r = sides
            common = _common([full[i] for i in l], [full[i] for i in r])
            linked = np.zeros((len(ids), len(ids)), bool)
            linked[np.ix_(l, r)] = (common > 0) & (100 * common >= SIMILAR_PERCENT * (n[l][:, None] + n[r][None, :] - common))
            edges = _forest(linked | linked.T)
        a, b = (ids[[e[k] for e in edges]] if edges else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _cells(keys).join(sets, "rep").groupBy("value", "band", "next", "i", "j").applyInArrow(run, "a long, b long").filter("a <> b").distinct()


def _open_lists(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """The entries of lists that hold several components; of lists with the same members one stays."""
    of = keys.join(nodes.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    members = [F.count("*").alias("m"), F.bit_xor(F.xxhash64("rep", "n")).alias("x"), F.bit_xor(F.xxhash64("n", "rep")).alias("y")]
    lists = of.groupBy("value").agg(*members, F.min(component).alias("low"), F.max(component).alias("high")).filter("low <> high")
    return keys.join(lists.groupBy("m", "x", "y").agg(F.min("value").alias("value")).select("value"), "value", "left_semi")


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b, estimate: the union sketch of two sketches is the smallest values of both; the share that both hold
    estimates the similarity. Sets no larger than the sketch are compared exactly."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, estimate = [], []
        lists = [batch.column(c) for c in ("sketch_a", "sketch_b")]
        (va, oa), (vb, ob) = ((x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()) for x in lists)
        for i in range(batch.num_rows):
            a, b = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
            union = np.union1d(a, b)
            if len(a) == SKETCH or len(b) == SKETCH:
                union = union[:SKETCH]
            common = np.intersect1d(a, b, assume_unique=True)
            k = len(union)
            e = np.searchsorted(common, union[-1], "right") / k
            t = SIMILAR_PERCENT / 100
            if e >= t - DEVIATIONS * sqrt(t * (1 - t) / k):
                keep.append(i)
                estimate.append(float(e))
        return pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64())), pa.array(estimate, pa.float64())], ["a", "b", "estimate"])

    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    joined = pairs.join(side("a"), "a").filter("a <> b").join(side("b"), "b").filter(_long_enough(F.col("n_a"), F.col("n_b")))
    return map_batches(joined.select("a", "b", "sketch_a", "sketch_b"), run, "a long, b long, estimate double")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, shingles (binary) of the documents in ``wanted`` (rep), in one pass over the texts. A filter of fixed size
    keeps most other documents out of the shuffle; the join is exact."""
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))
    parts = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits")).collect()
    bits = spark.sparkContext.broadcast({r["bucket"]: bytes(r["bits"]) for r in parts})  # FILTER_BITS / 8 bytes at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        maps = bits.value
        size = len(next(iter(maps.values()))) * 8 if maps else 1
        keep = []
        for i, b in enumerate(batch.column("bit").to_pylist()):
            held = maps.get(b // size + 1) if b is not None else None
            if held and held[(b % size) >> 3] >> (b % 8) & 1:
                keep.append(i)
        at = pa.array(keep, pa.int64())
        sets = [shingle_set(t, WIDTH).tobytes() for t in utf8(batch.column("text").take(at))]
        return pa.RecordBatch.from_arrays([batch.column("rep").take(at), pa.array(sets, pa.binary())], ["rep", "shingles"])

    keyed = docs.select(F.col("doc_id").alias("rep"), "text").filter("rep is not null").withColumn("bit", bit)
    return map_batches(keyed, run, "rep long, shingles binary").join(wanted, "rep", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough. Where an id stands for several texts, any two of them count."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common and 100 * common >= SIMILAR_PERCENT * (len(x) + len(y) - common):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    side = lambda c: sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"set_{c}"))
    return map_batches(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b"), run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Texts that are null or without words have 0 shingles and are linked with nothing; so are rows without an id, whose
    component_id is null. Rows that share an id share a component. Other columns are left out.
    """
    sketched = cut(sketches(docs), "sketches")
    usable = sketched.filter("n_shingles > 0 and doc_id is not null")
    # one document speaks for all of an equal set
    reps = cut(usable.groupBy("identity").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    shallow = cut(_with_length(reps.select("rep", "n", F.explode(F.slice("sketch", 1, KEYS)).alias("value"))), "lists")
    candidates = _pairs(shallow.filter("df is null"))
    # documents that lack short lists look at their whole sketch
    lacking = shallow.filter("df is not null").groupBy("rep", "n").agg(F.count("*").alias("common")).filter(_too_few_short(F.least(F.col("n"), F.lit(KEYS)), F.col("common")))
    of_doc, parts = _parts(reps.join(cut(lacking.select("rep"), "lists-lacking"), "rep", "left_semi"))
    deep = cut(_with_length(parts.select("part", "times", F.explode("values").alias("value")), "times"), "lists-deep")
    of_part = deep.groupBy("part").agg(
        F.collect_list(F.when(F.col("df").isNull(), F.col("value"))).alias("short"),
        F.collect_list(F.when(F.col("df").isNotNull(), F.struct(F.floor(F.log2("df")).alias("level"), F.xxhash64("value").alias("at"), "value"))).alias("lists"),
    )
    marked = cut(of_doc.join(of_part, "part"), "sketch-parts-marked")
    candidates = candidates.unionByName(_pairs(marked.select(F.explode("short").alias("value"), "rep", "n")))
    # those that lack short lists even so keep as many of their rarest long lists (by powers of two, so that near copies
    # agree on their first ones) as linked ones need to meet in one
    values = F.least(F.col("n"), F.lit(SKETCH))
    ranked = F.array_sort(F.flatten(F.collect_list("lists")))
    still = marked.groupBy("rep", "n").agg(ranked.alias("lists")).withColumn("common", F.size("lists")).filter(_too_few_short(values, F.col("common")))
    prefix = F.slice("lists", F.lit(1), (_may_lack(values) + 1 - (values - F.col("common"))).cast("int"))
    keys = cut(still.select("rep", "n", F.col("lists")[0]["value"].alias("first"), F.explode(prefix).alias("k")).select("rep", "n", "first", "k.value"), "lists-common")
    estimated = cut(_estimated(candidates.distinct(), reps), "estimates")
    wanted = estimated.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(keys.select("rep")).distinct()
    sets = cut(_sets_of(docs, cut(wanted, "wanted")), "sets")
    # first the best candidate of each document
    best = estimated.groupBy("a").agg(F.max_by("b", "estimate").alias("b")).unionByName(estimated.groupBy("b").agg(F.max_by("a", "estimate").alias("a")).select("a", "b")).distinct()
    # an id that stands for several texts ties their classes together
    several = usable.groupBy("doc_id").agg(F.min("identity").alias("low"), F.max("identity").alias("high")).filter("low <> high").select("doc_id")
    same_id = usable.join(several, "doc_id", "left_semi").join(reps.select("identity", "rep"), "identity").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    links = cut(_verified(best, sets).unionByName(same_id), "links")
    nodes = cut(connected_components(links), "components-now")
    label = lambda c: nodes.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    apart = F.coalesce("of_a", "a") != F.coalesce("of_b", "b")
    open_ = estimated.select("a", "b").join(best, ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left").filter(apart).select("a", "b")
    more = cut(_verified(open_, sets), "links-more")
    # long lists: at first each document in the first of its own, which ties most near copies, then all that hold several components
    for lists in (keys.filter("value = first"), keys):
        if not more.isEmpty():
            links = links.unionByName(more)
            nodes = cut(connected_components(links), "components-now")
        more = cut(_settled(cut(_open_lists(lists, nodes), "lists-open"), sets), "links-more")
    if not more.isEmpty():
        nodes = connected_components(links.unionByName(more))
    labels = reps.join(nodes.select(F.col("node").alias("rep"), "component"), "rep", "left").select("identity", F.coalesce("component", "rep").alias("component"))
    found = usable.select("doc_id", "identity").join(labels, "identity").groupBy("doc_id").agg(F.min("component").alias("component"))
    return (
        sketched.select("doc_id", "n_shingles")
        .join(found, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component (the one whose id is the smallest); rows without an id all stay. Of
    rows that repeat an id one stays, the least by its columns."""
    fate = cut(near_duplicates(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "kept")
    repeated = fate.filter("kept and n > 1").select("doc_id")
    gone = fate.filter("not kept or n > 1").select("doc_id")
    columns = docs.columns
    one = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("row")).select(*[F.col("row")[c].alias(c) for c in columns])
    return docs.join(gone, "doc_id", "left_anti").select(columns).unionByName(one)
