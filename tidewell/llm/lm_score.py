"""Operator 7: language-model scores.

Counts of all training words are gathered first. Each distinct word is encoded once into subword symbols (an id of the
word-level BPE, and whether it ends its word); from the words' counts come the base score, the counts of all symbols
and, by class, of all transitions between symbols. The commonest symbols are classes of their own, the others share
classes by frequency. A causal self-attention model predicts the class of the next symbol from the transitions and
from 16 to 31 symbols before it; within its class a symbol has its share of the counts. It is trained on every symbol of
every training text once, in the same overlapping windows in which texts are scored: runs of windows are dealt to groups
and rounds; the groups of a round take Adam steps on their own from the weights of the round before, and theirs are
averaged. Texts are scored in overlapping windows, each symbol once.

A token's probability is a mixture that sums to 1 at most over all words and the end of the text: of the product of its
symbols' probabilities, its share of the training counts (0 for an unknown word), and its share of the text so far.
Different words have different symbols, but for words that the tokenizer normalises; those are spelled byte by byte
behind an escape of probability ``ESCAPE`` instead.

Counts and symbols of common words (at most ``TOP_WORDS``) travel to every worker. Each text is written once as numbers
of common words and symbols of its others, from which it is trained on and scored; the others' counts are joined.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from math import ceil, log, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention as model
from .common import ARROW_ROWS, byte_strings, coded_words, cut, gathered, give_back, held_out, keep_memory, kept_by_worker, map_batches
from .wordbpe import encoder

FOLDS = 5
TOP_WORDS = 1 << 18
TOP_WORD_BYTES = 64
#: Words that a task counts before it passes the counts on.
FLUSH_WORDS = 400_000
#: Symbols: id * 2, + 1 at the end of a word; the one behind all others ends a text.
IDS = 49408
END = 2 * IDS
END_CLASS = model.CLASSES - 1
SINGLE_CLASSES = model.CLASSES - 17
#: A text's blocks go to training in runs of so many; a group of about so many blocks trains by itself, in steps.
RUN_BLOCKS = 64
GROUP_BLOCKS = 65536
STEP_BLOCKS = 256
#: Learning rates of the rounds; each has its own share of the runs.
RATES = (0.01, 0.004)
#: Weights are summed as whole numbers of this share, so that their order doesn't matter.
WHOLE = 1 << 24
#: Weights in a word's probability: of the model, of the training counts, of the text so far.
MODEL, REMEMBERED, REPEATED = 0.5, 0.35, 0.15
#: Probability of a word that is spelled in bytes, and natural log of a byte or the end of the spelling.
ESCAPE, BYTE = 1e-4, -log(257)
SCORE_WINDOWS = 256
#: Words of ASCII signs and Latin-1 letters: in normal form and without white space, so that normalising only lowers them.
SIMPLE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # both know ASCII only, as the contract's words do


def count_words(training: DataFrame) -> DataFrame:
    """word, c over all texts of ``training`` (text); partial counts leave a task when there are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["word", "c"])
            counts.clear()
            return b

        keep_memory()
        for batch in batches:
            for at in range(0, batch.num_rows, ARROW_ROWS):
                distinct, which, _ = coded_words(pc.ascii_lower(batch.column("text").slice(at, ARROW_ROWS)))
                for word, n in zip(byte_strings(distinct), np.bincount(which, minlength=len(distinct)).tolist(), strict=True):
                    counts[word] += n
                if len(counts) > FLUSH_WORDS:
                    yield out()
        if counts:
            yield out()
        give_back()

    return training.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def is_plain(word: bytes, ids: bytes, vocabulary: str | None) -> bool:
    """Whether the word's symbols spell it and no other word."""
    if not ids:
        return False
    if word.isascii():
        return True
    s = word.decode("utf-8", "replace")
    if SIMPLE.fullmatch(s):
        return s == s.lower()
    return not any(map(str.isspace, s)) and unicodedata.is_normalized("NFC", s) and encoder(vocabulary).library.normalizer.normalize_str(s) == s and s.encode() == word


def encoded(words: DataFrame, vocabulary: str | None) -> DataFrame:
    """word, c, ids (little-endian unsigned 32-bit), plain: every distinct word encoded once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column("word").cast(pa.binary()).to_pylist()
        ids = encoder(vocabulary).ids_of(own)
        return pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(ids, pa.binary()), pa.array([is_plain(w, x, vocabulary) for w, x in zip(own, ids, strict=True)], pa.bool_())], ["word", "c", "ids", "plain"])

    return map_batches(words, run, "word string, c long, ids binary, plain boolean", rows=8192)


def to_symbols(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of words one after another, and how many each word has (a word without ids has none)."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
    symbols = np.frombuffer(b"".join(parts), "<u4").astype(np.int64) * 2
    ends = np.cumsum(sizes)[sizes > 0] - 1
    symbols[ends] += 1
    return symbols, sizes


def _summed(words: DataFrame, size: int, counts) -> np.ndarray:
    """The sum of ``counts`` (an array of ``size`` for symbols, sizes and word counts) over all plain words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += counts(*to_symbols(batch.column("ids").to_pylist()), batch.column("c").to_numpy())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["at", "n"])

    out = np.zeros(size, np.int64)
    for r in words.filter("plain").select("ids", "c").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most ``size``
        out[r["at"]] = r["n"]
    return out


def symbol_counts(words: DataFrame) -> np.ndarray:
    return _summed(words, END + 1, lambda symbols, sizes, c: np.bincount(symbols, np.repeat(c, sizes), END + 1).astype(np.int64))


def transition_counts(words: DataFrame, group: np.ndarray, documents: int) -> np.ndarray:
    """Counts of each class behind each class (and behind the beginning) in all training texts. Inside of words they
    are exact; behind a word's end they are those of any word's first symbol or the end of a text."""
    n = model.CLASSES

    def count(symbols: np.ndarray, sizes: np.ndarray, c: np.ndarray) -> np.ndarray:
        of, first, last = group[symbols], np.cumsum(sizes) - sizes, np.cumsum(sizes) - 1
        inner = np.ones(len(of), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        pairs = np.bincount(of[at - 1] * n + of[at], np.repeat(c, sizes)[at], n * n)
        return np.concatenate([pairs, np.bincount(of[first], c, n), np.bincount(of[last], c, n)]).astype(np.int64)

    total = _summed(words, n * n + 2 * n, count)
    pairs, first, last = total[: n * n].reshape(n, n).astype(float), total[n * n : n * n + n].astype(float), total[n * n + n :]
    first[END_CLASS] += documents
    share = first / max(first.sum(), 1.0)
    return np.concatenate([pairs + last[:, None] * share, documents * share[None, :]])


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each symbol, natural log of its share of its class (smoothed by one half)."""
    smooth = counts + 0.5
    order = np.argsort(-counts[:END], kind="stable")
    group = np.empty(END + 1, np.int64)
    group[END] = END_CLASS
    group[order[:SINGLE_CLASSES]] = np.arange(SINGLE_CLASSES)
    rest = order[SINGLE_CLASSES:]
    mass = np.cumsum(np.sqrt(smooth[rest]))
    group[rest] = SINGLE_CLASSES + np.minimum((mass / mass[-1] * 16).astype(np.int64), 15)
    of_class = np.bincount(group, smooth, model.CLASSES)
    return group, np.log(smooth / of_class[group]).astype(np.float32)


def pack_weights(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in model.shapes()])


def unpack_weights(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n, s in model.shapes().items():
        size = int(np.prod(s))
        out[n] = flat[at : at + size].reshape(s).astype(np.float32)
        at += size
    return out


class Common:
    """The common words as a worker looks them up."""

    def __init__(self, words: bytes | None):
        table = pa.ipc.open_stream(words).read_all() if words else pa.table({"word": pa.array([], pa.string()), "c": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "plain": pa.array([], pa.bool_())})
        self.words = table.column("word").cast(pa.large_string()).combine_chunks()
        self.count = table.column("c").to_numpy().astype(float)
        self.symbols, self.sizes = to_symbols(table.column("ids").to_pylist())
        self.plain = table.column("plain").to_numpy(zero_copy_only=False).astype(bool)
        self.length = pc.binary_length(self.words).to_numpy(zero_copy_only=False).astype(np.int64)

    def numbers(self, distinct: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word; the others, which get numbers behind those of the common ones."""
        number = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(number < 0)
        number[new] = len(self.words) + np.arange(len(new))
        return number, byte_strings(distinct.take(pa.array(new)))

    def with_symbols(self, own: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and sizes of the common words and of others behind them."""
        return np.concatenate([self.symbols, own]), np.concatenate([self.sizes, sizes])


_COMMON: dict[str, Common] = kept_by_worker()
#: A text in words: the numbers of its common words (32 bits; -1, -2, ...: the text's own first, second, ... other word),
#: the other words with a space between, their symbols (32 bits) and how many each has (32 bits, doubled, 1 more if they
#: spell it and no other word).
CODED = "words binary, others string, symbols binary, sizes binary"


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``values`` as one binary each up to ``ends``."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def coded(texts: pa.Array, common: Common, vocabulary: str | None) -> list[pa.Array]:
    """The columns of ``CODED`` for texts."""
    distinct, nth_distinct, per_text = coded_words(pc.ascii_lower(texts))
    number, fresh = common.numbers(distinct)
    which = number[nth_distinct]
    ids = encoder(vocabulary).ids_of(fresh)
    symbols, sizes = to_symbols(ids)
    plain = np.fromiter((is_plain(w, x, vocabulary) for w, x in zip(fresh, ids, strict=True)), bool, len(fresh))
    # each text's own other words, in order of their first occurrence
    at = np.flatnonzero(which >= len(common.words))
    other, of = which[at] - len(common.words), np.repeat(np.arange(len(texts)), per_text)[at]
    pairs, first, own = np.unique(of * max(1, len(fresh)) + other, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    per = np.bincount(pairs // max(1, len(fresh)), minlength=len(texts))
    upto = np.cumsum(per)
    which[at] = (upto - per)[of] - place[own] - 1
    other = (pairs % max(1, len(fresh)))[order]
    size = sizes[other]
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], upto])), pa.array(fresh, pa.large_binary()).cast(pa.large_string()).take(pa.array(other)))
    return [
        binaries(which.astype("<i4"), np.cumsum(per_text)),
        pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()),
        binaries(gathered(symbols, (np.cumsum(sizes) - sizes)[other], size).astype("<u4"), np.concatenate([[0], np.cumsum(size)])[upto]),
        binaries((size * 2 + plain[other]).astype("<i4"), upto),
    ]


def uncoded(columns: list[pa.Array], common: Common) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From coded texts: the numbers of all words, other words numbered behind the common ones; words of each text;
    symbols and sizes of the other words; whether they are plain."""
    words, symbols, sizes = (b"".join(columns[k].to_pylist()) for k in (0, 2, 3))
    which, sizes = np.frombuffer(words, "<i4").astype(np.int64), np.frombuffer(sizes, "<i4").astype(np.int64)
    per_text, per = (pc.binary_length(columns[k]).to_numpy(zero_copy_only=False).astype(np.int64) >> 2 for k in (0, 3))
    other = np.flatnonzero(which < 0)
    which[other] = len(common.words) - 1 - which[other] + (np.cumsum(per) - per)[np.repeat(np.arange(len(per)), per_text)[other]]
    return which, per_text, np.frombuffer(symbols, "<u4").astype(np.int64), sizes >> 1, (sizes & 1) > 0


def common_words(key: str, packed: bytes | None) -> Common:
    if key not in _COMMON:
        _COMMON.clear()
        _COMMON[key] = Common(packed)
    return _COMMON[key]


def coded_texts(rows: DataFrame, vocabulary: str | None, packed: bytes | None = None) -> DataFrame:
    """``rows`` (text and others) with ``CODED`` in place of their text: each text is looked up and encoded once."""
    sent, key = rows.sparkSession.sparkContext.broadcast(packed), uuid.uuid4().hex
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep_memory()
        columns = coded(batch.column("text"), common_words(key, sent.value), vocabulary)
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], [*(f.name for f in kept), "words", "others", "symbols", "sizes"])

    return map_batches(rows, run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), CODED]))


def training_runs(training: DataFrame, group: np.ndarray, vocabulary: str | None, common: bytes | None = None) -> DataFrame:
    """nth, run (8-bit classes behind a byte that is 0 at a text's beginning; elsewhere what is before the first target
    and how it is scored comes first, a block and one; then the targets), targets (how many). All symbols of each text
    of ``training`` (text, or ``CODED`` by ``common``) and its end are targets once."""
    if "text" in training.columns:
        training = coded_texts(training.select("text"), vocabulary, common)
    sent = training.sparkSession.sparkContext.broadcast((group.astype(np.uint8), common))
    key, step, front = uuid.uuid4().hex, model.BLOCK * RUN_BLOCKS, model.BLOCK + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep_memory()
        of, packed = sent.value
        known = common_words(key, packed)
        which, words, *own, _ = uncoded([batch.column(n) for n in ("words", "others", "symbols", "sizes")], known)
        symbols, sizes = known.with_symbols(*own)
        begin, sizes = (np.cumsum(sizes) - sizes)[which], sizes[which]
        kinds = gathered(of[symbols], begin, sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(words)].tolist()
        runs, targets, end = [], [], of[-1:].tobytes()
        for low, high in zip([0, *ends], ends):  # there is one end less
            s = kinds[low:high].tobytes() + end
            for at in range(0, len(s), step):
                own = s[at : at + step]
                runs.append(b"\1" + s[at - front : at] + own if at else b"\0" + own)
                targets.append(len(own))
        return pa.RecordBatch.from_arrays([pa.array(runs, pa.binary()), pa.array(targets, pa.int32())], ["run", "targets"])

    return map_batches(training.select("words", "others", "symbols", "sizes"), run, "run binary, targets int").withColumn("nth", F.monotonically_increasing_id())


def blocks_of(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets (-1: none) of runs, each in blocks behind one that only answers."""
    front = model.BLOCK + 1
    stored = np.fromiter(map(len, runs), np.int64, len(runs)) - 1
    inner = np.frombuffer(b"".join(r[:1] for r in runs), np.uint8) > 0
    flat = np.frombuffer(b"".join(r[1:] for r in runs), np.uint8)
    missing = np.where(inner, 0, front)  # padding in front of a text isn't stored
    lengths = stored + missing
    blocks = 1 - (front - lengths) // model.BLOCK
    begin = (np.cumsum(blocks) - blocks) * model.BLOCK
    size, places = int(blocks.sum()) * model.BLOCK, np.arange(len(flat))
    before = np.cumsum(stored) - stored
    place = places + np.repeat(begin + missing - before, stored)
    inputs, target = np.full(size, model.PAD, np.int16), np.full(size, -1, np.int16)
    asks = np.ones(len(flat), bool)
    asks[before + stored - 1] = False
    asked = places >= np.repeat(before + front - missing, stored)
    inputs[place[asks]], target[place[asked] - 1] = flat[asks], flat[asked]
    return inputs.reshape(-1, model.BLOCK), target.reshape(-1, model.BLOCK)


def train(runs: DataFrame, logs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rounds of Adam steps in groups of about ``GROUP_BLOCKS`` blocks, then the mean of the groups' weights by
    targets; every run is in one group of one round. Only sums of weights reach the driver; they are whole numbers, so
    that reruns agree."""
    weights = pack_weights(model.initial())
    rounds = len(RATES)
    if not rounds:
        return weights
    targets = runs.agg(F.coalesce(F.sum("targets"), F.lit(0))).first()[0]
    groups = rounds * ceil(max(1, targets) / (GROUP_BLOCKS * model.BLOCK * rounds))
    dealt = runs.withColumn("group", F.pmod(F.xxhash64("nth"), F.lit(groups)))
    sent = runs.sparkSession.sparkContext.broadcast(logs)

    def learner(start: np.ndarray, rate: float):
        def learn(table: pa.Table) -> pa.Table:
            keep_memory()
            inputs, target = blocks_of(table.sort_by("nth").column("run").to_pylist())
            p, adam, seen = unpack_weights(start), model.Adam(rate), int((target >= 0).sum())
            for k in range(1, len(inputs), STEP_BLOCKS):
                here = target[k : k + STEP_BLOCKS].ravel()
                at = np.flatnonzero(here >= 0)
                share = np.full(len(at), 1 / max(1, len(at)), np.float32)
                adam.update(p, model.block_gradients(p, sent.value, inputs[k - 1 : k + STEP_BLOCKS].astype(np.int64), at, here[at].astype(np.int64), share)[1])
            flat = np.rint(pack_weights(p).astype(np.float64) * WHOLE).astype(np.int64) * seen
            return pa.table({"at": pa.array(np.arange(len(flat), dtype=np.int32)), "weighted": pa.array(flat), "seen": pa.array(np.full(len(flat), seen))})

        return learn

    whole = F.sum(F.col("weighted").cast("decimal(38,0)")).cast("double")
    for nth, rate in enumerate(RATES):
        own = dealt.filter(F.col("group") % rounds == nth)
        mean = own.groupBy("group").applyInArrow(learner(weights.copy(), rate), "at int, weighted long, seen long").groupBy("at").agg((whole / F.sum("seen") / WHOLE).alias("w"))
        for r in mean.collect():  # one row a weight
            weights[r["at"]] = r["w"]
    return weights


class Scorer:
    """What a worker needs to score texts."""

    def __init__(self, weights: np.ndarray, logs: tuple[np.ndarray, np.ndarray], group: np.ndarray, share: np.ndarray, words: bytes, of_words: tuple[float, float, float]):
        self.tables, self.group, self.share = model.Tables(unpack_weights(weights), logs), group, share
        self.common = Common(words)
        self.in_words, self.documents, self.divisor = of_words
        self.base = np.log10((self.common.count + 0.5) / self.divisor)

    def symbol_logs(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural logs of the symbols' probabilities; texts of ``lengths`` symbols one after another."""
        place, size = model.windows(lengths)
        own = self.group[symbols]
        inputs = np.full(size, model.PAD, np.int64)
        behind = np.ones(len(symbols), bool)
        behind[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
        behind = np.flatnonzero(behind)
        inputs[place[behind]] = own[behind - 1]
        target = np.full(size, -1, np.int64)
        target[place] = own
        out, step = np.zeros(size, np.float32), SCORE_WINDOWS * model.BLOCK
        blocks = inputs.reshape(-1, model.BLOCK)
        for low in range(model.BLOCK, size, step):  # the first block is padding
            high = min(low + step, size)
            context = self.tables.contexts(blocks[low // model.BLOCK - 1 : high // model.BLOCK])
            scored = np.flatnonzero(target[low:high] >= 0)
            out[scored + low] = self.tables.log_probabilities(context.take(scored, 0), inputs[scored + low], target[scored + low])
        return out[place] + self.share[symbols]

    def table(self, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
        """For each text of the columns of ``CODED``: tokens; known ones, base score and score as far as the common
        words tell; each other word with what model and text give to its probability."""
        which, per_text, *own, plain = uncoded(columns, self.common)
        common, texts = which < len(self.common.words), len(per_text)
        pool, sizes = self.common.with_symbols(*own)
        fresh = pc.ascii_split_whitespace(columns[1].cast(pa.large_string()).filter(pc.greater(pc.binary_length(columns[1]), 0))).values
        plain = np.concatenate([self.common.plain, plain])
        length = np.concatenate([self.common.length, pc.binary_length(fresh).to_numpy(zero_copy_only=False).astype(np.int64)])
        # the symbols of all texts, an end behind each
        begin, size = (np.cumsum(sizes) - sizes)[which], sizes[which]
        upto = np.cumsum(size)
        symbols = gathered(pool, begin, size)
        ends = np.cumsum(per_text)
        symbols_upto = np.concatenate([[0], upto])[ends]
        lengths = np.diff(symbols_upto, prepend=0) + 1
        logs = self.symbol_logs(np.insert(symbols, symbols_upto, END), lengths).astype(np.float64)
        end_at = np.cumsum(lengths) - 1
        running = np.concatenate([[0.0], np.cumsum(np.delete(logs, end_at))])
        word = log(1 - ESCAPE) + running[upto] - running[upto - size]
        spelled = np.flatnonzero(~plain[which])
        word[spelled] = log(ESCAPE) + BYTE * (length[which[spelled]] + 1)
        # shares: what can't speak leaves its weight to the model
        of = np.repeat(np.arange(texts), per_text)
        nth = np.arange(len(which)) - (ends - per_text)[of]
        repeated = REPEATED * earlier(of, which) / np.maximum(nth, 1)
        remembered, spoken = (REMEMBERED, MODEL) if self.in_words + self.documents else (0.0, MODEL + REMEMBERED)
        rest = np.where(nth > 0, spoken, spoken + REPEATED) * np.exp(word) + repeated
        tokens = max(self.in_words + self.documents, 1)
        known = which[common]
        mixed = np.log10((remembered / tokens * self.common.count)[known] + rest[common])
        end = np.log10(remembered * self.documents / tokens + np.where(per_text > 0, spoken, spoken + REPEATED) * np.exp(log(1 - ESCAPE) + logs[end_at]))
        n_known, base, mixed = (np.bincount(of[common], x, texts) for x in (None, self.base[known], mixed))
        others = np.flatnonzero(~common)
        other = pa.StructArray.from_arrays([fresh.take(pa.array(which[others] - len(self.common.words))).cast(pa.string()), pa.array(rest[others])], ["word", "rest"])
        upto = np.concatenate([[0], np.cumsum(np.bincount(of[others], minlength=texts))]).astype(np.int32)
        return per_text + 1, n_known, base + log10((self.documents + 0.5) / self.divisor), mixed + end, pa.ListArray.from_arrays(pa.array(upto), other)

    def score(self, texts: pa.Array | list[bytes], vocabulary: str | None) -> list[tuple[int, int, float, float, list[tuple[bytes, float]]]]:
        """The rows of table()."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.binary()).cast(pa.string())
        *columns, other = self.table(coded(texts, self.common, vocabulary))
        return list(zip(*(c.tolist() for c in columns), [[(o["word"].encode(), o["rest"]) for o in row] for row in other.to_pylist()], strict=True))


def earlier(text: np.ndarray, word: np.ndarray) -> np.ndarray:
    """How often each word came before in its text; the texts are one after another."""
    at = np.arange(len(word))
    bits = len(word).bit_length()
    key = np.sort(word << bits | at)
    order = key & ((1 << bits) - 1)
    own, text = key >> bits, text[order]
    new = np.ones(len(order), bool)
    new[1:] = (text[1:] != text[:-1]) | (own[1:] != own[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


_SCORERS: dict[str, Scorer] = kept_by_worker()


def lm_scores(docs: DataFrame, vocabulary: str | None = None, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text).

    A null text is empty: its only token is the end. Repeated rows count each, in training too. Rows without an id
    aren't held out. Without training rows nothing is known and the model is its initial one. Other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), folds).alias("held_out"))
    training = rows.filter(~F.col("held_out")).select("text")
    words = cut(encoded(count_words(training), vocabulary), "words")
    documents = training.count()
    in_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, vocabulary_size = in_words + documents, distinct + (documents > 0)
    divisor = tokens + 0.5 * (vocabulary_size + 1)
    counts = symbol_counts(words)
    counts[END] = documents
    group, share = classes_of(counts)
    logs = model.transitions(transition_counts(words, group, documents))
    # the least count of the common words: the commonest powers of two that stay within TOP_WORDS
    fits = words.filter(F.length(F.col("word").cast("binary")) <= TOP_WORD_BYTES)
    level = F.floor(F.log2("c")).cast("int")
    least, held = 0, 0
    for r in sorted(fits.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # at most 63 rows
        held += r["count"]
        if held > TOP_WORDS:
            least = r["level"] + 1
            break
    common = fits.filter(F.col("c") >= (1 << least)).select("word", "c", "ids", "plain").toArrow()
    with pa.BufferOutputStream() as sink:
        with pa.ipc.new_stream(sink, common.schema) as writer:
            writer.write_table(common)
        packed = sink.getvalue().to_pybytes()
    # the rows' numbers are written before they are used twice
    texts = cut(coded_texts(rows.withColumn("row", F.monotonically_increasing_id()), vocabulary, packed), "lm-texts")
    weights = train(cut(training_runs(texts.filter(~F.col("held_out")), group, vocabulary, packed), "lm-runs"), logs)
    sent = spark.sparkContext.broadcast((weights, logs, group, share, packed, (in_words, documents, divisor)))  # TOP_WORDS words and the vocabulary
    key = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep_memory()
        if key not in _SCORERS:
            _COMMON.clear()
            _SCORERS.clear()
            _SCORERS[key] = Scorer(*sent.value)
        *columns, other = _SCORERS[key].table([batch.column(n) for n in ("words", "others", "symbols", "sizes")])
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), *map(pa.array, columns), other],
            ["row", "doc_id", "held_out", "n_tokens", "n_common", "base", "score", "other"],
        )

    scored = cut(map_batches(texts, run, "row long, doc_id long, held_out boolean, n_tokens long, n_common long, base double, score double, other array<struct<word:string,rest:double>>"), "lm-scored")
    other = scored.select("row", F.explode("other").alias("o")).select("row", "o.word", "o.rest")
    rare = words.filter((F.col("c") < (1 << least)) | (F.length(F.col("word").cast("binary")) > TOP_WORD_BYTES)).select("word", "c")
    c = F.coalesce("c", F.lit(0))
    remembered = (REMEMBERED / tokens if tokens else 0.0) * c
    of_rare = other.join(rare, "word", "left").groupBy("row").agg(F.sum(F.log10((c + 0.5) / divisor)).alias("rare_base"), F.sum(F.log10(remembered + F.col("rest"))).alias("rare_score"), F.sum((c > 0).cast("long")).alias("rare_known"))
    return scored.drop("other").join(of_rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("rare_known", F.lit(0)) + F.lit(1 if documents else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
