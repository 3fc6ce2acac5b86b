"""What the corpus operators share: shared scratch space, cutting lineage, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only used by a session of one machine that names no shared folder (tests, a laptop).
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"
#: Rows in an Arrow batch that goes to Python; texts may be long, so batches are short.
ARROW_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_CHECKPOINT_DIR).rstrip("/")


#: Paths that cut() has written inside a scratch() block of this thread.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def cut(df: DataFrame, label: str, kept: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there.

    Lost executors cost no recomputation of what was written, and a later plan reads the columns it needs. Inside of a
    scratch() block the files go with it, unless ``kept``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell/{label}-{uuid.uuid4().hex}"
    if (written := _WRITTEN.get()) is not None and not kept:
        written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what cut() has written in it; results must have been used or kept by then."""
    token = _WRITTEN.set([])
    try:
        yield
    finally:
        paths = _WRITTEN.get() or []
        _WRITTEN.reset(token)
        jvm = spark.sparkContext._jvm
        for p in map(jvm.org.apache.hadoop.fs.Path, paths):
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: What this worker keeps between tasks (models, vocabularies), by what made it.
KEPT: list[dict] = []
_OPERATOR = [""]


def kept_by_worker() -> dict:
    """An empty dictionary that a worker fills once and keeps as long as its tasks are those of one operator."""
    KEPT.append({})
    return KEPT[-1]


def serve(operator: str) -> None:
    """Workers outlive a stage: what they kept for another operator goes, and their memory returns to the system."""
    if operator != _OPERATOR[0]:
        for kept in KEPT:
            kept.clear()
        _OPERATOR[0] = operator
        give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def keep_memory() -> None:
    """Arrays that are made and dropped again and again stay in this process's heap until give_back(): else each one's
    pages are fetched from the system anew, which takes as long as the work on them."""
    if option := getattr(ctypes.CDLL(None), "mallopt", None):
        option(-3, 1 << 25)  # M_MMAP_THRESHOLD, at its largest
        option(-1, 1 << 27)  # M_TRIM_THRESHOLD


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = ARROW_ROWS) -> DataFrame:
    """``mapInArrow`` for a function of one batch of at most ``rows`` rows; empty batches are skipped. A batch may be
    larger on its way, as the session says, and is cut where it arrives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve(fn.__module__)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                if (out := fn(batch.slice(at, rows))) is not None:
                    yield out
        batch = out = None
        give_back()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; a null is an empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of ``texts`` (what is between ASCII white space; a null text is empty), the number of each
    word of the texts one after another among them, and how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = lists.values.dictionary_encode()
    distinct, which = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    if (empty := pc.index(distinct, "").as_py()) >= 0:  # before the first word and behind the last
        kept = which != empty
        sizes = np.bincount(np.repeat(np.arange(len(texts)), sizes)[kept], minlength=len(texts))
        which = which[kept]
        which -= which > empty
        distinct = pa.concat_arrays([distinct[:empty], distinct[empty + 1 :]])
    return distinct, which, sizes


def byte_strings(strings: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an array of large strings without nulls."""
    if not len(strings):
        return []
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data, ends = data[int(ends[0]) : int(ends[-1])].to_pybytes() if data else b"", (ends - ends[0]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]  # one range less than ends


def words_by_text(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """As coded_words(), with the words' bytes."""
    distinct, which, sizes = coded_words(texts)
    return byte_strings(distinct), which, sizes


def gathered(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of ``pool`` of ``sizes`` at ``begins``, one after another."""
    upto = np.cumsum(sizes)
    return pool[np.repeat(begins - upto + sizes, sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]


def held_out(doc_id: Column, folds: int) -> Column:
    """True where crc32 of the id as text, modulo ``folds``, is 1 (a null id is never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 1, F.lit(False))


def needs(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra ones can't clash with those an operator adds."""
    return df.select(*[df[n] for n in names])
