"""From raw documents to packed training sequences: each stage reads what its forerunner wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import cut, documents, scratch
from tidewell.llm.language_id import learn_dictionaries, with_language
from tidewell.llm.mixing import take
from tidewell.llm.near_dup import drop_near_duplicates
from tidewell.llm.packing import pack
from tidewell.llm.pii import redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin; texts without letters and narrow margins go."""
    docs = docs.select(COLUMNS)
    return with_language(docs, learn_dictionaries(docs, F.lit(True))).filter(~F.col("rejected")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_duplicates(docs.select(COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    return redact(docs.select(COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return take(docs.select(COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return pack(docs.select(COLUMNS))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]
#: Not expressible: compression, component search, model-based redaction and packing. Tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote for itself goes behind it
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}", kept=True)
    return STAGES[-1][1](spark, docs, sf_dir)
