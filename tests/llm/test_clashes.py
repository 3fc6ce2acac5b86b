"""Columns that share a name with an output or a helper change nothing."""

import pytest
from pyspark.sql import functions as F

from tidewell.llm.jpeg import media_columns
from tidewell.llm.language_id import identify, learn_dictionaries, with_language
from tidewell.llm.lm_score import lm_scores
from tidewell.llm.mixing import mix, take
from tidewell.llm.near_dup import drop_near_duplicates, near_duplicates
from tidewell.llm.neighbours import nearest_neighbours
from tidewell.llm.packing import pack
from tidewell.llm.pii import find_personal_data, redact
from tidewell.llm.secret_scan import find_secrets
from tidewell.llm.token_counts import token_counts

HELPERS = "row item times nth copies key size target rate chance block found kept bit rep value n df part cell dims score bound drawn held_out draw word window sketch identity rejected lang_pred spans shard piece offset sequence_id component_id base other mix_identity level".split()
REPORTS = [media_columns, identify, lm_scores, mix, near_duplicates, pack, find_personal_data, find_secrets, token_counts]
FILTERS = [take, drop_near_duplicates, redact]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 60").repartition(1).sortWithinPartitions("doc_id").cache()


def crowded(df):
    return df.select("*", *[F.lit("x").alias(n) for n in HELPERS if n not in df.columns])


@pytest.mark.parametrize("operator", REPORTS, ids=lambda f: f.__name__)
def test_reports(docs, operator):
    plain = operator(docs)
    got = operator(crowded(docs))
    assert got.columns == plain.columns
    ids = [c for c in plain.columns if c != "sequence_id"]
    assert sorted(map(str, got.select(ids).collect())) == sorted(map(str, plain.select(ids).collect())) if operator is not pack else got.count() == plain.count()


@pytest.mark.parametrize("operator", FILTERS, ids=lambda f: f.__name__)
def test_filters_keep_them(docs, operator):
    rows = operator(crowded(docs)).collect()
    assert rows and all(r[n] == "x" for r in rows for n in HELPERS)
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in operator(docs).collect())


def test_languages_take_the_names(docs):
    dictionaries = learn_dictionaries(docs, F.lit(True))
    rows = with_language(crowded(docs), dictionaries).collect()
    assert all(r.lang_pred != "x" and 0 <= r.score <= 1 and r.copies == "x" for r in rows)


def test_neighbours(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert sorted(nearest_neighbours(crowded(table)).collect()) == sorted(nearest_neighbours(table).collect())
