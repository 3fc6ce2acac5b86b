import pyarrow as pa

from tidewell.llm import common, language_id, wordbpe


def test_a_worker_keeps_the_models_of_one_operator_only(spark):
    """Workers serve all stages of the pipeline: what one stage kept is gone in the next."""
    docs = spark.createDataFrame([("a plain text",)] * 2, "text string").coalesce(1)

    def fill(batch):
        wordbpe.encoder().encode(batch.column("text"))
        language_id._COMPRESSORS.setdefault("x", 1)
        return look(batch)

    def look(batch):
        return pa.record_batch([pa.array([len(wordbpe._ENCODERS) + len(language_id._COMPRESSORS)] * batch.num_rows)], ["kept"])

    def kept(fn, module):
        fn.__module__ = module
        return [r.kept for r in common.map_batches(docs, fn, "kept long").collect()]

    assert kept(fill, "one") == [2, 2]
    assert kept(look, "another") == [0, 0]
