import zlib

import pytest
import zstandard

from tidewell.llm.language_id import BLOCK_BYTES, LEVEL, Compressors, has_letter, identify, learn_dictionaries


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 250 < len(held) < 420
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    print([(r.doc_id, r.lang, r.lang_pred, r.score) for r in rows if r.lang_pred != r.lang or r.rejected])


def test_awkward_rows(spark, awkward):
    rows = identify(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    for i in (1, 2, 3):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[5].lang_pred in ("en", "fr", "xx") and by[None].held_out is False
    assert identify(awkward.limit(0)).count() == 0
    unlabelled = identify(awkward.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_narrow_margins_are_rejected():
    same = Compressors({"a": b"the same words in both", "b": b"the same words in both"})
    assert same.predict("the same words")[2] is True
    assert Compressors({"a": b"abc " * 50}).predict("abc") == ("a", 1.0, False)


def test_letters():
    assert not any(map(has_letter, ("½ ²", "Ⅷ 12", "_ 9 ٣", "!?", "")))
    assert all(map(has_letter, ("½a", "é", "漢", "ª", "1 ß")))


def test_predictions_equal_plain_compression(spark):
    """Every document against every language's dictionary, by the library, one after another."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    taught = spark.createDataFrame([r for r in rows if not held(r.doc_id)], docs.schema)
    dictionaries = learn_dictionaries(taught, __import__("pyspark").sql.functions.lit(True))
    assert set(dictionaries) == {r.lang for r in rows if not held(r.doc_id) and r.lang}

    def size(text, lang):
        data = text.lower().encode()
        content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False)
        return sum(len(c.compress(data[k : k + BLOCK_BYTES])) for k in range(0, len(data), BLOCK_BYTES))

    got = {r.doc_id: r for r in identify(docs).collect()}
    for r in rows[::5]:
        r_got = got[r.doc_id]
        assert r_got.held_out == held(r.doc_id)
        sizes = sorted((size(r.text or "", lang), lang) for lang in dictionaries)
        if has_letter(r.text or ""):
            assert (r_got.lang_pred, r_got.score) == (sizes[0][1], pytest.approx(1 - sizes[0][0] / sizes[1][0])), r.doc_id
        else:
            assert (r_got.lang_pred, r_got.score) == ("und", 0.0)
