"""Operator 10: language identification by compression.

For each language a raw-content zstandard dictionary is filled from a bounded sample of labelled documents. A text is
encoded with every dictionary, block by block so that the dictionary counts everywhere in it; the language with the
smallest total wins, and a narrow margin to the second is a rejection. The sample is bounded in documents of each
language and in the bytes of a dictionary, and languages in number; the documents of the sample teach by whole texts.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, kept_by_worker, map_batches

#: The classifier's sample: documents of each language (expected number), bytes of a dictionary, most languages.
SAMPLE_DOCUMENTS = 100
DICTIONARY_BYTES = 1 << 17
MOST_LANGUAGES = 500
BLOCK_BYTES = 1 << 11
LEVEL = 9
#: A text is rejected where its best total isn't below the second by this share.
NARROW = 0.003
FOLDS = 3
NONE = "und"
#: Word signs that aren't decimal digits; some are numbers, so that each is asked whether it is a letter.
MAYBE_LETTER = re.compile(r"[^\W\d_]")
ADDED = ("lang_pred", "score", "rejected")
HASH_SPAN = 1 << 20


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in MAYBE_LETTER.finditer(text))


def learn_dictionaries(docs: DataFrame, usable: Column, sample_documents: int = SAMPLE_DOCUMENTS) -> dict[str, bytes]:
    """Language -> dictionary content, from rows of (doc_id, text, lang) where ``usable``.

    The sample is drawn by a hash of the id at a rate set by each language's number of rows, so languages are about
    equally large; what reaches the driver is bounded by languages x SAMPLE_DOCUMENTS x DICTIONARY_BYTES. More than
    MOST_LANGUAGES are an error.
    """
    labelled = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rates = {r["lang"]: min(HASH_SPAN, -(-sample_documents * HASH_SPAN // r["count"])) for r in labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(rates) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not rates:
        return {}
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(HASH_SPAN))
    rate = F.element_at(F.create_map(*[x for lang, n in rates.items() for x in (F.lit(lang), F.lit(n))]), F.col("lang"))
    sample = labelled.filter(drawn < rate).select("lang", drawn.alias("drawn"), "doc_id", F.substring("text", 1, DICTIONARY_BYTES).alias("text"))  # more than all a dictionary holds
    parts: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["drawn"], r["doc_id"] or 0, r["text"])):
        if has_letter(r["text"]):
            parts.setdefault(r["lang"], []).append(r["text"])
    return {lang: "\n".join(texts).lower().encode()[:DICTIONARY_BYTES] for lang, texts in parts.items()}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.languages = sorted(dictionaries)
        self.compressors = []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False))

    def totals(self, text: str) -> list[int]:
        data = text.lower().encode("utf-8", "replace")
        blocks = [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). The score is the share by which the best total undercuts the second."""
        if not text or not self.languages or not has_letter(text):
            return NONE, 0.0, True
        totals = self.totals(text)
        best = min(range(len(totals)), key=lambda i: (totals[i], i))
        others = [t for i, t in enumerate(totals) if i != best]
        margin = 1 - totals[best] / min(others) if others else 1.0
        return self.languages[best], margin, margin < NARROW


#: This worker's compressors, by the key of the query that they serve.
_COMPRESSORS: dict[str, Compressors] = kept_by_worker()


def with_language(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``docs`` with lang_pred, score and rejected (columns of these names give way); only the text is looked at."""
    docs = docs.drop(*ADDED)
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    key = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # languages x DICTIONARY_BYTES

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _COMPRESSORS:
            _COMPRESSORS.clear()
            _COMPRESSORS[key] = Compressors(sent.value)
        found = [_COMPRESSORS[key].predict(t) for t in batch.column("text").to_pylist()]
        added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names], *added], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return map_batches(docs, run, f"{fields}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of ``docs`` (doc_id, text, lang).

    Learns from rows that aren't held out and have text and language. Null texts and texts without a letter are `und`
    with score 0; without any labelled row all are. Ties go to the first language by name. Repeated rows are
    predicted each; other columns are left out.
    """
    out = held_out(F.col("doc_id"), folds)
    dictionaries = learn_dictionaries(docs, ~out)
    return with_language(docs.select("doc_id", out.alias("held_out"), "text"), dictionaries).select("doc_id", "held_out", "lang_pred", "score", "rejected")
