"""Operator 5: token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks with offsets. Two neighbours are spliced at a proven stable common
boundary: an offset in the overlap where both encodings start a token, directly behind white space or between a digit
and an ASCII letter or digit (the pre-tokenizer joins across neither), and behind which both list the same ids up to
the end of the overlap. The first such offset wins. If there is none the overlap doubles, until one is found or the
chunk reaches the document's end; a run of letters alone, however long, is one piece for the tokenizer too.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, needs, utf8
from .wordbpe import WordEncoder, encoder

CHUNK_BYTES = 1 << 15
OVERLAP_BYTES = 1 << 8
OVER_LIMIT = 2048
#: Runs without white space, cut behind a digit where an ASCII letter or digit follows: a digit is a piece by itself.
_PART = re.compile(rb"[^\x20\x09-\x0D]+?(?=[\x20\x09-\x0D]|\Z|(?<=[0-9])[0-9A-Za-z])")


def _encode_chunk(enc: WordEncoder, text: bytes, start: int, end: int) -> tuple[np.ndarray, list[bytes]]:
    """Offsets of the parts in text[start:end] and the ids of each. A part cut by the chunk's end has unproven ids."""
    chunk = enc.lowered(text[start:end])
    found = [m.span() for m in _PART.finditer(chunk)]
    return np.array([a + start for a, _ in found], dtype=np.int64), enc.ids_of([chunk[a:b] for a, b in found])


def _common_boundary(left: tuple[np.ndarray, list[bytes]], right: tuple[np.ndarray, list[bytes]], low: int, last: bool) -> int | None:
    """The first offset behind ``low`` at which both encodings begin a part and agree on all complete parts behind it."""
    (a, a_ids), (b, b_ids) = left, right
    i, j = int(np.searchsorted(a, low, "right")), int(np.searchsorted(b, low, "right"))
    common, ia, jb = np.intersect1d(a[i:], b[j:], assume_unique=True, return_indices=True)
    for n, p in enumerate(common):
        x, y = i + int(ia[n]), j + int(jb[n])
        span = len(a) - x
        whole = span if last else span - 1  # the part at the chunk's end may be cut
        if whole >= 1 and a_ids[x : x + whole] == b_ids[y : y + whole]:
            return int(p)
    return None


def resynchronised_ids(enc: WordEncoder, text: bytes, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> list[bytes]:
    """The ids of a huge text, one bytes object for each spliced chunk. Chunks begin where a character begins."""
    n, start, taken_to, out = len(text), 0, 0, []

    def edge(p: int) -> int:
        while p < n and text[p] & 0xC0 == 0x80:
            p += 1
        return min(p, n)

    end = edge(chunk + overlap)
    left = _encode_chunk(enc, text, start, end)
    while end < n:
        following = edge(start + chunk)
        right_end = edge(following + chunk + overlap)
        right = _encode_chunk(enc, text, following, right_end)
        width = overlap
        while (p := _common_boundary(left, right, following, end >= n)) is None and end < n:
            width *= 2
            end = edge(following + width)
            left = _encode_chunk(enc, text, start, end)
            if end > right_end:
                right_end = edge(end + overlap)
                right = _encode_chunk(enc, text, following, right_end)
        if p is None:  # widened to the end of the document: the left encoding is whole
            break
        at, ids = left
        out.append(b"".join(ids[int(np.searchsorted(at, taken_to)) : int(np.searchsorted(at, p))]))
        start, end, left, taken_to = following, right_end, right, p
    at, ids = left
    out.append(b"".join(ids[int(np.searchsorted(at, taken_to)) :]))
    return out


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = OVER_LIMIT, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and n_chunks for each row of ``docs`` (doc_id, text).

    A null or empty text has 0 bytes and tokens. Repeated rows are counted each. Other columns are left out.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, texts = encoder(vocabulary), utf8(batch.column("text"))
        short = [t for t in texts if len(t) <= chunk]
        sizes = iter([len(x) // 4 for x in enc.encode(short)])
        tokens, chunks = [], []
        for t in texts:
            if len(t) <= chunk:
                tokens.append(next(sizes))
                chunks.append(1)
            else:
                ids = resynchronised_ids(enc, t, chunk, overlap)
                tokens.append(sum(map(len, ids)) // 4)
                chunks.append(len(ids))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens]), pa.array(chunks, pa.int64())],
            ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"],
        )

    return map_batches(needs(docs, "doc_id", "text"), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long")
