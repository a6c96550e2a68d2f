"""Words of texts as packed 32-bit hashes, stored once and read by several passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, lean, slices
from tidemark.llm.spans import mix, span_hashes
from tidemark.session import cut_lineage

_LONGEST = 1 << 13
#: Words of packed documents that a pass works on at once (one document may hold more).
SLICE_WORDS = 1 << 18
#: ASCII letters and digits and all other than ASCII belong to words.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True


def word_hashes(texts: list[str], symbols: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the lower-case words of all texts in a row, and the n+1 places where texts begin.

    Words of more than 8 KB count as several. With ``symbols``, each character that is neither in a word nor blank is a
    word of its own.
    """
    raw = [t.lower().encode("utf-8", "replace") + b" " for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    text = np.frombuffer(b"".join(raw), np.uint8)
    inside = _IN_WORD[text]
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    if symbols:
        alone = ~(inside | _BLANK[text])
        start = np.flatnonzero((edges[:-1] == 1) | alone)
        end = np.flatnonzero((edges[1:] == -1) | alone) + 1
    else:
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if len(start) and (end - start).max() > _LONGEST:
        cuts = [np.arange(a, b, _LONGEST) for a, b in zip(start, end)]
        end = np.concatenate([np.append(c[1:], b) for c, b in zip(cuts, end)])
        start = np.concatenate(cuts)
    hashes = (mix(span_hashes(text, start, end)) >> np.uint64(32)).astype(np.uint32)
    return hashes, np.searchsorted(start, offsets)


def store_words(rows: DataFrame, name: str, symbols: bool = False) -> DataFrame:
    """``doc_id`` and ``words`` (packed little-endian hashes) of ``rows (doc_id, text)``, written to the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, texts in slices(b.column("text"), 1024):
                hashes, first = word_hashes(texts, symbols)
                packed = [hashes[x:y].astype("<u4").tobytes() for x, y in zip(first[:-1], first[1:])]
                yield batch(doc_id=b.column("doc_id").slice(i, len(texts)), words=pa.array(packed, pa.binary()))

    return cut_lineage(rows.mapInArrow(lean(pack), "doc_id long, words binary"), name)


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch in a row and the n+1 places where documents begin."""
    parts = column.to_pylist()
    first = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return np.frombuffer(b"".join(parts), "<u4"), first


def token_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j of a packed column with at most so many words, or one row with more, and their words as ``unpack`` gives."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4)
    i = 0
    while i < len(column):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
        yield i, j, *unpack(column.slice(i, j - i))
        i = j


def bucket_counts(words: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n`` over all words; every task sums up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for *_, some, _ in token_slices(b.column("words"), SLICE_WORDS):
                total += np.bincount(some % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield batch(bucket=pa.array(some, pa.int32()), n=total[some])

    return words.select("words").mapInArrow(lean(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def word_counts(words: DataFrame) -> DataFrame:
    """``word, n``: how often each word occurs. A row per distinct word, so the table grows with the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, n = np.unique(unpack(b.column("words"))[0], return_counts=True)
            yield batch(word=word.astype(np.int64), n=n.astype(np.int64))

    return words.select("words").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
