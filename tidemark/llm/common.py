"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule ``[^\x20\x09-\x0D]+``, and ASCII letters.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS, WORD_CHAR = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so that other columns cannot clash; null text is empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK_CLASS + "+"), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are (``lower`` is the same, and faster, where all is ASCII)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow string column without nulls, and the n+1 offsets into them."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_array(parts: Iterable[bytes]) -> pa.Array:
    return pa.array(list(parts), pa.binary())


def batch(**columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, so that later tasks find what earlier ones looked up."""
    holder = sys.modules.setdefault("_tidemark_worker_store", types.ModuleType("_tidemark_worker_store"))
    return holder.__dict__.setdefault(name, {})


def lean(work: Callable[[Iterator], Iterator], *kept: str) -> Callable[[Iterator], Iterator]:
    """``work`` for a worker that other operators used before: it first frees all worker stores but those named, and before and
    after it hands back memory that is free but still held."""

    def run(batches: Iterator) -> Iterator:
        _release(kept)
        yield from work(batches)
        _release(kept)

    return run


def _release(kept: tuple[str, ...]) -> None:
    stores = sys.modules.get("_tidemark_worker_store")
    for name in [n for n in vars(stores) if not n.startswith("__") and n not in kept] if stores else []:
        delattr(stores, name)
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


#: Before a blank that follows a non-blank: no token of the split pattern holds a blank after a non-blank.
_SAFE_CUT = re.compile(r"(?<=\S)(?= )")
#: Texts with a blank after white space of any kind (for RE2, at least all that Python calls so).
_BLANK_PAIR = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}] "
#: Of each of the two generations of a memo.
MEMO_ENTRIES = 400_000
LONG_WORD = 100


def safe_parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All parts of the texts cut before each blank that follows a non-blank, the n+1 places where texts begin, and the texts'
    order: those with blanks in a row come last.

    Tokens never cross such a place, so the parts can be encoded one by one. All but the first of a text lack that blank.
    """
    texts = texts.cast(pa.large_string())
    odd = pc.match_substring_regex(texts, _BLANK_PAIR)
    lists = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    rows = []
    for text in texts.filter(odd).to_pylist():
        first, *rest = _SAFE_CUT.split(text)
        rows.append([first, *(p[1:] for p in rest)])
    parts = pa.concat_arrays([lists.flatten(), pa.array([p for r in rows for p in r], pa.large_string())])
    counts = np.concatenate([pc.list_value_length(lists).to_numpy(), np.array([len(r) for r in rows], np.int64)])
    return parts, np.concatenate([[0], np.cumsum(counts)]), np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")


class PartEncoder:
    """Ids of whole texts, with a bounded memo of words already encoded.

    ``encode_all`` gets distinct parts of texts (a word with the blank before it, or the begin of a text) and returns the
    packed little-endian ids of each. Arrow finds the distinct parts, so Python handles each once a call, and ids are put
    together by their places. The memo only saves time: when it is full it becomes the old one, which gives way to it, and of
    which only words that are met again are kept. Very long words are not kept.
    """

    def __init__(self, store: dict, encode_all: Callable[[list[str]], list[bytes]]):
        self.store, self.encode_all = store, encode_all
        for name in ("words", "heads", "old words", "old heads"):
            store.setdefault(name, {})

    def _packed(self, parts: list[str], name: str, before: str) -> list[bytes]:
        if len(self.store[name]) > MEMO_ENTRIES:
            self.store[name], self.store[f"old {name}"] = {}, self.store[name]
        memo, old = self.store[name], self.store[f"old {name}"]
        out = list(map(memo.get, parts))
        places = [i for i, x in enumerate(out) if x is None]
        if old:
            for i in places:
                ids = old.pop(parts[i], None)
                if ids is not None:
                    out[i] = memo[parts[i]] = ids
            places = [i for i in places if out[i] is None]
        new = [parts[i] for i in places]
        for i, part, ids in zip(places, new, self.encode_all([before + p for p in new])):
            out[i] = ids
            if len(part) <= LONG_WORD:
                memo[part] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n+1 places where texts begin."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        parts, first, order = safe_parts(texts)
        coded = parts.dictionary_encode()
        words, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        heads = parts.take(pa.array(first[:-1])).dictionary_encode()
        code[first[:-1]] = heads.indices.to_numpy() + len(words)
        packed = self._packed(words, "words", " ") + self._packed(heads.dictionary.to_pylist(), "heads", "")
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        each = sizes[code]
        ends = np.cumsum(each)
        kind = np.int32 if max(ends[-1], sizes.sum()) < 1 << 31 else np.int64
        shift = (np.cumsum(sizes) - sizes)[code]
        shift -= ends - each
        at = np.repeat(shift.astype(kind), each)
        at += np.arange(len(at), dtype=kind)
        ids = np.frombuffer(b"".join(packed), "<u4").take(at)
        borders = np.concatenate([[0], ends[first[1:] - 1]])
        if (np.diff(order) > 0).all():
            return ids, borders
        place = np.argsort(order)
        sizes = np.diff(borders)[place]
        return np.concatenate([ids[a : a + n] for a, n in zip(borders[place], sizes)]), np.concatenate([[0], np.cumsum(sizes)])


def text_slices(column: pa.Array, most: int = 2048, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Rows i to j of a text column, bounded in number and, unless it is one row, in bytes."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(column):
        before = ends[i - 1] if i else 0
        j = min(len(column), i + most, max(i + 1, int(np.searchsorted(ends, before + most_bytes, "right"))))
        yield i, j
        i = j


def slices(column: pa.Array, most: int = 512) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column, some at a time."""
    for i in range(0, len(column), most):
        yield i, column.slice(i, most).to_pylist()
