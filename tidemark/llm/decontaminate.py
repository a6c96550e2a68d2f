"""Operator 1, benchmark decontamination by latent semantic retrieval.

Passages of 24 words (12 for items shorter than that) are TF-IDF vectors over hashed words (with squared IDF, so that rare words count). A randomised SVD over the passages of all documents gives a
latent basis: ``A' A R`` for a random ``R`` is a sum over passages, added up by Spark; its size is fixed, and
its orthonormal columns are the basis. Windows of every document are compared with the passages of the
benchmark by cosine in the latent space. That search is approximate, so a second one adds every stretch of a document
that shares enough of an item's rarest words; it misses nothing that the rule below accepts. Candidates of both are
confirmed by longest common subsequence, and paraphrases in addition by the answer, the last words of an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, id_and_text, lean
from tidemark.llm.words import SLICE_WORDS, bucket_counts, store_words, token_slices, word_hashes

FEATURES, RANK = 1 << 13, 64
TILE, TILES = 6, 4
PASSAGE = TILE * TILES
COSINE = 0.65
#: Share of a passage's weight that the words which a window shares with its item must have.
WEIGHT_SHARED = 0.4
#: Share of an item's words that must stand in a document in order: alone, or with the answer.
COPY, PARAPHRASE, ANSWER = 0.75, 0.6, 0.8
ANSWER_WORDS = 5
#: Buckets in which words are counted to tell an item's rarest words. Collisions cost time, never a leak.
COUNTED = 1 << 16
_MAP = 1 << 20
#: The benchmark is searched in blocks of so many items and characters, which bounds what is broadcast.
BLOCK_ITEMS, BLOCK_CHARS = 1000, 2_000_000
#: Cosines of windows and passages that are held at once.
CELLS = 1 << 21
#: Vectors of one feature that the sketch adds up in one step.
TOGETHER = 8


def _tiled(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by tile of ``size`` words (each document begins a tile; the rest of its last is empty), and document and
    first word of tiles."""
    sizes = np.diff(first)
    tiles = -(-sizes // size)
    begin = np.cumsum(tiles) - tiles
    doc = np.repeat(np.arange(len(sizes)), tiles)
    place = np.arange(len(words)) - np.repeat(first[:-1], sizes) + np.repeat(begin, sizes) * size
    table = np.full(len(doc) * size, FEATURES, np.uint16)
    table[place] = words % FEATURES
    return table.reshape(-1, size), doc, (np.arange(len(doc)) - begin[doc]) * size


def _summed(vectors: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the vectors of each row's features, in pieces that stay in the processor's cache."""
    out = np.empty((len(table), vectors.shape[1]), np.float32)
    for i in range(0, len(table), 512):
        some = table[i : i + 512]
        total = vectors[some[:, 0]]
        for k in range(1, some.shape[1]):
            total += vectors[some[:, k]]
        out[i : i + 512] = total
    return out


def _summed_by(group: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of the sorted ``group`` and the sum of ``vectors[rows]`` for each: sums of some rows first, then sums of
    those, until one is left (``np.add.reduceat`` along rows takes about ten times as long)."""
    while True:
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        sizes = np.diff(begin, append=len(group))
        lines = -(-sizes // TOGETHER)
        ends = np.cumsum(lines)
        table = np.full(int(lines.sum()) * TOGETHER, len(vectors), np.int32)
        table[np.arange(len(group)) - np.repeat(begin - (ends - lines) * TOGETHER, sizes)] = rows
        vectors = _summed(np.vstack([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)]), table.reshape(-1, TOGETHER))
        group, rows = np.repeat(group[begin], lines), np.arange(len(vectors))
        if len(group) == len(begin):
            return group, vectors


def _document_frequency(words: DataFrame) -> tuple[np.ndarray, int]:
    """How many passages hold each feature, and the number of passages. Fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 2, np.int64)
        for b in batches:
            for *_, words, first in token_slices(b.column("words"), SLICE_WORDS):
                table = np.sort(_tiled(words, first, PASSAGE)[0], axis=1)
                new = np.ones(table.shape, bool)
                new[:, 1:] = table[:, 1:] != table[:, :-1]
                total[: FEATURES + 1] += np.bincount(table[new], minlength=FEATURES + 1)
                total[FEATURES + 1] += len(table)
        yield batch(feature=np.arange(FEATURES + 2, dtype=np.int32), n=total)

    sums = words.select("words").mapInArrow(lean(count), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(FEATURES + 2, np.int64)
    for row in sums.collect():  # a row per feature
        out[row.feature] = row.n
    return out[:FEATURES], int(out[-1])


def _sketch(words: DataFrame, weight: np.ndarray, random: np.ndarray) -> np.ndarray:
    """``A' A R`` over all passages: each task adds up its own, Spark adds the tasks. Fixed size."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast((weight, random))
    names = [f"y{i}" for i in range(RANK)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, random = shared.value
        weighted = np.vstack([weight[:, None] * random, np.zeros((1, RANK))]).astype(np.float32)
        total = np.zeros((FEATURES + 1, RANK))
        tables = (_tiled(words, first, PASSAGE)[0] for b in batches for *_, words, first in token_slices(b.column("words"), SLICE_WORDS))
        for table in tables:
            for i in range(0, len(table), 1 << 13):
                some = table[i : i + (1 << 13)]
                latent = _summed(weighted, some)
                flat = some.ravel()
                order = np.argsort(flat, kind="stable")
                feature, sums = _summed_by(flat[order].astype(np.int32), latent, order // PASSAGE)
                total[feature] += sums
        total = total[:FEATURES] * weight[:, None]
        yield batch(feature=np.arange(FEATURES, dtype=np.int32), **{n: total[:, i] for i, n in enumerate(names)})

    schema = "feature int, " + ", ".join(f"{n} double" for n in names)
    sums = words.select("words").mapInArrow(lean(project), schema).groupBy("feature").agg(*(F.sum(n).alias(n) for n in names))
    out = np.zeros((FEATURES, RANK))
    for row in sums.collect():  # a row per feature
        out[row.feature] = row[1:]
    return out


def latent_basis(words: DataFrame, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the features in the latent space, TF-IDF weight included, and their IDF: ``FEATURES`` + 1 rows (the last is empty)."""
    frequency, passages = _document_frequency(words)
    idf = np.log((passages + 1) / (frequency + 1))
    weight = idf**2
    random = np.random.default_rng(seed).standard_normal((FEATURES, RANK))
    basis = np.linalg.qr(_sketch(words, weight, random))[0]
    basis = np.vstack([weight[:, None] * basis, np.zeros((1, RANK))]).astype(np.float32)
    return basis, np.append(idf, 0).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, with the item's places as bits of one number."""
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        match = row & places.get(w, 0)
        if match:
            row = ((row + match) | (row - match)) & full
    return len(item) - row.bit_count()


def _passages(items: list[tuple[int, list[int]]], basis: np.ndarray, idf: np.ndarray, tiles: int) -> tuple[np.ndarray, ...]:
    """Latent vectors of the passages of the items searched with windows of so many tiles, their items and least weights."""
    size = tiles * TILE
    vectors, owner, weights = [], [], []
    for k, (_, words) in enumerate(items):
        if (len(words) >= PASSAGE) != (tiles == TILES):
            continue
        starts = [*range(0, max(1, len(words) - size + 1), size // 2), max(0, len(words) - size)]
        for s in dict.fromkeys(starts):
            features = np.array(words[s : s + size], np.int64) % FEATURES
            vectors.append(basis[features].sum(axis=0))
            weights.append(WEIGHT_SHARED * idf[np.unique(features)].sum())
            owner.append(k)
    across = np.ascontiguousarray(_unit(np.array(vectors, np.float32).reshape(-1, RANK)).T)
    return tiles, across, np.array(owner, np.int64), np.array(weights)


def stretch(words: int) -> int:
    """How many words of a document are searched together for an item of so many words."""
    return 2 * (words + TILE) + PASSAGE


def leak(item: list[int], text: np.ndarray) -> tuple[float, bool] | None:
    """Share of the item's words found in order within one stretch of the text, and whether the answer is; None if no
    stretch holds the item by the rule."""
    own, words = set(item), text.tolist()
    at = [i for i, w in enumerate(words) if w in own]
    least = PARAPHRASE * len(item)
    if len(at) < least:  # a common subsequence cannot be longer
        return None
    answer = item[-ANSWER_WORDS:]

    def judged(some: list[int]) -> tuple[float, bool] | None:
        shared = common_subsequence(item, some)
        if shared < least:
            return None
        told = common_subsequence(answer, some) >= ANSWER * len(answer)
        return (shared / len(item), told) if told or shared >= COPY * len(item) else None

    inside = [words[i] for i in at]
    found = judged(inside)
    if found is None or at[-1] - at[0] < stretch(len(item)):
        return found
    ends = np.searchsorted(at, np.array(at) + stretch(len(item)))
    whole = np.diff(ends, prepend=0) > 0  # others lie within the stretch before
    each = [judged(inside[x:y]) for x, y in enumerate(ends.tolist()) if whole[x] and y - x >= least]
    return max((f for f in each if f), default=None)


def _rare_words(items: list[tuple[int, list[int]]], counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rare words and the items they belong to, sorted by word; by item how many must occur together, and how close.

    Of an item's n words a leak has at least m = PARAPHRASE * n in order. Leaving out any m - k of the n places leaves k
    that the leak has, so the rarest n - m + k places are enough to find all of them.
    """
    words, owner, needed, reach = [], [], [], []
    for k, (_, item) in enumerate(items):
        least = max(1, int(np.ceil(PARAPHRASE * len(item) - 1e-6)))
        needed.append(min(least, 2 + len(item) // 8))
        reach.append(stretch(len(item)))
        own = np.array(item, np.uint32)
        rarest = own[np.argsort(counts[own % COUNTED], kind="stable")[: len(item) - least + needed[-1]]]
        words.append(np.unique(rarest))
        owner.append(np.full(len(words[-1]), k))
    words, owner = np.concatenate(words), np.concatenate(owner)
    order = np.argsort(words, kind="stable")
    maybe = np.zeros(_MAP, bool)
    maybe[words % _MAP] = True
    return maybe, words[order], owner[order], np.array(needed), np.array(reach)


def _rare_stretches(
    words: np.ndarray, first: np.ndarray, maybe: np.ndarray, rare: np.ndarray, owner: np.ndarray, needed: np.ndarray, reach: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Documents, items, first and last word (exclusive) of the surroundings in which enough rare words of an item meet.

    Most words are told apart by the map ``maybe`` of the rare words' lowest bits, which misses none.
    """
    some = np.flatnonzero(maybe[words & np.uint32(_MAP - 1)])
    left = np.searchsorted(rare, words[some])
    same = rare[np.minimum(left, len(rare) - 1)] == words[some]
    some, left = some[same], left[same]
    many = np.searchsorted(rare, words[some], "right") - left
    place = np.repeat(some, many)
    item = owner[np.repeat(left - np.cumsum(many) + many, many) + np.arange(len(place))]
    order = np.argsort(item, kind="stable")  # places are in order already
    place, item = place[order], item[order]
    doc = np.searchsorted(first, place, "right") - 1
    last = np.arange(len(place)) + needed[item] - 1
    i = np.flatnonzero(last < len(place))
    j = last[i]
    i = i[(item[i] == item[j]) & (doc[i] == doc[j]) & (place[j] - place[i] < reach[item[i]])]
    j = last[i]
    low = np.maximum(first[doc[i]], place[j] - reach[item[i]] + 1)
    high = np.minimum(first[doc[i] + 1], place[i] + reach[item[i]])
    return doc[i], item[i], low, high


def _merged(*parts: tuple[np.ndarray, ...]) -> Iterator[tuple[int, int, int, int]]:
    """Document, item, first and last word of all stretches; those of one document and item that overlap become one."""
    doc, item, low, high = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((low, doc, item))
    doc, item, low, high = doc[order], item[order], low[order], high[order]
    span = int(high.max(initial=0)) + 1
    group = np.cumsum(np.diff(item, prepend=-1).astype(bool) | np.diff(doc, prepend=-1).astype(bool))
    end = np.maximum.accumulate(group * span + high) - group * span
    new = np.ones(len(doc), bool)
    new[1:] = (group[1:] != group[:-1]) | (low[1:] > end[:-1])
    opens = np.flatnonzero(new)
    closes = np.append(opens[1:], len(doc)) - 1
    yield from zip(doc[opens].tolist(), item[opens].tolist(), low[opens].tolist(), end[closes[: len(opens)]].tolist())


def _search(basis: np.ndarray, idf: np.ndarray, counts: np.ndarray, items: list[tuple[int, list[int]]]):
    member = np.zeros((len(items), FEATURES + 1), np.float32)
    for k, (_, words) in enumerate(items):
        features = np.array(words, np.int64) % FEATURES
        member[k, features] = idf[features]
    kinds = [_passages(items, basis, idf, TILES), _passages(items, basis, idf, TILES // 2)]

    def candidates(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tiles whose window is close to a passage and has words of its item, and the item."""
        tiles = _summed(basis, table)
        padded = np.vstack([tiles, np.zeros((TILES - 1, RANK), np.float32)])
        cells = np.vstack([table, np.full((TILES - 1, TILE), FEATURES, np.uint16)])
        found = [np.zeros((2, 0), np.int64)]
        for count, across, owner, need in kinds:
            if not len(owner):
                continue
            step = max(1, min(2048, CELLS // len(owner)))
            for i in range(0, len(tiles), step):
                n = min(step, len(tiles) - i)
                windows = _unit(sum(padded[i + k : i + k + n] for k in range(count)))
                close = np.flatnonzero((windows @ across).ravel() >= COSINE)
                tile, passage = close // len(owner) + i, close % len(owner)
                item = owner[passage]
                shared = sum(member[item[:, None], cells[tile + k]].sum(axis=1) for k in range(count))
                good = shared >= need[passage]
                found.append(np.unique(np.stack([tile[good], item[good]]), axis=1))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return both[0], both[1]

    rare = _rare_words(items, counts)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, words, first in token_slices(b.column("words"), SLICE_WORDS):
                found = matches(words, first)
                if found:
                    ids = b.column("doc_id").slice(i, j - i).to_pylist()
                    yield batch(
                        doc_id=pa.array([ids[d] for d, _ in found], pa.int64()), item_id=pa.array([items[k][0] for _, k in found], pa.int64()),
                        overlap=pa.array([v[0] for v in found.values()], pa.float64()), answer=pa.array([v[1] for v in found.values()], pa.bool_()),
                    )

    def matches(words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[float, bool]]:
        table, doc, at = _tiled(words, first, TILE)
        out = {}
        tile, item = candidates(table)
        room = np.array([len(w) + TILE for _, w in items], np.int64)[item]
        begin = first[doc[tile]] + at[tile]
        near = (doc[tile], item, np.maximum(first[doc[tile]], begin - room), np.minimum(first[doc[tile] + 1], begin + PASSAGE + room))
        for d, k, low, high in _merged(near, _rare_stretches(words, first, *rare)):
            found = leak(items[k][1], words[low:high])
            if found:
                out[d, k] = max(out.get((d, k), (0.0, False)), found)
        return out

    return search


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, list[int]]]]:
    """Items with words, some at a time."""
    block, chars = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL").toLocalIterator():
        words = word_hashes([row.text])[0].tolist()
        if words:
            block.append((row.item_id, words))
            chars += len(row.text)
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, overlap, answer``: documents that hold an item, word for word or paraphrased.

    ``overlap`` is the share of the item's words found in order in one stretch of the document (of twice the item's words
    and 36 more), ``answer`` whether its last words are among them. Case and punctuation do not matter. Rows with one ``doc_id`` count as one document, a
    null id as one more; items that repeat are found each. Null and empty texts and items have no words and match nothing;
    without documents or items the result is empty.
    """
    spark = docs.sparkSession
    words = store_words(id_and_text(docs), "words")
    counts = np.zeros(COUNTED, np.int64)
    for row in bucket_counts(words, COUNTED).toLocalIterator():  # at most a row per bucket
        counts[row.bucket] = row.n
    basis = spark.sparkContext.broadcast((*latent_basis(words), counts))
    schema = "doc_id long, item_id long, overlap double, answer boolean"
    found = spark.createDataFrame([], schema)
    for items in _blocks(benchmark):
        block = spark.sparkContext.broadcast(items)

        def search(batches, block=block):
            return _search(*basis.value, block.value)(batches)

        found = found.unionByName(words.mapInArrow(lean(search), schema))
    return found.groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"), F.bool_or("answer").alias("answer"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose document leaks no item, with all their columns."""
    leaks = find_leaks(docs, benchmark).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("_leak")), "left_anti")
