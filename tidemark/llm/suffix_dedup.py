"""Operator 10, repeated byte strings by hashes over thinned positions, in place of prefix doubling.

Asked for: every start of a string of ``length`` bytes that also starts elsewhere. Doubling over all positions
would shuffle each position several times, many times the size of the text. So positions are
thinned without losing any, and strings are hashed where they stand instead of pairing the ranks of halves:

1. A window of ``length`` bytes is represented by the smallest hash among its substrings of half that length
   (its anchor), which depends on the bytes of the window alone. Starts with one anchor form a run.
2. Ranks are classes of equal strings. A run has the rank of what all its windows share (its core; first
   the anchor, ``length / 2`` bytes) and the rank of what they cover together (its hull). Core unique: none of its
   windows is repeated, the run is dropped. Pair (core, hull) not unique: all of them are, the run is settled.
3. The others, and one witness of each settled pair beside them, are split, with cores that grow towards ``length``: runs, blocks of 16 starts, single
   starts, where core and hull are the string itself, past the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, id_and_text, text_bytes
from tidemark.llm.spans import CHUNK, MULTIPLIERS, between, prefix, sliding_minimum, span_hashes
from tidemark.session import cut_lineage

LENGTH = 400
BLOCK = 16
_KEY = ["doc_id", "text_hash"]
_ROWS = "doc_id long, text_hash long, at long, core long, hull long"


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _runs(buffer: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of starts with one anchor: document, first start, anchor minus start, starts, core and hull hash."""
    half, mult = length // 2, MULTIPLIERS[0]
    width = length - half + 1
    mask = np.uint64((1 << 20) - 1)
    for x in range(0, max(0, len(buffer) - length + 1), CHUNK):
        segment = buffer[x : x + CHUNK + length - 1]
        n = len(segment) - length + 1
        starts = np.arange(x, x + n)
        doc = np.searchsorted(offsets, starts, "right") - 1
        valid = starts + length <= offsets[doc + 1]
        if not valid.any():
            continue
        sums = prefix(segment, mult)
        at = np.arange(n + width - 1)
        grams = between(sums, at, at + half, mult)
        anchor = (sliding_minimum((grams & ~mask) | at.astype(np.uint64), width) & mask).astype(np.int64)
        opens = np.ones(n, bool)
        opens[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(opens)
        last = np.append(first[1:], n) - 1
        keep = valid[first]
        first, last = first[keep], last[keep]
        yield (
            doc[first], x + first - offsets[doc[first]], anchor[first] - first, last - first + 1,
            grams[anchor[first]], between(sums, first, last + length, mult),
        )


def _level0(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buffer, offsets = text_bytes(b.column("text"))
            ids, hashes = b.column("doc_id").to_numpy(), b.column("text_hash").to_numpy()
            for doc, first, ahead, n, core, hull in _runs(buffer, offsets, length):
                yield batch(
                    doc_id=ids[doc], text_hash=hashes[doc], at=(first << 32) | (ahead << 16) | n, core=_signed(core), hull=_signed(hull),
                )

    return rows


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers first[i] .. first[i]+count[i]-1, and i for each of them."""
    owner = np.repeat(np.arange(len(first)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return first[owner] + inside, owner


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values, np.repeat(np.arange(len(column)), sizes)


def _level1(length: int):
    """Blocks of 16 starts, counted backwards from the anchor, that hold starts of open runs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buffer, offsets = text_bytes(b.column("text"))
            ids, hashes = b.column("doc_id").to_numpy(), b.column("text_hash").to_numpy()
            at, doc = _listed(b.column("open"))
            first, ahead, n = at >> 32, (at >> 16) & 0xFFFF, at & 0xFFFF
            nearest, farthest = (ahead - n + 1) // BLOCK, ahead // BLOCK  # distance from start to anchor, in blocks
            block, run = _expand(nearest, farthest - nearest + 1)
            low = (first + ahead)[run] - BLOCK * block - (BLOCK - 1)
            doc = doc[run]
            pairs = np.unique(np.stack([doc, low]), axis=1)
            doc, low = pairs[0], pairs[1]
            high = low + BLOCK - 1
            base, size = offsets[doc], np.diff(offsets)[doc]
            whole = (low >= 0) & (high + length <= size)
            core = span_hashes(buffer, base + high, base + low + length)
            hull = np.zeros(len(core), np.uint64)
            hull[whole] = span_hashes(buffer, (base + low)[whole], (base + high + length)[whole])
            yield batch(
                doc_id=ids[doc], text_hash=hashes[doc], at=low, core=_signed(core),
                hull=pa.array(hull.view(np.int64), mask=~whole),
            )

    return rows


def _level2(length: int):
    """Single starts of open blocks; two hashes of the whole string."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buffer, offsets = text_bytes(b.column("text"))
            ids, hashes = b.column("doc_id").to_numpy(), b.column("text_hash").to_numpy()
            low, doc = _listed(b.column("open"))
            start, block = _expand(low, np.full(len(low), BLOCK))
            doc = doc[block]
            good = (start >= 0) & (start + length <= np.diff(offsets)[doc])
            if not good.any():
                continue
            pairs = np.unique(np.stack([doc[good], start[good]]), axis=1)
            doc, start = pairs[0], pairs[1]
            s = offsets[doc] + start
            yield batch(
                doc_id=ids[doc], text_hash=hashes[doc], at=start, core=_signed(span_hashes(buffer, s, s + length)),
                hull=_signed(span_hashes(buffer, s, s + length, MULTIPLIERS[1])),
            )

    return rows


def _rerank(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose core rank is shared, with ``settled``: whether the pair of ranks is, and ``open``: whether to split them.

    Open are the rows that are not settled and, where a core has several hulls, one row of each settled pair as a
    witness for the open ones. Counts are summed before the shuffle, and stored, so that joins on a very frequent
    rank can be split.
    """
    shared = cut_lineage(rows.groupBy("core").count().filter("count > 1").select("core"), f"{name}-cores")
    left = cut_lineage(rows.join(shared, "core").select(*_KEY, "at", "core", "hull"), f"{name}-left")
    pairs = left.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_KEY, "at")).alias("witness"))
    mixed = pairs.groupBy("core").agg(((F.count(F.lit(1)) > 1) | F.bool_or(F.col("hull").isNull())).alias("mixed"))
    settled = pairs.filter("n > 1 AND hull IS NOT NULL").join(mixed, "core")
    settled = cut_lineage(settled.withColumnsRenamed({"core": "c", "hull": "h"}), f"{name}-pairs")
    joined = left.join(settled, (F.col("core") == F.col("c")) & (F.col("hull") == F.col("h")), "left")
    done = F.col("c").isNotNull()
    witness = F.col("mixed") & (F.struct(*_KEY, "at") == F.col("witness"))
    return cut_lineage(joined.select(*_KEY, "at", done.alias("settled"), (~done | witness).alias("open")), f"{name}-ranked")


def _lists(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy(*_KEY).agg(
        F.collect_list(F.when(F.col("open"), F.col("at"))).alias("open"),
        F.collect_list(F.when(F.col("settled"), F.col("at"))).alias("done"),
    )


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each document with what is known of its repeated starts.

    Columns: ``doc_id`` (null ids as the least long), ``text_hash``, ``n_bytes``, ``sha256`` of the text where nothing is repeated,
    else ``text`` and the lists ``runs``, ``blocks`` and ``starts`` of settled runs, blocks and single starts.
    """
    rows = id_and_text(docs).select(
        F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    runs = _rerank(rows.mapInArrow(_level0(length), _ROWS), "runs")
    joined = rows.join(_lists(runs), _KEY, "left")
    hit = F.col("open").isNotNull()
    base = cut_lineage(joined.select(
        *_KEY, F.octet_length("text").cast("long").alias("n_bytes"), F.when(~hit, F.sha2("text", 256)).alias("sha256"),
        F.when(hit, F.col("text")).alias("text"), "open", F.col("done").alias("runs"),
    ), "hit-texts")
    texts = base.filter("text IS NOT NULL")
    blocks = _rerank(texts.select(*_KEY, "text", "open").mapInArrow(_level1(length), _ROWS), "blocks")
    block_lists = cut_lineage(_lists(blocks), "block-lists")
    open_texts = texts.select(*_KEY, "text").join(block_lists.filter(F.size("open") > 0).select(*_KEY, "open"), _KEY)
    starts = _rerank(open_texts.mapInArrow(_level2(length), _ROWS), "starts").filter("settled")
    start_lists = starts.groupBy(*_KEY).agg(F.collect_list("at").alias("starts"))
    return (
        base.drop("open")
        .join(block_lists.select(*_KEY, F.col("done").alias("blocks")), _KEY, "left")
        .join(start_lists, _KEY, "left")
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (removed runs of bytes as start and end) per row.

    Every byte covered by a repeated string of ``length`` bytes goes, in all places it stands; strings are judged on
    the input. Strings never cross documents. Null and empty texts have no bytes; texts shorter than ``length``
    lose nothing. Rows are documents of their own, also where ``doc_id`` repeats, so repeated rows of ``length`` bytes
    or more vanish wholly; ids may be null. An empty table gives an empty one.
    """
    found = repeated_starts(docs, length)
    empty = F.array().cast("array<long>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            lists = [_listed(b.column(c)) for c in ("runs", "blocks", "starts")]
            cuts = [np.searchsorted(doc, np.arange(b.num_rows + 1)) for _, doc in lists]
            given, known = b.column("text"), b.column("sha256").to_pylist()
            for i in range(b.num_rows):
                if known[i] is not None:
                    out.append((0, known[i], []))
                    continue
                text = np.frombuffer(given[i].as_py().encode(), np.uint8)
                run, block, start = (v[c[i] : c[i + 1]] for (v, _), c in zip(lists, cuts))
                change = np.zeros(len(text) + 1, np.int64)
                for first, n in ((run >> 32, run & 0xFFFF), (block, BLOCK), (start, 1)):
                    np.add.at(change, first, 1)
                    np.add.at(change, first + n - 1 + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                kept = text[~gone].tobytes()
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), edge.tolist()))
            yield batch(
                doc_id=b.column("doc_id"), n_bytes=b.column("n_bytes"), n_removed=pa.array([x[0] for x in out], pa.int64()),
                kept_sha256=pa.array([x[1] for x in out], pa.string()), spans=pa.array([x[2] for x in out], pa.list_(pa.int64())),
            )

    lists = [F.coalesce(c, empty).alias(c) for c in ("runs", "blocks", "starts")]
    kept = found.select("doc_id", "n_bytes", "sha256", "text", *lists).mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, kept_sha256 string, spans array<long>"
    )
    return kept.select(
        F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed",
        (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256", "spans",
    )
