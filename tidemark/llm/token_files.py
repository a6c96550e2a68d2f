"""Operator 9, token ids as Parquet list columns that can be read in part.

Ids are written in ascending document order with an end id each; values are delta encoded, row groups and
pages are small, and Parquet's page indexes let a reader fetch a range of documents, or the metadata alone.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import PartEncoder, batch, id_and_text, lean, text_slices, worker_store

END_ID = 0
#: Text that is encoded at once, and words that the library gets in a row.
SLICE_BYTES, ROW_WORDS = 2 << 20, 256
_WORD = re.compile(r" [^\s\x85\u200b]+").fullmatch
#: Row groups of 16 MB and pages of 64 KB; the column index is written by default.
WRITE_OPTIONS = {
    "parquet.block.size": str(16 << 20), "parquet.page.size": str(64 << 10), "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true", "compression": "zstd",
}


def library_encoder(json_text: str) -> PartEncoder:
    """Ids by the ``tokenizers`` library, as it gives them without adding special tokens; those that a text spells out count.

    The tokenizer must split as byte-level BPE does: before a blank that follows a non-blank, whatever stands around.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    store = worker_store("library")
    if store.get("json") != json_text:
        store.clear()
        model = Tokenizer.from_str(json_text)
        store["json"], store["model"] = json_text, model
        # bytes of every token: byte-level tokens have a sign per byte, added ones are written out
        sizes = np.zeros(model.get_vocab_size(), np.int64)
        for token, number in model.get_vocab().items():
            sizes[number] = len(token)
        for number, token in model.get_added_tokens_decoder().items():
            sizes[number] = len(token.content.encode())
        store["sizes"] = sizes
    model, sizes = store["model"], store["sizes"]

    def alone(parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in model.encode_batch_fast(parts, add_special_tokens=False)]

    def together(parts: list[str]) -> list[bytes]:
        """Parts that begin with a blank and hold no other white space: encoded in a row, then cut where their bytes end."""
        ids = np.array(model.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(p.encode()) for p in parts])
        cuts = np.searchsorted(np.cumsum(sizes[ids]), ends) + 1
        if len(ids) < cuts[-1] or (np.cumsum(sizes[ids])[cuts - 1] != ends).any():  # another kind of tokenizer
            return alone(parts)
        raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [raw[x:y] for x, y in zip(at[:-1], at[1:])]

    def encode_all(parts: list[str]) -> list[bytes]:
        found: dict[str, bytes] = {}
        words = [p for p in parts if _WORD(p)]
        for i in range(0, len(words), ROW_WORDS):
            found.update(zip(words[i : i + ROW_WORDS], together(words[i : i + ROW_WORDS])))
        others = [p for p in parts if p not in found]
        for i in range(0, len(others), 1024):
            found.update(zip(others[i : i + 1024], alone(others[i : i + 1024])))
        return [found[p] for p in parts]

    return PartEncoder(store, encode_all)


def tokenize(docs: DataFrame, json_path: str, end_id: int | None = END_ID) -> DataFrame:
    """``doc_id`` and ``ids array<int>`` of each whole text, with the end id appended; null and empty texts have only that.

    The tokenizer file (a fixed vocabulary of a few MB) is read once on the driver and broadcast.
    """
    with open(json_path) as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or library_encoder(model.value)
            for i, j in text_slices(b.column("text"), most_bytes=SLICE_BYTES):
                ids, first = encoder.encode(b.column("text").slice(i, j - i))
                if end_id is not None:
                    ids, first = np.insert(ids, first[1:], end_id), first + np.arange(j - i + 1)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.view("<i4")))
                yield batch(doc_id=b.column("doc_id").slice(i, j - i), ids=lists)

    return id_and_text(docs).mapInArrow(lean(encode, "library"), "doc_id long, ids array<int>")


def write_tokens(docs: DataFrame, json_path: str, path: str, end_id: int = END_ID) -> None:
    """Write the ids in ascending order of ``doc_id``; files hold consecutive ranges, named by ``part``.

    Null ids come first; rows of one ``doc_id`` are ordered by text. An empty table gives files without rows.
    """
    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    tokens = tokenize(ordered, json_path, end_id).withColumn("n_tokens", F.size("ids").cast("long"))
    numbered = tokens.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "*")
    numbered.write.options(**WRITE_OPTIONS).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``part, row, doc_id, start, n_tokens`` from the metadata columns alone; ``start`` counts the ids of all documents before."""
    meta = spark.read.parquet(path).select("part", "row", "doc_id", "n_tokens")
    sums = meta.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    running = meta.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return running.join(offsets, "part").select("part", "row", "doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens")


def read_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """``doc_id, ids`` of the documents ``first`` to ``last``; statistics of files, row groups and pages skip the others."""
    return spark.read.parquet(path).where(F.col("doc_id").between(first, last)).select("doc_id", "ids")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``part, row`` and the crc32 of each document's ids as little-endian 32-bit numbers, read from the files."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            ends = ids.offsets.to_numpy()
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).view(np.uint8)
            sums = [zlib.crc32(flat[4 * a : 4 * e]) for a, e in zip(ends[:-1], ends[1:])]
            yield batch(part=b.column("part"), row=b.column("row"), ids_crc32=pa.array(sums, pa.int64()))

    return spark.read.parquet(path).select("part", "row", "ids").mapInArrow(crc, "part int, row long, ids_crc32 long")
