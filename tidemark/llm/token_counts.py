"""Operator 7, token counts of documents in flat token files without an index.

A flat file is a stream of packed ids cut into blocks of a fixed size wherever that falls; documents are told
apart by an end id only. Blocks are searched one by one; a prefix scan over the blocks of a file stitches
documents that cross their borders. Blocks are rows of a Parquet table, so any Spark store can hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import _encoder, read_ranks
from tidemark.llm.common import batch, id_and_text, text_slices

END_ID = 50256
BLOCK_IDS = 1 << 16
#: The vocabulary has fewer than 65,536 ids.
ID_TYPE = "<u2"


def flat_files(docs: DataFrame, ranks_path: str, pattern: str, path: str, block_ids: int = BLOCK_IDS) -> None:
    """Encode all texts and write one flat file per input partition: rows ``file, block, payload``.

    A second kind of row (``payload`` null) lists the ``doc_ids`` that went into a block, to label results; the
    scan does not read it.
    """
    table = read_ranks(ranks_path)
    if max(*table.values(), END_ID) > np.iinfo(ID_TYPE).max:
        raise ValueError("the vocabulary does not fit the ids of flat files")
    ranks = docs.sparkSession.sparkContext.broadcast(table)
    size = block_ids * np.dtype(ID_TYPE).itemsize
    schema = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, block, labels, rest = None, TaskContext.get().partitionId(), 0, 0, bytearray()

        def rows(payloads: list[bytes], first: int, ids: list) -> pa.RecordBatch:
            n = len(payloads)
            return pa.RecordBatch.from_arrays([
                pa.array([file] * (n + 1), pa.int32()), pa.array([*range(first, first + n), labels], pa.int64()),
                pa.array([*payloads, None], pa.binary()), pa.array([*[None] * n, ids], pa.list_(pa.int64())),
            ], schema=schema)

        for b in batches:
            encoder = encoder or _encoder(ranks.value, pattern)[1]
            doc_ids = b.column("doc_id").to_pylist()
            for i, j in text_slices(b.column("text")):
                ids, first = encoder.encode(b.column("text").slice(i, j - i))
                rest += np.insert(ids.astype(ID_TYPE), first[1:], END_ID).tobytes()
                full = len(rest) // size
                yield rows([bytes(rest[k * size : (k + 1) * size]) for k in range(full)], block, doc_ids[i:j])
                del rest[: full * size]
                block, labels = block + full, labels + 1
        if rest:
            yield rows([bytes(rest)], block, [])

    spark_schema = "file int, block long, payload binary, doc_ids array<long>"
    id_and_text(docs).mapInArrow(write, spark_schema).write.option("compression", "zstd").parquet(path)


def count_tokens(files: DataFrame, end_id: int = END_ID) -> DataFrame:
    """``file, ordinal, n_tokens``: tokens of each document, without the end id, in order inside its file.

    Tokens after the last end id of a file are a document without end and count as one if there are any. An
    empty document counts 0. An empty table gives no rows; blocks may be of any size and null ones are skipped.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, ID_TYPE) for x in b.column("payload").to_pylist()]
            ends = [np.flatnonzero(x == end_id).tolist() for x in ids]
            yield batch(
                file=b.column("file"), block=b.column("block"), size=pa.array([len(x) for x in ids], pa.int64()),
                ends=pa.array(ends, pa.list_(pa.int64())),
            )

    found = files.filter("payload IS NOT NULL").select("file", "block", "payload").mapInArrow(
        search, "file int, block long, size long, ends array<long>"
    )
    # the prefix scan: where a block starts, how many documents ended before it, and where the last of them did
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block")
    at = found.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    at = at.withColumn("global", F.transform("ends", lambda e: e + F.col("start")))
    at = at.withColumns({
        "done": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
        "carry": F.coalesce(F.max(F.try_element_at("global", F.lit(-1))).over(before), F.lit(-1).cast("long")),
        "last_block": F.lead("block").over(upto).isNull(),
    })
    cuts = F.concat(
        F.array("carry"), "global",
        F.when(
            F.col("last_block") & (F.col("start") + F.col("size") - 1 > F.coalesce(F.get("global", F.size("global") - 1), "carry")),
            F.array(F.col("start") + F.col("size")),
        ).otherwise(F.array().cast("array<long>")),
    )
    counts = at.select("file", "done", F.transform(F.array(cuts), lambda c: F.transform(
        F.slice(c, 2, F.size(c)), lambda e, i: e - F.get(c, i) - 1
    ))[0].alias("counts"))
    return counts.select("file", "done", F.posexplode("counts").alias("i", "n_tokens")).select(
        "file", (F.col("done") + F.col("i")).alias("ordinal"), "n_tokens"
    )


def labels(files: DataFrame) -> DataFrame:
    """``file, ordinal, doc_id`` as written."""
    listed = files.filter("payload IS NULL").select("file", "block", "doc_ids")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = listed.withColumn("done", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0)))
    return placed.select("file", "done", F.posexplode("doc_ids").alias("i", "doc_id")).select(
        "file", (F.col("done") + F.col("i")).alias("ordinal"), "doc_id"
    )
