"""Operator 13, rows into weighted shards by rendezvous hashing.

Each shard draws a number in (0, 1) from the hash of (row key, shard) and bids ``ln(draw) / weight``; the highest bid takes
the row. Key and shard list alone decide, so rows can be placed anywhere without looking at others, a shard gets its share
by weight, and a further shard only takes the rows on which it outbids all others; nothing moves between the old ones.

Null key: hashed like the empty string. Rows with equal keys share a shard. Empty table: no rows. Null text: empty.
Other columns are passed through by ``assign`` and ``write_shards``, which refuse a column named like their result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Rows that one task numbers, on average; the buckets of a shard grow with the table.
ROWS_PER_BUCKET = 100_000
#: A row repeated very often is numbered in parts of this many.
REPEATS_PER_PART = 65_536
#: Hex digits of the hash in a draw: 52 bits fit a double exactly.
_DIGITS = 13


def weights_of(shards: int | Mapping[int, float]) -> dict[int, float]:
    """Weight by shard number; a count means equal weights."""
    weights = dict.fromkeys(range(shards), 1.0) if isinstance(shards, int) else dict(shards)
    if not weights or min(weights.values()) <= 0:
        raise ValueError("at least one shard, with a weight above 0, is needed")
    return weights


def _digest(key: Column, shard: Column) -> Column:
    return F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), shard.cast("string")).cast("binary"))


def rendezvous(key: Column, shards: int | Mapping[int, float]) -> Column:
    """The shard with the highest bid for ``key``; the largest number wins a tie.

    With equal weights the order of the bids is that of the hashes, so these are compared as they are.
    """
    weights = weights_of(shards)
    numbers = F.array(*[F.lit(s) for s in weights])
    if len(set(weights.values())) == 1:
        bids = F.transform(numbers, lambda s: F.struct(_digest(key, s).alias("bid"), s.alias("shard")))
    else:
        weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])

        def bid(s: Column) -> Column:
            drawn = F.conv(F.substring(_digest(key, s), 1, _DIGITS), 16, 10).cast("double")
            return F.log((drawn + 0.5) / F.lit(16.0**_DIGITS)) / weight[s]

        bids = F.transform(numbers, lambda s: F.struct(bid(s).alias("bid"), s.alias("shard")))
    return F.array_max(bids)["shard"].cast("int")


def assign(docs: DataFrame, shards: int | Mapping[int, float], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``docs`` with the column ``shard``; no shuffle."""
    if "shard" in docs.columns:
        raise ValueError("the table has a column shard already")
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return docs.withColumn("shard", rendezvous(F.concat_ws("/", *parts), shards))


def write_shards(docs: DataFrame, path: str, shards: int | Mapping[int, float], keys: Sequence[str] = ("doc_id",)) -> None:
    """One folder of Parquet files per shard; rebalancing by size splits a shard that is too large for one task."""
    assign(docs, shards, keys).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def manifest(docs: DataFrame, shards: int | Mapping[int, float], grown: int | Mapping[int, float], doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` of every row; ``grown_shard`` is its shard under ``grown``.

    Slots count from 0 in each shard without gaps, in the order of a hash of the row. No shard is numbered by one task: rows
    are counted per range of hashes, a prefix sum over a shard's ranges gives each its first slot, and ranges number their
    rows. Equal rows are counted before the shuffle and spread again after. ``size`` is the text's UTF-8 bytes plus 16.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(whole).cast("long") + 16).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"), (F.monotonically_increasing_id() % 64).cast("int").alias("salt"),
    )
    key = ["doc_id", "size", "text_crc32", "salt"]
    distinct = rows.groupBy(*key).agg(F.count("*").alias("repeats"))
    place = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32").cast("binary"))
    buckets = max(1, -(-docs.count() // (len(weights_of(shards)) * ROWS_PER_BUCKET)))
    placed = cut_lineage(distinct.select(
        "*", rendezvous(F.col("doc_id"), shards).alias("shard"), rendezvous(F.col("doc_id"), grown).alias("grown_shard"),
        place.alias("place"), F.shiftright(F.conv(F.substring(place, 1, 8), 16, 10).cast("long") * buckets, 32).alias("bucket"),
    ), "shard-rows")
    sums = placed.groupBy("shard", "bucket").agg(F.sum("repeats").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("place", *key).rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.join(sums, ["shard", "bucket"]).withColumn(
        "first", F.col("first") + F.coalesce(F.sum("repeats").over(inside), F.lit(0))
    )
    last = F.col("first") + F.col("repeats") - 1
    parts = numbered.withColumn("part", F.explode(F.sequence("first", last, F.lit(REPEATS_PER_PART).cast("long"))))
    slots = F.explode(F.sequence("part", F.least(last, F.col("part") + REPEATS_PER_PART - 1)))
    return parts.select("doc_id", "size", "text_crc32", "shard", slots.alias("slot"), "grown_shard")
