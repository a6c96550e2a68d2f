"""Operator 6, line dedup: hashes dealt by range, sorted by document and position, and keep bitmaps as the result.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, id_and_text, lower_ascii
from tidemark.session import cut_lineage

MIN_CHARS = 40
MIN_DOCS = 5
#: A line found in very many documents is dealt over so many parts.
SALTS = 256


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _row_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_hash", F.xxhash64("text"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document that loses lines: ``n_dropped`` and ``keep``, the changed 64-line words of its keep bitmap.

    A word that is not listed is all ones. A key of ``min_chars`` code points or more found in
    ``min_docs`` documents or more keeps the lines of the largest ``doc_id`` that holds it.
    Rows with the same ``doc_id`` count as one document; where their texts differ each has a
    bitmap of its own (``text_hash``). Rows without ``doc_id`` are left alone and not counted.
    Null and empty texts have one empty line; an empty table gives an empty result.
    """
    rows = _row_key(id_and_text(docs)).filter(F.col("doc_id").isNotNull())
    key = line_key(F.col("line"))
    lines = (
        rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .filter(F.length("line") >= min_chars)
        .select("doc_id", "text_hash", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        .select(
            F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"),
            F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), "doc_id", "text_hash", "pos",
        )
    )
    part = ["h1", "h2", "salt"]
    # the range partitioning already clusters by the window's key: rows stream by, sorted within each task
    ranged = lines.repartitionByRange(*part)
    w = Window.partitionBy(*part).orderBy(F.col("doc_id").desc(), "pos", "text_hash")
    marks = ranged.withColumn("first_of_doc", F.coalesce(F.lag("doc_id").over(w) != F.col("doc_id"), F.lit(True)))
    marks = cut_lineage(marks, "line-marks")
    salted = marks.groupBy(*part).agg(F.sum(F.col("first_of_doc").cast("long")).alias("n"), F.max("doc_id").alias("last"))
    frequent = (
        salted.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.max("last").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
    )
    rules = salted.select(*part).join(frequent.select("h1", "h2", "keeper"), ["h1", "h2"])
    dropped = marks.join(rules, part).filter(F.col("doc_id") != F.col("keeper"))
    words = (
        dropped.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("gone"))
    )
    return words.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"),
    )


def _dense(keep: Column) -> Column:
    """The words of the bitmap from the first to the last changed one."""
    return F.flatten(F.transform(keep, lambda x, i: F.concat(
        F.array_repeat(F.lit(-1).cast("long"), x["word"] - F.when(i == 0, 0).otherwise(F.get(keep, i - 1)["word"] + 1)),
        F.array(x["bits"]),
    )))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` without the dropped lines, ``n_lines`` before and ``n_dropped``."""
    rows = _row_key(id_and_text(docs))
    joined = rows.join(bitmaps, ["doc_id", "text_hash"], "left").withColumn(
        "dense", F.when(F.col("keep").isNotNull(), F.transform(F.array("keep"), _dense)[0])
    )
    kept = F.transform(F.array("dense"), lambda d: F.array_join(F.filter(
        F.split("text", "\n"),
        lambda line, i: F.getbit(F.coalesce(F.get(d, F.floor(i / 64).cast("int")), F.lit(-1).cast("long")), i % 64) == 1,
    ), "\n"))[0]
    return joined.select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept).alias("text"),
        (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The table with lines dropped from ``text``; other columns stay as they are, null text stays null."""
    names = docs.columns
    bitmaps = keep_bitmaps(docs, min_chars, min_docs).select(
        F.col("doc_id").alias("_bm_id"), F.col("text_hash").alias("_bm_hash"), F.col("keep").alias("_bm_keep")
    )
    rows = docs.withColumn("_bm_row", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = rows.join(bitmaps, (F.col("doc_id") == F.col("_bm_id")) & (F.col("_bm_row") == F.col("_bm_hash")), "left")
    lines = F.split("text", "\n")
    kept = F.transform(F.array(F.transform(F.array("_bm_keep"), _dense)[0]), lambda d: F.array_join(F.filter(
        lines, lambda line, i: F.getbit(F.coalesce(F.get(d, F.floor(i / 64).cast("int")), F.lit(-1).cast("long")), i % 64) == 1,
    ), "\n"))[0]
    text = F.when(F.col("_bm_keep").isNull(), F.col("text")).otherwise(kept)
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in names))
