"""Train/test splits as columns of one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rand import order_key
from tidemark.operators.blocks import series_lengths
from tidemark.spec import SeriesSpec

TRAIN, TEST = "train", "test"
CV_FOLDS = 5
CV_TEST_SHARE = 0.2
CV_MIN_ROWS = 30
# Hash buckets used to find the smallest hashes of a series without sorting it.
HASH_BUCKETS = 1_024


def split_percentage(df: DataFrame, spec: SeriesSpec, share: float) -> DataFrame:
    """The first ``floor(n * share)`` rows of each series train; adds ``fold``, ``split`` and ``n_train``."""
    lengths = series_lengths(df, spec, "_n")
    n_train = F.floor(F.col("_n") * share).cast("long")
    return (
        df.join(lengths, list(spec.keys))
        .withColumn("n_train", n_train)
        .withColumn("fold", F.lit(0))
        .withColumn("split", F.when(F.col("t") < F.col("n_train"), TRAIN).otherwise(TEST))
        .drop("_n")
    )


def split_expanding(df: DataFrame, spec: SeriesSpec, initial: int, test: int) -> DataFrame:
    """Expanding time-series split: fold f trains on the first ``initial + f*test`` rows, tests on the next ``test``."""
    lengths = series_lengths(df, spec, "_n")
    last = F.ceil(F.col("_n") / (initial + test)).cast("int") - 1
    n_train = F.least(F.lit(initial) + F.col("fold") * test, F.col("_n"))
    return (
        df.join(lengths, list(spec.keys))
        .withColumn("fold", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("n_train", n_train.cast("long"))
        .withColumn(
            "split",
            F.when(F.col("t") < F.col("n_train"), TRAIN).when(F.col("t") < F.col("n_train") + test, TEST),
        )
        .where(F.col("split").isNotNull())
        .drop("_n")
    )


def split(df: DataFrame, spec: SeriesSpec, share: float | None, initial: int = 0, test: int = 0) -> DataFrame:
    """Percentage split when a share is given, else the expanding split."""
    return split_percentage(df, spec, share) if share else split_expanding(df, spec, initial, test)


def smallest_by_hash(df: DataFrame, keys, wanted: Column, hash_col: Column, name: str) -> DataFrame:
    """Flag the ``wanted`` rows with the smallest hashes of each group, without sorting the group.

    Counting hash buckets tells in which bucket the last wanted row lies; only
    that bucket is ranked.
    """
    keys = list(keys)
    rows = df.withColumn("_h", hash_col).withColumn("_hb", F.shiftrightunsigned("_h", 54).cast("int"))
    counts = rows.groupBy(*keys, "_hb").agg(F.count(F.lit(1)).alias("_c"), F.first(wanted).alias("_w"))
    before = Window.partitionBy(*keys).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.select(
        *keys, "_hb", "_w", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), "_c"
    )
    inside = Window.partitionBy(*keys, "_hb").orderBy(F.shiftrightunsigned("_h", 1), "t")
    return (
        rows.join(cut, [*keys, "_hb"])
        .withColumn("_rank", F.row_number().over(inside))
        .withColumn(name, F.col("_off") + F.col("_rank") <= F.col("_w"))
        .drop("_h", "_hb", "_w", "_off", "_c", "_rank")
    )


def split_shuffled(
    df: DataFrame, spec: SeriesSpec, folds: int = CV_FOLDS, test_share: float = CV_TEST_SHARE, seed: int = 0
) -> DataFrame:
    """Random splits: in each fold ``ceil(n * test_share)`` rows test. Series under 30 rows get none."""
    lengths = series_lengths(df, spec, "_n")
    rows = (
        df.join(lengths, list(spec.keys))
        .where(F.col("_n") >= CV_MIN_ROWS)
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    )
    h = order_key(seed, F.col("fold"), *[F.col(k) for k in spec.keys], F.col("t"))
    chosen = smallest_by_hash(rows, [*spec.keys, "fold"], F.ceil(F.col("_n") * test_share), h, "_test")
    return chosen.withColumn("split", F.when(F.col("_test"), TEST).otherwise(TRAIN)).drop("_test", "_n")
