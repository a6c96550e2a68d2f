"""Positions, calendars and block-wise windows.

A window partitioned by the series key alone puts a whole series into one task.
Here a series is cut into blocks of ``spec.block_rows`` consecutive rows; each
block also receives the last ``lookback`` rows of the block before it (the
halo), so any frame with a bounded look-back gives the same values as over the
whole series while one long series spreads over many tasks. Sums over all
earlier rows carry per-block totals instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, task_count
from tidemark.spec import SeriesSpec

CALENDAR_CHUNK = 4_096


def step_index(ts: Column, step: str) -> Column:
    """Number of whole steps since 1970-01-01 (weeks start on Monday)."""
    if step == "hour":
        return F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600).cast("long")
    days = F.unix_date(F.to_date(ts)).cast("long")
    if step == "day":
        return days
    if step == "week":
        return F.floor((days + 3) / 7).cast("long")
    months = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
    if step == "month":
        return months.cast("long")
    return F.floor(months / 3).cast("long")


def step_start(g: Column, step: str) -> Column:
    """First moment of step ``g``, the inverse of :func:`step_index`."""
    if step == "hour":
        return F.timestamp_seconds(g * 3600)
    epoch = F.lit("1970-01-01").cast("date")
    if step == "day":
        return F.date_from_unix_date(g.cast("int")).cast("timestamp")
    if step == "week":
        return F.date_from_unix_date((g * 7 - 3).cast("int")).cast("timestamp")
    factor = 1 if step == "month" else 3
    return F.add_months(epoch, (g * factor).cast("int")).cast("timestamp")


def dense_calendar(df: DataFrame, spec: SeriesSpec, fill: float | None = 0.0) -> DataFrame:
    """One row for every step between the first and last one of each series.

    The position is the distance to the first step, so no sort is needed. The
    calendar is expanded in two levels: chunks first, then the steps of each
    chunk, which lets one very long series expand in many tasks.
    """
    keys = list(spec.keys)
    values = [c for c in df.columns if c not in (*keys, spec.ts)]
    rows = df.withColumn("_g", step_index(F.col(spec.ts), spec.step)).drop(spec.ts)
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "_g")]))
    rows = cut_lineage(rows, "steps")  # read twice, and often a sum over a large table
    bounds = rows.groupBy(*keys).agg(F.min("_g").alias("_lo"), F.max("_g").alias("_hi"))
    chunks = bounds.withColumn(
        "_from", F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.lit(CALENDAR_CHUNK).cast("long")))
    )
    chunks = chunks.repartition(task_count(df), F.xxhash64(*keys, "_from"))
    calendar = chunks.withColumn(
        "_g",
        F.explode(F.sequence(F.col("_from"), F.least(F.col("_hi"), F.col("_from") + (CALENDAR_CHUNK - 1)))),
    ).select(*keys, "_g", (F.col("_g") - F.col("_lo")).alias("t"))
    joined = calendar.join(rows, [*keys, "_g"], "left")
    filled = [F.coalesce(F.col(c), F.lit(fill)).alias(c) if fill is not None else F.col(c) for c in values]
    return joined.select(*keys, step_start(F.col("_g"), spec.step).alias(spec.ts), "t", *filled)


def with_position(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Row position within the series, for tables that may have gaps.

    Rows are numbered inside time buckets; the number of rows in earlier buckets
    is added from a small table of bucket counts.
    """
    keys = list(spec.keys)
    bucket = F.floor(F.unix_seconds(F.col(spec.ts).cast("timestamp")) / spec.bucket_seconds).cast("long")
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(spec.ts)
    return (
        rows.join(offsets, [*keys, "_bucket"])
        .withColumn("t", (F.col("_off") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_bucket", "_off")
    )


def series_lengths(df: DataFrame, spec: SeriesSpec, name: str = "n") -> DataFrame:
    return df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias(name))


def in_blocks(df: DataFrame, spec: SeriesSpec, lookback: int) -> DataFrame:
    """Assign rows to blocks; rows near a block's end are copied into the next one as halo."""
    size = max(spec.block_rows, lookback, 1)
    own = F.floor(F.col("t") / size).cast("long")
    if lookback <= 0:
        return df.withColumn("_block", own).withColumn("_halo", F.lit(False))
    near_end = F.pmod(F.col("t"), F.lit(size)) >= size - lookback
    return df.withColumn(
        "_block", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))
    ).withColumn("_halo", F.col("_block") > own)


def without_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_block", "_halo")


def block_window(spec: SeriesSpec) -> WindowSpec:
    return Window.partitionBy(*spec.keys, "_block").orderBy("t")


def windowed(
    df: DataFrame, spec: SeriesSpec, lookback: int, columns: Callable[[WindowSpec], dict[str, Column]]
) -> DataFrame:
    """Add columns computed over the ordered series; all share one shuffle and one sort.

    ``columns`` gets the window and returns named expressions that look back at
    most ``lookback`` rows.
    """
    blocks = in_blocks(df, spec, lookback)
    added = columns(block_window(spec))
    return without_halo(blocks.select("*", *[c.alias(n) for n, c in added.items()]))


def full_frame(
    value: Column, aggregate: Callable[[Column], Column], window: WindowSpec, n: int, last: int = -1
) -> Column:
    """Aggregate of the ``n`` rows ending ``last`` rows from the current one; NULL unless all are present."""
    frame = window.rowsBetween(last - n + 1, last)
    return F.when(F.count(value).over(frame) == n, aggregate(value).over(frame))


def expanding_moments(df: DataFrame, spec: SeriesSpec, value: str = "y", current: bool = False) -> DataFrame:
    """Count, mean, population and sample deviation of all rows before (or up to) each row.

    Adds ``n_seen, mean_seen, std_pop_seen, std_samp_seen``. Sums are taken around
    the series mean, so that large levels lose no digits; the results do not
    depend on that centre.
    """
    keys = list(spec.keys)
    rows = df.withColumn("_block", F.floor(F.col("t") / spec.block_rows).cast("long"))
    totals = rows.groupBy(*keys, "_block").agg(
        F.count(value).alias("_n"), F.avg(value).alias("_m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("_v")
    )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.col("_m"), F.col("_c")) - F.col("_c")
    carry = (
        totals.withColumn("_c", F.sum(F.col("_n") * F.col("_m")).over(whole) / F.sum("_n").over(whole))
        .withColumn("_d1", F.col("_n") * shift)
        .withColumn("_d2", F.col("_n") * (F.col("_v") + shift * shift))
        .select(
            *keys,
            "_block",
            "_c",
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o) for c, o in (("_n", "_n0"), ("_d1", "_s0"), ("_d2", "_q0"))],
        )
    )
    frame = Window.partitionBy(*keys, "_block").orderBy("t").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    centred = F.col(value) - F.col("_c")
    n, s, q = F.col("_n1"), F.col("_s1"), F.col("_q1")
    spread = F.greatest(q - s * s / n, F.lit(0.0))
    return (
        rows.join(carry, [*keys, "_block"])
        .withColumn("_n1", F.col("_n0") + F.count(value).over(frame))
        .withColumn("_s1", F.col("_s0") + F.coalesce(F.sum(centred).over(frame), F.lit(0.0)))
        .withColumn("_q1", F.col("_q0") + F.coalesce(F.sum(centred * centred).over(frame), F.lit(0.0)))
        .withColumn("n_seen", n)
        .withColumn("mean_seen", F.when(n > 0, F.col("_c") + s / n))
        .withColumn("std_pop_seen", F.when(n > 0, F.sqrt(spread / n)))
        .withColumn("std_samp_seen", F.when(n > 1, F.sqrt(spread / (n - 1))))
        .drop("_block", "_c", "_n0", "_s0", "_q0", "_n1", "_s1", "_q1")
    )


def last_rows_join(
    rows: DataFrame, ends: DataFrame, spec: SeriesSpec, end: str, length: int | None
) -> DataFrame:
    """Range join: for each end position, the up to ``length`` rows of the series ending there.

    Rows are bucketed by ``length`` positions, so an end meets at most two buckets
    and the join is an equi-join on key and bucket, however long the series is. Without
    ``length`` each end meets all rows up to it.
    """
    keys = list(spec.keys)
    if length is None:
        return rows.join(ends, keys).where(F.col("t") <= F.col(end))
    bucket = lambda c: F.floor(c / length).cast("long")
    first = F.greatest(F.col(end) - (length - 1), F.lit(0))
    wanted = ends.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(first), bucket(F.col(end))))))
    return (
        rows.withColumn("_bucket", bucket(F.col("t")))
        .join(wanted, [*keys, "_bucket"])
        .where((F.col("t") <= F.col(end)) & (F.col("t") > F.col(end) - length))
        .drop("_bucket")
    )
