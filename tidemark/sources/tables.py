"""Series built from relational tables by plain aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.blocks import dense_calendar
from tidemark.session import cut_lineage
from tidemark.spec import SeriesSpec

MONTHLY = SeriesSpec(season=12, step="month")
DAILY = SeriesSpec(season=7, step="day")
HOURLY = SeriesSpec(season=24, step="hour")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def supplier_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity shipped per supplier and month; the number of series grows with the tables.

    Stored, because plans read it several times and each reader would sum up all of ``lineitem`` again.
    """
    raw = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").cast("string").alias("series_id"), F.date_trunc("month", "l_shipdate").alias("ts"))
        .agg(F.sum("l_quantity").alias("y"))
    )
    return cut_lineage(dense_calendar(raw, MONTHLY), "supplier-months")


def revenue_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Order value per market segment and month."""
    raw = (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("series_id"), F.date_trunc("month", "o_orderdate").alias("ts"))
        .agg(F.sum("o_totalprice").alias("y"))
    )
    return dense_calendar(raw, MONTHLY)


def orders_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per priority and day, with three public holidays a year."""
    raw = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.date_trunc("day", "o_orderdate").alias("ts"))
        .agg(F.count(F.lit(1)).cast("double").alias("y"))
    )
    md = F.date_format("ts", "MM-dd")
    holiday = F.when(md == "01-01", "NewYear").when(md == "05-01", "MayDay").when(md == "12-25", "Christmas")
    return dense_calendar(raw, DAILY).withColumn("public_holiday", F.coalesce(holiday, F.lit("no")))


def shipments_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity shipped per return flag and day."""
    raw = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series_id"), F.date_trunc("day", "l_shipdate").alias("ts"))
        .agg(F.sum("l_quantity").alias("y"))
    )
    return dense_calendar(raw, DAILY)


def events_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Events per type and hour: ``y`` the number, ``v`` the mean and ``w`` the largest value.

    ``v`` and ``w`` are missing in hours without events and, by a fixed rule on the
    position, in some more.
    """
    raw = (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.count(F.lit(1)).cast("double").alias("y"), F.avg("value").alias("v"), F.max("value").alias("w"))
    )
    dense = dense_calendar(raw, HOURLY, fill=None)
    return dense.select(
        "series_id", "ts", "t", F.coalesce("y", F.lit(0.0)).alias("y"),
        F.when(F.col("t") % 17 != 3, F.col("v")).alias("v"),
        F.when(F.col("t") % 13 != 5, F.col("w")).alias("w"),
    )
