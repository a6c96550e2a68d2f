"""Semicolon CSV tables with European numbers and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(c: Column) -> Column:
    """Decimal comma or point; true/false count as 1/0; anything else is NULL."""
    text = F.lower(F.trim(c))
    parsed = F.regexp_replace(text, ",", ".").try_cast("double")
    value = F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(parsed)
    return F.when(~F.isnan(value), value)


def day(c: Column) -> Column:
    """``dd.MM.yyyy`` or ``yyyy-MM-dd``."""
    return F.coalesce(
        F.try_to_timestamp(c, F.lit("dd.MM.yyyy")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))
    )


def read_series(
    spark: SparkSession,
    path: str,
    strings=("public_holiday", "school_holiday"),
    index: str | None = None,
    ts: str = "ts",
    key: str | None = None,
    dated: bool = True,
) -> DataFrame:
    """Read files whose first column (or ``index``) is the date.

    Everything is read as text and cast here, so the schema does not depend on the
    data. Without dates the index becomes the integer ``t``. A table without a series
    key gets a constant one.
    """
    raw = spark.read.option("sep", ";").option("header", True).option("inferSchema", False).csv(path)
    index = raw.columns[0] if index is None else index
    position = day(F.col(index)).alias(ts) if dated else F.col(f"`{index}`").cast("long").alias("t")
    values = [c for c in raw.columns if c not in (index, key) and "Unnamed" not in c]
    return raw.select(
        (F.col(key) if key else F.lit("all")).alias("series_id"),
        position,
        *[F.col(f"`{c}`").alias(c) if c in strings else number(F.col(f"`{c}`")).alias(c) for c in values],
    )


def repair_numbers(df: DataFrame, columns=None) -> DataFrame:
    """Turn text columns that hold numbers into doubles."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: number(F.col(c)) for c in (text if columns is None else columns)})


def european(c: Column) -> Column:
    return F.replace(F.format_string("%.10f", c.cast("double")), F.lit("."), F.lit(","))


def write_series(df: DataFrame, path: str) -> None:
    """Semicolon CSV with decimal comma and ten decimals; nested values are written as JSON."""

    def text(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(c.isNotNull(), european(c)).alias(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(c).alias(field.name)
        return c.cast("string").alias(field.name)

    df.select([text(f) for f in df.schema.fields]).write.option("sep", ";").option("header", True).csv(path)


def write_results(df: DataFrame, path: str, run_keys=()) -> None:
    """Result table as parquet, one folder per run key value."""
    df.write.partitionBy(*run_keys).parquet(path)
