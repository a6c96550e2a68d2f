"""Column-level preparation: types, drops, condensing, encoding, guards."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.spec import DUMMY_PREDICTION, SeriesSpec



def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def zero_if_nan(c: Column) -> Column:
    return F.coalesce(null_if_nan(c), F.lit(0.0))


def set_types(df: DataFrame, strings=(), keep=()) -> DataFrame:
    """Listed columns become strings, every other one but ``keep`` a double; NaN becomes NULL."""

    def typed(field: T.StructField) -> Column:
        c = F.col(field.name)
        if field.name in keep:
            return c
        if field.name in strings:
            return c.cast("string").alias(field.name)
        return null_if_nan(c.cast("double")).alias(field.name)

    return df.select([typed(f) for f in df.schema.fields])


def drop_columns(df: DataFrame, columns=(), containing: str | None = None) -> DataFrame:
    matched = [c for c in df.columns if containing is not None and containing in c]
    return df.drop(*columns, *matched)


def drop_dates(df: DataFrame, spec: SeriesSpec, start: str, end: str | None = None) -> DataFrame:
    """Remove the inclusive date range; days that do not occur are no error."""
    day = F.to_date(spec.ts)
    inside = day >= F.lit(start).cast("date")
    if end is not None:
        inside = inside & (day <= F.lit(end).cast("date"))
    return df.where(~inside)


def condense(df: DataFrame, columns, name: str) -> DataFrame:
    """Sum of the columns (NULL when any is NULL) in place of them."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    return df.withColumn("_sum", total).drop(*columns).withColumnRenamed("_sum", name)


def levels_of(df: DataFrame, columns) -> dict[str, list[str]]:
    """Distinct levels of each column, which become columns; keep them in the configuration for streams."""
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("p")
    ).select("p.*")
    rows = pairs.where(F.col("v").isNotNull()).distinct().orderBy("c", "v").collect()
    return {c: [r.v for r in rows if r.c == c] for c in columns}


def one_hot(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """One 0/1 column per level, named ``column_level``, in place of the column."""
    coded = [
        F.when(F.col(c) == v, 1).otherwise(0).alias(f"{c}_{v}") for c, values in levels.items() for v in values
    ]
    return df.select("*", *coded).drop(*levels)


def drop_null_target(df: DataFrame, target: str = "y") -> DataFrame:
    return df.dropna(subset=[target])


def duplicate_columns(df: DataFrame, order: str, columns=None) -> DataFrame:
    """Columns whose values equal those of an earlier column, as ``(column_name, same_as)``.

    A first aggregate fingerprints every column; only columns with equal
    fingerprints are then compared value by value, in one more aggregate.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c != order] if columns is None else list(columns)
    position = F.col(order)
    prints = df.agg(
        *[F.bit_xor(F.xxhash64(position, F.col(c).cast("string"))).alias(f"_{i}") for i, c in enumerate(columns)]
    ).first()
    types = dict(df.dtypes)
    pairs = [
        (a, b)
        for (i, a), (j, b) in combinations(enumerate(columns), 2)
        if prints[i] == prints[j] and types[a] == types[b]
    ]
    if not pairs:
        return spark.createDataFrame([], "column_name string, same_as string")
    checks = df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    found = F.array(
        *[
            F.struct(F.lit(b).alias("column_name"), F.lit(a).alias("same_as"), F.col(f"_{i}").alias("same"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return (
        checks.select(F.explode(found).alias("f"))
        .select("f.*")
        .where("same")
        .groupBy("column_name")
        .agg(F.min_by("same_as", F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("same_as"))).alias("same_as"))
    )


def has_missing(df: DataFrame, keys, columns) -> DataFrame:
    """Whether any value of the column is NULL or NaN, per key."""
    return df.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.col(c).isNull() | F.isnan(c)), F.lit(False)).alias(f"{c}_missing") for c in columns]
    )


def drop_dummy(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Remove rows with the exported "no prediction" marker."""
    return df.where(F.col(prediction).isNull() | (F.col(prediction) != DUMMY_PREDICTION))
