"""Missing-value imputation fitted per series on train rows.

Only columns with a missing value in the train rows of a series are filled, as
in a per-series fit; others keep their missing values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.rand import normal
from tidemark.operators.quantiles import exact_quantile
from tidemark.operators.splits import TRAIN

# Most cells per axis of the neighbour grid, by the number of axes (three and more: the last).
CELLS_PER_AXIS = (256, 64, 16)
# Donors at one point are thinned in this many parts before they are ranked together.
POINT_SALTS = 64


def is_train(df: DataFrame) -> Column:
    return F.col("split") == TRAIN if "split" in df.columns else F.lit(True)


def impute_mean(df: DataFrame, keys, columns, fitted_on: DataFrame | None = None) -> DataFrame:
    """Train means of each series, taken from ``fitted_on`` when given."""
    source = df if fitted_on is None else fitted_on
    stats = source.where(is_train(source)).groupBy(*keys).agg(
        *[F.when(F.count(c) < F.count(F.lit(1)), F.avg(c)).alias(f"_f_{c}") for c in columns]
    )
    return _fill(df, stats, keys, columns)


def impute_median(df: DataFrame, keys, columns) -> DataFrame:
    """Exact medians of the train rows; the columns are ranked together in long form."""
    keys = list(keys)
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns])
    long = df.where(is_train(df)).select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.c", "p.v")
    holes = long.groupBy(*keys, "c").agg((F.count("v") < F.count(F.lit(1))).alias("_holes"))
    medians = exact_quantile(long, [*keys, "c"], "v", 0.5, "_median").join(holes.where("_holes"), [*keys, "c"])
    stats = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("c") == c, F.col("_median"))).alias(f"_f_{c}") for c in columns]
    )
    return _fill(df, stats, keys, columns)


def _fill(df: DataFrame, stats: DataFrame, keys, columns) -> DataFrame:
    filled = {c: F.coalesce(F.col(c), F.col(f"_f_{c}")) for c in columns}
    return df.join(stats, list(keys), "left").withColumns(filled).select(*df.columns)


def impute_knn(df: DataFrame, keys, columns, k: int = 10) -> DataFrame:
    """Mean of the ``k`` nearest train rows that have the value.

    Distances use the coordinates both rows have, scaled up by the share present.
    Ties go to the earlier row; without any comparable donor the column mean is
    used. Donors lie in grid cells with known bounding boxes and counts. For each
    row to fill, the cells that can hold one of its k nearest donors follow
    exactly from the boxes, and only their donors are compared.
    """
    keys, columns = list(keys), list(columns)
    out = df
    for c in columns:
        others = [o for o in columns if o != c]
        if others:
            filled = _knn_column(df, keys, c, others, k)
            out = out.join(filled, [*keys, "t"], "left").withColumn(c, F.coalesce(c, "_knn")).drop("_knn")
    return impute_mean(out, keys, columns, fitted_on=df)


def _all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _pattern(others) -> Column:
    """Which coordinates a row has, as 0/1 text."""
    return F.concat(*[F.when(F.col(o).isNotNull(), "1").otherwise("0") for o in others])


def _total(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _knn_column(df: DataFrame, keys, c: str, others, k: int) -> DataFrame:
    d = len(others) + 1  # number of coordinates including the one to fill
    donors = df.where(is_train(df) & F.col(c).isNotNull() & ~_all_of(F.col(o).isNull() for o in others))
    most = CELLS_PER_AXIS[min(len(others), len(CELLS_PER_AXIS)) - 1]
    shape = donors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.percentile_approx(o, [i / most for i in range(1, most)], 1_000).alias(f"_cut_{o}") for o in others],
    )
    # about sqrt(n) cells of about sqrt(n) donors, cut at quantiles so that outliers do not crowd the rest
    axis = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.pow(F.col("_n"), 0.5 / len(others)))))

    def cell_part(o: str) -> Column:
        below = F.size(F.filter(F.col(f"_cut_{o}"), lambda cut: cut < F.col(o)))
        place = F.floor(below * F.col("_axis") / most).cast("string")
        return F.when(F.col(o).isNull(), "-").otherwise(place)

    placed = donors.join(shape.withColumn("_axis", axis), keys).withColumn(
        "_cell", F.concat_ws(",", *[cell_part(o) for o in others])
    )
    # Of donors at the very same point only the k earliest can ever be chosen.
    point = [*keys, "_cell", *others]
    for part in ([F.pmod("t", F.lit(POINT_SALTS))], []):
        rank = F.row_number().over(Window.partitionBy(*point, *part).orderBy("t"))
        placed = placed.withColumn("_same", rank).where(F.col("_same") <= k)
    placed = placed.select(
        *keys, "_cell", F.col("t").alias("_dt"), F.col(c).alias("_dv"), *[F.col(o).alias(f"_d_{o}") for o in others]
    )
    cells = placed.groupBy(*keys, "_cell").agg(
        F.count(F.lit(1)).alias("_cn"),
        *[F.min(f"_d_{o}").alias(f"_bl_{o}") for o in others],
        *[F.max(f"_d_{o}").alias(f"_bh_{o}") for o in others],
    )
    has_holes = df.where(is_train(df)).groupBy(*keys).agg((F.count(c) < F.count(F.lit(1))).alias("_holes")).where("_holes")
    receivers = (
        df.where(F.col(c).isNull()).join(has_holes, keys, "left_semi").select(*keys, "t", *others)
    )
    # Equal receivers share one search.
    points = receivers.where(~_all_of(F.col(o).isNull() for o in others)).select(*keys, *others).distinct()

    both = {o: F.col(o).isNotNull() & F.col(f"_bl_{o}").isNotNull() for o in others}
    shared = _total(F.when(both[o], 1).otherwise(0) for o in others)
    near = {o: F.greatest(F.col(f"_bl_{o}") - F.col(o), F.col(o) - F.col(f"_bh_{o}"), F.lit(0.0)) for o in others}
    far = {o: F.greatest(F.abs(F.col(o) - F.col(f"_bl_{o}")), F.abs(F.col(o) - F.col(f"_bh_{o}"))) for o in others}
    square = lambda parts: _total(F.when(both[o], parts[o] * parts[o]).otherwise(0.0) for o in others) * d / shared
    met = (
        points.join(cells, keys)
        .where(shared > 0)
        .withColumns({"_near": square(near), "_far": square(far)})
    )
    by_far = Window.partitionBy(*keys, *others).orderBy("_far")
    reach = Window.partitionBy(*keys, *others)
    needed = (
        met.withColumn("_upto", F.sum("_cn").over(by_far.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cn"))
        # the smallest radius certain to enclose k donors; rounding gets a little room
        .withColumn("_radius", F.max(F.when(F.col("_upto") < k, F.col("_far"))).over(reach))
        .where(F.col("_near") <= F.col("_radius") * (1 + 1e-9))
        .select(*keys, *others, "_cell")
    )
    seen = {o: F.col(o).isNotNull() & F.col(f"_d_{o}").isNotNull() for o in others}
    common = _total(F.when(seen[o], 1).otherwise(0) for o in others)
    gap = lambda o: F.col(o) - F.col(f"_d_{o}")
    distance = _total(F.when(seen[o], gap(o) * gap(o)).otherwise(0.0) for o in others) * d / common
    best = (
        needed.join(placed, [*keys, "_cell"])
        .withColumn("_dist", distance)
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, *others).orderBy("_dist", "_dt")))
        .where(F.col("_rank") <= k)
        .groupBy(*keys, *others)
        .agg(F.avg("_dv").alias("_knn"))
    )
    best = best.select(*[F.col(x).alias(f"_b_{x}") for x in (*keys, *others)], "_knn")
    same_point = [F.col(o).eqNullSafe(F.col(f"_b_{o}")) for o in others] + [F.col(x) == F.col(f"_b_{x}") for x in keys]
    return receivers.join(best, _all_of(same_point)).select(*keys, "t", "_knn")


def impute_iterative(
    df: DataFrame,
    keys,
    columns,
    rounds: int = 100,
    sample: bool = True,
    minimum: float | None = 0.0,
    seed: int = 0,
    tolerance: float = 1e-8,
) -> DataFrame:
    """Multivariate imputation: each column regressed on the others, iterated to a fixed point.

    With linear regressions, all an iteration needs from the data are the counts,
    sums and cross products of the rows with each pattern of missing columns. One
    aggregate collects them; the rounds then run on these small matrices, one
    series per row, and one pass fills the table. With ``sample`` the filled value
    is drawn around the regression with its residual deviation.
    """
    keys, columns = list(keys), list(columns)
    p = len(columns)
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    train = df.where(is_train(df))
    # centre on train means so that cross products keep their digits
    centres = train.groupBy(*keys).agg(
        F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in columns]).alias("centre"),
        F.array(*[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)) for c in columns]).alias("scale"),
        F.array(*[F.count(c) < F.count(F.lit(1)) for c in columns]).alias("holes"),
    )
    z = [(F.col(c) - F.col("centre")[i]) / F.col("scale")[i] for i, c in enumerate(columns)]
    z = [F.coalesce(v, F.lit(0.0)) for v in z]
    patterns = (
        train.join(centres, keys)
        .withColumn("pattern", _pattern(columns))
        .withColumn("z", F.array(*z))
        .groupBy(*keys, "pattern")
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.array(*[F.sum(F.col("z")[i]) for i in range(p)]).alias("s"),
            F.array(*[F.sum(F.col("z")[i] * F.col("z")[j]) for i, j in cells]).alias("q"),
        )
    )
    # at most 2^p patterns per series
    stats = patterns.groupBy(*keys).agg(
        F.collect_list("pattern").alias("pattern"), F.collect_list("n").alias("n"),
        F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("q")).alias("q"),
    )
    schema = T.StructType(
        [stats.schema[x] for x in keys]
        + [T.StructField("mu", T.ArrayType(T.DoubleType())), T.StructField("cov", T.ArrayType(T.DoubleType()))]
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mus, covs = [], []
            for names, n, s, q in zip(batch["pattern"], batch["n"], batch["s"], batch["q"]):
                mu, cov = _gaussian_fit(list(names), np.asarray(n), np.asarray(s).reshape(-1, p),
                                        np.asarray(q).reshape(-1, len(cells)), cells, p, rounds, tolerance)
                mus.append(mu)
                covs.append(cov.ravel())
            yield batch[keys].assign(mu=mus, cov=covs)

    model = stats.mapInPandas(solve, schema).join(centres, keys)
    # Regressions are wanted per series and pattern: few rows, found once, joined back.
    wanted = df.where(~_all_of(F.col(c).isNotNull() for c in columns)).select(*keys, _pattern(columns).alias("pattern")).distinct()
    plans = wanted.join(model, keys)
    plan_schema = T.StructType(
        [wanted.schema[x] for x in keys]
        + [T.StructField("pattern", T.StringType()),
           T.StructField("weights", T.ArrayType(T.DoubleType())),
           T.StructField("offset", T.ArrayType(T.DoubleType())),
           T.StructField("noise", T.ArrayType(T.DoubleType())),
           T.StructField("holes", T.ArrayType(T.BooleanType()))]
    )

    def regressions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weights, offsets, noises = [], [], []
            for row in batch.itertuples():
                w, b, e = _regress(row.pattern, np.asarray(row.mu), np.asarray(row.cov).reshape(p, p))
                centre, scale = np.asarray(row.centre), np.asarray(row.scale)
                w = w * scale[:, None] / scale[None, :]
                weights.append(w.ravel())
                offsets.append(b * scale + centre - w @ centre)
                noises.append(e * scale)
            yield batch[[*keys, "pattern"]].assign(weights=weights, offset=offsets, noise=noises, holes=batch["holes"])

    fills = plans.mapInPandas(regressions, plan_schema)
    rows = df.withColumn("pattern", _pattern(columns)).join(fills, [*keys, "pattern"], "left")
    filled = {}
    for i, c in enumerate(columns):
        value = F.col("offset")[i]
        for j, o in enumerate(columns):
            value = value + F.col("weights")[i * p + j] * F.coalesce(F.col(o), F.lit(0.0))
        if sample:
            draw = normal(seed, *[F.col(x) for x in keys], F.col("t"), F.lit(c))
            value = value + F.col("noise")[i] * draw
        if minimum is not None:
            value = F.greatest(value, F.lit(float(minimum)))
        filled[c] = F.coalesce(F.col(c), F.when(F.col("holes")[i], value))
    return rows.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def _regress(pattern: str, mu: np.ndarray, cov: np.ndarray):
    """Weights, offset and residual deviation of the missing columns given the present ones."""
    p = len(mu)
    have = np.array([c == "1" for c in pattern])
    weights, offset, noise = np.zeros((p, p)), np.zeros(p), np.zeros(p)
    lost = ~have
    if have.any():
        ridge = cov[np.ix_(have, have)] + 1e-6 * np.eye(have.sum())
        weights[np.ix_(lost, have)] = np.linalg.solve(ridge, cov[np.ix_(have, lost)]).T
    offset[lost] = (mu - weights @ mu)[lost]
    rest = cov - weights @ cov
    noise[lost] = np.sqrt(np.clip(np.diag(rest)[lost], 0, None))
    return weights, offset, noise


def _gaussian_fit(names, n, s, q, cells, p, rounds, tolerance):
    """Mean and covariance at which every column's regression on the others reproduces itself."""
    mu, cov = np.zeros(p), np.eye(p)
    total = n.sum()
    for _ in range(rounds):
        first, second = np.zeros(p), np.zeros((p, p))
        for name, count, sums, products in zip(names, n, s, q):
            have = np.array([c == "1" for c in name])
            cross = np.zeros((p, p))
            for (i, j), v in zip(cells, products):
                cross[i, j] = cross[j, i] = v
            weights, offset, _ = _regress(name, mu, cov)
            # completed row = A x + b, with x zero where missing
            a = np.diag(have.astype(float)) + weights
            rest = np.zeros((p, p))
            lost = ~have
            residual = cov - weights @ cov
            rest[np.ix_(lost, lost)] = residual[np.ix_(lost, lost)]
            first += a @ sums + count * offset
            mixed = np.outer(a @ sums, offset)
            second += a @ cross @ a.T + mixed + mixed.T + count * (np.outer(offset, offset) + rest)
        new_mu = first / total
        new_cov = second / total - np.outer(new_mu, new_mu)
        moved = max(np.abs(new_mu - mu).max(), np.abs(new_cov - cov).max())
        mu, cov = new_mu, new_cov
        if moved < tolerance:
            break
    return mu, cov


def impute(df: DataFrame, keys, columns, method: str | None) -> DataFrame:
    if method is None:
        return df
    methods = {"mean": impute_mean, "median": impute_median, "knn": impute_knn, "iterative": impute_iterative}
    if method not in methods:
        raise ValueError(f"unknown imputation {method!r}")
    return methods[method](df, keys, columns)
