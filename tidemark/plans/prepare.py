"""From a raw table to model-ready train and test rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import columns as cols
from tidemark.operators import resample
from tidemark.operators.blocks import with_position
from tidemark.operators.calendar import HOLIDAY, add_calendar
from tidemark.operators.features import add_statistics
from tidemark.operators.impute import impute
from tidemark.operators.splits import TRAIN, split, split_expanding
from tidemark.operators.transforms import pca_fit, pca_transform
from tidemark.session import cut_lineage
from tidemark.spec import DatasetSpec, SeriesSpec

# feature set -> (calendar features, statistical features)
FEATURE_SETS = {"full": (True, True), "cal": (True, False), "stat": (False, True), "none": (False, False)}
STRUCTURE = ("t", "fold", "split", "n_train")
WEEKLY_LAGS = (1, 2)
WEEKLY_WINDOW = 4


def variants(df: DataFrame, dataset: DatasetSpec) -> DataFrame:
    """The raw table and, with a break date, its part before the break, told apart by ``variant``."""
    raw = cols.drop_columns(df, dataset.drop_columns, containing="Unnamed")
    if dataset.drop_from:
        raw = cols.drop_dates(raw, dataset.series, dataset.drop_from)
    out = raw.withColumn("variant", F.lit(dataset.name))
    if dataset.break_date:
        before = cols.drop_dates(raw, dataset.series, dataset.break_date)
        out = out.unionByName(before.withColumn("variant", F.lit(f"{dataset.name}_before_break")))
    return out


def feature_columns(df: DataFrame, spec: SeriesSpec) -> list[str]:
    structure = {*spec.keys, spec.ts, spec.target, *STRUCTURE}
    return [c for c in df.columns if c not in structure]


def prepare(
    df: DataFrame,
    dataset: DatasetSpec,
    featureset: str = "full",
    imputation: str | None = "mean",
    dim_reduction: str | None = None,
    levels: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Impute, derive features, encode, resample, split, impute again and reduce.

    The imputer is fitted on the raw train rows of each fold, so rows are repeated per fold from the start.
    ``levels`` fixes the categories of string columns; without it they are looked up once.
    """
    calendar, statistics = FEATURE_SETS[featureset]
    base = dataset.series
    strings = [c for c in dataset.string_columns if c in df.columns]
    typed = cols.set_types(df, strings, keep=(*base.keys, base.ts))
    # operators that join a table with its own statistics read it twice, so results are stored in between
    raw = cut_lineage(_split(with_position(typed, base), base, dataset), "raw")
    spec = base.with_keys("fold")
    keys = list(spec.keys)
    numeric = [c for c in df.columns if c not in (*base.keys, base.ts, *strings)]
    out = impute(raw, keys, numeric, imputation)
    if dataset.split_perc is None:
        # fold f sees the whole series through the values its train rows imputed
        out = _whole_series_per_fold(out, typed, base, dataset, numeric, imputation, keys)
    out = out.drop("split", "n_train")

    if dataset.features.condense:
        out = cols.condense(out, dataset.features.condense, dataset.features.condensed_name)
    if calendar:
        season = 0 if dataset.weekly else base.season
        out = add_calendar(out, spec, dataset.features.event_lags, dataset.features.special_days, season)
    if statistics and not dataset.weekly:
        out = add_statistics(out, spec, dataset.features)
    encode = [c for c in strings if c in out.columns]
    if featureset == "stat":
        out, encode = out.drop(*[c for c in encode if "_holiday" in c]), []
    if encode:
        out = cols.one_hot(out, cols.levels_of(df, encode) if levels is None else {c: levels[c] for c in encode})
    out = cols.drop_null_target(out, base.target)

    if dataset.weekly:
        out = resample.weekly(out.drop("t"), spec, sums=dataset.targets)
        out = out.drop("cal_date_weekday", "cal_date_day_of_month").dropna()
        out = with_position(cut_lineage(out, "weeks"), replace(spec, step="week"))
        if statistics:
            weekly = replace(
                dataset.features, lags=WEEKLY_LAGS, window=WEEKLY_WINDOW, seasonal_window=WEEKLY_WINDOW, weekday_stats=False
            )
            out = add_statistics(out, replace(spec, season=dataset.model_season), weekly)
    else:
        out = with_position(cut_lineage(out.drop("t"), "features"), spec)
    rivals = [c for c in dataset.targets if c != base.target]
    out = cut_lineage(_split_again(out.drop(*rivals), spec, dataset), "split")
    features = feature_columns(out, spec)
    out = impute(out, keys, features, imputation)
    if dim_reduction is not None:
        out = cut_lineage(out, "complete")
    if dim_reduction == "pca":
        out = pca_transform(out, keys, pca_fit(out, keys, features), features)
    return out


def imputed_split(
    df: DataFrame, spec: SeriesSpec, columns, method: str, share: float | None, initial: int = 0, test: int = 0
) -> DataFrame:
    """Split, then fill each fold with an imputer fitted on its own train rows."""
    return impute(split(df, spec, share, initial, test), [*spec.keys, "fold"], columns, method)


def _split(df: DataFrame, spec: SeriesSpec, dataset: DatasetSpec) -> DataFrame:
    initial, test = dataset.fold_lengths
    return split(df, spec, dataset.split_perc, initial, test)


def _whole_series_per_fold(imputed, typed, spec, dataset, numeric, imputation, keys) -> DataFrame:
    """All rows of the series in every fold, imputed with the statistics of the fold's train rows."""
    initial, test = dataset.fold_lengths
    folds = imputed.select(*keys, "n_train").distinct()
    rows = with_position(typed, spec).join(folds, list(spec.keys))
    marked = rows.withColumn("split", F.when(F.col("t") < F.col("n_train"), TRAIN).otherwise("test"))
    return impute(marked, keys, numeric, imputation)


def _split_again(df: DataFrame, spec: SeriesSpec, dataset: DatasetSpec) -> DataFrame:
    """The same kind of split on the feature table, whose rows may be fewer (weeks, rows without target)."""
    series = replace(spec, keys=spec.keys[:-1])
    if dataset.split_perc is not None:
        return split(df.drop("fold"), series, dataset.split_perc)
    initial, test = dataset.fold_lengths
    if dataset.weekly:
        initial, test = int(initial / 7), int(test / 7)
    n_train = F.lit(initial).cast("long") + F.col("fold") * test
    return (
        df.withColumn("n_train", n_train)
        .withColumn("split", F.when(F.col("t") < F.col("n_train"), TRAIN).when(F.col("t") < F.col("n_train") + test, "test"))
        .where(F.col("split").isNotNull())
    )


def model_rows(prepared: DataFrame, spec: SeriesSpec, features: list[str]) -> DataFrame:
    """Rows as ``t, x, y`` with the features as one array, without rows that miss a feature."""
    complete = prepared.dropna(subset=features)
    return complete.select(
        *spec.keys, *[c for c in STRUCTURE if c in complete.columns], spec.target,
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
    )
