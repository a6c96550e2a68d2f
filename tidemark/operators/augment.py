"""Training sets for refits: recent history with its target brought to the new scale."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rand import order_key
from tidemark.functions.resample import interpolate_rare, noise_copies
from tidemark.operators.blocks import last_rows_join
from tidemark.session import task_count
from tidemark.spec import OnlineSpec, SeriesSpec


def history(rows: DataFrame, ends: DataFrame, spec: SeriesSpec, end: str, length: int | None) -> DataFrame:
    """The last ``length`` rows (all without one) up to each end position, as one ordered array ``rows`` per end.

    ``rows`` needs ``t, x, y``; the array is bounded by ``length`` where given.
    """
    groups = [c for c in ends.columns]
    slim = rows.select(*spec.keys, "t", "x", F.col(spec.target).alias("_y"))
    joined = last_rows_join(slim, ends, spec, end, length)
    return joined.groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct("t", "x", F.col("_y").alias("y")))).alias("rows")
    )


def scaled(rows: Column, scale: Column) -> Column:
    """Every target times the scale; features stay."""
    return F.transform(rows, lambda r: F.struct(r["t"].alias("t"), r["x"].alias("x"), (r["y"] * scale).alias("y")))


def last_of(rows: Column, n: int) -> Column:
    return F.slice(rows, F.greatest(F.size(rows) - n + 1, F.lit(1)), n)


def as_arrays(df: DataFrame, rows: str = "rows") -> DataFrame:
    """Flat training arrays ``xs`` (row by row) and ``ys``."""
    return df.withColumn("xs", F.flatten(F.transform(rows, lambda r: r["x"]))).withColumn(
        "ys", F.transform(rows, lambda r: r["y"])
    ).drop(rows)


def augmented(histories: DataFrame, spec: SeriesSpec, online: OnlineSpec | list[OnlineSpec]) -> DataFrame:
    """Augmented training arrays per refit; expects ``rows`` and ``scale``.

    Given a list of settings, the rows name theirs by position in ``param_id``.
    """
    several = isinstance(online, (list, tuple))
    variants = [o.resolved(spec.season) for o in (online if several else [online])]
    first = variants[0]
    recent = last_of(F.col("rows"), first.max_samples)
    shifted = scaled(recent, F.col("scale"))
    doubled = [i for i, o in enumerate(variants) if o.da != "scaled" and o.append == "before"]
    if doubled:
        both = F.concat(recent, shifted)
        shifted = F.when(F.col("param_id").isin(doubled), both).otherwise(shifted) if several else both
    arrays = as_arrays(histories.withColumn("rows", shifted))
    if first.da == "scaled":
        return arrays
    job = [F.col(k) for k in (*spec.keys, "refit_t")]
    seeds = arrays.withColumn("_seed", F.shiftrightunsigned(order_key(first.seed, *job), 1))
    seeds = seeds.repartition(task_count(seeds), F.xxhash64(*job))
    return seeds.mapInPandas(_rebalancer(variants, several), arrays.schema)


def _rebalancer(variants: list[OnlineSpec], several: bool):
    def one(job: dict):
        online = variants[int(job["param_id"]) if several else 0]
        y = np.asarray(job["ys"], dtype=float)
        x = np.asarray(job["xs"], dtype=float).reshape(len(y), -1)
        rng = np.random.default_rng(int(job["_seed"]))
        if online.da == "smogn":
            side = "high" if job["scale"] > 1 else "low"
            return interpolate_rare(x, y, rng, online.rel_thr, online.rel_coef, side, online.under_samp)
        return noise_copies(x, y, rng, online.thr, online.o_perc, online.u_perc)

    def rebalance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [one(job) for job in batch.to_dict("records")]
            yield batch.drop(columns=["_seed"]).assign(xs=[x.ravel() for x, _ in pairs], ys=[y for _, y in pairs])

    return rebalance
