"""From change points to refits: a trigger fires when the scale has moved far enough.

The scale that the next change is compared with moves only when a trigger fires,
a recursion over the flagged rows. It is run block by block: whatever the scale
on entering a block, the first row to fire is a running maximum or minimum of the
block, so a block is summed up by these few rows and the state each leads to. A
pass over the summaries gives every block its entry state, and all blocks then
run at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.groups import map_sorted_groups
from tidemark.session import task_count
from tidemark.spec import SeriesSpec

START_SCALE = 1.0
BASE_MODEL = -1
SEARCH = 256


def fires(scale, old, threshold):
    """Relative deviation above the threshold; never once the old scale is negative."""
    return np.abs(scale - old) / old > threshold


def _next_firing(s: np.ndarray, start: int, old: float, threshold: float) -> int:
    """First index at or after ``start`` that fires against ``old``, else ``len(s)``."""
    if old <= 0:
        return len(s)
    width = SEARCH
    while start < len(s):
        hit = np.flatnonzero(fires(s[start : start + width], old, threshold))
        if len(hit):
            return start + int(hit[0])
        start += width
        width *= 2
    return len(s)


def _outcomes(s: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can be first to fire, and for each the last row to fire after it (itself if none)."""
    if not len(s):
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    highs = np.concatenate([[True], s[1:] > np.maximum.accumulate(s)[:-1]])
    lows = np.concatenate([[True], s[1:] < np.minimum.accumulate(s)[:-1]])
    records = np.flatnonzero(highs | lows)
    ends: dict[int, int] = {}
    for first in records:
        chain, at = [], int(first)
        while at not in ends:
            chain.append(at)
            following = _next_firing(s, at + 1, s[at], threshold)
            if following == len(s):
                ends[at] = at
            else:
                at = following
        for row in chain:
            ends[row] = ends[at]
    return records, np.array([ends[int(r)] for r in records], dtype=int)


def respond(flagged: DataFrame, spec: SeriesSpec, threshold: float | list[float], failed: DataFrame | None = None) -> DataFrame:
    """Triggers and the model in force for every test row.

    Expects ``t, change_point, scale`` for test rows. Adds ``triggered``, ``refit_t``
    (position of the last trigger strictly before the row, -1 for the base model),
    ``scale_old`` (the scale that trigger set, 1 at first) and ``reason`` for change
    points that fire nothing. A list of thresholds is referred to by ``param_id``. Refits known to fail are rows of ``failed``
    (series keys and ``t``): such a trigger fires, but moves neither scale nor model.
    """
    usable = F.col("scale").isNotNull() & ~F.isnan("scale") & (F.abs("scale") != float("inf")) & (F.col("scale") != 0)
    vain = F.lit(False)
    if failed is not None:
        flagged = flagged.join(failed.select(*spec.keys, "t", F.lit(True).alias("_vain")), [*spec.keys, "t"], "left")
        vain = F.coalesce("_vain", F.lit(False))
    rows = (
        flagged.withColumn("_block", F.floor(F.col("t") / spec.block_rows).cast("long"))
        .withColumn("_usable", F.col("change_point") & F.coalesce(usable, F.lit(False)) & ~vain)
    )
    threshold_of = _threshold_lookup(threshold)
    keys = [*spec.keys, "_block"]
    entries = _entry_states(rows, spec, threshold_of)
    if entries is not None:
        rows = rows.join(entries, keys, "left")
    else:
        rows = rows.withColumn("_s_in", F.lit(None).cast("double")).withColumn("_t_in", F.lit(None).cast("long"))
    rows = rows.withColumns(
        {"_s_in": F.coalesce("_s_in", F.lit(START_SCALE)), "_t_in": F.coalesce("_t_in", F.lit(BASE_MODEL).cast("long"))}
    )
    rows = _spread(rows, keys).sortWithinPartitions(*keys, "t")
    kept = [f for f in rows.schema.fields if f.name not in ("_block", "_usable", "_s_in", "_t_in")]
    schema = T.StructType(
        kept
        + [
            T.StructField("triggered", T.BooleanType()),
            T.StructField("refit_t", T.LongType()),
            T.StructField("scale_old", T.DoubleType()),
        ]
    )
    names = [f.name for f in kept]

    def play(group: pd.DataFrame) -> pd.DataFrame:
        t = group["t"].to_numpy()
        usable_rows = np.flatnonzero(group["_usable"].to_numpy(dtype=bool))
        s = group["scale"].to_numpy(dtype=float)[usable_rows]
        old, refit = float(group["_s_in"].iloc[0]), int(group["_t_in"].iloc[0])
        threshold = threshold_of(group)
        triggered = np.zeros(len(t), dtype=bool)
        refits, olds = np.full(len(t), refit), np.full(len(t), old)
        at = _next_firing(s, 0, old, threshold)
        while at < len(s):
            row = usable_rows[at]
            old, refit = s[at], t[row]
            triggered[row] = True
            # in force from the next row on
            refits[row + 1 :], olds[row + 1 :] = refit, old
            at = _next_firing(s, at + 1, old, threshold)
        return group[names].assign(triggered=triggered, refit_t=refits, scale_old=olds)

    out = rows.mapInPandas(lambda batches: map_sorted_groups(batches, keys, play), schema)
    if failed is not None:  # a refit that fails is asked for by the scale in force, and leaves it
        limits = threshold if isinstance(threshold, (list, tuple)) else [threshold]
        which = F.col("param_id") + 1 if isinstance(threshold, (list, tuple)) else F.lit(1)
        limit = F.element_at(F.array(*[F.lit(float(x)) for x in limits]), which)
        moved = F.when(F.col("scale_old") > 0, F.abs(F.col("scale") - F.col("scale_old")) / F.col("scale_old") > limit)
        asked = F.col("_vain").isNotNull() & F.col("change_point") & usable & moved
        out = out.withColumn("triggered", F.col("triggered") | F.coalesce(asked, F.lit(False))).drop("_vain")
    why_not = (
        F.when(F.col("scale").isNull(), "no scale")
        .when(~usable, "unusable scale")
        .when(F.col("scale_old") <= 0, "negative scale in force")
        .otherwise("below threshold")
    )
    return out.withColumn("reason", F.when(F.col("change_point") & ~F.col("triggered"), why_not))


def _spread(rows: DataFrame, keys) -> DataFrame:
    """Rows of one key together, over all tasks (an earlier shuffle on the keys may have been merged into few)."""
    return rows.repartition(task_count(rows), F.xxhash64(*keys))


def _threshold_lookup(threshold):
    if isinstance(threshold, (list, tuple)):
        return lambda rows: threshold[int(rows["param_id"].iloc[0])]
    return lambda rows: threshold


def _entry_states(rows: DataFrame, spec: SeriesSpec, threshold_of) -> DataFrame | None:
    """Scale and trigger in force on entering each block; None while no series has a second block."""
    last = rows.agg(F.max("_block")).first()[0]
    if not last:
        return None
    series = list(spec.keys)
    keys = [*series, "_block"]
    # param_id, where used, is one of the keys
    key_fields = [rows.schema[c] for c in keys]
    summary_schema = T.StructType(
        key_fields
        + [
            T.StructField("record", T.ArrayType(T.DoubleType())),
            T.StructField("scale_after", T.ArrayType(T.DoubleType())),
            T.StructField("t_after", T.ArrayType(T.LongType())),
        ]
    )

    def sum_up(group: pd.DataFrame) -> pd.DataFrame:
        part = group[group["_usable"].to_numpy(dtype=bool)]
        s, t = part["scale"].to_numpy(dtype=float), part["t"].to_numpy()
        records, ends = _outcomes(s, threshold_of(group))
        return group[keys].iloc[:1].assign(
            record=[s[records].tolist()], scale_after=[s[ends].tolist()], t_after=[t[ends].tolist()]
        )

    slim = _spread(rows.select(*keys, "t", "scale", "_usable"), keys).sortWithinPartitions(*keys, "t")
    summaries = slim.mapInPandas(lambda b: map_sorted_groups(b, keys, sum_up), summary_schema)
    entry_schema = T.StructType(
        key_fields + [T.StructField("_s_in", T.DoubleType()), T.StructField("_t_in", T.LongType())]
    )

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, scale, refit = None, START_SCALE, BASE_MODEL
        for batch in batches:
            scales, refits = [], []
            for i, row in enumerate(batch.to_dict("records")):
                key = tuple(row[k] for k in series)
                if key != current:
                    current, scale, refit = key, START_SCALE, BASE_MODEL
                scales.append(scale)
                refits.append(refit)
                threshold = threshold_of(batch.iloc[i : i + 1])
                first = _next_firing(np.asarray(row["record"], dtype=float), 0, scale, threshold)
                if first < len(row["record"]):
                    scale, refit = row["scale_after"][first], row["t_after"][first]
            yield batch[keys].assign(_s_in=scales, _t_in=refits)

    return summaries.repartition(*series).sortWithinPartitions(*keys).mapInPandas(chain, entry_schema)
