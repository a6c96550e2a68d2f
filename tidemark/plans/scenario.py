"""What-if backtests: scale ramps injected into real series, over many scenarios and settings."""

from __future__ import annotations

import math
import random
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.config import explode_config
from tidemark.operators.metrics import rmse, rmse_ratio
from tidemark.operators.transforms import ramp_factor, ramp_feasible
from tidemark.plans.online import BASE, ONLINE, run_online
from tidemark.spec import GPSpec, OnlineSpec, SeriesSpec

SCENARIO_SCHEMA = "scenario_id int, name string, start_off bigint, end_off bigint, slope double, max_factor double"

# Ramp speeds and sizes of the scenarios.
SLOW, FAST = 0.1, 0.25
SMALL, BIG, BIG_SHORT_SEASON, DECREASE = 1.5, 2.5, 2.0, 0.5
SHORT_SEASON = 20

# The named scenarios, as window -> speed and size.
FULL_RANGE = ("slow_inc+small", "slow_inc+big", "fast_inc+small", "fast_inc+big", "slow_dec+big")
HALF_RANGE = ("slow_inc+small", "fast_inc+small", "fast_inc+big", "slow_dec+big")
MID_RANGE = FULL_RANGE

# Draws of the parameter search over scenarios.
PARAM_DRAWS = 100
SCALE_THRESHOLDS = (0.05, 0.1, 0.2)
SCALE_SEASONS = (1, 2)
SCALE_WINDOW_FACTORS = (0.05, 0.1)
SCALE_WINDOW_MINIMA = (1, 2)
CF_R_VALUES = (0.2, 0.3, 0.4, 0.5, 0.6)
CF_SMOOTH_RANGE = (3, 8)
CF_THRESHOLDS = (70, 80, 90, 95)
CONST_HAZARDS = (1, 2, 3, 100, 1000)
SMOGN_RANGES = {"rel_thr": (0.01, 0.98), "rel_coef": (1.0, 0.8)}
NOISE_RANGES = {"o_perc": (1.5, 2.0), "u_perc": (0.1, 0.2), "thr": (0.2, 0.5)}


def scenarios(season: int) -> list[dict]:
    """The 23 named ramps, with positions counted from the end of the train part."""
    half = season // 2
    windows = {
        "full_season1": (0, season, FULL_RANGE),
        "full_season2": (season, 2 * season, FULL_RANGE),
        "begin_season1": (0, half, HALF_RANGE),
        "end_season1": (half, season, HALF_RANGE),
        "mid_season1": (season // 4, math.ceil(3 * season / 4), MID_RANGE),
    }
    big = BIG_SHORT_SEASON if season <= SHORT_SEASON else BIG
    # the two full seasons alternate
    order = [(kind, w) for kind in FULL_RANGE for w in ("full_season1", "full_season2")]
    order += [(kind, w) for w in ("begin_season1", "end_season1", "mid_season1") for kind in windows[w][2]]
    out = []
    for number, (kind, window) in enumerate(order):
        speed, size = kind.split("+")
        factor = DECREASE if speed.endswith("dec") else SMALL if size == "small" else big
        out.append(
            {
                "scenario_id": number, "name": f"{kind}+{window}",
                "start_off": windows[window][0], "end_off": windows[window][1],
                "slope": SLOW if speed.startswith("slow") else FAST, "max_factor": factor,
            }
        )
    return out


def draw_settings(n: int = PARAM_DRAWS, da: str = "scaled", cpd: str = "cf", seed: int = 0) -> list[OnlineSpec]:
    """Random settings of the online response: lists are drawn from, ranges drawn uniformly.

    A grid of lists with fewer than ``n`` combinations is used whole.
    """
    rng = random.Random(seed)
    choices: dict[str, tuple] = {
        "scale_thr": SCALE_THRESHOLDS, "scale_seasons": SCALE_SEASONS,
        "scale_window_factor": SCALE_WINDOW_FACTORS, "scale_window_minimum": SCALE_WINDOW_MINIMA,
        "append": ("not",) if da == "scaled" else ("not", "before"),
    }
    ranges: dict[str, tuple] = {}
    if da == "smogn":
        choices["under_samp"] = (False, True)
        ranges = SMOGN_RANGES
    elif da == "gn":
        ranges = NOISE_RANGES
    if cpd == "cf":
        choices |= {"cf_r": CF_R_VALUES, "cf_smooth": tuple(range(*CF_SMOOTH_RANGE)), "cf_thr_perc": CF_THRESHOLDS}
    else:
        choices["const_hazard_factor"] = CONST_HAZARDS
    size = math.prod(len(v) for v in choices.values())
    if not ranges:
        numbers = rng.sample(range(size), min(n, size))
    else:
        numbers = [rng.randrange(size) for _ in range(n)]
    drawn = []
    for number in numbers:
        values = {}
        for name, options in choices.items():
            number, at = divmod(number, len(options))
            values[name] = options[at]
        values |= {name: low + span * rng.random() for name, (low, span) in ranges.items()}
        drawn.append(OnlineSpec(cpd=cpd, da=da, **values))
    return drawn


def inject(series: DataFrame, target: str = "y") -> DataFrame:
    """Multiply the target by its scenario's ramp; infeasible ramps leave ``status`` ``infeasible``.

    Expects ``n_train, start_off, end_off, slope, max_factor``; offsets count from the train end.
    """
    start, end = F.col("n_train") + F.col("start_off"), F.col("n_train") + F.col("end_off")
    arguments = (start, end, F.col("max_factor"), F.col("slope"))
    feasible = ramp_feasible(*arguments)
    return series.withColumn("status", F.when(feasible, "ok").otherwise("infeasible")).withColumn(
        target, F.when(feasible, F.col(target) * ramp_factor(F.col("t"), *arguments)).otherwise(F.col(target))
    )


def run_scenarios(
    series: DataFrame,
    cells: DataFrame,
    spec: SeriesSpec,
    settings: list[OnlineSpec],
    gp: GPSpec,
    features=("x",),
    cell_keys=("scenario_id",),
) -> DataFrame:
    """Online response against the unchanged base model for every series, cell and setting.

    ``series`` has ``t, y, x, n_train``; ``cells`` has the same rows once per cell, with its ramp columns.
    The ramps start after the train part, so all cells of a series share its base model. Returns
    ``rmse, rmse_base, rmse_ratio, n_cps, n_refits, status`` per series, cell and ``param_id``; cells whose
    ramp is infeasible have only their status.
    """
    base_keys = list(spec.keys)
    ids = [*base_keys, *cell_keys]
    injected = inject(cells, spec.target)
    feasible = injected.where(F.col("status") == "ok").select(*ids, "t", spec.target, "x", "n_train")
    params = F.explode(F.lit(list(range(len(settings)))))
    expanded = feasible.withColumn("param_id", params)
    keyed = replace(spec, keys=(*ids, "param_id"))
    run = run_online(
        expanded, keyed, settings if len(settings) > 1 else settings[0], gp, features,
        base_series=series, base_keys=base_keys,
    )
    keys = list(keyed.keys)
    actual = run.states.select(*keys, "t", F.col(spec.target).alias("y"))
    errors = rmse(run.predictions.join(actual, [*keys, "t"]), [*keys, "model"]).drop("status")
    online = errors.where(F.col("model") == ONLINE).drop("model")
    base = errors.where(F.col("model") == BASE).select(*keys, F.col("rmse").alias("rmse_base"))
    counts = run.states.groupBy(*keys).agg(
        F.count_if("change_point").alias("n_cps"), F.count_if("triggered").alias("n_refits")
    )
    done = rmse_ratio(online, base, keys).join(counts, keys)
    # ramps that cannot finish are listed, not run
    asked = injected.groupBy(*ids).agg(F.min("status").alias("status")).withColumn("param_id", params)
    return asked.join(done, keys, "left")


def scenario_suite(
    series: DataFrame, spec: SeriesSpec, settings: list[OnlineSpec], gp: GPSpec, features=("x",)
) -> DataFrame:
    """All named scenarios for all series and settings."""
    cells = explode_config(series, scenarios(spec.season), SCENARIO_SCHEMA)
    named = explode_config(series.select(*spec.keys).distinct(), scenarios(spec.season), SCENARIO_SCHEMA)
    results = run_scenarios(series, cells, spec, settings, gp, features)
    return results.join(named, [*spec.keys, "scenario_id"]).withColumn("season", F.lit(spec.season))


def position_cells(
    series: DataFrame, spec: SeriesSpec, slope: float, max_factor: float, step: int | None = None, shortest: int = 1
) -> DataFrame:
    """Heat map over windows of the test part: every start and length in multiples of ``step`` (a fifth of a season, unless
    given) and of at least ``shortest`` rows in which the ramp can climb to its factor and come back."""
    step = step or max(1, spec.season // 5)
    bounds = series.groupBy(*spec.keys).agg(F.first("n_train").alias("_first"), F.count(F.lit(1)).alias("_n"))
    windows = bounds.select(*spec.keys, "_first", (F.col("_n") - F.col("_first")).alias("_room")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("_room", F.lit(0)), F.lit(step).cast("long"))).alias("start_off")
    )
    windows = windows.where(F.col("start_off") + step <= F.col("_room")).withColumn(
        "end_off", F.explode(F.sequence(F.col("start_off") + step, F.col("_room"), F.lit(step).cast("long")))
    ).withColumns({"slope": F.lit(float(slope)), "max_factor": F.lit(float(max_factor))})
    start, end = F.col("_first") + F.col("start_off"), F.col("_first") + F.col("end_off")
    fits = ramp_feasible(start, end, F.col("max_factor"), F.col("slope")) & (end - start >= shortest)
    return series.join(windows.where(fits).drop("_first", "_room"), list(spec.keys))


def shape_cells(
    series: DataFrame, spec: SeriesSpec, factors: tuple[float, float, float], slopes=(0.1, 1.0, 0.1)
) -> DataFrame:
    """Heat map of slope against largest factor, in the second season after the train part."""

    def steps(first: float, last: float, by: float) -> list[float]:
        return [round(first + i * by, 10) for i in range(int(round((last - first) / by)) + 1)]

    entries = [{"slope": s, "max_factor": f} for s in steps(*slopes) for f in steps(*factors)]
    return (
        explode_config(series, entries, "slope double, max_factor double")
        .withColumn("start_off", F.lit(spec.season).cast("long"))
        .withColumn("end_off", F.lit(2 * spec.season).cast("long"))
    )


CELL_KEYS = ("start_off", "end_off", "slope", "max_factor")


def heat_map(series: DataFrame, cells: DataFrame, spec: SeriesSpec, setting: OnlineSpec, gp: GPSpec, features=("x",)) -> DataFrame:
    """One error ratio per cell."""
    return run_scenarios(series, cells, spec, [setting], gp, features, cell_keys=CELL_KEYS).drop("param_id")
