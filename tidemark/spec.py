"""Configuration of series, features, models and the online response.

Everything here is plain data: operators read these objects on the driver and
turn them into column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# Length of one step in seconds; only used to size time buckets.
STEP_SECONDS = {
    "hour": 3_600,
    "day": 86_400,
    "week": 604_800,
    "month": 2_629_800,
    "quarter": 7_889_400,
}

# Measurement columns that get no seasonal statistics.
NON_SEASONAL_FEATURES = ("mean_temp", "total_prec_height_mm", "total_sun_dur_h")

# Days around a holiday that carry a counter, and days with a counter of their own.
EVENT_LAGS = (-7, -6, -5, -4, -3, -2, -1, 0, 1, 2, 3)
SPECIAL_DAYS = ("Valentine", "MothersDay", "Karfreitag")
NO_HOLIDAY_NEAR = 99

# Fixed value: "no baseline prediction" marker in exported tables.
DUMMY_PREDICTION = -9999.0


@dataclass(frozen=True)
class SeriesSpec:
    """How a long table holds its series."""

    keys: tuple[str, ...] = ("series_id",)
    ts: str = "ts"
    target: str = "y"
    season: int = 12
    step: str = "month"
    # rows of one series handled together; longer series are split into blocks
    block_rows: int = 65_536

    def __post_init__(self):
        if self.step not in STEP_SECONDS:
            raise ValueError(f"unknown step {self.step!r}")
        if self.season < 1:
            raise ValueError("season must be at least 1")

    def with_keys(self, *more: str) -> SeriesSpec:
        return replace(self, keys=self.keys + more)

    @property
    def bucket_seconds(self) -> int:
        return STEP_SECONDS[self.step] * self.block_rows


@dataclass(frozen=True)
class FeatureSpec:
    """Which derived features to build, and from which columns."""

    features: tuple[str, ...] = ("y",)
    lags: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7, 14)
    window: int | None = None  # season when unset
    seasonal_window: int | None = None
    weekday_window: int = 4
    weekday_stats: bool | None = None  # only for season 7 when unset
    non_seasonal: tuple[str, ...] = NON_SEASONAL_FEATURES
    event_lags: tuple[int, ...] = EVENT_LAGS
    special_days: tuple[str, ...] = SPECIAL_DAYS
    condense: tuple[str, ...] = ()
    condensed_name: str | None = None


@dataclass(frozen=True)
class DatasetSpec:
    """One dataset: where its target is and how it is prepared."""

    name: str
    series: SeriesSpec = SeriesSpec()
    features: FeatureSpec = FeatureSpec()
    targets: tuple[str, ...] = ("y",)  # all target candidates, rivals are dropped
    string_columns: tuple[str, ...] = ("public_holiday", "school_holiday")
    drop_columns: tuple[str, ...] = ()
    drop_from: str | None = None  # first date no longer recorded
    break_date: str | None = None
    weekly: bool = False
    quarter: bool | None = None  # rows of one quarter a year only; unset: as the name says
    split_perc: float | None = 0.8

    @property
    def model_season(self) -> int:
        """Steps of a season after weekly resampling; data of one quarter have a fourth of them."""
        if not self.weekly:
            return self.series.season
        weeks = int(self.series.season / 7)
        return int(weeks / 4) if (self.quarter if self.quarter is not None else "quarter" in self.name) else weeks

    @property
    def fold_lengths(self) -> tuple[int, int]:
        """Initial train length and test length of the expanding split."""
        return 2 * self.series.season, self.series.season


@dataclass(frozen=True)
class GPSpec:
    """Gaussian-process regression settings; ``kernel`` is a sum of products of base kernels."""

    kernel: tuple[tuple[str, ...], ...] = (("periodic",),)
    alpha: float = 0.1
    n_restarts: int = 0
    standardize: bool = False
    normalize_y: bool = True
    # None: length 1 and period 1 with wide bounds, else a period near the season
    period: int | None = None
    seed: int = 42


@dataclass(frozen=True)
class OnlineSpec:
    """Online response: detector, scale trigger and augmentation."""

    cpd: str = "cf"
    da: str = "scaled"
    scale_thr: float = 0.1
    scale_seasons: int = 2
    scale_window: int | None = None
    scale_window_factor: float = 0.1
    scale_window_minimum: int = 2
    const_hazard: float | None = None
    const_hazard_factor: float = 2
    cf_r: float = 0.4
    cf_order: int = 1
    cf_smooth: int = 4
    cf_thr_perc: float = 90
    append: str = "no"
    max_samples: int | None = None
    max_samples_factor: int = 10
    o_perc: float = 1.1
    u_perc: float = 0.1
    thr: float = 0.2
    under_samp: bool = False
    rel_thr: float = 0.5
    rel_coef: float = 1.5
    rival_cap: int | None = None  # all rows when unset
    # whose output the "scaled" rival multiplies: the model in force, or the base model
    scale_of: str = "current"
    seed: int = 42

    def __post_init__(self):
        if self.cpd not in ("cf", "bocd"):
            raise ValueError(f"unknown change point detector {self.cpd!r}")
        if self.da not in ("scaled", "smogn", "gn"):
            raise ValueError(f"unknown augmentation {self.da!r}")
        if self.scale_seasons not in (1, 2):
            raise ValueError("scale_seasons must be 1 or 2")
        if self.scale_of not in ("current", "base"):
            raise ValueError("scale_of must be 'current' or 'base'")

    def resolved(self, season: int) -> OnlineSpec:
        """Fill the defaults that depend on the season."""
        window = self.scale_window
        if window is None:
            window = max(self.scale_window_minimum, int(self.scale_window_factor * season))
        samples = self.max_samples_factor * season if self.max_samples is None else self.max_samples
        return replace(
            self,
            scale_window=window,
            const_hazard=self.const_hazard_factor * season if self.const_hazard is None else self.const_hazard,
            max_samples=samples,
        )
