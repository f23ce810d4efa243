"""Run settings. One frozen object per job; every path a job uses is an argument of the job."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# The twelve model features and the baseline columns.
FEATURES = (
    "dow", "month", "sin_doy", "cos_doy",
    "y_lag_1", "y_lag_7", "y_lag_14", "y_lag_28",
    "y_roll_mean_7", "y_roll_std_7",
    "y_roll_mean_28", "y_roll_std_28",
)
BASELINES = {
    "seasonal_naive_lag7": "y_lag_7",
    "naive_lag1": "y_lag_1",
    "rolling_mean_7": "y_roll_mean_7",
}


@dataclass(frozen=True)
class PanelConfig:
    """Modelling window, eligibility limits, feature lags and split dates."""

    window_start: date = date(2021, 6, 1)
    window_end: date = date(2024, 12, 31)
    coverage_threshold: float = 0.90
    min_valid_days: int = 730
    lag_days: tuple[int, ...] = (1, 7, 14, 28)
    roll_windows: tuple[int, ...] = (7, 28)
    train_end: date = date(2023, 6, 30)
    val_end: date = date(2023, 12, 31)
    seed: int = 7

    def __post_init__(self) -> None:
        if not self.window_start <= self.train_end <= self.val_end <= self.window_end:
            raise ValueError("dates must be ordered: window_start, train_end, val_end, window_end")
        if 7 not in self.lag_days:
            raise ValueError("lag_days must hold 7: a panel row needs a value seven days back")

    @property
    def expected_days(self) -> int:
        return (self.window_end - self.window_start).days + 1


@dataclass(frozen=True)
class BacktestConfig:
    """Expanding-window backtest. ``parallel_fits`` folds are fitted at the same time."""

    horizon_days: int = 28
    step_days: int = 56
    min_train_days: int = 365
    baseline_col: str = "y_lag_7"
    target: str = "y"
    seed: int = 7
    n_estimators: int = 600
    min_samples_leaf: int = 1
    parallel_fits: int = 2

    def __post_init__(self) -> None:
        if min(self.horizon_days, self.step_days) < 1 or self.min_train_days < 0:
            raise ValueError("horizon_days and step_days must be positive, min_train_days not negative")


@dataclass(frozen=True)
class MartConfig:
    """Reporting dates: the baseline year and the period shaded before the modelling window."""

    baseline_year: int = 2019
    shade_from: date = date(2020, 3, 1)
    coverage_year_start: int = 2020
    coverage_year_end: int = 2024
