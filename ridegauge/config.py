"""Settings as frozen dataclasses; every operator takes one or plain arguments."""

from __future__ import annotations

from dataclasses import dataclass

# Cadence, analysis defaults and season lengths by frequency label.
FREQUENCY_STEP = {
    "hourly": "INTERVAL 1 HOUR",
    "daily": "INTERVAL 1 DAY",
    "weekly": "INTERVAL 7 DAYS",
    "monthly": "INTERVAL 1 MONTH",
    "quarterly": "INTERVAL 3 MONTHS",
}
SEASON_LENGTH = {
    "h": 24, "hour": 24, "hourly": 24,
    "d": 7, "day": 7, "daily": 7,
    "w": 52, "week": 52, "weekly": 52,
    "m": 12, "month": 12, "monthly": 12,
    "q": 4, "quarter": 4, "quarterly": 4,
    "y": 1, "year": 1, "yearly": 1,
}
KNOWN_FUTURE_PREFIXES = ("known_", "forecast_", "planned_", "calendar_", "event_")


def season_length(frequency: str | None, fallback: int = 1) -> int:
    """Season length of a frequency label; unknown labels give ``fallback``."""
    if frequency is None:
        return int(fallback)
    return SEASON_LENGTH.get(str(frequency).strip().lower(), int(fallback))


@dataclass(frozen=True)
class SeriesDiagnosisConfig:
    frequency: str = "daily"
    candidate_periods: tuple[int, ...] = (7, 30, 365)
    fallback_period: int | None = 7
    rolling_window: int = 28
    anomaly_window: int = 28
    anomaly_threshold: float = 5.0
    max_acf_lag: int = 56


@dataclass(frozen=True)
class StationConfig:
    """Thresholds of the station diagnosis."""

    recent_window_days: int = 90
    newborn_observed_days: int = 30
    young_observed_days: int = 120
    mature_observed_days: int = 240
    mature_in_service_days: int = 300
    sparse_mature_span_days: int = 365
    stale_recent_observed_days: int = 3
    low_coverage_ratio: float = 0.60
    mature_coverage_ratio: float = 0.75
    recent_availability_ratio: float = 0.60
    out_of_service_gap_days: int = 21
    post_service_gap_days: int = 30
    almost_always_zero: float = 0.95
    sparse_zero_rate: float = 0.60
    sparse_active_day_rate: float = 0.40
    low_mean_demand: float = 1.0
    max_cv: float = 10.0
    min_days_autocorr: int = 30
    min_pairs_autocorr: int = 20
    min_days_trend: int = 45
    min_days_pattern: int = 21
    min_positive_days_outlier: int = 20
    min_coverage_temporal: float = 0.65
    shift_window_obs: int = 30
    outlier_z: float = 3.5
    anomaly_outlier_rate: float = 0.08
    busy_quantile: float = 0.75
    stable_cv: float = 0.85
    volatile_cv: float = 1.35
    commuter_weekday_effect: float = 0.18
    commuter_weekend_ratio: float = 0.85
    leisure_weekend_ratio: float = 1.20
    min_behavior_coverage: float = 0.55
    min_behavior_observed_days: int = 28
    min_behavior_recent_days: int = 10
    preferred_k: int = 6
    k_values: tuple[int, ...] = (4, 5, 6, 7)
    cluster_seeds: tuple[int, ...] = (11, 19, 29, 37, 43)
    bootstrap_iterations: int = 8
    bootstrap_fraction: float = 0.80
    cluster_mature_only: bool = True
    min_cluster_size_abs: int = 8
    min_cluster_size_ratio: float = 0.02
    min_cluster_eligible: int = 12
    min_cluster_coverage: float = 0.70
    min_cluster_observed_days: int = 120
    stability_good: float = 0.75
    stability_ok: float = 0.55
    representatives_per_category: int = 3
    representative_min_size: int = 3
    spike_quantile: float = 0.999
    spike_multiplier: float = 8.0
    warning_min_days: int = 14
    warning_gap_days: int = 14
    random_state: int = 42


@dataclass(frozen=True)
class BacktestConfig:
    """Rolling-origin settings for one network series."""

    horizons: tuple[int, ...] = (7, 30)
    production_horizons: tuple[int, ...] = (7, 30, 90)
    initial_train_size: int = 730
    step_size: int = 7
    max_folds: int = 8
    season: int = 7
    seasonal_naive_periods: tuple[int, ...] = (7, 30)
    lags: tuple[int, ...] = (1, 2, 3, 7, 14, 21, 28, 30, 365)
    rolling_windows: tuple[int, ...] = (7, 14, 28, 30)
    weekly_order: int = 3
    yearly_order: int = 3


@dataclass(frozen=True)
class StationForecastConfig:
    """Rolling-origin settings for the station panel."""

    horizons: tuple[int, ...] = (7, 30)
    production_horizons: tuple[int, ...] = (7, 30)
    initial_train_size: int = 365
    step_size: int = 30
    max_folds: int = 4
    season: int = 7
    recent_window_days: int = 90
    min_recent_service_days: int = 3
