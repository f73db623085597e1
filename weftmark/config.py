"""Detector parameters."""

from __future__ import annotations

from dataclasses import dataclass

# Metric columns of the weekly facts, in reporting order.
METRICS = ("FUNDRAISERS", "GDV", "NAC2", "COMPLETES", "VIEWS", "CLICKS", "COST")
MONEY_METRIC = "GDV"
DIMENSIONS = ("country", "device", "traffic_source")
SERIES_KEY = ("source_table", "metric")
PERIOD = "week_start_date"


@dataclass(frozen=True)
class DetectorParams:
    """Thresholds of the anomaly detector. The defaults are fixed values."""

    lookback_weeks: int = 26
    baseline_weeks: int = 8
    min_baseline_obs: int = 4

    pct_drop: float = -10.0
    pct_spike: float = 10.0
    pct_critical: float = 25.0
    z_threshold: float = 2.0
    z_critical: float = 3.5
    iqr_multiplier: float = 1.5
    cusum_threshold: float = 3.0
    cusum_slack: float = 0.5
    bayes_threshold: float = 0.80

    # votes: percentage, z, fence, drift, probability
    layer_weights: tuple[float, ...] = (1.0, 2.0, 1.5, 1.0, 1.5)
    direction_threshold: float = 0.3
    high_consensus: float = 0.6
    medium_consensus: float = 0.4

    yoy_weeks: int = 52
    indicator_lags: tuple[int, ...] = (1, 2, 4)
    min_indicator_weeks: int = 6
    min_indicator_pairs: int = 5
    significance: float = 0.05

    annual_target: float = 1_000_000_000
    weekly_impact_floor: float = 10_000

    max_null_fraction: float = 0.3
    min_total_rows: int = 10
