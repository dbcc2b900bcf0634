"""Thresholds and weights, one frozen dataclass per area; every operator takes them as arguments."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class IntervalConfig:
    # Base billing periods in days, shortest first.
    bases: tuple[tuple[str, int], ...] = (
        ("monthly", 30),
        ("quarterly", 91),
        ("semi_annual", 182),
        ("annual", 365),
    )
    match_tolerance: float = 0.15
    one_time_horizon_days: int = 400
    max_gap_cv: float = 0.5
    mixed_dominant_share_max: float = 0.8
    # "shortest" keeps the first base on equal error; "longest" prefers the longer period.
    prefer: str = "shortest"


@dataclass(frozen=True)
class ChurnConfig:
    outcome_window_days: int = 365
    grace_days: int = 30
    drop_threshold: float = 0.5


@dataclass(frozen=True)
class DecisionConfig:
    continue_max_risk: float = 0.45
    nogo_min_risk: float = 0.70
    min_interval_confidence: float = 0.50


@dataclass(frozen=True)
class TargetConfig:
    # Status labels counted as positive / negative / left out.
    positive: tuple[str, ...] = (
        "Actively Seeking New Employees",
        "Will Consider New Projects",
    )
    negative: tuple[str, ...] | None = (
        "Out of Business",
        "Not Making New Products",
        "Reducing Activity",
    )
    exclude: tuple[str, ...] = (
        "None",
        "Other",
        "Acquired/Merged",
        "Acquired/Merged (Operating Subsidiary)",
    )
    weights: tuple[tuple[str, float], ...] = (
        ("sales_efficiency", 0.30),
        ("retention", 0.20),
        ("conversion", 0.20),
        ("momentum", 0.15),
        ("active_clients", 0.15),
    )


@dataclass(frozen=True)
class PortfolioConfig:
    shrinkage_m: float = 10.0
    top_percentile: float = 70.0
    bottom_percentile: float = 30.0
    confidence_high: int = 10
    confidence_medium: int = 5


@dataclass(frozen=True)
class CreditConfig:
    budget_burn_threshold: float = 0.10
    blocked_statuses: tuple[str, ...] = ("inactive", "suspended", "closed")
    continue_util_floor: float = 0.10
    continue_retention_floor: float = 0.15
    continue_strong_util: float = 1.0
    continue_adequate_retention: float = 0.25


@dataclass(frozen=True)
class BillingConfig:
    interval: IntervalConfig = field(default_factory=IntervalConfig)
    churn: ChurnConfig = field(default_factory=ChurnConfig)
    decision: DecisionConfig = field(default_factory=DecisionConfig)
    snapshots: tuple[dt.date, ...] = (dt.date(1999, 6, 1), dt.date(2000, 6, 1))
    seed: int = 42

    def __post_init__(self) -> None:
        if list(self.snapshots) != sorted(set(self.snapshots)):
            raise ValueError("snapshots must be distinct and in date order")


# Weight sets compared by weight_sensitivity: name -> weights in the order of TargetConfig.weights.
WEIGHT_SETS: dict[str, tuple[float, float, float, float, float]] = {
    "default": (0.30, 0.20, 0.20, 0.15, 0.15),
    "sales_heavy": (0.50, 0.15, 0.15, 0.10, 0.10),
    "retention_heavy": (0.15, 0.45, 0.20, 0.10, 0.10),
    "growth_focused": (0.10, 0.15, 0.30, 0.35, 0.10),
    "equal": (0.20, 0.20, 0.20, 0.20, 0.20),
}
