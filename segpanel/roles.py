"""Column roles and threshold sets. Operators take these instead of fixed column names."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from datetime import date


@dataclass(frozen=True)
class Roles:
    """Which column plays which part in an event or aggregate table."""

    time: str = "day"
    week: str = "week"
    month: str = "month"
    grp: str = "grp"
    area: str = "area"
    cat: str = "cat"
    cls: str = "cls"
    value: str = "n"
    x: str = "x"
    y: str = "y"

    @property
    def keys(self) -> list[str]:
        return [self.grp, self.area, self.cat, self.cls]


@dataclass(frozen=True)
class Box:
    """Inclusive coordinate bounds."""

    x_min: float
    x_max: float
    y_min: float
    y_max: float

    def __post_init__(self) -> None:
        if not (self.x_min < self.x_max and self.y_min < self.y_max):
            raise ValueError("box bounds must be increasing")


@dataclass(frozen=True)
class QualityConfig:
    """Limits behind the row quality flags."""

    min_day: date
    as_of: date
    box: Box
    allowed_groups: tuple[str, ...]
    allowed_classes: tuple[str, ...]

    def __post_init__(self) -> None:
        if self.min_day > self.as_of:
            raise ValueError("min_day must not be after as_of")


def _require_positive(config: object, names: tuple[str, ...]) -> None:
    for name in names:
        if getattr(config, name) <= 0:
            raise ValueError(f"{name} must be positive")


def _require_ladder(config: object, names: tuple[str, ...]) -> None:
    values = [getattr(config, name) for name in names]
    if values != sorted(values):
        raise ValueError("thresholds must not decrease: " + ", ".join(names))


@dataclass(frozen=True)
class AnomalyConfig:
    """Weekly anomaly thresholds. The defaults are fixed values."""

    short_weeks: int = 8
    base_weeks: int = 13
    long_weeks: int = 26
    min_prior_weeks: int = 13
    min_prior_total: int = 13
    min_actual: int = 4
    min_increase: float = 3.0
    min_pct_change: float = 75.0
    model_multiple: float = 1.75
    z: tuple[float, float, float, float] = (2.0, 2.75, 3.5, 4.5)
    robust_z: tuple[float, float, float, float] = (3.0, 4.0, 5.0, 6.0)
    model_scaled: tuple[float, float, float, float] = (2.5, 3.5, 4.5, 6.0)
    pct_steps: tuple[float, float] = (125.0, 200.0)
    score_steps: tuple[float, float, float] = (2.5, 3.5, 4.5)
    high_min_residual: float = 6.0
    critical_min_residual: float = 8.0
    critical_min_actual: int = 10
    recent_weeks: int = 8
    top_n: int = 25
    volatile_min_weeks: int = 52
    volatile_min_events: int = 100

    def __post_init__(self) -> None:
        _require_positive(
            self, ("short_weeks", "base_weeks", "long_weeks", "min_prior_weeks", "min_actual", "top_n")
        )
        for ladder in (self.z, self.robust_z, self.model_scaled, self.pct_steps, self.score_steps):
            if list(ladder) != sorted(ladder):
                raise ValueError("severity thresholds must not decrease")
        _require_ladder(self, ("min_increase", "high_min_residual", "critical_min_residual"))
        if self.min_prior_weeks > self.base_weeks:
            raise ValueError("min_prior_weeks cannot exceed base_weeks")


@dataclass(frozen=True)
class GrainLimits:
    """Minimum volumes of one hotspot grain. The defaults below are fixed values."""

    density_reference: int
    min_recent: int
    min_baseline: int
    high_min_recent: int
    critical_min_recent: int

    def __post_init__(self) -> None:
        _require_positive(self, tuple(f.name for f in fields(self)))
        _require_ladder(self, ("high_min_recent", "critical_min_recent"))


@dataclass(frozen=True)
class HotspotConfig:
    """Spatial hotspot windows and thresholds. The defaults are fixed values."""

    box: Box
    cell_size: float = 0.01
    short_days: int = 7
    recent_days: int = 30
    long_days: int = 90
    baseline_days: int = 365
    area: GrainLimits = field(default_factory=lambda: GrainLimits(250, 25, 50, 50, 100))
    grid: GrainLimits = field(default_factory=lambda: GrainLimits(30, 8, 8, 12, 20))
    min_ratio: float = 1.25
    min_share_change: float = 0.0
    min_score: float = 30.0
    ratio_steps: tuple[float, float, float] = (1.5, 2.0, 3.0)
    score_steps: tuple[float, float, float] = (45.0, 65.0, 85.0)
    include_latest_day: bool = False

    def __post_init__(self) -> None:
        _require_positive(self, ("cell_size", "short_days", "recent_days", "long_days", "baseline_days"))
        if not self.short_days < self.recent_days < self.long_days:
            raise ValueError("recent windows must grow")
        for ladder in (self.ratio_steps, self.score_steps):
            if list(ladder) != sorted(ladder):
                raise ValueError("severity thresholds must not decrease")
