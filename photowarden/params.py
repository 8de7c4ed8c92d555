"""Parameters and their validation."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """brightness_change decides what a flash is; flashes_per_second is stored with results and decides nothing."""

    brightness_change: float = 0.2
    flashes_per_second: int = 3
    cluster_gap: float = 0.3

    def __post_init__(self):
        if not 0.05 <= self.brightness_change <= 1:
            raise ValueError("brightness_change must be within 0.05 and 1")
        if not 1 <= self.flashes_per_second <= 10:
            raise ValueError("flashes_per_second must be within 1 and 10")
        if not 0 < self.cluster_gap <= 2:
            raise ValueError("cluster_gap must be above 0 and at most 2 seconds")


@dataclass(frozen=True)
class Flags:
    """Optional groups of metrics: an operator that is off is never planned."""

    red: bool = False
    temporal_contrast: bool = False
    compat: bool = False


@dataclass(frozen=True)
class Sampling:
    """Seconds between analysed frames."""

    interval: float = 1 / 30

    def __post_init__(self):
        if not 0.01 <= self.interval <= 0.5:
            raise ValueError("interval must be within 0.01 and 0.5 seconds")

    def recommended_cluster_gap(self) -> float:
        """3.5 intervals, within 0.05 and 2 seconds, to 2 places."""
        return int(min(max(3.5 * self.interval, 0.05), 2.0) * 100 + 0.5) / 100


def percent(p: float | int | str) -> float:
    """A percentile argument as 0..100: 0.95, 95, '95%' and 'p95' are the same; 1 is 100 %."""
    if isinstance(p, str):
        text = p.strip().lower()
        if text.endswith("%"):
            return min(max(float(text[:-1]), 0.0), 100.0)
        if text.startswith("p"):
            return min(max(float(text[1:]), 0.0), 100.0)
        p = float(text)
    if p != p:
        raise ValueError("not a percentile")
    return min(max(p * 100.0 if 0 <= p <= 1 else float(p), 0.0), 100.0)
