"""Settings, checked when made."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import InvalidRequest


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidRequest(message)


@dataclass(frozen=True)
class HealthConfig:
    window_seconds: int = 300
    max_samples_per_edge: int = 1024

    def __post_init__(self):
        _need(self.window_seconds > 0, "window_seconds must be positive")
        _need(self.max_samples_per_edge > 0, "max_samples_per_edge must be positive")


@dataclass(frozen=True)
class IngestConfig:
    max_events_per_trigger: int = 10_000
    on_overflow: str = "block"
    max_files_per_trigger: int = 10
    trigger_seconds: int = 1

    def __post_init__(self):
        _need(self.max_files_per_trigger > 0 and self.trigger_seconds > 0, "files and seconds per trigger must be positive")
        _need(self.max_events_per_trigger > 0, "max_events_per_trigger must be positive")
        _need(self.on_overflow in ("block", "shed"), "on_overflow is block or shed")


@dataclass(frozen=True)
class GeneratorConfig:
    services: int = 5000
    events: int = 100_000
    hubs: int = 8
    cycles: int = 3
    error_rate: float = 0.05
    duplicate_rate: float = 0.01
    seed: int = 42

    def __post_init__(self):
        _need(self.services >= 2 and self.events >= 0, "at least two services and no negative number of events")
        _need(0 <= self.hubs <= self.services and self.cycles >= 0, "hubs are services; cycles cannot be negative")
        _need(0 <= self.error_rate <= 1 and 0 <= self.duplicate_rate <= 1, "rates lie between 0 and 1")
