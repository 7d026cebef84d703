"""Times of what a session does: how often, and how long at least, at most, on average."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass


@dataclass
class Times:
    count: int = 0
    total: float = 0.0
    least: float = float("inf")
    most: float = 0.0

    def add(self, seconds: float) -> None:
        self.count += 1
        self.total += seconds
        self.least, self.most = min(self.least, seconds), max(self.most, seconds)

    @property
    def mean(self) -> float:
        return self.total / self.count if self.count else 0.0


class Metrics:
    def __init__(self):
        self.times: dict[str, Times] = {}

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.times.setdefault(name, Times()).add(time.perf_counter() - began)

    def rows(self) -> list[tuple[str, int, float, float, float]]:
        """(name, count, least, most and mean seconds), by name."""
        return [(n, t.count, t.least, t.most, t.mean) for n, t in sorted(self.times.items())]
