"""Counters of a stage, taken while its rows pass."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation


class Stage:
    """Counts rows, and whatever else is asked for, of a table while it is written, with the seconds that took: no pass of its own."""

    def __init__(self, name: str, df: DataFrame, **counters: Column):
        self.name, self._observation, self._began = name, Observation(), time.time()
        self.rows = df.observe(self._observation, *(c.alias(k) for k, c in counters.items()))

    def run(self, action: Callable[[DataFrame], object]) -> dict[str, object]:
        """The counters, `seconds` and the action's rate a second of each counter, after action(rows)."""
        self._began = time.time()
        action(self.rows)
        seconds = time.time() - self._began
        counted = dict(self._observation.get)
        return {"stage": self.name, **counted, "seconds": round(seconds, 3), **{f"{k}_per_second": round(v / max(seconds, 1e-9), 1) for k, v in counted.items() if isinstance(v, int | float)}}
