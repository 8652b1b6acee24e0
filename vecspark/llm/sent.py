"""Values of bounded size that every task needs, and what a Python worker makes of them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

_made: dict[tuple[str, int], Any] = {}


class Sent:
    """A broadcast value. ``made`` builds something of it once in each Python worker and keeps the last of its kind."""

    def __init__(self, spark: SparkSession, kind: str, value: Any):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.key = kind, self.broadcast._jbroadcast.id()

    def made(self, build: Callable[[Any], Any]) -> Any:
        if self.key not in _made:
            for old in [k for k in _made if k[0] == self.key[0]]:
                del _made[old]
            _made[self.key] = build(self.broadcast.value)
        return _made[self.key]
