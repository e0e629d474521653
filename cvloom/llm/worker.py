"""What a Python worker keeps between tasks: one value per kind, known by a mark that its broadcast was given."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

_KEPT: dict[str, tuple[str, Any]] = {}


class Shared:
    """A broadcast value and what a worker makes of it, made once per worker. The mark travels with the task, so a worker
    that has served another value of the same kind before makes a new one, and the old one goes."""

    def __init__(self, spark: SparkSession, kind: str, value: Any, make: Callable[[Any], Any]):
        self.handle, self.kind, self.mark, self.make = spark.sparkContext.broadcast(value), kind, uuid.uuid4().hex, make

    def get(self) -> Any:
        mark, made = _KEPT.get(self.kind, (None, None))
        if mark != self.mark:
            made = self.make(self.handle.value)
            _KEPT[self.kind] = (self.mark, made)
        return made
