"""Tables that several queries share: made by the first that asks, read by the others."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")

_MADE: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], T]) -> T:
    """What ``make`` gives for these inputs, the first time in this application; it should give written tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]  # type: ignore[return-value]
