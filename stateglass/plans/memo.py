"""Folders built once per application and scale, shared between queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

_BUILT: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, label: str, build: Callable[[], str]) -> str:
    place = (spark.sparkContext.applicationId, sf_dir, label)
    if place not in _BUILT:
        _BUILT[place] = build()
    return _BUILT[place]
