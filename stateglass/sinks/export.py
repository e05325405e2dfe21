"""Export of entries and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_json(rows: DataFrame, path: str) -> None:
    """One JSON object per row, null fields included, in as many files as tasks."""
    rows.write.option("ignoreNullFields", False).json(path)
