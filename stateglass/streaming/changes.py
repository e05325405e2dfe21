"""Changes between two committed batches of one checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stateglass.operators.diff import diff_snapshots
from stateglass.sources.state import _load, read_keyed_state


def touched_keys(
    spark: SparkSession, checkpoint: str, state_name: str, after: int, until: int, operator_id: int = 0
) -> DataFrame:
    """Keys written in the batches ``after + 1 .. until``."""
    feed = _load(
        spark,
        checkpoint,
        operatorId=operator_id,
        stateVarName=state_name,
        readChangeFeed=True,
        changeStartBatchId=after + 1,
        changeEndBatchId=until,
    )
    return feed.select("key").distinct()


def batch_changes(
    spark: SparkSession, checkpoint: str, state_name: str, after: int, until: int, operator_id: int = 0
) -> DataFrame:
    """What changed of a state between two batches.

    A key that was not written since is the same in both, so this is the diff of
    the two without what is unchanged: two scans and one join. The change feed
    (``touched_keys``) would be a third scan and two more joins.
    """
    sides = [read_keyed_state(spark, checkpoint, state_name, b, operator_id) for b in (after, until)]
    return diff_snapshots(*sides).filter(F.col("status") != "UNCHANGED")
