"""Operator state: one state per subtask, not per key.

Entries are rows ``operator_uid, subtask, state_name, mode, pos, key, value``.
Modes: BROADCAST (the same map on every subtask), UNION and SPLIT (a list per
subtask). ``key`` is null for lists and ``pos`` is null for maps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST, UNION, SPLIT = "BROADCAST", "UNION", "SPLIT"
UNSET = "unset"


def broadcast_entries(states: DataFrame, state: str = "state") -> DataFrame:
    """One row per entry of a map column."""
    rest = [c for c in states.columns if c != state]
    return states.select(*rest, F.explode(F.map_entries(state)).alias("__e")).select(
        *rest, F.col("__e.key").alias("key"), F.col("__e.value").alias("value")
    )


def list_entries(states: DataFrame, state: str = "state") -> DataFrame:
    """One row per element of an array column, numbered from 0 in ``partition``."""
    rest = [c for c in states.columns if c != state]
    return states.select(*rest, F.posexplode(state).alias("partition", "value"))


def first_replica(entries: DataFrame) -> DataFrame:
    """One replica of each broadcast state, that of the lowest subtask.

    A state is a name that a job declares, so there are few. What is known of each
    comes in as one small map; a join on so few keys would put all entries into a
    few tasks.
    """
    lowest = _by_state(entries, F.min("subtask"))
    return entries.filter(F.col("subtask") == F.try_element_at(lowest, _state()))


def _state() -> Column:
    return F.struct(F.col("operator_uid").alias("o"), F.col("state_name").alias("s"))


def _by_state(entries: DataFrame, value: Column) -> Column:
    """An aggregate per operator and state, as a map in one scalar subquery."""
    each = entries.groupBy("operator_uid", "state_name").agg(value.alias("__value"))
    pairs = F.collect_list(F.struct(_state().alias("k"), F.col("__value").alias("v")))
    return each.agg(F.map_from_entries(pairs).alias("m")).scalar()


def diverging_replicas(entries: DataFrame) -> DataFrame:
    """Broadcast keys that do not have one and the same value on every subtask."""
    subtasks = F.try_element_at(_by_state(entries, F.count_distinct("subtask")), _state())
    per_key = entries.groupBy("operator_uid", "state_name", "key").agg(
        F.count("*").alias("n_replicas"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )
    return (
        per_key.withColumn("__subtasks", subtasks)
        .filter(
            (F.col("n_replicas") != F.col("__subtasks"))
            | ~F.col("min_value").eqNullSafe(F.col("max_value"))
        )
        .drop("__subtasks")
    )


def union_entries(entries: DataFrame) -> DataFrame:
    """List state of all subtasks, each element still marked with its subtask."""
    return entries.filter(F.col("mode") == UNION)


def read_operator_state(entries: DataFrame, state_name: str, mode: str) -> DataFrame:
    """A named state as the mode asks: one replica, or the lists of all subtasks."""
    if mode not in (BROADCAST, UNION, SPLIT):
        raise ValueError(f"unknown mode {mode!r}")
    of_state = entries.filter((F.col("state_name") == state_name) & (F.col("mode") == mode))
    return first_replica(of_state) if mode == BROADCAST else of_state


def subtask_summary(records: DataFrame, time: str = "ts") -> DataFrame:
    return records.groupBy("subtask").agg(
        F.count("*").alias("n_records"), F.max(time).alias("last_time")
    )


def current_config(config: DataFrame, names: Sequence[str]) -> DataFrame:
    """The latest value of each named setting, as one row; null when never set.

    ``config`` has rows ``k, v, seq``.
    """
    return config.agg(
        *[F.max_by("v", F.when(F.col("k") == n, F.col("seq"))).alias(n) for n in names]
    )


def with_config(records: DataFrame, current: DataFrame, names: Sequence[str]) -> DataFrame:
    """Records with the current settings, ``unset`` for a missing one.

    ``current`` is a single row by construction, so it comes in as a scalar
    subquery and there is no join.
    """
    packed = current.select(F.struct(*names).alias("config")).scalar()
    return (
        records.withColumn("__config", packed)
        .withColumns({n: F.coalesce(F.col(f"__config.{n}"), F.lit(UNSET)) for n in names})
        .drop("__config")
    )
