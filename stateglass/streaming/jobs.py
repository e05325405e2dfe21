"""Streams that produce the kinds of state this package reads.

``keyed_state`` and ``recent_buffer`` run two streams in turn (see
``summaries``); the others are single frames to be written by
``run_available``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from stateglass.functions.text import config_key, config_value
from stateglass.streaming import summaries as sm
from stateglass.streaming.processors import (
    BUFFER_OUTPUT,
    KEYED_OUTPUT,
    KeyedStateProcessor,
    RecentBufferProcessor,
)


def run_available(frame: DataFrame, checkpoint: str, mode: str = "update", batch_function=None) -> None:
    """Process all input at hand as micro-batches into ``checkpoint``."""
    writer = frame.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    if batch_function is None:
        writer = writer.format("noop")
    else:
        writer = writer.foreachBatch(batch_function)
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def _summarised(events: DataFrame, work: str, summarise, schema: str) -> DataFrame:
    """Run the first stream; returns the source of the second."""
    folder = f"{work}/summaries"
    write = sm.summaries_into(folder, summarise)
    run_available(events, f"{work}/summarise", "append", write)
    return events.sparkSession.readStream.schema(schema).parquet(f"{folder}/*")


def initial_states(states: DataFrame) -> DataFrame:
    """Typed states of a snapshot (``key`` and a column per state) as an initial state.

    The parts of the key become columns. Such rows come from ``views.typed_states``, of a
    pin or of another checkpoint.
    """
    return states.select("key.*", *[f"`{c}`" for c in states.columns if c != "key"])


def keyed_state(
    events: DataFrame,
    work: str,
    checkpoint: str,
    ranges: int | None = None,
    initial: DataFrame | None = None,
) -> None:
    """State per user: count, last category, average, recent values, categories.

    ``work`` holds the first stream and the summaries, ``checkpoint`` the state. A new
    checkpoint starts from ``initial``, typed states of an older one, if given.
    """
    summarise = partial(sm.keyed_summary, ranges=ranges)
    summaries = _summarised(events, work, summarise, sm.KEYED_SCHEMA)
    started = None if initial is None else initial_states(initial).groupBy("user_id")
    state = summaries.groupBy("user_id").transformWithState(
        KeyedStateProcessor(sm.ALPHA, sm.RECENT_VALUES), KEYED_OUTPUT, "Update", "None", started
    )
    run_available(state, checkpoint)


def recent_buffer(events: DataFrame, work: str, checkpoint: str, initial: DataFrame | None = None) -> None:
    """List state per subtask: the newest entries."""
    summaries = _summarised(events, work, sm.buffer_summary, sm.BUFFER_SCHEMA)
    started = None if initial is None else initial_states(initial).groupBy("subtask")
    state = summaries.groupBy("subtask").transformWithState(
        RecentBufferProcessor(sm.BUFFER_SIZE), BUFFER_OUTPUT, "Update", "None", started
    )
    run_available(state, checkpoint)


def union_summary(events: DataFrame) -> DataFrame:
    return (
        events.withColumn("subtask", F.col("event_id") % sm.SUBTASKS)
        .groupBy("subtask")
        .agg(F.count("*").alias("n_records"), F.max("ts").alias("last_time"))
    )


def config_upserts(entries: DataFrame) -> DataFrame:
    """Latest value per setting from texts ``entry`` like ``k=v`` with ``seq``."""
    return (
        entries.select(
            config_key(F.col("entry")).alias("k"), config_value(F.col("entry")).alias("v"), "seq"
        )
        .filter(F.col("k").isNotNull())
        .groupBy("k")
        .agg(F.max_by("v", "seq").alias("v"))
    )


def value_aggregates(events: DataFrame) -> DataFrame:
    """Reducing and aggregating state: a sum, and an average kept as sum and count."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return events.groupBy("user_id").agg(
        F.sum(cents).alias("total_cents"), F.avg(cents).alias("average_cents")
    )
