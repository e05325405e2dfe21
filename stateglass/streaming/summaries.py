"""What a micro-batch brings to each key, worked out with batch operators.

A stateful operator gets all rows of a key in one task. If one key has a third
of the stream, that task has a third of every batch. So each batch is first
reduced, with the operators of ``operators.order``, which split hot keys, to a
few rows per key; those are what the stateful operator folds into its state.

The two run as separate streams with a folder of summaries between them. They
run in turn: a batch of summaries is rewritten whole if the first stream is
broken off and repeated, and the second starts only when the first is done, so
every batch is folded in exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from stateglass.functions.text import entry_text, timed_value
from stateglass.operators.order import average_step, category_counts, recent_rows

# Fixed values of the job: average weight, buffer sizes, number of subtasks.
ALPHA = 0.1
RECENT_VALUES = 20
BUFFER_SIZE = 50
SUBTASKS = 4

KEYED_SCHEMA = (
    "user_id bigint, kind string, n bigint, added double, first_value double, "
    "category string, texts array<string>, counts array<bigint>, batch_id bigint"
)
BUFFER_SCHEMA = "subtask bigint, seq bigint, entry string, batch_id bigint"


def epoch_millis(ts):
    """Milliseconds since 1970 of a timestamp without zone."""
    return F.unix_millis(ts.cast("timestamp"))


def keyed_summary(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """Three rows per user: a step of the average, the recent values with the last
    category, and the categories (``texts``) with their counts.

    A worker takes a row cell by cell, so values of one kind come as arrays.
    """
    steps = average_step(events, ["user_id"], "event_id", "value", ALPHA, ranges).withColumn("kind", F.lit("step"))
    values = events.select("user_id", "event_id", "event_type", "value", "ts")
    # Texts are made for the rows that are kept only.
    text = timed_value(F.col("value"), epoch_millis(F.col("ts"))).alias("text")
    recent = (
        recent_rows(values, ["user_id"], "event_id", RECENT_VALUES)
        .groupBy("user_id")
        .agg(
            F.max_by("event_type", "pos").alias("category"),
            F.sort_array(F.collect_list(F.struct("pos", text))).alias("rows"),
        )
        .select("user_id", "category", F.col("rows.text").alias("texts"), F.lit("recent").alias("kind"))
    )
    counts = (
        category_counts(events, ["user_id"], "event_type")
        .groupBy("user_id")
        .agg(F.collect_list(F.struct("map_key", "value")).alias("rows"))
        .select(
            "user_id",
            F.col("rows.map_key").alias("texts"),
            F.col("rows.value").alias("counts"),
            F.lit("category").alias("kind"),
        )
    )
    return steps.unionByName(recent, allowMissingColumns=True).unionByName(
        counts, allowMissingColumns=True
    )


def buffer_summary(events: DataFrame) -> DataFrame:
    """Per subtask: the entries that may stay in its buffer."""
    rows = events.select(
        (F.col("event_id") % SUBTASKS).alias("subtask"), "event_id", "user_id", "event_type", "value"
    )
    return recent_rows(rows, ["subtask"], "event_id", BUFFER_SIZE).select(
        "subtask",
        F.col("event_id").alias("seq"),
        entry_text(F.col("user_id"), F.col("event_type"), F.col("value")).alias("entry"),
    )


def summaries_into(folder: str, summarise: Callable[[DataFrame], DataFrame]):
    """A ``foreachBatch`` function that writes the summary of each batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = summarise(batch).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        numbered.write.mode("overwrite").parquet(f"{folder}/b{batch_id}")

    return write
