"""Enriching a stream with settings that change while it runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from stateglass.operators.opstate import current_config, with_config
from stateglass.sources.catalog import state_metadata
from stateglass.sources.files import create_new, exists, read_text
from stateglass.sources.state import read_aggregation_state

NO_BATCH = -1


def settings_batch(spark: SparkSession, checkpoint: str) -> int:
    """The newest batch of the stream of settings; -1 before its first."""
    if not exists(spark, f"{checkpoint}/commits") or not exists(spark, f"{checkpoint}/state"):
        return NO_BATCH
    newest = state_metadata(spark, checkpoint).agg(F.max("maxBatchId")).first()[0]
    return NO_BATCH if newest is None else newest


def settings_at(spark: SparkSession, checkpoint: str, batch_id: int) -> DataFrame:
    """The settings ``k, v, seq`` that the stream of ``jobs.config_upserts`` held at a batch."""
    if batch_id == NO_BATCH:
        return spark.createDataFrame([], "k string, v string, seq bigint")
    return read_aggregation_state(spark, checkpoint, ["v", "seq"], batch_id).select("key.k", "v", "seq")


def enrich_into(config_checkpoint: str, output_path: str, names: Sequence[str]):
    """A ``foreachBatch`` function: join each batch with the settings as they are.

    The settings are the state of a ``jobs.config_upserts`` stream, one row each, at its
    newest batch. The number of that batch is noted once under ``output_path/_settings``
    before the batch is written; a batch that is run again reads the note, so it meets
    the same settings, and overwrites its own folder, so its rows are there once. The
    stream of settings has to retain its batches (``minBatchesToRetain``) for as long.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        note = f"{output_path}/_settings/{batch_id}"
        # Only the first try makes the note.
        create_new(spark, note, str(settings_batch(spark, config_checkpoint)))
        config = settings_at(spark, config_checkpoint, int(read_text(spark, note)))
        enriched = with_config(batch, current_config(config, names), names)
        enriched.write.mode("overwrite").parquet(f"{output_path}/batch={batch_id}")

    return write
