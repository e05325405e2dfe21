"""Summaries of snapshots, operators, reads and pins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def snapshot_stats(snapshots: DataFrame) -> DataFrame:
    savepoint = F.col("type") == "savepoint"
    return snapshots.agg(
        F.count_if(~savepoint).alias("n_checkpoints"),
        F.count_if(savepoint).alias("n_savepoints"),
        F.count_distinct("job_id").alias("n_jobs"),
    )


def operator_summary(operators: DataFrame) -> DataFrame:
    """Text like ``a(keyed), b(keyed,operator[2])`` per snapshot path.

    ``operators`` has one row per declared operator of a snapshot; snapshots
    without any come in with a null uid and read ``(none)``.
    """
    kinds = F.concat_ws(
        ",",
        F.when(F.size("keyed_states") > 0, "keyed"),
        F.when(
            F.size("operator_states") > 0,
            F.concat(F.lit("operator["), F.size("operator_states").cast("string"), F.lit("]")),
        ),
    )
    label = F.when(
        F.col("uid").isNotNull(),
        F.concat(F.col("uid"), F.when(kinds != "", F.concat(F.lit("("), kinds, F.lit(")"))).otherwise("")),
    )
    listed = F.array_join(F.array_sort(F.collect_list(label)), ", ")
    return operators.groupBy("path").agg(
        F.when(listed == "", "(none)").otherwise(listed).alias("operators")
    )


def operator_details(operators: DataFrame) -> DataFrame:
    """The operators of each snapshot path as an array of structs."""
    packed = F.struct("uid", "name", "keyed_states", "operator_states")
    return operators.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(F.col("uid").isNotNull(), packed))).alias("operators")
    )


def read_report(entries: DataFrame, raw: str = "raw") -> DataFrame:
    """Undecoded entries per operator and the reasons given.

    ``raw`` is an envelope column, null for entries that were decoded.
    """
    return entries.groupBy("operator_uid").agg(
        F.count("*").alias("n_entries"),
        F.count_if(F.col(raw).isNotNull()).alias("n_undecoded"),
        F.array_join(F.array_sort(F.collect_set(f"{raw}._reason")), "; ").alias("warnings"),
        (F.count_if(F.col(raw).isNotNull()) > 0).alias("partial_read"),
    )
