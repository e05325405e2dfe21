"""Stateful operators and their state variables in a stream checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

VARIABLES_SCHEMA = (
    "struct<stateVariables:array<struct<stateName:string,stateVariableType:string,"
    "ttlEnabled:boolean>>>"
)


def state_metadata(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row per operator and state store, as Spark reports them."""
    return spark.read.format("state-metadata").load(checkpoint)


def state_variables(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row per operator and declared state variable.

    Operators without declared variables, such as aggregations, hold one value
    per key; it is listed under the name of the store.
    """
    meta = state_metadata(spark, checkpoint)
    declared = F.from_json("operatorProperties", VARIABLES_SCHEMA)["stateVariables"]
    variable = F.explode_outer(F.transform(declared, lambda v: v)).alias("v")
    return meta.select(
        F.col("operatorId").alias("operator_id"),
        F.col("operatorName").alias("name"),
        F.col("stateStoreName").alias("store"),
        F.col("numPartitions").alias("n_partitions"),
        F.col("minBatchId").alias("min_batch_id"),
        F.col("maxBatchId").alias("max_batch_id"),
        variable,
    ).select(
        "operator_id",
        "name",
        F.coalesce("v.stateName", "store").alias("state_name"),
        F.coalesce("v.stateVariableType", F.lit("ValueState")).alias("state_type"),
        F.col("v.stateName").isNotNull().alias("declared"),
        "store",
        "n_partitions",
        "min_batch_id",
        "max_batch_id",
    )


def discover_operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``uid, name, keyed_states, operator_states`` per operator.

    Streams know keyed state only, so ``operator_states`` is empty; pinned
    snapshots may have both (see ``pinned_operators``).
    """
    names = F.array_sort(F.collect_set(F.when(~F.col("internal"), F.col("state_name"))))
    return (
        state_variables(spark, checkpoint)
        .withColumn("internal", F.col("state_name").rlike(r"^\$"))
        .groupBy(F.col("operator_id").cast("string").alias("uid"), "name")
        .agg(names.alias("keyed_states"))
        .withColumn("operator_states", F.expr("cast(array() as array<string>)"))
    )


def pinned_operators(entries: DataFrame) -> DataFrame:
    """Operators of entries ``operator_uid, state_kind, state_name, ...``.

    ``uid, name, keyed_states, operator_states, n_entries``; only distinct names
    and counts are shuffled.
    """

    def names(kind: str):
        chosen = F.when(F.col("state_kind") == kind, F.col("state_name"))
        return F.array_sort(F.collect_set(chosen))

    return entries.groupBy(F.col("operator_uid").alias("uid")).agg(
        F.lit("").alias("name"),
        names("keyed").alias("keyed_states"),
        names("operator").alias("operator_states"),
        F.count("*").alias("n_entries"),
    )


def stateful_only(operators: DataFrame) -> DataFrame:
    return operators.filter(F.size("keyed_states") + F.size("operator_states") > 0)


def with_keyed_state(operators: DataFrame) -> DataFrame:
    return operators.filter(F.size("keyed_states") > 0)


def with_operator_state(operators: DataFrame) -> DataFrame:
    return operators.filter(F.size("operator_states") > 0)
