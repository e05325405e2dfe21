"""Reading the state of a stream checkpoint at a batch as typed rows."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F, types as T

from stateglass.functions.text import json_text
from stateglass.operators.entries import combine_states, merge_rows, one_result
from stateglass.sources.catalog import discover_operators, state_variables
from stateglass.sources.custom import as_entries
from stateglass.sources.files import matching


def _ready(spark: SparkSession) -> None:
    # State can be read only once the streaming manager of the session exists.
    spark.streams.active  # noqa: B018


def _load(spark: SparkSession, checkpoint: str, **options: object) -> DataFrame:
    _ready(spark)
    reader = spark.read.format("statestore")
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, str(value).lower() if isinstance(value, bool) else value)
    try:
        return reader.load(checkpoint)
    except PySparkException as error:
        given = ", ".join(f"{k}={v}" for k, v in options.items() if v is not None)
        raise ValueError(f"no such state in {checkpoint} ({given}): {error}") from error


def _unwrapped(name: str, dtype: T.DataType):
    """A struct of one field stands for that field."""
    if isinstance(dtype, T.StructType) and len(dtype) == 1:
        return F.col(f"{name}.{dtype[0].name}"), dtype[0].dataType
    return F.col(name), dtype


def read_value_state(
    spark: SparkSession, checkpoint: str, state_name: str, batch_id: int | None = None, operator_id: int = 0
) -> DataFrame:
    """``key, value`` rows of a VALUE state; one-field structs are unwrapped."""
    raw = _load(spark, checkpoint, batchId=batch_id, operatorId=operator_id, stateVarName=state_name)
    value, _ = _unwrapped("value", raw.schema["value"].dataType)
    return raw.select("key", value.alias("value"))


def read_list_state(
    spark: SparkSession, checkpoint: str, state_name: str, batch_id: int | None = None, operator_id: int = 0
) -> DataFrame:
    """``key, value`` rows of a LIST state, one per element, in no order."""
    raw = _load(spark, checkpoint, batchId=batch_id, operatorId=operator_id, stateVarName=state_name)
    value, _ = _unwrapped("list_element", raw.schema["list_element"].dataType)
    return raw.select("key", value.alias("value"))


def read_map_state(
    spark: SparkSession, checkpoint: str, state_name: str, batch_id: int | None = None, operator_id: int = 0
) -> DataFrame:
    """``key, map_key, value`` rows of a MAP state, one per entry."""
    raw = _load(spark, checkpoint, batchId=batch_id, operatorId=operator_id, stateVarName=state_name)
    map_key, _ = _unwrapped("user_map_key", raw.schema["user_map_key"].dataType)
    value, _ = _unwrapped("user_map_value", raw.schema["user_map_value"].dataType)
    return raw.select("key", map_key.alias("map_key"), value.alias("value"))


def read_keyed_state(
    spark: SparkSession,
    checkpoint: str,
    state_name: str,
    batch_id: int | None = None,
    operator_id: int = 0,
    flatten: bool = False,
) -> DataFrame:
    """``key, value`` rows of a VALUE, LIST or MAP state at a committed batch.

    Lists come as arrays and maps as maps; with ``flatten`` every element or
    entry is a row of its own, which suits states of unbounded size.
    """
    if flatten:
        raw = _load(spark, checkpoint, batchId=batch_id, operatorId=operator_id, stateVarName=state_name)
        if "list_element" in raw.columns:
            return read_list_state(spark, checkpoint, state_name, batch_id, operator_id)
        if "user_map_key" in raw.columns:
            return read_map_state(spark, checkpoint, state_name, batch_id, operator_id)
        return read_value_state(spark, checkpoint, state_name, batch_id, operator_id)
    raw = _load(
        spark,
        checkpoint,
        batchId=batch_id,
        operatorId=operator_id,
        stateVarName=state_name,
        flattenCollectionTypes=False,
    )
    name = next(c for c in ("value", "list_value", "map_value") if c in raw.columns)
    dtype = raw.schema[name].dataType
    value = F.col(name)
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, T.StructType) and len(dtype.elementType) == 1:
            field = dtype.elementType[0].name
            value = F.transform(value, lambda x: x[field])
    elif isinstance(dtype, T.MapType):
        if isinstance(dtype.keyType, T.StructType) and len(dtype.keyType) == 1:
            key_field = dtype.keyType[0].name
            value = F.transform_keys(value, lambda k, _: k[key_field])
        if isinstance(dtype.valueType, T.StructType) and len(dtype.valueType) == 1:
            value_field = dtype.valueType[0].name
            value = F.transform_values(value, lambda _, v: v[value_field])
    else:
        value, _ = _unwrapped(name, dtype)
    return raw.select("key", value.alias("value"))


def read_aggregation_state(
    spark: SparkSession,
    checkpoint: str,
    fields: list[str],
    batch_id: int | None = None,
    operator_id: int = 0,
) -> DataFrame:
    """Accumulators of a streaming aggregation: ``key`` and the named fields.

    Field names repeat inside the stored struct, so it is cast by position.
    """
    raw = _load(spark, checkpoint, batchId=batch_id, operatorId=operator_id)
    stored = raw.schema["value"].dataType
    if len(stored) != len(fields):
        raise ValueError(f"the accumulator has {len(stored)} fields: {stored.simpleString()}")
    renamed = T.StructType([T.StructField(n, f.dataType) for n, f in zip(fields, stored)])
    return raw.select("key", F.col("value").cast(renamed).alias("value")).select("key", "value.*")


def visible_states(spark: SparkSession, checkpoint: str) -> list[Row]:
    """Operators and their states without those Spark keeps for itself.

    As many rows as the job declares, so they may come to the driver.
    """
    return (
        state_variables(spark, checkpoint)
        .filter(~F.col("state_name").rlike(r"^\$"))
        .select("operator_id", "name", "state_name", "store", "declared")
        .distinct()
        .orderBy("operator_id", "state_name")
        .collect()
    )


def _read_any(
    spark: SparkSession, checkpoint: str, state: Row, batch_id: int | None
) -> DataFrame:
    if state["declared"]:
        return read_keyed_state(
            spark, checkpoint, state["state_name"], batch_id, state["operator_id"]
        )
    store = None if state["store"] == "default" else state["store"]
    raw = _load(
        spark, checkpoint, batchId=batch_id, operatorId=state["operator_id"], storeName=store
    )
    return raw.select("key", "value")


def _json(df: DataFrame, name: str) -> Column:
    """JSON text of a column; repeated field names get their position added."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StructType) and len(set(dtype.names)) < len(dtype):
        dtype = T.StructType(
            [T.StructField(f"{f.name}_{i}", f.dataType) for i, f in enumerate(dtype)]
        )
    return json_text(F.col(name).cast(dtype), dtype)


def state_entries(
    spark: SparkSession, checkpoint: str, batch_id: int | None = None
) -> DataFrame:
    """All states of all operators as long entries, keys and values as JSON text."""
    parts = []
    for state in visible_states(spark, checkpoint):
        rows = _read_any(spark, checkpoint, state, batch_id)
        parts.append(
            as_entries(
                rows,
                str(state["operator_id"]),
                state["state_name"],
                _json(rows, "key"),
                _json(rows, "value"),
            )
        )
    return one_result(parts)


def operator_entry_counts(
    spark: SparkSession, checkpoint: str, batch_id: int | None = None
) -> DataFrame:
    """Number of distinct keys each operator holds: ``uid, n_keys``."""
    keys: dict[int, list[DataFrame]] = {}
    for state in visible_states(spark, checkpoint):
        rows = _read_any(spark, checkpoint, state, batch_id).select("key")
        keys.setdefault(state["operator_id"], []).append(rows)
    return one_result(
        [
            one_result(parts)
            .distinct()
            .agg(F.count("*").alias("n_keys"))
            .select(F.lit(str(operator)).alias("uid"), "n_keys")
            for operator, parts in keys.items()
        ]
    )


def operators_with_counts(
    spark: SparkSession, checkpoint: str, batch_id: int | None = None
) -> DataFrame:
    """The operator catalog with ``n_keys``, the keys each operator holds."""
    catalog = discover_operators(spark, checkpoint)
    return merge_rows([catalog, operator_entry_counts(spark, checkpoint, batch_id)], ["uid"])


def read_all_states(
    spark: SparkSession, checkpoint: str, batch_id: int | None = None, operator_id: int = 0
) -> DataFrame:
    """One row per key with a typed column per declared state variable."""
    states = visible_states(spark, checkpoint)
    names = [s["state_name"] for s in states if s["operator_id"] == operator_id]
    return combine_states(
        {n: read_keyed_state(spark, checkpoint, n, batch_id, operator_id) for n in names}
    )


def all_typed_states(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> dict[str, DataFrame]:
    """By operator one row per key with a typed column per state, declared or not."""
    found: dict[str, dict[str, DataFrame]] = {}
    for state in visible_states(spark, checkpoint):
        rows = _read_any(spark, checkpoint, state, batch_id)
        found.setdefault(str(state["operator_id"]), {})[state["state_name"]] = rows
    return {uid: combine_states(states) for uid, states in found.items()}


def read_source_offsets(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Source positions of each batch: ``job_id, batch_id, planned_ms, source, position, committed``.

    ``checkpoint`` may be a pattern of many. An offset file has a version line, a line
    about the batch and one line per source; ``position`` is that line, see
    ``source_positions``. ``job_id`` is the name of the checkpoint's folder.
    """
    root = checkpoint.rstrip("/")
    committed = _batch_log(spark, root, "commits").select("__root", "batch_id", F.lit(True).alias("committed"))
    info = F.from_json(F.get("lines", F.lit(1)), "struct<batchTimestampMs:bigint>")
    sources = F.expr("slice(lines, 3, size(lines))")
    return (
        _batch_log(spark, root, "offsets")
        .select(
            "__root",
            "batch_id",
            info["batchTimestampMs"].alias("planned_ms"),
            F.posexplode(sources).alias("source", "position"),
        )
        .join(committed, ["__root", "batch_id"], "left")
        .select(
            F.element_at(F.split("__root", "/"), -1).alias("job_id"),
            "batch_id",
            "planned_ms",
            "source",
            "position",
            F.coalesce("committed", F.lit(False)).alias("committed"),
        )
    )


def _batch_log(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``__root, batch_id, lines`` of the files of a log; without such a folder none."""
    schema = "__root string, batch_id bigint, lines array<string>"
    if not matching(spark, f"{root}/{name}"):
        return spark.createDataFrame([], schema)
    path = F.col("_metadata.file_path")
    return (
        spark.read.text(f"{root}/{name}", wholetext=True)
        .select(
            F.regexp_extract(path, f"^(.*)/{name}/[^/]*$", 1).alias("__root"),
            F.regexp_extract(path, "([0-9]+)$", 1).try_cast("bigint").alias("batch_id"),
            F.split("value", "\n").alias("lines"),
        )
        .filter(F.col("batch_id").isNotNull())
    )


_POSITION = T.StructType().add("partition", "string").add("position", "long")


@F.arrow_udf(T.ArrayType(_POSITION))
def _positions(texts: pa.Array) -> pa.Array:
    """The whole numbers in JSON texts, each with the names that lead to it."""

    def walk(value, names: tuple[str, ...]):
        if isinstance(value, dict):
            for name, below in value.items():
                yield from walk(below, (*names, name))
        elif isinstance(value, list):
            for number, below in enumerate(value):
                yield from walk(below, (*names, str(number)))
        elif isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63:
            yield {"partition": "/".join(names), "position": value}
        elif isinstance(value, str) and value.lstrip("-").isdigit() and len(value) < 19:
            yield {"partition": "/".join(names), "position": int(value)}

    def positions(text: str | None) -> list:
        try:
            return list(walk(json.loads(text or ""), ()))
        except ValueError:
            return []

    kind = pa.list_(pa.struct([("partition", pa.string()), ("position", pa.int64())]))
    return pa.array([positions(t) for t in texts.to_pylist()], kind)


def source_positions(offsets: DataFrame) -> DataFrame:
    """One row per batch, source and partition: ``partition``, ``position`` and ``advance``.

    A position is any JSON: every whole number in it is a position, named by the fields
    and places that lead to it, joined by slashes (``topic/0``, ``logOffset``, or nothing
    for a bare number). Sources whose line has none, such as ``-``, give no rows.
    ``advance`` is the move since the batch before that has the partition.
    """
    by = Window.partitionBy("job_id", "source", "partition").orderBy("batch_id")
    return (
        offsets.select("job_id", "batch_id", "planned_ms", "committed", "source", F.inline(_positions("position")))
        .withColumn("advance", F.col("position") - F.lag("position").over(by))
    )
