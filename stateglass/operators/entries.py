"""Reading entries: filters, projections, wide and long forms, assembly.

Long entries have the columns ``operator_uid, state_kind, state_name, key,
value``; wide entries have one row per key and one column per state.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ENTRY_COLUMNS = ("operator_uid", "state_kind", "state_name", "key", "value")


def of_operator(entries: DataFrame, uid: str) -> DataFrame:
    return entries.filter(F.col("operator_uid") == uid)


def of_state(entries: DataFrame, name: str) -> DataFrame:
    return entries.filter(F.col("state_name") == name)


def keyed_only(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("state_kind") == "keyed")


def with_key_text(entries: DataFrame, text: str | None, key: Column | None = None) -> DataFrame:
    """Entries whose key text contains ``text`` as it stands; empty means all."""
    if not text:
        return entries
    key = F.col("key") if key is None else key
    return entries.filter(key.cast("string").contains(text))


def keys_only(entries: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    return entries.select(*keys).distinct()


def tagged(rows: DataFrame, uid: str, kind: str) -> DataFrame:
    return rows.withColumns({"operator_uid": F.lit(uid), "state_kind": F.lit(kind)})


def to_long(wide: DataFrame, states: Sequence[str], keys: Sequence[str] = ("key",)) -> DataFrame:
    """One row per key and state, values as text, a missing value as ''."""
    texts = [F.coalesce(F.col(s).cast("string"), F.lit("")).alias(s) for s in states]
    return wide.select(*keys, *texts).unpivot(list(keys), list(states), "state_name", "value")


def to_wide(long: DataFrame, states: Sequence[str], keys: Sequence[str] = ("key",)) -> DataFrame:
    """One row per key with a column per state.

    There is one value per key and state, so ``max`` only picks it out. Naming
    the states up front makes this one aggregation with a map-side part.
    """
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("state_name") == s, F.col("value"))).alias(s) for s in states]
    )


def merge_rows(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key with the columns of all frames, each once per key.

    A union and one aggregation shuffle each frame once; a chain of outer joins
    would shuffle what is joined so far again for every further frame.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])


def combine_states(states: dict[str, DataFrame], keys: Sequence[str] = ("key",)) -> DataFrame:
    """One row per key from one frame per state variable, a typed column each.

    Every frame has the key columns and ``value``, once per key.
    """
    frames = [df.select(*keys, F.col("value").alias(name)) for name, df in states.items()]
    return merge_rows(frames, keys)


def last_write_wins(
    writes: DataFrame, seq: str, keys: Sequence[str] = ("key",), value: str = "value"
) -> DataFrame:
    return writes.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def last_rows(writes: DataFrame, seq: str, keys: Sequence[str] = ("key",)) -> DataFrame:
    """The last write of each key with all its fields, without ``seq``."""
    fields = [c for c in writes.columns if c not in keys and c != seq]
    if not fields:
        return writes.select(*keys).distinct()
    last = F.max_by(F.struct(*fields), seq).alias("__last")
    return writes.groupBy(*keys).agg(last).select(*keys, "__last.*")


def one_result(parts: Sequence[DataFrame]) -> DataFrame:
    """Entries of several operators in one frame."""
    return reduce(DataFrame.unionByName, parts)


def entry_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("operator_uid", "state_name").agg(F.count("*").alias("n_entries"))


def state_names(entries: DataFrame) -> DataFrame:
    """State names per operator, sorted; only distinct names are shuffled on."""
    return entries.groupBy("operator_uid").agg(
        F.array_sort(F.collect_set("state_name")).alias("state_names")
    )


def assemble_lists(
    elements: DataFrame,
    keys: Sequence[str],
    pos: str = "pos",
    value: str = "value",
    segment_size: int | None = None,
) -> DataFrame:
    """Lists put together from elements numbered 0, 1, 2, ... per key, one row per key.

    A list that may not fit a row stays as rows, or is asked for in segments: with
    ``segment_size`` every key has a row per so many positions, numbered by
    ``segment``.
    """
    packed = F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(value))))
    if segment_size is None:
        return elements.groupBy(*keys).agg(F.transform(packed, lambda x: x[value]).alias("items"))
    segment = F.call_function("div", F.col(pos).cast("bigint"), F.lit(segment_size).cast("bigint"))
    return (
        elements.withColumn("segment", segment)
        .groupBy(*keys, "segment")
        .agg(F.transform(packed, lambda x: x[value]).alias("items"))
    )


def assemble_maps(
    entries: DataFrame,
    keys: Sequence[str],
    map_key: str = "map_key",
    value: str = "value",
    segments: int | None = None,
) -> DataFrame:
    """Maps put together from rows that are unique per key and map key, one row per key.

    Maps that may not fit a row stay as rows, or are asked for in ``segments``: then
    the entries of every key are dealt to so many rows by a hash of the map key,
    numbered by ``segment``; rows without entries are left out.
    """
    items = F.map_from_entries(F.collect_list(F.struct(F.col(map_key), F.col(value)))).alias("items")
    if segments is None:
        return entries.groupBy(*keys).agg(items)
    segment = F.pmod(F.xxhash64(map_key), F.lit(segments)).cast("bigint")
    return entries.withColumn("segment", segment).groupBy(*keys, "segment").agg(items)
