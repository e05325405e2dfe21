"""Looking at a storage path as a whole: list, browse, inspect, compare.

A snapshot is named by its path: the folder of a pinned snapshot, the
checkpoint folder of a stream (its latest batch), or ``.../offsets/N`` in it
(batch N), which is how discovery names the batches of a stream.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stateglass.functions.naming import iso_time, short_job_id
from stateglass.functions.payload import raw_envelope
from stateglass.operators import diff as d, entries as e, paging, reports
from stateglass.operators.payloads import decode_payloads
from stateglass.operators.selection import desc
from stateglass.sinks.pins import PinStore, read_catalog, read_pin, read_typed, typed_uids
from stateglass.sources.catalog import discover_operators
from stateglass.sources.files import exists
from stateglass.sources.snapshots import MARKER, discover_snapshots, merge_listings
from stateglass.sources.state import all_typed_states, read_all_states, state_entries

# How many rows are shown unless told otherwise.
LIST_LIMIT = 20
INSPECT_LIMIT = 1_000

# Where an entry of operator state is.
PLACE_COLUMNS = ("subtask", "mode", "pos")

_BATCH = re.compile(r"^(.*)/offsets/(\d+)$")


def list_snapshots(
    spark: SparkSession, base: str, limit: int = LIST_LIMIT, per_job: int | None = None
) -> DataFrame:
    """The newest snapshots of both layouts below ``base``, and whether there are more.

    ``truncated`` says on every row whether ``limit`` cut any off.
    """
    found = merge_listings(
        discover_snapshots(spark, base, "pinned"), discover_snapshots(spark, base, "streaming")
    )
    if per_job is not None:
        newest = [desc("modification_time"), "path"]
        found = paging.top_per_group(found, ["job_id"], newest, per_job).drop("pos")
    return paging.bounded_read(found, [desc("modification_time"), "path"], limit)


def _split(path: str) -> tuple[str, int | None]:
    batch = _BATCH.match(path.rstrip("/"))
    return (batch.group(1), int(batch.group(2))) if batch else (path.rstrip("/"), None)


def snapshot_entries(spark: SparkSession, path: str) -> DataFrame:
    """``operator_uid, state_kind, state_name, key, value`` of a snapshot.

    Entries of operator state also have ``subtask, mode, pos`` if the pin does.
    """
    root, batch = _split(path)
    if batch is None and exists(spark, f"{root}/{MARKER}"):
        rows = read_pin(spark, root)
        more = [c for c in PLACE_COLUMNS if c in rows.columns]
        return rows.select(*e.ENTRY_COLUMNS, *more)
    return state_entries(spark, root, batch)


def typed_states(spark: SparkSession, path: str, operator_uid: str = "0") -> DataFrame:
    """One row per key of an operator, a typed column per state variable."""
    root, batch = _split(path)
    if batch is None and exists(spark, f"{root}/{MARKER}"):
        return read_typed(spark, root, operator_uid)
    return read_all_states(spark, root, batch, int(operator_uid))


def typed_operators(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The typed states of every operator of a snapshot, by uid."""
    root, batch = _split(path)
    if batch is None and exists(spark, f"{root}/{MARKER}"):
        return {uid: read_typed(spark, root, uid) for uid in typed_uids(spark, root)}
    return all_typed_states(spark, root, batch)


def snapshot_operators(spark: SparkSession, path: str) -> DataFrame:
    """``uid, name, keyed_states, operator_states`` of a snapshot."""
    root, batch = _split(path)
    if batch is None and exists(spark, f"{root}/{MARKER}"):
        return read_catalog(spark, root).drop("n_entries")
    return discover_operators(spark, root)


def browse(spark: SparkSession, base: str, limit: int = LIST_LIMIT) -> DataFrame:
    """The newest snapshots with a running index and their operators.

    Paths are taken to the driver, ``limit`` of them at most, to open each
    snapshot's catalog.
    """
    listed = list_snapshots(spark, base, limit)
    rows = listed.collect()
    listed = spark.createDataFrame(rows, listed.schema)
    catalogs = [
        snapshot_operators(spark, r["path"]).withColumn("path", F.lit(r["path"]))
        for r in rows
        if r["valid"]
    ]
    shown = listed.withColumns({"index": F.col("pos"), "millis": F.unix_millis("modification_time")}).select(
        "index",
        "type",
        short_job_id(F.col("job_id")).alias("job"),
        iso_time(F.col("millis")).alias("time"),
        "path",
        "truncated",
    )
    if not catalogs:
        return shown.withColumn("operators", F.lit("(none)"))
    summaries = reports.operator_summary(e.one_result(catalogs))
    return e.merge_rows([shown, summaries], ["path"]).withColumn(
        "operators", F.coalesce("operators", F.lit("(none)"))
    )


def select_entries(
    entries: DataFrame,
    operator_uid: str | None = None,
    state_name: str | None = None,
    key_filter: str | None = None,
) -> DataFrame:
    """Entries of one operator and state, or of all; filters apply to every kind."""
    if operator_uid is not None:
        entries = e.of_operator(entries, operator_uid)
    if state_name is not None:
        entries = e.of_state(entries, state_name)
    return e.with_key_text(entries, key_filter)


def inspect(
    spark: SparkSession,
    path: str,
    operator_uid: str | None = None,
    state_name: str | None = None,
    key_filter: str | None = None,
    keys_only: bool = False,
    offset: int = 0,
    limit: int = INSPECT_LIMIT,
    after: Sequence | None = None,
) -> DataFrame:
    """A page of the entries of a snapshot, with ``pos`` and ``has_more``.

    Any depth is reached with ``after``, the values of the last row seen in the order
    of the page, which ``inspect_order`` gives.
    """
    paging.check_offset(offset)
    paging.check_limit(limit)
    rows = select_entries(snapshot_entries(spark, path), operator_uid, state_name, key_filter)
    if keys_only:
        rows = e.keys_only(rows, ["operator_uid", "key"])
    return paging.page(rows, inspect_order(rows), offset, limit, after)


def inspect_report(spark: SparkSession, path: str, operator_uid: str | None = None) -> DataFrame:
    """What reading a snapshot could not decode: the read report of its typed values.

    ``operator_uid, n_entries, n_undecoded, warnings, partial_read``. Values with a type
    are decoded by it; binary ones are tried as payloads.
    """
    read = []
    for uid, rows in typed_operators(spark, path).items():
        if operator_uid not in (None, uid):
            continue
        for field in rows.schema:
            if field.name == "key":
                continue
            value = F.col(f"`{field.name}`")
            opaque = value if isinstance(field.dataType, T.BinaryType) else F.lit(None).cast("binary")
            held = rows.filter(value.isNotNull()).select(F.lit(uid).alias("operator_uid"), opaque.alias("payload"))
            if isinstance(field.dataType, T.BinaryType):
                read.append(decode_payloads(held, "payload").select("operator_uid", "raw"))
            else:
                read.append(held.select("operator_uid", raw_envelope(F.col("payload"), F.lit("")).alias("raw")))
    if not read:
        read = [spark.createDataFrame([], "operator_uid string, raw struct<_reason:string>")]
    return reports.read_report(e.one_result(read))


def inspect_order(rows: DataFrame) -> list[str]:
    """The columns that pages of entries, or of their keys, are ordered by."""
    return [c for c in ("operator_uid", "state_name", *PLACE_COLUMNS, "key") if c in rows.columns]


def compare(
    spark: SparkSession,
    left: str,
    right: str,
    operator_uid: str | None = None,
    state_name: str | None = None,
    keys_only: bool = False,
) -> DataFrame:
    """The diff of two snapshots over the operators and states of both.

    ``operator_uid, state_name, key, status, left_value, right_value``, keys and
    values as text; elements of list state are told apart by ``subtask, mode, pos``,
    which are there if either snapshot has them. An entry that occurs twice fails
    the job. See ``compare_operator`` for typed values and their fields, and
    ``diff.page_per_status`` and ``diff.diff_summary`` for pages and totals.
    """
    sides = [select_entries(snapshot_entries(spark, p), operator_uid, state_name) for p in (left, right)]
    types = {c: s.schema[c].dataType for s in sides for c in PLACE_COLUMNS if c in s.columns}

    def side(rows: DataFrame) -> DataFrame:
        places = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()]
        return rows.select(F.struct("operator_uid", "state_name", "key", *places).alias("key"), "value")

    found = d.diff_snapshots(*map(side, sides), keys_only=keys_only, check_keys=True)
    if keys_only:
        return found.select("key.*", "status")
    return found.select(
        "key.*",
        "status",
        F.col("left.value").alias("left_value"),
        F.col("right.value").alias("right_value"),
    )


def compare_operator(
    spark: SparkSession, left: str, right: str, operator_uid: str = "0", keys_only: bool = False
) -> DataFrame:
    """The diff of an operator's typed states, one row per key.

    ``key, status, left, right, field_changes``; a state variable is a field, and
    keys are compared by type.
    """
    sides = (typed_states(spark, p, operator_uid) for p in (left, right))
    return d.diff_snapshots(*sides, keys_only=keys_only)


def compare_operators(spark: SparkSession, left: str, right: str, keys_only: bool = False) -> DataFrame:
    """The diff of the typed states of all operators of both snapshots, in one job.

    ``operator_uid, key, status, left, right, field_changes``, see ``diff.diff_operators``.
    """
    sides = (typed_operators(spark, p) for p in (left, right))
    return d.diff_operators(*sides, keys_only=keys_only)


def pin_checkpoint(
    spark: SparkSession, store: PinStore, path: str, job: str | None, name: str
) -> str:
    """Copy a snapshot into a pin that outlives it; returns the id of the pin.

    The pin has the entries as text and the typed rows of every operator.
    """
    rows = snapshot_entries(spark, path).withColumn("operator_id", F.col("operator_uid"))
    return store.pin_snapshot(rows, job, name, source_path=path, typed=typed_operators(spark, path))
