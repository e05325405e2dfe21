"""Comparing two snapshots key by key.

A side is any DataFrame with one row per key; a side that is a log of writes is
first brought to that by naming its sequence column. The two sides meet in one full outer join. A key
column that is not nullable, such as a struct of the key parts, is compared
with plain equality: null parts still match, and the join takes over the
partitioning of the aggregation that made the snapshot, with no further
shuffle. Nullable key columns are compared null-safe.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from stateglass.functions.text import json_text
from stateglass.operators.entries import last_rows
from stateglass.operators.paging import check_limit, check_offset, rows_after, top_per_group
from stateglass.session import kept

ADDED, REMOVED, MODIFIED, UNCHANGED = "ADDED", "REMOVED", "MODIFIED", "UNCHANGED"

# Never reported as changed: they say which entry it is.
IDENTITY_FIELDS = ("key", "partition")

CHANGES_TYPE = "array<struct<field_name:string,old_value:string,new_value:string>>"


def field_names(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[str]:
    """Value fields of both sides, those of the left first."""
    skip = {*keys, *IDENTITY_FIELDS}
    return [c for c in dict.fromkeys([*left.columns, *right.columns]) if c not in skip]


def combined_fields(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides under the union of their fields; absent is null."""
    return left.unionByName(right, allowMissingColumns=True)


def _without_null_keys(side: DataFrame, keys: Sequence[str]) -> DataFrame:
    for key in keys:
        null = F.raise_error(F.lit(f"null in key column {key}")).cast("boolean")
        side = side.filter(F.when(F.col(f"`{key}`").isNull(), null).otherwise(True))
    return side


def unique_keys(side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; a key that occurs twice fails the job.

    Rows of a key have to meet for it, as they do for the join, whose
    partitioning and order by keys that are not nullable this already is.
    """
    names = [f"`{k}`" for k in keys]
    twice = F.raise_error(F.lit(f"a key occurs more than once: {', '.join(keys)}")).cast("boolean")
    number = F.row_number().over(Window.partitionBy(*names).orderBy(*names))
    numbered = side.withColumn("__number", number)
    return numbered.filter(F.when(F.col("__number") > 1, twice).otherwise(True)).drop("__number")


def _key_condition(
    left: DataFrame, right: DataFrame, keys: Sequence[str], null_keys: bool = True
) -> Column:
    def same(key: str) -> Column:
        l, r = F.col(f"l.`{key}`"), F.col(f"r.`{key}`")
        if null_keys and (left.schema[key].nullable or right.schema[key].nullable):
            return l.eqNullSafe(r)
        return l == r

    return reduce(Column.__and__, [same(k) for k in keys])


class _Field:
    """One value field as seen from both sides of the join."""

    def __init__(self, name: str, left: DataFrame, right: DataFrame):
        self.name = name
        self.ltype = left.schema[name].dataType if name in left.columns else None
        self.rtype = right.schema[name].dataType if name in right.columns else None

    def _side(self, side: str, dtype: T.DataType | None) -> Column:
        return F.lit(None).cast("string") if dtype is None else F.col(f"{side}.`{self.name}`")

    def old(self) -> Column:
        return json_text(self._side("l", self.ltype), self.ltype or T.StringType())

    def new(self) -> Column:
        return json_text(self._side("r", self.rtype), self.rtype or T.StringType())

    def same(self) -> Column:
        """Equal JSON text; values of one plain type need not be printed for it."""
        plain = isinstance(
            self.ltype,
            (
                T.IntegralType,
                T.StringType,
                T.BooleanType,
                T.DateType,
                T.TimestampType,
                T.TimestampNTZType,
                T.DecimalType,
                T.FractionalType,
            ),
        )
        if plain and self.ltype == self.rtype:
            return self._side("l", self.ltype).eqNullSafe(self._side("r", self.rtype))
        return self.old().eqNullSafe(self.new())


def _joined(
    left: DataFrame, right: DataFrame, keys: Sequence[str], null_keys: bool = True
) -> DataFrame:
    l = left.withColumn("__left", F.lit(True)).alias("l")
    r = right.withColumn("__right", F.lit(True)).alias("r")
    return l.join(r, _key_condition(left, right, keys, null_keys), "full_outer")


def _status(unchanged: Column) -> Column:
    return (
        F.when(F.col("__left").isNull(), ADDED)
        .when(F.col("__right").isNull(), REMOVED)
        .when(unchanged, UNCHANGED)
        .otherwise(MODIFIED)
    )


def _fields(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[_Field]:
    return [_Field(n, left, right) for n in field_names(left, right, keys)]


def _all_same(fields: list[_Field]) -> Column:
    return reduce(Column.__and__, [f.same() for f in fields], F.lit(True))


def _keys_out(keys: Sequence[str]) -> list[Column]:
    # The key of the side that has one: null parts of a key are kept as they are.
    return [
        F.when(F.col("__left").isNull(), F.col(f"r.`{k}`")).otherwise(F.col(f"l.`{k}`")).alias(k)
        for k in keys
    ]


def diff_snapshots(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = ("key",),
    keys_only: bool = False,
    null_keys: bool = True,
    seq: str | None = None,
    check_keys: bool = False,
) -> DataFrame:
    """One row per key: ``keys..., status, left, right, field_changes``.

    A key on both sides is MODIFIED exactly when ``field_changes`` is not
    empty. With ``keys_only`` there are just ``keys..., status`` and no key is
    MODIFIED. ``null_keys=False`` says that no key is null, as in bucketed
    pins, so that the join can take over how they are stored; a null key then
    fails the job. With ``seq`` the sides are writes, and the one with the
    largest number counts for its key. Otherwise a key must occur once per side;
    ``check_keys`` fails the job if one does not, at the price of a sort.
    """
    if check_keys and seq is None:
        left, right = unique_keys(left, keys), unique_keys(right, keys)
    if seq is not None:
        left, right = last_rows(left, seq, keys), last_rows(right, seq, keys)
    if not null_keys:
        left, right = _without_null_keys(left, keys), _without_null_keys(right, keys)
    joined = _joined(left, right, keys, null_keys)
    if keys_only:
        return joined.select(*_keys_out(keys), _status(F.lit(True)).alias("status"))
    fields = _fields(left, right, keys)
    both = F.col("__left").isNotNull() & F.col("__right").isNotNull()

    def side(marker: str, name: str, df: DataFrame) -> Column:
        values = [F.col(f"{name}.`{f.name}`") for f in fields if f.name in df.columns]
        packed = F.struct(*values) if values else F.struct(F.lit(None).cast("string").alias("_none"))
        return F.when(F.col(marker).isNotNull(), packed)

    none = F.expr(f"cast(array() as {CHANGES_TYPE})")

    def change(f: _Field) -> Column:
        return F.array(
            F.struct(
                F.lit(f.name).alias("field_name"),
                f.old().alias("old_value"),
                f.new().alias("new_value"),
            )
        )

    # Joined arrays of one or no change keep to generated code; a filter over
    # an array of all fields would not.
    changes = F.concat(none, *[F.when(both & ~f.same(), change(f)).otherwise(none) for f in fields])
    return joined.select(
        *_keys_out(keys),
        _status(_all_same(fields)).alias("status"),
        side("__left", "l", left).alias("left"),
        side("__right", "r", right).alias("right"),
        changes.alias("field_changes"),
    )


def diff_operators(
    left: Mapping[str, DataFrame], right: Mapping[str, DataFrame], keys_only: bool = False
) -> DataFrame:
    """The diff of all operators of two snapshots in one join, every value in its type.

    A side has by operator one row per ``key``, with a column per state. Gives
    ``operator_uid, key, status`` and, unless ``keys_only``, ``left, right,
    field_changes``. Keys are a struct with one part per operator and type of key, of
    which one has a value, so keys of different types never meet; ``left`` and ``right``
    have the states of all operators as ``uid.state``, and ``field_changes`` the names of
    the states. An operator that one side does not have is added or removed as a whole.
    """
    parts: dict[tuple[str, str], tuple[str, T.DataType]] = {}
    for uid, rows in [*left.items(), *right.items()]:
        kind = rows.schema["key"].dataType
        parts.setdefault((uid, kind.simpleString()), (f"key_{len(parts)}", kind))
    if not parts:
        raise ValueError("no operator on either side")

    def wide(uid: str, rows: DataFrame) -> DataFrame:
        own, _ = parts[uid, rows.schema["key"].dataType.simpleString()]
        key = [(F.col("key") if name == own else F.lit(None).cast(kind)).alias(name) for name, kind in parts.values()]
        values = [] if keys_only else [F.col(f"`{c}`").alias(f"{uid}.{c}") for c in rows.columns if c != "key"]
        return rows.select(F.struct(F.lit(uid).alias("operator_uid"), *key).alias("key"), *values)

    def side(operators: Mapping[str, DataFrame], other: Mapping[str, DataFrame]) -> DataFrame:
        # Without operators a side has the other's columns and no rows.
        frames = [wide(*o) for o in operators.items()] or [wide(*o).limit(0) for o in other.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    found = diff_snapshots(side(left, right), side(right, left), keys_only=keys_only)
    uid = F.col("key.operator_uid")
    if keys_only:
        return found.select(uid.alias("operator_uid"), "key", "status")

    def named(change: Column) -> Column:
        name = F.substr(change["field_name"], F.length(uid) + 2)
        return F.struct(name.alias("field_name"), change["old_value"], change["new_value"])

    changes = F.transform("field_changes", named).cast(CHANGES_TYPE).alias("field_changes")
    return found.select(uid.alias("operator_uid"), "key", "status", "left", "right", changes)


def diff_status(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Just ``keys..., status``; nothing is printed as JSON for it."""
    return _joined(left, right, keys).select(
        *_keys_out(keys), _status(_all_same(_fields(left, right, keys))).alias("status")
    )


def added_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    condition = _key_condition(left, right, keys)
    return right.alias("r").join(left.alias("l"), condition, "left_anti").select(*keys)


def removed_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    condition = _key_condition(left, right, keys)
    return left.alias("l").join(right.alias("r"), condition, "left_anti").select(*keys)


def unchanged_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    condition = _key_condition(left, right, keys) & _all_same(_fields(left, right, keys))
    return left.alias("l").join(right.alias("r"), condition, "left_semi").select(*keys)


def all_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    return left.select(*keys).union(right.select(*keys)).distinct()


def field_changes(diff: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """One row per changed field of a modified key."""
    return diff.filter(F.col("status") == MODIFIED).select(
        *keys, F.inline("field_changes")
    )


def change_counts(diff: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    return diff.filter(F.col("status") == MODIFIED).select(
        *keys, F.size("field_changes").cast("bigint").alias("n_changes")
    )


def diff_summary(diff: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals per status, over all keys or per group of ``by``."""

    def total(status: str, name: str) -> Column:
        return F.count_if(F.col("status") == status).alias(name)

    return diff.groupBy(*by).agg(
        total(ADDED, "total_added"),
        total(REMOVED, "total_removed"),
        total(MODIFIED, "total_modified"),
        total(UNCHANGED, "unchanged_count"),
        F.count("*").alias("total_keys"),
    )


def page_totals(diff: DataFrame, offset: int = 0, limit: int = 10_000) -> DataFrame:
    """Per status what its page holds: ``total``, ``entry_count`` and ``has_more``."""
    check_offset(offset)
    check_limit(limit)
    total = F.col("total")
    return (
        diff.filter(F.col("status") != UNCHANGED)
        .groupBy("status")
        .agg(F.count("*").alias("total"))
        .withColumn("entry_count", F.greatest(F.least(total - offset, F.lit(limit)), F.lit(0)))
        .withColumn("has_more", total > offset + limit)
    )


def page_per_status(
    diff: DataFrame,
    offset: int = 0,
    limit: int = 10_000,
    keys: Sequence[str] = ("key",),
    after: Sequence | None = None,
) -> DataFrame:
    """The same page of each list of changes; ``pos`` counts from 1.

    The diff is worked out once: its changes are written to the shared folder, and
    each status is cut to the end of the page by selection, so the task that ranks a
    status gets a bounded number of rows however many there are. With ``after``, the
    keys of the last row seen, pages begin behind it and ``pos`` counts from there.
    """
    check_offset(offset)
    check_limit(limit)
    changes = kept(diff.filter(F.col("status") != UNCHANGED), "changes")
    paged = top_per_group(rows_after(changes, keys, after), ["status"], keys, offset + limit, bounded=False)
    return paged.filter(F.col("pos") > offset)
