"""The first rows of an order, found by selection instead of a sort of everything.

To cut rows to a rank, a sample of the order's columns gives a few bounds around the
place where that rank should be, one aggregation counts the rows up to each bound, and
the smallest bound with enough rows becomes a filter: plain comparisons with literals,
which reach the scan. That is repeated on what is left until little more than the rank
is; only this is sorted. Rows are never shuffled for it, whatever the rank. The input is
read twice per round (columns of the order only), so an input that is costly to make
should be written first; each round leaves about a thousandth of it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from stateglass.session import kept

# Rows beyond the rank that are left for the sort. Only speed depends on it.
SLACK = 100_000
# Rows of a sample, and how many of them serve as bounds.
SAMPLED = 2_000
MAX_ROUNDS = 12


class Key(NamedTuple):
    """A column of an order, by name or as an expression; nulls first, or last if descending."""

    by: Column | str
    descending: bool = False

    @property
    def column(self) -> Column:
        return F.col(self.by) if isinstance(self.by, str) else self.by

    def sort(self) -> Column:
        return self.column.desc() if self.descending else self.column.asc()


def desc(by: Column | str) -> Key:
    return Key(by, True)


def order_keys(order: Sequence[Key | Column | str]) -> list[Key]:
    """The columns of an order; descending ones are given by ``desc`` of this module."""
    for part in order:
        if isinstance(part, Column) and str(part).endswith(("NULLS FIRST'>", "NULLS LAST'>")):
            raise ValueError("give the direction of an order by stateglass.operators.selection.desc")
    return [part if isinstance(part, Key) else Key(part) for part in order]


def sorting(order: Sequence[Key | Column | str]) -> list[Column]:
    return [key.sort() for key in order_keys(order)]


def literal(value, kind: T.DataType) -> Column:
    """A value that was collected, as a column of its type."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        parts = [literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)]
        return F.struct(*parts)
    if isinstance(kind, T.ArrayType):
        return F.array(*[literal(v, kind.elementType) for v in value]).cast(kind)
    if isinstance(kind, T.TimestampNTZType) and isinstance(value, datetime):
        return F.lit(value.isoformat()).cast(kind)
    return F.lit(value).cast(kind)


def _before(key: Key, bound: Column) -> Column:
    """Whether a row comes before the bound by this key alone; never null."""
    column = key.column
    if key.descending:
        found = F.when(bound.isNull(), column.isNotNull()).otherwise(column > bound)
    else:
        found = bound.isNotNull() & (column.isNull() | (column < bound))
    return F.coalesce(found, F.lit(False))


def _for_scans(kind: T.DataType) -> bool:
    """Whether minima and maxima of files order values as Spark does, NaN among them."""
    return not isinstance(kind, (T.FloatType, T.DoubleType, T.StructType, T.ArrayType))


def up_to(keys: Sequence[Key], bounds: Sequence[Column], kind: T.DataType) -> Column:
    """Rows not after the bound, one value per key, in the order of the keys.

    ``kind`` is the type of the first key.
    """
    found = F.lit(True)
    for key, bound in reversed(list(zip(keys, bounds))):
        found = _before(key, bound) | (key.column.eqNullSafe(bound) & found)
    if not _for_scans(kind):
        return found
    # The first key alone is a condition that every scan understands.
    first, bound = keys[0], bounds[0]
    if first.descending:
        return (bound.isNull() | (first.column >= bound)) & found
    return (first.column.isNull() | (first.column <= bound)) & found


def beyond(keys: Sequence[Key], values: Sequence, kinds: Sequence[T.DataType]) -> Column:
    """Rows that come after the one with these values."""
    if len(keys) != len(values):
        raise ValueError("one value per column of the order is needed")
    found = F.lit(False)
    for key, value, kind in reversed(list(zip(keys, values, kinds))):
        bound, column = literal(value, kind), key.column
        if key.descending:
            later = F.lit(False) if value is None else column.isNull() | (column < bound)
        else:
            later = column.isNotNull() if value is None else F.coalesce(column > bound, F.lit(False))
        found = later | (column.eqNullSafe(bound) & found)
    return F.coalesce(found, F.lit(False))


def _targets(rank: int, rows: int, sampled: int) -> list[int]:
    """Places in a sorted sample near that of the rank, which is a little below the first."""
    if sampled == rows:
        return [rank - 1]
    place = rank * sampled / rows
    spread = math.sqrt(place) + 1
    return sorted({min(sampled - 1, math.ceil(place + k * spread)) for k in (1, 3, 6, 12, 40)})


def cut_to_rank(
    rows: DataFrame, order: Sequence[Key | Column | str], rank: int, slack: int = SLACK
) -> DataFrame:
    """The first ``rank`` rows of the order and few more, by a filter; not sorted.

    At most ``slack`` rows more are left, if the order is total.
    """
    keys = order_keys(order)
    names = [f"k{i}" for i in range(len(keys))]
    shape = rows.select(*[k.column.alias(n) for k, n in zip(keys, names)])
    kinds = [f.dataType for f in shape.schema]
    on_names = [Key(F.col(n), k.descending) for k, n in zip(keys, names)]
    cut, condition = rows, F.lit(True)
    left = shape.count()
    for _ in range(MAX_ROUNDS):
        if left <= rank + slack:
            break
        sample = shape.filter(condition).sample(min(1.0, SAMPLED / left))
        found = sample.orderBy(*sorting(on_names)).collect()
        if not found:
            continue
        bounds = [found[t] for t in _targets(rank, left, len(found))]
        literals = [[literal(v, k) for v, k in zip(b, kinds)] for b in bounds]
        conditions = [up_to(on_names, found, kinds[0]) for found in literals]
        counts = shape.filter(condition).agg(*[F.count_if(c) for c in conditions]).first()
        enough = [(n, i) for i, n in enumerate(counts) if n >= rank]
        if enough and enough[0][0] < left:
            left, best = enough[0]
            condition = conditions[best]
            cut = rows.filter(up_to(keys, literals[best], kinds[0]))
    return cut


def cut_groups(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[Key | Column | str],
    rank: int,
    slack: int = SLACK,
) -> DataFrame:
    """The first ``rank`` rows of every group and few more; groups may be many.

    Only groups of more than ``rank + slack`` rows are cut. Their bounds are rows of a
    table, found for all groups in the same passes: a sample of each group, ranked in
    the group, gives a bound, and a count says whether it lets enough rows pass.
    """
    keys = order_keys(order)
    names = [f"__k{i}" for i in range(len(keys))]
    group = F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.struct(F.lit(0).alias("all"))
    keyed = rows.withColumns({"__group": group, **{n: k.column for k, n in zip(keys, names)}})
    on_names = [Key(F.col(n), k.descending) for k, n in zip(keys, names)]
    bounds = [F.col(f"__bound.{n}") for n in names]
    shape = keyed.select("__group", *names)
    passes = F.col("__bound").isNull() | up_to(on_names, bounds, shape.schema[names[0]].dataType)
    empty = F.lit(None).cast(shape.select(F.struct(*names).alias("b")).schema["b"].dataType)
    large = shape.groupBy("__group").agg(F.count("*").alias("__n")).filter(F.col("__n") > rank + slack)
    known = kept(large.withColumn("__bound", empty), "bounds")
    if known.isEmpty():
        return rows
    for _ in range(MAX_ROUNDS):
        open_groups = known.filter(F.col("__n") > rank + slack)
        if open_groups.isEmpty():
            break
        left = shape.join(open_groups, "__group").filter(passes)
        in_group = Window.partitionBy("__group").orderBy(*sorting(on_names))
        sample = left.filter(F.rand() < SAMPLED / F.col("__n")).withColumn("__place", F.row_number().over(in_group))
        place = rank * F.lit(SAMPLED) / F.col("__n")
        # A small group is in its sample whole.
        target = F.when(F.col("__n") <= SAMPLED, rank).otherwise(F.ceil(place + 4 * (F.sqrt(place) + 1)))
        tried = sample.filter(F.col("__place") == target).select(
            "__group", F.col("__n").alias("__before"), F.struct(*names).alias("__bound")
        )
        # Fixed in a table, so that the sample is not drawn anew.
        tried = kept(tried, "bounds")
        counted = (
            left.drop("__bound", "__n")
            .join(tried, "__group")
            .filter(passes)
            .groupBy("__group")
            .agg(F.count("*").alias("__now"))
            .join(tried, "__group")
            .filter((F.col("__now") >= rank) & (F.col("__now") < F.col("__before")))
            .select("__group", F.col("__now"), F.col("__bound").alias("__next"))
        )
        known = known.join(counted, "__group", "left").select(
            "__group",
            F.coalesce("__now", "__n").alias("__n"),
            F.coalesce("__next", "__bound").alias("__bound"),
        )
        known = kept(known, "bounds")
    return (
        keyed.join(known.drop("__n"), "__group", "left")
        .filter(passes)
        .select(*[f"`{c}`" for c in rows.columns])
    )
