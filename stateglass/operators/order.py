"""Running values per key and positions, in the order of a sequence.

A window over a key sorts all rows of that key in one task, which fails when one key
holds a large share of the table. Here rows are dealt to ranges of (key, sequence)
whose bounds Spark measures, so a hot key takes several ranges. A segment, the rows of
one key in one range, becomes one associative step (a count, or how an average moves);
a scan over the steps of a key gives each segment what came before it. The number of
segments is at most the number of keys plus that of ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stateglass.functions.sorting import sort_bytes
from stateglass.operators.selection import Key, order_keys
from stateglass.session import kept

# The lower bits of an id that Spark counts up are the place in a partition.
PLACE_BITS = 33


def _ranged(
    rows: DataFrame, order: Sequence[Column | str], ranges: int | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """``rows`` in ranges of the order: with ``__range`` and the 0-based ``__place`` in it.

    Of the columns only ``columns`` are written, if given.

    The ranges are written to the shared folder, so that a lost task cannot number
    them anew. Without ``ranges`` Spark chooses how many there are.
    """
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    names = [f"`{c}`" for c in (rows.columns if columns is None else columns)]
    written = kept(dealt.select(*names, F.monotonically_increasing_id().alias("__id")), "ranged")
    return written.select(
        *names,
        F.shiftright("__id", PLACE_BITS).alias("__range"),
        F.col("__id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("__place"),
    )


def _segments(ranged: DataFrame) -> DataFrame:
    """``__segment, first, n, before``: where each starts, its rows, the rows of its key before."""
    before = Window.partitionBy("__segment.key").orderBy("__segment.range").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.groupBy("__segment")
        .agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    )


def _segmented(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], ranges: int | None
) -> DataFrame:
    """Ranged rows with ``__segment``, a struct of key and range that is never null."""
    names = [F.col(f"`{k}`") for k in keys]
    ranged = _ranged(rows, [*names, *order], ranges)
    key = F.struct(*names, F.lit(0).alias("__one"))
    return ranged.withColumn("__segment", F.struct(key.alias("key"), F.col("__range").alias("range")))


def running_count(
    rows: DataFrame,
    keys: Sequence[str],
    seq: str,
    name: str = "running_count",
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Every row with its 1-based position among the rows of its key.

    With no keys this is a position in the whole table. Rows of equal number are told
    apart arbitrarily, but for good.
    """
    order = F.col(f"`{seq}`").desc() if descending else F.col(f"`{seq}`").asc()
    placed = _segmented(rows, keys, [order], ranges)
    # A place less that of the segment's first row is a count in the segment.
    return placed.join(_segments(placed), "__segment").select(
        *[f"`{c}`" for c in rows.columns],
        (F.col("__place") - F.col("__first") + 1 + F.col("__before")).cast("bigint").alias(name),
    )


def global_index(
    rows: DataFrame,
    order: Sequence[Column | str],
    name: str = "index",
    ranges: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Every row, or its ``columns``, with its 1-based position in the whole table, in any order.

    ``order`` should be total for the result to be repeatable.
    """
    columns = rows.columns if columns is None else columns
    placed = _ranged(rows, order, ranges, columns)
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so a broadcast has a known bound and the rows are not shuffled again.
    before = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = before.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__range").select(
        *[f"`{c}`" for c in columns],
        (F.col("__place") + 1 + F.col("__before")).alias(name),
    )


def index_in_orders(
    rows: DataFrame,
    orders: Mapping[str, Sequence[Key | Column | str]],
    name: str = "pos",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Every row once per order, with ``order`` and its 1-based position in that order.

    All orders go through one range partitioning: each is a binary that sorts as its
    columns do, behind the number of the order. ``orders`` should be total. Only
    ``columns`` go through it with their order, if given.
    """
    columns = rows.columns if columns is None else columns
    keyed = []
    for number, (label, order) in enumerate(orders.items()):
        keys = order_keys(order)
        kinds = [f.dataType for f in rows.select(*[k.column for k in keys]).schema]
        parts = [sort_bytes(k.column, kind, k.descending) for k, kind in zip(keys, kinds)]
        keyed.append(F.struct(F.lit(number).alias("n"), F.concat(*parts).alias("by")))
    every = rows.select(*[f"`{c}`" for c in columns], F.inline(F.array(*keyed)).alias("__order", "__by"))
    placed = global_index(every, ["__order", "__by"], "__index", columns=[*columns, "__order"])
    labels = F.element_at(F.array(*[F.lit(label) for label in orders]), F.col("__order") + 1)
    # Each order has every row, so the rows before an order are a multiple of their number.
    total = placed.agg((F.count("*") / len(keyed)).cast("bigint").alias("n"))
    return placed.select(
        *[f"`{c}`" for c in columns],
        labels.alias("order"),
        (F.col("__index") - F.col("__order") * F.coalesce(total.scalar(), F.lit(0))).alias(name),
    )


def average_step(
    rows: DataFrame, keys: Sequence[str], seq: str, value: str, alpha: float, ranges: int | None = None
) -> DataFrame:
    """How the rows of each key move an exponential average: ``keys..., n, added, first_value``.

    n rows turn the average x into (1 - alpha)^n x + ``added``. Each segment is such a
    step; those of a key are put together by how many rows come after each.
    """
    narrow = rows.select(
        *[f"`{k}`" for k in keys], F.col(f"`{seq}`").alias("__seq"), F.col(f"`{value}`").alias("__value")
    )
    placed = _segmented(narrow, keys, [F.col("__seq").asc()], ranges)
    keep = F.lit(1.0 - alpha)
    after = F.col("__first") + F.col("__n") - 1 - F.col("__place")
    steps = (
        placed.join(_segments(placed).drop("__before"), "__segment")
        .groupBy("__segment")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.lit(alpha) * F.pow(keep, after) * F.col("__value")).alias("added"),
            F.min_by("__value", "__place").alias("first_value"),
        )
    )
    later = (
        Window.partitionBy("__segment.key")
        .orderBy(F.col("__segment.range").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        steps.withColumn("__after", F.coalesce(F.sum("n").over(later), F.lit(0)))
        .groupBy("__segment.key")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("added") * F.pow(keep, "__after")).alias("added"),
            F.min_by("first_value", "__segment.range").alias("first_value"),
        )
        .select(*[F.col(f"key.`{k}`").alias(k) for k in keys], "n", "added", "first_value")
    )


def exponential_average(
    rows: DataFrame, keys: Sequence[str], seq: str, value: str, alpha: float = 0.1, ranges: int | None = None
) -> DataFrame:
    """Average that moves by ``alpha`` towards each value, from the first value on.

    The first value enters as the average before any row, so that the first step
    leaves it as it is.
    """
    started = F.col("first_value") * F.pow(F.lit(1.0 - alpha), "n")
    steps = average_step(rows, keys, seq, value, alpha, ranges)
    return steps.select(*[f"`{k}`" for k in keys], (F.col("added") + started).alias("running_average"))


def recent_rows(rows: DataFrame, keys: Sequence[str], seq: str, size: int) -> DataFrame:
    """The newest ``size`` rows per key, ``pos`` 0 being the oldest of them.

    Each input partition keeps ``size`` rows per key before the shuffle, so a
    hot key costs no more than any other.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    kept = rows.withColumn("__rank", F.row_number().over(newest)).filter(F.col("__rank") <= size)
    oldest = Window.partitionBy(*keys).orderBy(F.col("__rank").desc())
    return kept.withColumn("pos", (F.row_number().over(oldest) - 1).cast("bigint")).drop("__rank")


def last_value_per_key(rows: DataFrame, keys: Sequence[str], seq: str, value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def category_counts(rows: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Map entries of the per-key category counter: ``keys..., map_key, value``."""
    return (
        rows.groupBy(*keys, F.col(category).alias("map_key")).agg(F.count("*").alias("value"))
    )
