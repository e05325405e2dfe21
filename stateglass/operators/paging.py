"""Pages, bounded reads and orders of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stateglass.operators.selection import Key, beyond, cut_groups, cut_to_rank, desc, order_keys, sorting

# The largest page and the largest offset.
MAX_LIMIT = 100_000


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return limit


def check_offset(offset: int) -> int:
    if not 0 <= offset <= MAX_LIMIT:
        raise ValueError(f"offset must be between 0 and {MAX_LIMIT}")
    return offset


def _numbered(
    fetched: DataFrame, order: Sequence[Key | Column | str], offset: int, limit: int, flag: str
) -> DataFrame:
    # At most limit + 1 rows are left here, so one partition holds them.
    everything = Window.partitionBy(F.lit(0))
    return (
        fetched.withColumn(flag, F.count("*").over(everything) > limit)
        .withColumn("pos", F.row_number().over(everything.orderBy(*sorting(order))).cast("bigint") + offset)
        .filter(F.col("pos") <= offset + limit)
    )


def page(
    rows: DataFrame,
    order: Sequence[Key | Column | str],
    offset: int = 0,
    limit: int = 1000,
    after: Sequence | None = None,
) -> DataFrame:
    """One page of rows, their 1-based ``pos`` in the whole and an exact ``has_more``.

    One row extra is fetched to know whether more follow. ``order`` must be
    total for pages to be repeatable; descending columns are given by
    ``selection.desc``. Rows are cut to the end of the page by selection, so that
    nothing else is sorted or shuffled. Pages of any depth are reached with
    ``after``, the values of the last row seen: rows before it are filtered out,
    down to the scan, and ``pos`` counts from there.
    """
    check_offset(offset)
    check_limit(limit)
    rows = rows_after(rows, order, after)
    cut = cut_to_rank(rows, order, offset + limit + 1)
    fetched = cut.orderBy(*sorting(order)).offset(offset).limit(limit + 1)
    return _numbered(fetched, order, offset, limit, "has_more")


def rows_after(
    rows: DataFrame, order: Sequence[Key | Column | str], after: Sequence | None
) -> DataFrame:
    """Rows beyond the one with these values of the order; all of them for none."""
    if after is None:
        return rows
    keys = order_keys(order)
    kinds = [f.dataType for f in rows.select(*[k.column for k in keys]).schema]
    return rows.filter(beyond(keys, after, kinds))


def page_report(paged: DataFrame, offset: int) -> DataFrame:
    """One row about a page: its row count, whether more follow, where it began."""
    return paged.agg(
        F.count("*").alias("entry_count"),
        F.coalesce(F.bool_or("has_more"), F.lit(False)).alias("has_more"),
    ).withColumn("offset", F.lit(offset).cast("bigint"))


def bounded_read(rows: DataFrame, order: Sequence[Key | Column | str], limit: int) -> DataFrame:
    """The first ``limit`` rows and whether that cut any off."""
    check_limit(limit)
    fetched = cut_to_rank(rows, order, limit + 1).orderBy(*sorting(order)).limit(limit + 1)
    return _numbered(fetched, order, 0, limit, "truncated")


def newest_first(rows: DataFrame, time: str, tie: str, limit: int) -> DataFrame:
    order = [desc(time), tie]
    cut = cut_to_rank(rows, order, check_limit(limit))
    return cut.orderBy(*sorting(order)).limit(limit)


def top_per_group(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[Key | Column | str],
    limit: int,
    bounded: bool = True,
) -> DataFrame:
    """The first rows of each group; the task that ranks one gets a bounded number of rows."""
    cut = cut_groups(rows, by, order, check_limit(limit) if bounded else limit)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*sorting(order)))
    return cut.withColumn("pos", rank).filter(F.col("pos") <= limit)


def numeric_aware(column: Column) -> list[Column]:
    """Sort keys that put ``k2`` before ``k10``: text, trailing number, all."""
    return [
        F.regexp_replace(column, "[0-9]+$", ""),
        F.regexp_extract(column, "[0-9]+$", 0).try_cast("bigint"),
        column,
    ]
