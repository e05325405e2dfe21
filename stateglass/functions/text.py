"""Values as text: JSON, previews, cells, sizes, entries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Preview length and the ellipsis.
PREVIEW_CHARS = 200
ELLIPSIS = "..."


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.MapType) or isinstance(dtype, T.ArrayType) and _has_map(dtype.elementType)


def sorted_maps(value: Column, dtype: T.DataType) -> Column:
    """The value with the entries of maps at every depth in order of their keys.

    A map whose keys are structs or arrays becomes an array of key and value.
    """
    if not _has_map(dtype):
        return value
    if isinstance(dtype, T.StructType):
        fields = [sorted_maps(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: sorted_maps(x, dtype.elementType))
    entries = F.map_entries(value)
    nested = isinstance(dtype.keyType, (T.StructType, T.ArrayType))
    entries = F.array_sort(entries, _by_key)
    entries = F.transform(
        entries, lambda e: F.struct(e["key"].alias("key"), sorted_maps(e["value"], dtype.valueType).alias("value"))
    )
    return entries if nested else F.map_from_entries(entries)


def json_text(value: Column, dtype: T.DataType) -> Column:
    """A value as JSON text; null stays null.

    Numbers and booleans print as they are. Maps print with sorted keys at every
    depth, so equal values have equal text; maps with nested keys print as arrays.
    """
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return value.cast("string")
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(sorted_maps(value, dtype), {"ignoreNullFields": "false"})
    boxed = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(boxed, F.lit(2), F.length(boxed) - 2))


def cell_text(value: Column, dtype: T.DataType) -> Column:
    """Table cell: null is empty, nested values are JSON, others plain text."""
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(json_text(value, dtype), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.when(
        F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(ELLIPSIS))
    ).otherwise(text)


def truncate(text: Column, width: int) -> Column:
    """Cut to ``width`` characters; the ellipsis counts, if there is room for it."""
    if width <= len(ELLIPSIS):
        return F.substring(text, 1, width)
    cut = F.concat(F.substring(text, 1, width - len(ELLIPSIS)), F.lit(ELLIPSIS))
    return F.when(F.length(text) > width, cut).otherwise(text)


def is_numeric_text(text: Column) -> Column:
    number = text.try_cast("double").isNotNull()
    return number & ~F.lower(F.trim(text)).rlike("^[+-]?inf$")


def human_bytes(size: Column) -> Column:
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", size / 1024))
        .otherwise(F.format_string("%.1f MB", size / (1024 * 1024)))
    )


def config_key(entry: Column) -> Column:
    """Part before the first ``=``; null when there is none."""
    parts = F.split(entry, "=", 2)
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0)))


def config_value(entry: Column) -> Column:
    parts = F.split(entry, "=", 2)
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(1)))


def entry_text(key: Column, category: Column, value: Column) -> Column:
    return F.format_string("%s:%s=%.2f", key.cast("string"), category, value)


def timed_value(value: Column, millis: Column) -> Column:
    return F.format_string("%.2f@%d", value, millis)


def string_keys(mapping: Column) -> Column:
    return F.transform_keys(mapping, lambda k, _: k.cast("string"))


def map_text(mapping: Column) -> Column:
    """Sorted ``k=v`` pairs joined by commas."""
    pairs = F.transform(
        F.map_entries(mapping),
        lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")),
    )
    return F.array_join(F.array_sort(pairs), ",")
