"""Names of snapshots, jobs, paths and operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SHORT_ID_LENGTH = 8
MILLIS_PER_DAY = 86_400_000


def short_job_id(job_id: Column) -> Column:
    return F.substring(job_id, 1, SHORT_ID_LENGTH)


def last_segment(path: Column) -> Column:
    """Text after the last slash of either kind; ``unknown`` for no path."""
    return F.coalesce(
        F.substring_index(F.translate(path, "\\", "/"), "/", -1), F.lit("unknown")
    )


def display_name(path: Column, job_id: Column) -> Column:
    # concat_ws leaves a null job id out, separator included.
    return F.concat_ws("/", short_job_id(job_id), last_segment(path))


def iso_time(epoch_millis: Column) -> Column:
    """ISO-8601 UTC text, the fraction only when it is not zero.

    Plain arithmetic on days and milliseconds of the day, so the session zone
    has no say in it.
    """
    millis = epoch_millis.cast("bigint")
    of_day = F.pmod(millis, F.lit(MILLIS_PER_DAY)).cast("bigint")
    days = ((millis - of_day) / MILLIS_PER_DAY).cast("int")
    fraction = of_day % 1000

    def digits(number: Column, width: int) -> Column:
        return F.lpad(number.cast("string"), width, "0")

    return F.concat(
        F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"),
        F.lit("T"),
        digits(F.floor(of_day / 3_600_000), 2),
        F.lit(":"),
        digits(F.floor(of_day / 60_000) % 60, 2),
        F.lit(":"),
        digits(F.floor(of_day / 1000) % 60, 2),
        F.when(fraction == 0, "").otherwise(F.concat(F.lit("."), digits(fraction, 3))),
        F.lit("Z"),
    )


def snapshot_type(name: Column) -> Column:
    return F.when(name.startswith("savepoint-"), "savepoint").otherwise("checkpoint")


def snapshot_label(path: Column) -> Column:
    """``chk-N`` or ``savepoint-x`` found in the path, else its last segment."""
    found = F.regexp_extract(path, r"chk-\d+|savepoint-[a-z0-9]+", 0)
    tail = F.substring_index(path, "/", -1)
    return F.when(found != "", found).when(tail != "", tail).otherwise(path)


def checkpoint_number(name: Column) -> Column:
    return F.regexp_extract(name, r"chk-(\d+)", 1).try_cast("bigint")


def _without_scheme(uri: Column) -> Column:
    return F.regexp_replace(uri, "^(s3a?|gs|https?)://", "")


def uri_bucket(uri: Column) -> Column:
    return F.substring_index(_without_scheme(uri), "/", 1)


def uri_key(uri: Column) -> Column:
    """Object key of a URI without the one slash that may end it."""
    return F.regexp_replace(F.regexp_extract(_without_scheme(uri), "^[^/]*/(.*)$", 1), "/$", "")


def operator_label(
    name: Column, uid: Column, keyed: Column, operator: Column, entries: Column
) -> Column:
    """``name (has data + s1, s2)``; the start of the uid stands in for no name."""
    base = F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(
        F.concat(F.substring(uid, 1, 12), F.lit("..."))
    )
    keyed_part = F.when(
        F.size(keyed) > 0,
        F.when(entries > 0, "has data").when(entries == 0, "empty").otherwise("keyed"),
    )
    operator_part = F.when(F.size(operator) > 0, F.array_join(operator, ", "))
    parts = F.concat_ws(" + ", keyed_part, operator_part)
    return F.when(parts != "", F.concat(base, F.lit(" ("), parts, F.lit(")"))).otherwise(base)
