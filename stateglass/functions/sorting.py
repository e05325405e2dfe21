"""Orders as text: one column whose plain order is the order of several, either way."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Hex digits from last to first turn an order round. The two ends of a value sort below
# and above every digit, so that a shorter value comes before, or after, a longer one.
DIGITS, TURNED = "0123456789ABCDEF", "FEDCBA9876543210"
LOW_END, HIGH_END = "!", "G"


def sort_text(column: Column, kind: T.DataType, descending: bool = False) -> Column:
    """Text that sorts by bytes as ``column`` does, nulls first or, descending, last.

    For strings, binary, integers, booleans, dates and timestamps. Texts of several
    columns, one after the other, sort by the first, then the second and so on.
    """
    if isinstance(kind, T.StringType):
        digits = F.hex(column.cast("binary"))
    elif isinstance(kind, T.BinaryType):
        digits = F.hex(column)
    else:
        if isinstance(kind, T.TimestampNTZType):
            number = _clock_micros(column)
        elif isinstance(kind, T.TimestampType):
            number = F.unix_micros(column)
        elif isinstance(kind, T.DateType):
            number = F.unix_date(column).cast("long")
        elif isinstance(kind, (T.IntegralType, T.BooleanType)):
            number = column.cast("long")
        else:
            raise ValueError(f"no order text for {kind.simpleString()}")
        # With the sign bit turned, unsigned digits have the order of signed numbers.
        digits = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    if descending:
        return F.coalesce(F.concat(F.lit("0"), F.translate(digits, DIGITS, TURNED), F.lit(HIGH_END)), F.lit("1"))
    return F.coalesce(F.concat(F.lit("1"), digits, F.lit(LOW_END)), F.lit("0"))


def sort_bytes(column: Column, kind: T.DataType, descending: bool = False) -> Column:
    """Binary in the order of ``sort_text``, of about half its size.

    Bytes of a string or binary stand for themselves but for zeros, which get a byte behind
    them, as the end of a value is a zero and a one.
    """
    if isinstance(kind, (T.StringType, T.BinaryType)):
        # As Latin text a byte is a character.
        latin = F.decode(column.cast("binary"), "ISO-8859-1")
        own = F.concat(F.encode(F.replace(latin, F.lit("\0"), F.lit("\0\u00ff")), "ISO-8859-1"), F.lit(b"\0\1"))
    else:
        # Digits are as many for all values, so neither end is needed.
        own = F.unhex(F.substring(sort_text(column, kind), 2, 16))
    if descending:
        own = F.unhex(F.translate(F.hex(own), DIGITS, TURNED))
    first, none = (b"\0", b"\1") if descending else (b"\1", b"\0")
    return F.when(column.isNull(), F.lit(none)).otherwise(F.concat(F.lit(first), own))


def _clock_micros(column: Column) -> Column:
    """Microseconds since 1970 by the clock alone, with no time zone in between."""
    days = F.unix_date(column.cast("date")).cast("long")
    minutes = (days * 24 + F.hour(column)) * 60 + F.minute(column)
    seconds = F.extract(F.lit("SECOND"), column).cast("decimal(18,6)")
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("long")
