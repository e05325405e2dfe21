"""Readable forms of opaque bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bytes shown as hex, and the longest payload given as base64.
HEX_BYTES = 256
BASE64_BYTES = 1024


def hex_preview(data: Column, max_bytes: int = HEX_BYTES) -> Column:
    digits = F.lower(F.hex(F.substring(data, 1, max_bytes)))
    return F.when(
        F.octet_length(data) > max_bytes, F.concat(digits, F.lit("..."))
    ).otherwise(digits)


def base64_small(data: Column, max_bytes: int = BASE64_BYTES) -> Column:
    """Base64 without line breaks; null for longer payloads."""
    return F.when(
        F.octet_length(data) <= max_bytes, F.regexp_replace(F.base64(data), "[\r\n]", "")
    )


def raw_envelope(data: Column, reason: Column) -> Column:
    return F.when(
        data.isNotNull(),
        F.struct(
            F.lit(True).alias("_raw"),
            reason.alias("_reason"),
            F.octet_length(data).alias("_bytes"),
            hex_preview(data).alias("_hex"),
            base64_small(data).alias("_base64"),
        ),
    )
