"""Guessing the fields of opaque binary payloads, as a job over a column.

Four kinds of field are told apart, tried in this order at every position:

* ``string``: a 2-byte length and that many bytes that look like text;
* ``long``: 8 bytes directly before such a string, 12 or more bytes to the end;
* ``int``: 4 bytes;
* ``hex``: what is left at the end, 1 to 3 bytes.

Numbers are big-endian and signed. Payloads under 4 bytes or with fewer than
two fields are not decoded. All positions of a batch are classified at once
with array arithmetic, then all payloads hop from field to field together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from stateglass.functions.payload import raw_envelope

FIELDS_TYPE = T.ArrayType(
    T.StructType().add("pos", "integer").add("type", "string").add("text", "string")
)
NOT_DECODED = "no field structure found"

STRING, LONG, INT, HEX = 0, 1, 2, 3
KIND_NAMES = ("string", "long", "int", "hex")
MIN_PAYLOAD = 4
MIN_FIELDS = 2
# Payloads are worked on in groups of about this many bytes, to stay in the cache.
GROUP_BYTES = 128 << 10
# Fewer payloads than this are walked one by one.
TOGETHER = 16

_ARROW_FIELDS = pa.list_(
    pa.struct([("pos", pa.int32()), ("type", pa.string()), ("text", pa.string())])
)

# Printable ASCII makes text; tabs, line ends and UTF-8 bytes are allowed in it.
_CODES = np.arange(256)
_PRINTABLE = (_CODES >= 0x20) & (_CODES <= 0x7E)
_ALLOWED = _PRINTABLE | np.isin(_CODES, (0x09, 0x0A, 0x0D)) | ((_CODES >= 0x80) & (_CODES <= 0xF7))


def _running_total(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))


def _classify(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind and width of the field that would start at each byte.

    ``ends`` gives, per byte, where its payload ends.
    """
    size = len(data)
    at = np.arange(size)
    left = ends - at
    following = np.append(data[1:], 0).astype(np.int64)
    length = (data.astype(np.int64) << 8) | following
    fits = (left >= 2) & (length > 0) & (length <= left - 2)
    begin = np.minimum(at + 2, size)
    stop = np.where(fits, at + 2 + length, begin)
    printable = _running_total(_PRINTABLE[data])
    foreign = _running_total(~_ALLOWED[data])
    text = fits & (foreign[stop] == foreign[begin])
    text &= printable[stop] - printable[begin] > length // 2

    ahead = np.zeros(size, dtype=bool)
    ahead[: max(size - 8, 0)] = text[8:]
    kind = np.select([text, (left >= 12) & ahead, left >= 4], [STRING, LONG, INT], HEX)
    width = np.choose(kind, [length + 2, 8, 4, left])
    return kind, width


def _starts(width: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and position of every field, in order.

    All payloads hop to their next field together, as long as many take part;
    what is left of the few long ones is walked alone.
    """
    rows, at = np.arange(len(begins)), begins
    row_parts, at_parts = [], []
    while True:
        going = at < ends[rows]
        rows, at = rows[going], at[going]
        if len(rows) < TOGETHER:
            break
        row_parts.append(rows)
        at_parts.append(at)
        at = at + width[at]
    hops = memoryview(np.ascontiguousarray(width))
    for row, start in zip(rows.tolist(), at.tolist()):
        end, walked = int(ends[row]), []
        while start < end:
            walked.append(start)
            start += hops[start]
        row_parts.append(np.full(len(walked), row))
        at_parts.append(np.array(walked, dtype=np.int64))
    if not row_parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    all_rows, all_at = np.concatenate(row_parts), np.concatenate(at_parts)
    order = np.argsort(all_rows, kind="stable")
    return all_rows[order], all_at[order]


class _Group:
    """The fields of a run of payloads, one after the other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, valid: np.ndarray):
        self.data = data
        begins, ends = offsets[:-1], offsets[1:]
        self.kind, self.width = _classify(data, np.repeat(ends, ends - begins))
        long_enough = valid & (ends - begins >= MIN_PAYLOAD)
        rows, starts = _starts(self.width, begins, np.where(long_enough, ends, begins))
        counts = np.bincount(rows, minlength=len(begins))
        self.decoded = counts >= MIN_FIELDS
        kept = self.decoded[rows]
        self.rows, self.starts = rows[kept], starts[kept]
        self.counts = np.where(self.decoded, counts, 0)
        self.kinds = self.kind[self.starts]

    def _numbers(self, kind: int, size: int) -> pa.Array:
        starts = self.starts[self.kinds == kind]
        raw = self.data[starts[:, None] + np.arange(size)]
        values = np.ascontiguousarray(raw).view(f">i{size}").ravel().astype(np.int64)
        return pa.array(values).cast(pa.string())

    def _slices(self, kind: int, skip: int) -> pa.Array:
        """The bytes of all fields of a kind, without the first ``skip``."""
        starts = self.starts[self.kinds == kind]
        sizes = self.width[starts] - skip
        stops = np.cumsum(sizes)
        offsets = np.concatenate(([0], stops))
        inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
        picked = self.data[np.repeat(starts + skip, sizes) + inside]
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(picked.tobytes())]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers)

    def _strings(self) -> pa.Array:
        raw = self._slices(STRING, 2)
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # looks like UTF-8 but is not
            return pa.array([v.decode("utf-8", "replace") for v in raw.to_pylist()], pa.string())

    def texts(self) -> pa.Array:
        tails = [v.hex() for v in self._slices(HEX, 0).to_pylist()]
        by_kind = [self._strings(), self._numbers(LONG, 8), self._numbers(INT, 4), pa.array(tails, pa.string())]
        # Texts lie kind by kind; put them back in the order of the fields.
        place = np.empty(len(self.kinds), dtype=np.int64)
        place[np.argsort(self.kinds, kind="stable")] = np.arange(len(self.kinds))
        return pa.concat_arrays(by_kind).take(pa.array(place))

    def _per_row(self, counts: np.ndarray, values: pa.Array) -> pa.Array:
        """Lists of ``values``, ``counts`` of them per row; null if not decoded."""
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        missing = np.append(~self.decoded, False)
        return pa.ListArray.from_arrays(pa.array(offsets, mask=missing), values)

    def fields(self) -> pa.Array:
        first = np.cumsum(self.counts) - self.counts
        numbers = np.arange(len(self.rows)) - first[self.rows]
        values = pa.StructArray.from_arrays(
            [
                pa.array(numbers.astype(np.int32)),
                pa.array(KIND_NAMES).take(pa.array(self.kinds)),
                self.texts(),
            ],
            ["pos", "type", "text"],
        )
        return self._per_row(self.counts, values)

    def layouts(self) -> pa.Array:
        new_run = np.ones(len(self.rows), dtype=bool)
        new_run[1:] = (self.rows[1:] != self.rows[:-1]) | (self.kinds[1:] != self.kinds[:-1])
        at = np.flatnonzero(new_run)
        length = np.diff(np.append(at, len(self.rows)))
        codes, which = np.unique(length * len(KIND_NAMES) + self.kinds[at], return_inverse=True)
        named = [(n, KIND_NAMES[kind]) for n, kind in (divmod(c, len(KIND_NAMES)) for c in codes.tolist())]
        names = [name if n == 1 else f"{name}*{n}" for n, name in named]
        texts = pa.array(names, pa.string()).take(pa.array(which))
        runs = np.bincount(self.rows[at], minlength=len(self.counts))
        return pc.binary_join(self._per_row(runs, texts), ",")


def _groups(column: pa.Array) -> Iterator[_Group]:
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset :][: len(column) + 1]
    data = np.frombuffer(data_buffer or b"", dtype=np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    first = 0
    while first < len(column):
        # As many payloads as make up the wanted size, at least one.
        last = int(np.searchsorted(offsets, offsets[first] + GROUP_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        here = offsets[first : last + 1]
        yield _Group(data[here[0] : here[-1]], here - here[0], valid[first:last])
        first = last


def _field_array(column: pa.Array) -> pa.Array:
    parts = [group.fields() for group in _groups(column)]
    return pa.concat_arrays(parts) if parts else pa.array([], _ARROW_FIELDS)


def _layout_array(column: pa.Array) -> pa.Array:
    parts = [group.layouts() for group in _groups(column)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


# Only the payload goes to Python and only the result comes back; the other
# columns stay in the JVM and unused ones are never read.
payload_fields = F.arrow_udf(_field_array, FIELDS_TYPE)
payload_layout = F.arrow_udf(_layout_array, T.StringType())


def decode_payloads(df: DataFrame, payload: str) -> DataFrame:
    """All columns, ``fields`` (null if not decoded) and ``raw`` (null if decoded)."""
    return df.withColumn("fields", payload_fields(payload)).withColumn(
        "raw",
        F.when(F.col("fields").isNull(), raw_envelope(F.col(payload), F.lit(NOT_DECODED))),
    )


def payload_layouts(df: DataFrame, payload: str) -> DataFrame:
    """All columns and ``layout``: field kinds in order, repeats as ``kind*n``."""
    return df.withColumn("layout", F.coalesce(payload_layout(payload), F.lit("raw")))


def layout_profile(df: DataFrame, payload: str, by: list[str]) -> DataFrame:
    """Rows per layout in each group of ``by``, and their share of the group.

    Group totals are counted on the input, without decoding anything again.
    """
    group = F.struct(*by).alias("__group")
    laid = payload_layouts(df, payload).select(group, "layout")
    counts = laid.groupBy("__group", "layout").agg(F.count("*").alias("n_rows"))
    totals = df.select(group).groupBy("__group").agg(F.count("*").alias("__total"))
    return counts.join(totals, "__group").select(
        "__group.*", "layout", "n_rows", (F.col("n_rows") / F.col("__total")).alias("share")
    )
