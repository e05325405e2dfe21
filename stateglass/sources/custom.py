"""Any table as a source of entries, and sources registered by name.

A DataFrame becomes entries with ``as_entries``. A store that Spark has no reader for
becomes a format: subclass ``EntrySource`` with the slices of the store and how to read
one, register it, and ``read_entries`` gives its entries to every operator here.
Filters on operator, state and key are pushed into the source: slices of other operators
and states are not read at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringStartsWith,
)

from stateglass.sources.listing import Store

ENTRY_SCHEMA = "operator_uid string, state_kind string, state_name string, key string, value string, seq bigint"
_ARROW_SCHEMA = pa.schema(
    [(c, pa.string()) for c in ("operator_uid", "state_kind", "state_name", "key", "value")] + [("seq", pa.int64())]
)


def as_entries(
    rows: DataFrame,
    operator_uid: str | Column,
    state_name: str | Column,
    key: Column,
    value: Column,
    state_kind: str = "keyed",
) -> DataFrame:
    """Rows in the long entry form every operator here accepts."""

    def column(given: str | Column) -> Column:
        return F.lit(given) if isinstance(given, str) else given

    return rows.select(
        column(operator_uid).alias("operator_uid"),
        F.lit(state_kind).alias("state_kind"),
        column(state_name).alias("state_name"),
        key.cast("string").alias("key"),
        value.cast("string").alias("value"),
    )


@dataclass
class Slice(InputPartition):
    """A piece of a source that one task reads; None for what only its rows tell."""

    operator_uid: str | None
    state_name: str | None
    place: str
    part: int = 0


@dataclass
class Wanted:
    """The filters that a source has taken over; an empty set of values matches nothing."""

    values: dict[str, set] = field(default_factory=dict)
    texts: list[Filter] = field(default_factory=list)

    def take(self, filter: Filter) -> bool:
        """Whether the source can apply the filter by itself."""
        if isinstance(filter, (EqualTo, In)) and filter.attribute in (("operator_uid",), ("state_name",), ("key",)):
            values = {filter.value} if isinstance(filter, EqualTo) else set(filter.value)
            name = filter.attribute[0]
            self.values[name] = self.values[name] & values if name in self.values else values
            return True
        if isinstance(filter, (StringContains, StringStartsWith)) and filter.attribute == ("key",):
            self.texts.append(filter)
            return True
        return False

    def may_hold(self, slice: Slice) -> bool:
        return all(
            value is None or value in self.values.get(name, {value})
            for name, value in (("operator_uid", slice.operator_uid), ("state_name", slice.state_name))
        )

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        for name, values in self.values.items():
            batch = batch.filter(pc.is_in(batch.column(name), pa.array(sorted(v for v in values if v is not None), pa.string())))
        for filter in self.texts:
            match = pc.match_substring if isinstance(filter, StringContains) else pc.starts_with
            batch = batch.filter(match(batch.column("key"), filter.value))
        return batch


class EntrySource(DataSource):
    """Base of sources; ``name`` is the format, ``self.options`` what the reader was given.

    Subclasses say which slices there are and read one as record batches with some of
    the columns of ENTRY_SCHEMA; the rest are null, and the kind is keyed.
    """

    def schema(self) -> str:
        return ENTRY_SCHEMA

    def slices(self) -> Sequence[Slice]:
        raise NotImplementedError

    def read_slice(self, slice: Slice) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def reader(self, schema) -> EntryReader:
        return EntryReader(self)


class EntryReader(DataSourceReader):
    def __init__(self, source: EntrySource):
        self.source, self.wanted = source, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for filter in filters:
            if not self.wanted.take(filter):
                yield filter

    def partitions(self) -> list[Slice]:
        # One slice at least: without any Spark would call read with none.
        return [s for s in self.source.slices() if self.wanted.may_hold(s)] or [Slice(None, None, "")]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.place:
            return
        for batch in self.source.read_slice(partition):
            given = {f.name: batch.column(f.name).cast(f.type) for f in _ARROW_SCHEMA if f.name in batch.schema.names}
            given.setdefault("state_kind", pa.array(["keyed"] * batch.num_rows, pa.string()))
            columns = [given.get(f.name, pa.nulls(batch.num_rows, f.type)) for f in _ARROW_SCHEMA]
            batch = self.wanted.rows(pa.RecordBatch.from_arrays(columns, schema=_ARROW_SCHEMA))
            if batch.num_rows:
                yield batch


class PinSource(EntrySource):
    """The entries of a pinned snapshot (option ``path``); a slice is a file of its data."""

    @classmethod
    def name(cls) -> str:
        return "stateglass-pin"

    def _store(self) -> Store:
        return Store(dict(self.options))

    def slices(self) -> list[Slice]:
        store, found = self._store(), []
        todo = [(f"{self.options['path'].rstrip('/')}/data", {})]
        while todo:
            folder, values = todo.pop()
            for name, is_folder, _, _ in store.children(folder):
                column, _, value = name.partition("=")
                if is_folder:
                    todo.append((f"{folder}/{name}", {**values, column: unquote(value)}))
                elif name.endswith(".parquet") and not name.startswith(("_", ".")):
                    found.append(Slice(None, values.get("state_name"), f"{folder}/{name}"))
        return found

    def read_slice(self, slice: Slice) -> Iterator[pa.RecordBatch]:
        store, path = self._store().open(slice.place)
        with store.open_input_file(path) as file:
            table = pq.ParquetFile(file)
            names = [c for c in _ARROW_SCHEMA.names if c in table.schema_arrow.names]
            for batch in table.iter_batches(columns=names):
                if slice.state_name is not None:
                    state = pa.array([slice.state_name] * batch.num_rows, pa.string())
                    batch = batch.append_column("state_name", state)
                yield batch


class TableSource(EntrySource):
    """A Parquet table as entries; a slice is a row group.

    Options: ``path``, ``operator`` (its name) and the columns ``state``, ``key``, ``value``
    and, for a log of writes, ``seq``. ``kind`` is keyed unless given.
    """

    @classmethod
    def name(cls) -> str:
        return "stateglass-table"

    def _store(self) -> Store:
        return Store(dict(self.options))

    def slices(self) -> list[Slice]:
        store, path = self._store(), self.options["path"].rstrip("/")
        places, found = [path], []
        if store.is_folder(path):
            names = [name for name, is_folder, _, _ in store.children(path) if not is_folder]
            places = [f"{path}/{name}" for name in sorted(names) if name.endswith(".parquet") and name[0] not in "._"]
        for place in places:
            system, own = store.open(place)
            with system.open_input_file(own) as file:
                groups = pq.ParquetFile(file).num_row_groups
            found += [Slice(self.options["operator"], None, place, g) for g in range(groups)]
        return found

    def read_slice(self, slice: Slice) -> Iterator[pa.RecordBatch]:
        columns = {name: self.options[name] for name in ("state", "key", "value", "seq") if name in self.options}
        store, path = self._store().open(slice.place)
        with store.open_input_file(path) as file:
            table = pq.ParquetFile(file)
            for batch in table.iter_batches(row_groups=[slice.part], columns=sorted(set(columns.values()))):
                made = {
                    "operator_uid": pa.array([slice.operator_uid] * batch.num_rows, pa.string()),
                    "state_kind": pa.array([self.options.get("kind", "keyed")] * batch.num_rows, pa.string()),
                    "state_name": batch.column(columns["state"]).cast(pa.string()),
                    "key": batch.column(columns["key"]).cast(pa.string()),
                    "value": batch.column(columns["value"]).cast(pa.string()),
                }
                if "seq" in columns:
                    made["seq"] = batch.column(columns["seq"])
                yield pa.RecordBatch.from_pydict(made)


def read_entries(spark: SparkSession, source: str, path: str | None = None, **options: str) -> DataFrame:
    """Entries of a registered source, safe to be filtered in several ways.

    Spark 4.1 keeps the filters last pushed into a loaded source and applies them to the
    next query on it that pushes none. So every query on this frame pushes one: entries
    always have a kind.
    """
    loaded = spark.read.format(source).options(**options).load(path)
    return loaded.filter(F.col("state_kind").isNotNull())


def register_sources(spark: SparkSession, *sources: type[EntrySource]) -> None:
    """Makes formats of the sources, by default of those of this module."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in sources or (PinSource, TableSource):
        spark.dataSource.register(source)
