"""Pinned snapshots: full copies that outlive the checkpoints they came from.

A pin is a folder ``base/job/name/`` with Parquet under ``data/``, its operators
under ``catalog/`` and, written last, ``snapshot.json``. The list of pins is a Parquet table of rows ``id,
source_path, pin_path, cached_at, size_bytes``, kept in numbered versions under
``base/pins.list/``: a change writes the next version whole and then its marker, which
names it, so a reader or a lost job never meets a half-written list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stateglass.sources.catalog import pinned_operators
from stateglass.sources.files import (
    children,
    create_new,
    delete,
    exists,
    matching,
    qualified,
    read_text,
    total_bytes,
    write_text,
)
from stateglass.sources.snapshots import MARKER

PINS_SCHEMA = (
    "id string, source_path string, pin_path string, cached_at timestamp, size_bytes bigint"
)
PARTITION_COLUMNS = ("operator_id", "state_name")
ENTRIES_SCHEMA = "operator_uid string, state_kind string, key string, value string, operator_id string, state_name string"
# How Spark names the folder of a null.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
# Folder of a pin with the typed rows of each operator.
TYPED = "typed"
# Fixed value: how many pins are kept.
MAX_PINS = 50


def pin_path(base: str, job: str | None, name: str) -> str:
    return "/".join([base.rstrip("/"), *([job] if job else []), name])


class PinStore:
    """The pins below one base folder.

    Writers may run at the same time: the marker of a version is made by one of them
    only, and the others make their change again on the newer list.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    def _version(self) -> int:
        """The newest list with a marker; -1 before the first."""
        markers = matching(self.spark, f"{self.base}/pins.list/v*.done")
        names = [m.path.rsplit("/", 1)[-1] for m in markers]
        return max((int(n.removeprefix("v").removesuffix(".done")) for n in names), default=-1)

    def _folder(self, version: int) -> str:
        """Where the rows of a version are, as its marker says."""
        return f"{self.base}/pins.list/{read_text(self.spark, f'{self.base}/pins.list/v{version}.done')}"

    def _read(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], PINS_SCHEMA)
        return self.spark.read.schema(PINS_SCHEMA).parquet(self._folder(version))

    def pins(self) -> DataFrame:
        return self._read(self._version())

    def _change(self, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Makes ``change`` of the newest list the next version; the list before it."""
        while True:
            version = self._version()
            listed = self._read(version)
            name = f"v{version + 1}-{uuid.uuid4().hex[:8]}"
            change(listed).coalesce(1).write.parquet(f"{self.base}/pins.list/{name}")
            if create_new(self.spark, f"{self.base}/pins.list/v{version + 1}.done", name):
                break
            # Somebody else made this version first.
            delete(self.spark, f"{self.base}/pins.list/{name}")
        # The list before stays for those who are reading it.
        old = f"{self.base}/pins.list/v{version - 1}.done"
        if exists(self.spark, old):
            delete(self.spark, self._folder(version - 1))
            delete(self.spark, old)
        return listed

    def _write_catalog(self, path: str) -> None:
        """The operators of a pin, so that listing it later reads no data."""
        rows = self.spark.read.parquet(f"{path}/data")
        if {"operator_uid", "state_kind", "state_name"} <= set(rows.columns):
            pinned_operators(rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/catalog")

    def _drop(self, path: str) -> None:
        # Without its marker a pin no longer counts, however far this gets.
        delete(self.spark, f"{path}/{MARKER}")
        delete(self.spark, path)

    def pin_snapshot(
        self,
        df: DataFrame,
        job: str | None,
        name: str,
        source_path: str | None = None,
        max_pins: int | None = None,
        typed: Mapping[str, DataFrame] | None = None,
    ) -> str:
        """Copy ``df`` into a new pin and return its id.

        ``typed`` has rows of their own schema by operator, which are kept as they
        are beside the entries. No other pin is touched, unless ``max_pins`` asks for it: then the oldest
        beyond that number are dropped.
        """
        path = pin_path(self.base, job, name)
        if exists(self.spark, f"{path}/{MARKER}"):
            raise ValueError(f"there is a snapshot at {path}")
        by = [c for c in PARTITION_COLUMNS if c in df.columns]
        # Leftovers of a copy that was broken off have no marker.
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/data")
        self._write_catalog(path)
        delete(self.spark, f"{path}/{TYPED}")
        for uid, rows in (typed or {}).items():
            rows.write.parquet(f"{path}/{TYPED}/{uid}")
        now = datetime.now(timezone.utc)
        pin_id = uuid.uuid4().hex[:8]
        size = total_bytes(self.spark, f"{path}/data")
        if typed:
            size += total_bytes(self.spark, f"{path}/{TYPED}")
        about = {
            "id": pin_id,
            "job_id": job,
            "snapshot": name,
            "source_path": source_path,
            "pinned_at": now.isoformat(),
        }
        write_text(self.spark, f"{path}/{MARKER}", json.dumps(about))
        row = self.spark.createDataFrame(
            [(pin_id, source_path or path, qualified(self.spark, path), now, size)], PINS_SCHEMA
        )
        def added(listed: DataFrame) -> DataFrame:
            more = listed.unionByName(row)
            return more if max_pins is None else newest_kept(more, max_pins)

        before = self._change(added).unionByName(row)
        if max_pins is not None:
            for old in beyond_newest(before, max_pins).select("pin_path").collect():
                self._drop(old["pin_path"])
        return pin_id

    def lookup(self, source_path: str) -> str | None:
        """Where the newest pin of a source is, if it still exists."""
        found = lookup_pin(self.pins(), source_path).select("pin_path").first()
        return found[0] if found and exists(self.spark, found[0]) else None

    def delete(self, pin_id: str) -> bool:
        """Drop a pin; says whether there was one."""
        found = self.pins().filter(F.col("id") == pin_id).select("pin_path").first()
        if found is None:
            return False
        self._change(lambda listed: without_pin(listed, pin_id))
        self._drop(found[0])
        return True

    def clear(self) -> int:
        """Drop all pins; returns how many there were."""
        before = self._change(lambda listed: listed.limit(0))
        paths = [r["pin_path"] for r in before.select("pin_path").collect()]
        for path in paths:
            self._drop(path)
        return len(paths)


def read_pin(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a whole pin; operator and state filters prune its folders."""
    path = path.rstrip("/")
    if not exists(spark, f"{path}/{MARKER}"):
        raise ValueError(f"no whole snapshot at {path}")
    reader = spark.read.option("basePath", f"{path}/data")
    found = reader.parquet(f"{path}/data")
    # Folder names like state_name=01 would be taken for numbers.
    fields = [T.StructField(f.name, T.StringType()) if f.name in PARTITION_COLUMNS else f for f in found.schema]
    schema = T.StructType(fields)
    return found if schema == found.schema else reader.schema(schema).parquet(f"{path}/data")


def read_typed(spark: SparkSession, path: str, uid: str) -> DataFrame:
    """The typed rows that a whole pin keeps of an operator."""
    path = path.rstrip("/")
    if not exists(spark, f"{path}/{MARKER}") or not exists(spark, f"{path}/{TYPED}/{uid}"):
        raise ValueError(f"no typed states of operator {uid} at {path}")
    return spark.read.parquet(f"{path}/{TYPED}/{uid}")


def typed_uids(spark: SparkSession, path: str) -> list[str]:
    """The operators that a pin keeps typed rows of."""
    return sorted(name for name, is_folder, _, _ in children(spark, f"{path.rstrip('/')}/{TYPED}") if is_folder)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The operators of a whole pin and how many entries each has."""
    path = path.rstrip("/")
    if exists(spark, f"{path}/catalog"):
        return spark.read.parquet(f"{path}/catalog")
    return pinned_operators(read_pin(spark, path))


def read_snapshots(spark: SparkSession, snapshots: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries of the whole snapshots of a listing, each with its path, job and name.

    All of them are read, or the newest ``limit``, by one scan: the files say which
    snapshot a row is from. The paths come to the driver, as those of any scan do. A
    listing without a whole snapshot gives no rows.
    """
    newest = snapshots.filter("valid")
    if limit is not None:
        newest = newest.orderBy(F.col("modification_time").desc(), "path").limit(limit)
    named = newest.select("path", F.col("job_id").cast("string").alias("job_id"), "snapshot")
    listed = named.collect()
    if not listed:
        return spark.createDataFrame([], f"{ENTRIES_SCHEMA}, {named.schema.toDDL()}")
    folders = [f"{row['path']}/data" for row in listed]
    rows = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*folders)
    file = _decoded(F.col("_metadata.file_path"))
    folder = F.regexp_extract(file, "^(.*)/data/", 1)
    below = F.substring(file, F.length(folder) + 1, F.length(file))
    columns = {}
    for name in PARTITION_COLUMNS:
        value = _decoded(F.nullif(F.regexp_extract(below, f"/{name}=([^/]*)/", 1), F.lit("")))
        value = F.nullif(value, F.lit(NULL_FOLDER))
        # A pin without such folders has the column in its files.
        columns[name] = F.coalesce(F.col(name).cast("string"), value) if name in rows.columns else value
    columns["__own"] = _one_slash(folder)
    listed = spark.createDataFrame(listed, named.schema).withColumn("__own", _one_slash(F.col("path")))
    return rows.withColumns(columns).join(listed, "__own").drop("__own")


def _decoded(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _one_slash(path: Column) -> Column:
    """Listings and files spell paths with one slash or three behind the scheme."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def pin_to_table(
    df: DataFrame, table: str, path: str, keys: Sequence[str] = ("key",), buckets: int = 200
) -> DataFrame:
    """Pin as a table bucketed and sorted by key, for diffs without a shuffle.

    Keys must not be null; a null fails the write. Two such tables with the
    same keys and number of buckets are joined bucket by bucket.
    """
    for key in keys:
        checked = F.coalesce(F.col(key), F.raise_error(F.lit(f"null {key}")).cast(df.schema[key].dataType))
        df = df.withColumn(key, checked)
    (
        df.repartition(buckets, *keys)
        .write.bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", path)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def lookup_pin(pins: DataFrame, source_path: str) -> DataFrame:
    return (
        pins.filter(F.col("source_path") == source_path)
        .orderBy(F.col("cached_at").desc(), F.col("id").desc())
        .limit(1)
    )


def newest_pins(pins: DataFrame) -> DataFrame:
    """The pin that ``lookup_pin`` would find, for every source path at once."""
    newest = F.max_by(F.struct("id", "cached_at"), F.struct("cached_at", "id"))
    return pins.groupBy("source_path").agg(newest.alias("p")).select("source_path", "p.*")


def without_pin(pins: DataFrame, pin_id: str) -> DataFrame:
    return pins.filter(~F.col("id").eqNullSafe(F.lit(pin_id)))


def newest_pins_first(pins: DataFrame) -> DataFrame:
    """The listing of pins: newest first, without where they are kept."""
    return pins.drop("pin_path").orderBy(F.col("cached_at").desc(), "id")


def beyond_newest(pins: DataFrame, keep: int = MAX_PINS) -> DataFrame:
    """Pins to evict: all but the newest ``keep``.

    The kept ones are found by a top-k and taken away by an anti join whose
    broadcast side has at most ``keep`` rows; no task sorts the whole list.
    """
    kept = newest_kept(pins, keep).select("id")
    return pins.join(F.broadcast(kept), "id", "left_anti")


def newest_kept(pins: DataFrame, keep: int = MAX_PINS) -> DataFrame:
    return pins.orderBy(F.col("cached_at").desc(), "id").limit(keep)


def pin_totals(pins: DataFrame) -> DataFrame:
    return pins.agg(F.count("*").alias("n_pins"), F.sum("size_bytes").alias("total_bytes"))
