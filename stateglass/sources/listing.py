"""Folders of a store, listed by tasks.

A row names a folder; the task that has the row asks the store what is in it. So names
stay in the job, however many there are, and only the sources that somebody typed come
from the driver. Tasks reach local folders, ``s3://``, ``gs://`` and ``hdfs://``; folders
of any other store that Spark reads are listed by its file system on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from stateglass.sources.files import children, qualified
from stateglass.sources.storage import S3_SETTINGS

MARKER = "snapshot.json"
SNAPSHOT_NAME = "^(chk|savepoint)-"
SNAPSHOT, FOLDER = "snapshot", "folder"
FOUND = "source string, job_id string, path string, name string, kind string, modified_ms long, valid boolean"
BATCHES = "source string, job_id string, path string, batch_id long, modified_ms long, valid boolean"
SIZES = "path string, job_id string, snapshot string, size_bytes long, n_files long"

_URI = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(.*)$")
_TASK_SCHEMES = {"", "file", "s3", "s3a", "gs", "hdfs"}


def scheme_of(uri: str) -> str:
    match = _URI.match(uri)
    return match.group(1).lower() if match else ""


def store_settings(spark: SparkSession) -> dict[str, str]:
    """What tasks have to know of the session to reach its object store."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    found = {name: conf.get(name) for name in S3_SETTINGS.values()}
    return {name: value for name, value in found.items() if value}


class Store:
    """Folders as a task sees them."""

    def __init__(self, settings: Mapping[str, str]):
        self.settings = settings
        self.opened: dict[str, pafs.FileSystem] = {}

    def _s3(self) -> pafs.FileSystem:
        endpoint = self.settings.get("fs.s3a.endpoint", "")
        options = {
            "access_key": self.settings.get("fs.s3a.access.key"),
            "secret_key": self.settings.get("fs.s3a.secret.key"),
            "region": self.settings.get("fs.s3a.endpoint.region"),
            "endpoint_override": endpoint.split("://")[-1],
            "scheme": "http" if endpoint.startswith("http://") else None,
        }
        return pafs.S3FileSystem(**{name: value for name, value in options.items() if value})

    def open(self, uri: str) -> tuple[pafs.FileSystem, str]:
        """The file system of a path, and the path as that file system spells it."""
        scheme, match = scheme_of(uri), _URI.match(uri)
        if scheme in ("", "file"):
            return pafs.LocalFileSystem(), match.group(3) if match else uri
        host, path = (match.group(2) or "//")[2:], match.group(3)
        if scheme == "hdfs":
            if host not in self.opened:
                self.opened[host] = pafs.FileSystem.from_uri(f"hdfs://{host}/")[0]
            return self.opened[host], path
        # Object stores: the bucket is part of the path.
        if scheme not in self.opened:
            self.opened[scheme] = self._s3() if scheme in ("s3", "s3a") else pafs.GcsFileSystem()
        return self.opened[scheme], host + path

    def children(self, uri: str, deep: bool = False) -> list[tuple[str, bool, int, int]]:
        """(name, is a folder, milliseconds, bytes) of what is in a folder; nothing if there is none."""
        store, path = self.open(uri)
        found = store.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=deep))
        return [
            (i.base_name, i.type == pafs.FileType.Directory, (i.mtime_ns or 0) // 1_000_000, i.size or 0) for i in found
        ]

    def modified_ms(self, uri: str) -> int | None:
        """When a file was written; None if there is none."""
        store, path = self.open(uri)
        info = store.get_file_info(path)
        return None if info.type == pafs.FileType.NotFound else (info.mtime_ns or 0) // 1_000_000

    def is_folder(self, uri: str) -> bool:
        store, path = self.open(uri)
        return store.get_file_info(path).type == pafs.FileType.Directory

    def write(self, uri: str, data: bytes) -> None:
        store, path = self.open(uri)
        if isinstance(store, pafs.LocalFileSystem):
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path) as stream:
            stream.write(data)


class DriverStore:
    """The same by Spark's file system, for stores that tasks cannot open."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def children(self, uri: str, deep: bool = False) -> list[tuple[str, bool, int, int]]:
        found = children(self.spark, uri)
        if deep:
            for name, is_folder, _, _ in list(found):
                found += self.children(f"{uri}/{name}", True) if is_folder else []
        return found

    def modified_ms(self, uri: str) -> int | None:
        folder, _, name = uri.rpartition("/")
        return next((ms for n, _, ms, _ in self.children(folder) if n == name), None)


def look_into(store, source: str, job: str | None, folder: str) -> Iterator[tuple]:
    """Rows of FOUND: the snapshots in a folder, and its other folders."""
    for name, is_folder, modified, _ in store.children(folder):
        if not is_folder:
            continue
        path = f"{folder}/{name}"
        if re.match(SNAPSHOT_NAME, name):
            marked = store.modified_ms(f"{path}/{MARKER}")
            yield source, job, path, name, SNAPSHOT, modified if marked is None else marked, marked is not None
        else:
            yield source, job, path, name, FOLDER, modified, False


def batches_of(store, source: str, job: str, folder: str) -> Iterator[tuple]:
    """Rows of BATCHES: the planned batches of a stream's checkpoint; it keeps few of them."""
    committed = {name: ms for name, _, ms, _ in store.children(f"{folder}/commits")}
    for name, is_folder, modified, _ in store.children(f"{folder}/offsets"):
        if name.isdigit() and not is_folder:
            yield source, job, f"{folder}/offsets/{name}", int(name), committed.get(name, modified), name in committed


def sizes_of(store, job: str | None, name: str, folder: str) -> tuple:
    """A row of SIZES; hidden files do not count."""
    sizes = [size for n, is_folder, _, size in store.children(folder, deep=True) if not is_folder and n[0] not in "._"]
    return folder, job, name, sum(sizes), len(sizes)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _mapped(settings: Mapping[str, str], ddl: str, expand, skip_errors: bool = False):
    """Turns each row into the rows that ``expand(store, row)`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, schema = Store(settings), _schema(ddl)
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    found = list(expand(store, row))
                except Exception:  # any storage error means the same here: nothing to offer
                    if not skip_errors:
                        raise
                    found = []
                for at in range(0, len(found), 10_000):
                    yield _rows(schema, found[at : at + 10_000])

    return run


def _first(store, row) -> Iterator[tuple]:
    return look_into(store, row["source"], None, row["path"])


def _second(store, row) -> Iterator[tuple]:
    """Snapshots as they are; other folders are jobs and may have snapshots."""
    if row["kind"] == SNAPSHOT:
        yield tuple(row.values())
    else:
        yield from (r for r in look_into(store, row["source"], row["name"], row["path"]) if r[4] == SNAPSHOT)


def _streams(store, row) -> Iterator[tuple]:
    if row["kind"] == FOLDER:
        yield from batches_of(store, row["source"], row["name"], row["path"])


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _listed(spark: SparkSession, sources: Sequence[str], ddl: str, below, skip_errors: bool) -> DataFrame:
    """What ``below`` makes of the folders in each source, two levels of listing."""
    near, far = [], []
    for source in sources:
        try:
            # Spelled as Spark spells paths.
            own = qualified(spark, source)
        except Exception:
            if not skip_errors:
                raise
            continue
        (near if scheme_of(own) in _TASK_SCHEMES else far).append((source, own))
    frames = []
    if near:
        settings = store_settings(spark)
        roots = spark.createDataFrame(near, "source string, path string").repartition(min(len(near), _tasks(spark)))
        jobs = roots.mapInArrow(_mapped(settings, FOUND, _first, skip_errors), FOUND)
        # A number that is asked for is kept, however few bytes the names have.
        frames.append(jobs.repartition(_tasks(spark)).mapInArrow(_mapped(settings, ddl, below, skip_errors), ddl))
    names = FOUND.replace(",", "").split()[::2]
    for source, own in far:
        store, made = DriverStore(spark), []
        try:
            for row in look_into(store, source, None, own):
                made += below(store, dict(zip(names, row)))
        except Exception:
            if not skip_errors:
                raise
            made = []
        frames.append(spark.createDataFrame(made, ddl))
    result = spark.createDataFrame([], ddl) if not frames else frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def listed_pins(spark: SparkSession, sources: Sequence[str], skip_errors: bool = False) -> DataFrame:
    """FOUND rows of all pinned snapshots one or two levels below the sources."""
    return _listed(spark, sources, FOUND, _second, skip_errors)


def listed_batches(spark: SparkSession, sources: Sequence[str], skip_errors: bool = False) -> DataFrame:
    """BATCHES rows of all streams whose checkpoints are folders in the sources."""
    return _listed(spark, sources, BATCHES, _streams, skip_errors)


def folder_sizes(spark: SparkSession, snapshots: DataFrame, base: str) -> DataFrame:
    """SIZES rows of the snapshots (``path, job_id, snapshot``) listed below ``base``."""

    def sizes(store, row):
        yield sizes_of(store, row["job_id"], row["snapshot"], row["path"])

    rows = snapshots.select("path", "job_id", "snapshot")
    if scheme_of(base) not in _TASK_SCHEMES:
        store = DriverStore(spark)
        return spark.createDataFrame([r for row in rows.collect() for r in sizes(store, row)], SIZES)
    rows = rows.repartition(_tasks(spark))
    return rows.mapInArrow(_mapped(store_settings(spark), SIZES, sizes), SIZES)


def write_files(rows: DataFrame) -> int:
    """Writes one small file per row of ``path, text``, in tasks; how many there were."""

    def write(store, row):
        store.write(row["path"], row["text"].encode())
        yield (row["path"],)

    spark = rows.sparkSession
    spread = rows.select("path", "text").repartition(_tasks(spark))
    return spread.mapInArrow(_mapped(store_settings(spark), "path string", write), "path string").count()
