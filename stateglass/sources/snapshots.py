"""Finding snapshots under a path.

Two layouts are known. ``pinned``: ``base/job/<name>/`` (or ``base/<name>/``,
with no job) where the name starts with ``chk-`` or ``savepoint-``; a file
``snapshot.json`` marks a whole one. ``streaming``: ``base/job/`` is the
checkpoint folder of a stream, each planned batch N is a snapshot ``chk-N``,
whole once the batch is committed.

Discovery looks at names and times only and opens no file. It is a job: tasks list the
folders (``listing``), and the rows stay in Spark. The folders that hold most files, the
data of pins and the state of streams, are not listed. Every action lists anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from stateglass.functions.naming import snapshot_type
from stateglass.sources.listing import MARKER, SNAPSHOT_NAME, folder_sizes, listed_batches, listed_pins

__all__ = ["MARKER", "discover_snapshots", "list_children", "merge_listings", "probe_sources", "snapshot_sizes"]


def _discovered(spark: SparkSession, sources: Sequence[str], layout: str, skip_errors: bool = False) -> DataFrame:
    """Snapshots of several sources, with ``source`` as it was given."""
    if layout == "pinned":
        found = listed_pins(spark, sources, skip_errors).withColumnRenamed("name", "snapshot")
    elif layout == "streaming":
        found = listed_batches(spark, sources, skip_errors)
        found = found.withColumn("snapshot", F.concat(F.lit("chk-"), F.col("batch_id").cast("string")))
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return found.select(
        "source",
        "path",
        "job_id",
        "snapshot",
        snapshot_type(F.col("snapshot")).alias("type"),
        F.timestamp_millis("modified_ms").alias("modification_time"),
        "valid",
    )


def discover_snapshots(spark: SparkSession, base: str, layout: str = "pinned") -> DataFrame:
    """``path, job_id, snapshot, type, modification_time, valid`` per snapshot."""
    return _discovered(spark, [base], layout).drop("source")


def snapshot_names_only(rows: DataFrame, name: str = "snapshot") -> DataFrame:
    return rows.filter(F.col(name).rlike(SNAPSHOT_NAME))


def of_type(snapshots: DataFrame, kind: str) -> DataFrame:
    return snapshots.filter(F.col("type") == kind)


def merge_listings(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both listings with every path once, as the first has it if it is there.

    One listing may hold a path twice too; the newest row counts then.
    """
    rest = [c for c in first.columns if c != "path"]
    both = first.withColumn("__rank", F.lit(0)).unionByName(second.withColumn("__rank", F.lit(1)))
    newest = F.struct(-F.col("__rank"), F.col("modification_time"))
    merged = both.groupBy("path").agg(F.max_by(F.struct(*rest), newest).alias("__row"))
    return merged.select("path", "__row.*").select(*first.columns)


def list_children(snapshots: DataFrame) -> DataFrame:
    """Folders that hold snapshots, one row per parent path and its name."""
    parent = F.regexp_replace("path", "/[^/]+/*$", "")
    return snapshots.select(
        parent.alias("parent"), F.substring_index(parent, "/", -1).alias("name")
    ).distinct()


def snapshot_sizes(spark: SparkSession, base: str) -> DataFrame:
    """Bytes and files per pinned snapshot: ``path, job_id, snapshot, size_bytes, n_files``."""
    return folder_sizes(spark, discover_snapshots(spark, base), base)


def probe_sources(spark: SparkSession, paths: str | Sequence[str], layout: str = "pinned") -> DataFrame:
    """How many snapshots each source holds; a source that cannot be read holds 0.

    ``paths`` is a sequence or a comma-separated list; empty items are skipped. All
    sources are listed by one job.
    """
    if isinstance(paths, str):
        paths = paths.split(",")
    sources = list(dict.fromkeys(p.strip() for p in paths if p.strip()))
    asked = spark.createDataFrame([(s,) for s in sources], "source string")
    counted = _discovered(spark, sources, layout, skip_errors=True).groupBy("source").agg(F.count("*").alias("n"))
    return asked.join(counted, "source", "left").select(
        "source", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_snapshots")
    )
