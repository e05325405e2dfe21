"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

# Temporary folders of local sessions that name no shared one, by application.
_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine;
    on a cluster the executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="stateglass-")
        base = _LOCAL[context.applicationId]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut of the lineage."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def streaming_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A sibling session set up for writing state.

    It shares the context and caches, so its results can be used in ``spark``,
    while the settings of ``spark`` stay as they are. The number of state partitions
    is fixed when a stream first starts: ``state_partitions``, or the session's
    ``spark.sql.shuffle.partitions``.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    # Writes a log of changes beside full snapshots; the change feed reads it.
    session.conf.set(
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"
    )
    partitions = state_partitions or spark.conf.get("spark.sql.shuffle.partitions")
    session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return session
