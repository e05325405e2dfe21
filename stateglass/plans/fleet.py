"""Folders of many jobs, made from the table of suppliers and listed by tasks.

Every supplier is a snapshot of the job of its nation: pinned ones in one base, batches
of streams in another. Those with a positive balance are whole.
"""

from pyspark.sql import functions as F

from stateglass.plans.memo import once
from stateglass.plans.registry import query
from stateglass.plans.tables import load
from stateglass.session import work_dir
from stateglass.sources import snapshots as s, state as st
from stateglass.sources.files import qualified
from stateglass.sources.listing import write_files

JOB = "nation-"
NATIONS = 25

PINNED_SQL = f"""
    SELECT CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE concat('{JOB}', s_nationkey) END AS job_id,
           concat(CASE WHEN s_suppkey % 5 = 0 THEN 'savepoint-' ELSE 'chk-' END, s_suppkey) AS snapshot,
           CASE WHEN s_suppkey % 5 = 0 THEN 'savepoint' ELSE 'checkpoint' END AS type,
           s_acctbal > 0 AS valid, length(s_name) + s_suppkey % 7 AS n_data
    FROM supplier
"""


def suppliers(spark, sf_dir):
    key = F.col("s_suppkey")
    prefix = F.when(key % 5 == 0, "savepoint-").otherwise("chk-")
    return load(spark, sf_dir, "supplier").select(
        key.alias("number"),
        F.concat(F.lit(JOB), "s_nationkey").alias("job"),
        (key % 10 == 0).alias("top"),
        F.concat(prefix, key).alias("name"),
        (F.col("s_acctbal") > 0).alias("whole"),
        F.concat("s_name", F.repeat(F.lit("x"), (key % 7).cast("int"))).alias("text"),
        F.round(F.abs("s_acctbal") * 100).cast("bigint").alias("cents"),
    )


def pinned_fleet(spark, sf_dir):
    """``base/job/name/`` or ``base/name/``, with data and, if whole, the marker."""

    def build():
        base = qualified(spark, work_dir(spark, "fleet"))
        rows = suppliers(spark, sf_dir)
        folder = F.concat_ws("/", F.lit(base), F.when(~F.col("top"), F.col("job")), "name")
        data = rows.select(F.concat(folder, F.lit("/data/part")).alias("path"), "text")
        marks = rows.filter("whole").select(F.concat(folder, F.lit(f"/{s.MARKER}")).alias("path"), F.lit("{}").alias("text"))
        write_files(data.unionByName(marks))
        return base

    return once(spark, sf_dir, "fleet", build)


def streamed_fleet(spark, sf_dir):
    """``base/job/offsets/N`` for every supplier, ``commits/N`` for whole ones."""

    def build():
        base = qualified(spark, work_dir(spark, "fleet-streams"))
        rows = suppliers(spark, sf_dir)
        place = F.concat(F.lit(f"{base}/"), "job", F.lit("/%s/"), F.col("number").cast("string"))
        log = F.format_string(
            'v1\n{"batchWatermarkMs":0,"batchTimestampMs":%d}\n{"logOffset":%d}\n{"orders":{"0":%d,"1":%d}}',
            "number",
            "number",
            F.col("number") * 3,
            "cents",
        )
        planned = rows.select(F.replace(place, F.lit("%s"), F.lit("offsets")).alias("path"), log.alias("text"))
        done = rows.filter("whole").select(
            F.replace(place, F.lit("%s"), F.lit("commits")).alias("path"), F.lit("v1\n{}").alias("text")
        )
        write_files(planned.unionByName(done))
        return base

    return once(spark, sf_dir, "fleet-streams", build)


def below(base, path="path"):
    """The path as seen from the base folder, which has a random name."""
    return F.replace(F.col(path), F.lit(base), F.lit(""))


@query(
    "s1_pinned_snapshots",
    f"SELECT concat(coalesce('/' || job_id, ''), '/', snapshot) AS path, job_id, snapshot, type, valid FROM ({PINNED_SQL})",
)
def pinned_snapshots(spark, sf_dir):
    base = pinned_fleet(spark, sf_dir)
    found = s.discover_snapshots(spark, base).withColumn("path", below(base))
    return found.drop("modification_time")


@query(
    "s1_stream_snapshots",
    f"""
    SELECT concat('{JOB}', s_nationkey) AS job_id, concat('chk-', s_suppkey) AS snapshot,
           'checkpoint' AS type, s_acctbal > 0 AS valid
    FROM supplier
    """,
)
def stream_snapshots(spark, sf_dir):
    found = s.discover_snapshots(spark, streamed_fleet(spark, sf_dir), "streaming")
    return found.select("job_id", "snapshot", "type", "valid")


@query("s10_list_children", f"SELECT DISTINCT coalesce('/' || job_id, '') AS parent FROM ({PINNED_SQL})")
def list_children(spark, sf_dir):
    base = pinned_fleet(spark, sf_dir)
    children = s.list_children(s.discover_snapshots(spark, base))
    return children.select(below(base, "parent").alias("parent"))


@query(
    "s12_probe_sources",
    f"""
    SELECT concat('/{JOB}', n) AS source, count(job_id) AS n_snapshots
    FROM range({NATIONS}) AS t(n) LEFT JOIN ({PINNED_SQL}) ON job_id = concat('{JOB}', n) GROUP BY n
    UNION ALL SELECT '', count(*) FROM supplier
    UNION ALL SELECT '/nowhere', CAST(0 AS BIGINT)
    """,
)
def probe_sources(spark, sf_dir):
    base = pinned_fleet(spark, sf_dir)
    jobs = [f"{base}/{JOB}{n}" for n in range(NATIONS)]
    found = s.probe_sources(spark, ",".join([base, "", f"{base}/nowhere", *jobs]))
    return found.withColumn("source", below(base, "source"))


@query(
    "a10_snapshot_sizes",
    f"""
    SELECT concat(coalesce('/' || job_id, ''), '/', snapshot) AS path, job_id, snapshot,
           CAST(n_data + CASE WHEN valid THEN 2 ELSE 0 END AS BIGINT) AS size_bytes,
           CAST(CASE WHEN valid THEN 2 ELSE 1 END AS BIGINT) AS n_files
    FROM ({PINNED_SQL})
    """,
)
def snapshot_sizes(spark, sf_dir):
    base = pinned_fleet(spark, sf_dir)
    return s.snapshot_sizes(spark, base).withColumn("path", below(base))


POSITIONS_SQL = f"""
    SELECT concat('{JOB}', s_nationkey) AS job_id, s_suppkey AS batch_id, s_acctbal > 0 AS committed, source, part AS partition,
           CASE part WHEN 'logOffset' THEN s_suppkey WHEN 'orders/0' THEN s_suppkey * 3
                ELSE CAST(round(abs(s_acctbal) * 100) AS BIGINT) END AS position
    FROM supplier, (VALUES (0, 'logOffset'), (1, 'orders/0'), (1, 'orders/1')) AS t(source, part)
"""


@query(
    "s9_source_offsets",
    f"""
    SELECT *, position - lag(position) OVER (PARTITION BY job_id, source, partition ORDER BY batch_id) AS advance
    FROM ({POSITIONS_SQL})
    """,
)
def source_offsets(spark, sf_dir):
    """Positions of all streams by source and partition, and how far each batch moved them."""
    positions = st.source_positions(st.read_source_offsets(spark, f"{streamed_fleet(spark, sf_dir)}/*"))
    return positions.select("job_id", "batch_id", "committed", "source", "partition", "position", "advance")
