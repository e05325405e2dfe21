"""Pins and exports, written from the tables and read back."""

from pyspark.sql import functions as F

from stateglass.operators import diff as d, order, reports
from stateglass.plans.diffs import JOINED_SQL
from stateglass.plans.memo import once
from stateglass.plans.registry import query
from stateglass.plans.tables import (
    AFTER,
    BEFORE,
    PINS_SQL,
    entries_at,
    entries_sql,
    pins,
    state_at,
    texts,
)
from stateglass.session import kept, work_dir
from stateglass.sinks import pins as k
from stateglass.sinks.export import export_json
from stateglass.sources import snapshots as s

COLUMNS = "operator_uid, state_kind, state_name, key, value"


def pinnable(spark, sf_dir, cut):
    return entries_at(spark, sf_dir, cut).withColumn("operator_id", F.col("operator_uid"))


def pinned_base(spark, sf_dir):
    """Pins of both cuts as checkpoints, a savepoint, and a copy broken off."""

    def build():
        base = work_dir(spark, "pins")
        store = k.PinStore(spark, base)
        store.pin_snapshot(pinnable(spark, sf_dir, BEFORE), "job-events", "chk-1", "s3://state/e/chk-1")
        store.pin_snapshot(pinnable(spark, sf_dir, AFTER), "job-events", "chk-2", "s3://state/e/chk-2")
        store.pin_snapshot(pinnable(spark, sf_dir, AFTER), None, "savepoint-a1", "s3://state/a1")
        broken = k.pin_path(base, "job-events", "chk-3")
        pinnable(spark, sf_dir, AFTER).write.parquet(f"{broken}/data")
        return base

    return once(spark, sf_dir, "pins", build)


@query(
    "s2_snapshot_validity",
    f"""
    SELECT 'job-events' AS job_id, 'chk-1' AS snapshot, true AS valid, count(*) AS n_entries
    FROM ({entries_sql(BEFORE)})
    UNION ALL SELECT 'job-events', 'chk-2', true, count(*) FROM ({entries_sql(AFTER)})
    UNION ALL SELECT 'job-events', 'chk-3', false, 0
    UNION ALL SELECT NULL, 'savepoint-a1', true, count(*) FROM ({entries_sql(AFTER)})
    """,
)
def snapshot_validity(spark, sf_dir):
    """Every snapshot, whole or not, with the entries that can be read from it."""
    found = s.discover_snapshots(spark, pinned_base(spark, sf_dir))
    counts = k.read_snapshots(spark, found).groupBy("path").agg(F.count("*").alias("n_entries"))
    return found.join(counts, "path", "left").select(
        "job_id", "snapshot", "valid", F.coalesce("n_entries", F.lit(0)).alias("n_entries")
    )


@query(
    "k1_export_json",
    f"SELECT {COLUMNS} FROM ({entries_sql(AFTER)})",
)
def exported(spark, sf_dir):
    path = work_dir(spark, "export")
    rows = entries_at(spark, sf_dir, AFTER)
    export_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("k2_pin_snapshot", f"SELECT {COLUMNS} FROM ({entries_sql(AFTER)})")
def pinned(spark, sf_dir):
    base = pinned_base(spark, sf_dir)
    path = k.PinStore(spark, base).lookup("s3://state/e/chk-2")
    return k.read_pin(spark, path).drop("operator_id").select(*COLUMNS.split(", "))


@query("k2_bucketed_diff", JOINED_SQL)
def bucketed_diff(spark, sf_dir):
    """The snapshot diff over two pins bucketed by key: neither side is shuffled."""

    def build():
        base = work_dir(spark, "buckets")
        buckets = spark.sparkContext.defaultParallelism
        for cut, name in ((BEFORE, "before"), (AFTER, "after")):
            table = f"{base.rsplit('/', 1)[-1].replace('-', '_')}_{name}"
            k.pin_to_table(texts(state_at(spark, sf_dir, cut)), table, f"{base}/{name}", buckets=buckets)
        return base

    base = once(spark, sf_dir, "buckets", build).rsplit("/", 1)[-1].replace("-", "_")
    sides = spark.table(f"{base}_before"), spark.table(f"{base}_after")
    return d.diff_snapshots(*sides, null_keys=False).select(
        "key",
        "status",
        F.col("left.event_count").alias("old_count"),
        F.col("right.event_count").alias("new_count"),
        F.col("left.average").alias("old_average"),
        F.col("right.average").alias("new_average"),
    )


@query(
    "k2_read_pruned",
    f"SELECT key, value FROM ({entries_sql(AFTER)}) WHERE state_name = 'order_count'",
)
def pruned(spark, sf_dir):
    base = pinned_base(spark, sf_dir)
    rows = k.read_pin(spark, k.pin_path(base, "job-events", "chk-2"))
    chosen = (F.col("operator_id") == "order-totals") & (F.col("state_name") == "order_count")
    return rows.filter(chosen).select("key", "value")


@query(
    "k3_lookup_pins",
    f"""
    SELECT source_path, id, cached_at FROM (
        SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY cached_at DESC, id DESC) AS n
        FROM ({PINS_SQL}))
    WHERE n = 1
    """,
)
def lookup_pins(spark, sf_dir):
    return k.newest_pins(pins(spark, sf_dir))


@query(
    "k4_delete_pin",
    f"""
    SELECT true AS deleted, false AS deleted_again, 'chk-2' AS snapshot, operator_uid,
           state_name, count(*) AS n_entries
    FROM ({entries_sql(AFTER)}) GROUP BY operator_uid, state_name
    """,
)
def delete_pin(spark, sf_dir):
    """Two pins, one deleted twice; the entries of the one that is left."""
    base = work_dir(spark, "delete")
    store = k.PinStore(spark, base)
    first = store.pin_snapshot(pinnable(spark, sf_dir, BEFORE), "job", "chk-1")
    store.pin_snapshot(pinnable(spark, sf_dir, AFTER), "job", "chk-2")
    deleted, again = store.delete(first), store.delete(first)
    rows = k.read_snapshots(spark, s.snapshot_names_only(s.discover_snapshots(spark, base)))
    return (
        rows.groupBy("snapshot", "operator_uid", "state_name")
        .agg(F.count("*").alias("n_entries"))
        .select(F.lit(deleted).alias("deleted"), F.lit(again).alias("deleted_again"), "*")
    )


@query(
    "k5_clear_pins",
    f"""
    SELECT 'chk-1' AS snapshot, operator_uid, count(*) AS n_entries, CAST(0 AS BIGINT) AS n_left FROM ({entries_sql(BEFORE)}) GROUP BY 2
    UNION ALL
    SELECT 'chk-2', operator_uid, count(*), CAST(0 AS BIGINT) FROM ({entries_sql(AFTER)}) GROUP BY 2
    """,
)
def clear_pins(spark, sf_dir):
    """What two pins held before all pins are deleted, and what is found of it afterwards."""
    base = work_dir(spark, "clear")
    store = k.PinStore(spark, base)
    for cut, name in ((BEFORE, "chk-1"), (AFTER, "chk-2")):
        store.pin_snapshot(pinnable(spark, sf_dir, cut), "job", name)

    def held(name):
        rows = k.read_snapshots(spark, s.discover_snapshots(spark, base))
        return rows.groupBy("snapshot", "operator_uid").agg(F.count("*").alias(name))

    before = kept(held("n_entries"), "held")
    store.clear()
    after = held("n_left").unionByName(store.pins().select(F.lit(None).alias("snapshot"), F.col("id").alias("operator_uid"), F.lit(1).alias("n_left")))
    joined = before.join(after, ["snapshot", "operator_uid"], "full")
    return joined.withColumn("n_left", F.coalesce("n_left", F.lit(0)).cast("bigint"))


@query(
    "o7_pins_newest_first",
    f"""
    SELECT id, source_path, cached_at, size_bytes, row_number() OVER (ORDER BY cached_at DESC, id) AS pos
    FROM ({PINS_SQL})
    """,
)
def pins_newest_first(spark, sf_dir):
    """All pins with their position, without where they are kept."""
    return order.global_index(pins(spark, sf_dir).drop("pin_path"), [F.col("cached_at").desc(), "id"], "pos")


@query(
    "w2_pins_to_evict",
    f"""
    SELECT id, source_path, pin_path, cached_at, size_bytes FROM (
        SELECT *, row_number() OVER (ORDER BY cached_at DESC, id) AS n FROM ({PINS_SQL}))
    WHERE n > {k.MAX_PINS}
    """,
)
def pins_to_evict(spark, sf_dir):
    return k.beyond_newest(pins(spark, sf_dir))


@query(
    "a10_pin_totals",
    f"SELECT count(*) AS n_pins, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM ({PINS_SQL})",
)
def pin_totals(spark, sf_dir):
    return k.pin_totals(pins(spark, sf_dir))


@query(
    "a4_pinned_operators",
    f"""
    SELECT 'chk-2' AS path, string_agg(concat(uid, label), ', ' ORDER BY uid) AS operators FROM (
        SELECT operator_uid AS uid,
               CASE WHEN any_value(state_kind) = 'keyed' THEN '(keyed)'
                    ELSE concat('(operator[', count(DISTINCT state_name), '])') END AS label
        FROM ({entries_sql(AFTER)}) GROUP BY operator_uid)
    """,
)
def pinned_catalog(spark, sf_dir):
    base = pinned_base(spark, sf_dir)
    found = k.read_catalog(spark, k.pin_path(base, "job-events", "chk-2"))
    return reports.operator_summary(found.withColumn("path", F.lit("chk-2")))


@query(
    "a3_pinned_counts",
    f"SELECT operator_uid AS uid, count(*) AS n_entries FROM ({entries_sql(AFTER)}) GROUP BY 1",
)
def pinned_counts(spark, sf_dir):
    """Entries per operator from the catalog of a pin; its data is not read."""
    base = pinned_base(spark, sf_dir)
    found = k.read_catalog(spark, k.pin_path(base, "job-events", "chk-2"))
    return found.select("uid", "n_entries")
