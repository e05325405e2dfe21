"""Operator state on subtasks, and settings that reach every record."""

from pyspark.sql import functions as F

from stateglass.operators import entries as e, opstate as o
from stateglass.plans.memo import once
from stateglass.plans.registry import query
from stateglass.plans.tables import (
    BUFFERED_SQL,
    OPERATOR_ENTRIES_SQL,
    SETTINGS,
    SETTINGS_SQL,
    buffered,
    load,
    operator_entries,
    settings,
    subtask_events,
    subtasks,
)
from stateglass import views
from stateglass.session import work_dir
from stateglass.sinks.pins import PinStore
from stateglass.streaming.summaries import SUBTASKS

COLUMNS = "operator_uid, subtask, state_name, mode, pos, key, value"
STATES = (("user-modes", o.BROADCAST), ("partitioned-records", o.SPLIT), ("union-records", o.UNION))


@query(
    "s6_operator_state",
    f"""
    SELECT {COLUMNS} FROM ({OPERATOR_ENTRIES_SQL})
    WHERE state_name IN ('partitioned-records', 'union-records')
       OR state_name = 'user-modes' AND subtask = 0
    """,
)
def operator_state(spark, sf_dir):
    rows = operator_entries(spark, sf_dir)
    return e.one_result([o.read_operator_state(rows, name, mode) for name, mode in STATES])


@query("k2_operator_state_pin", f"SELECT {COLUMNS} FROM ({OPERATOR_ENTRIES_SQL})")
def operator_state_pin(spark, sf_dir):
    """Operator state of every mode through a pin and back."""
    return views.snapshot_entries(spark, pinned_operator_state(spark, sf_dir)).select(*COLUMNS.split(", "))


@query(
    "j6_operator_state_diff",
    f"""
    SELECT operator_uid, state_name, subtask, pos, key,
           CASE WHEN mode = 'UNION' THEN 'MODIFIED' ELSE 'UNCHANGED' END AS status
    FROM ({OPERATOR_ENTRIES_SQL})
    """,
)
def operator_state_diff(spark, sf_dir):
    """A pin against one whose union state says something else, element by element."""
    left = pinned_operator_state(spark, sf_dir)
    right = pinned_operator_state(spark, sf_dir, "changed")
    found = views.compare(spark, left, right)
    return found.select("operator_uid", "state_name", "subtask", "pos", "key", "status")


def pinned_operator_state(spark, sf_dir, name="kept"):
    def build():
        rows = operator_entries(spark, sf_dir).withColumn("state_kind", F.lit("operator"))
        if name == "changed":
            changed = F.when(F.col("mode") == o.UNION, F.concat("value", F.lit("!"))).otherwise(F.col("value"))
            rows = rows.withColumn("value", changed)
        store = PinStore(spark, work_dir(spark, "operator-pins"))
        store.pin_snapshot(rows.withColumn("operator_id", F.col("operator_uid")), "job", "chk-1", "source")
        return store.lookup("source")

    return once(spark, sf_dir, f"operator-state-{name}", build)


@query(
    "s7_broadcast_entries",
    f"""
    SELECT s AS subtask, k AS key, arg_max(v, seq) AS value
    FROM ({SETTINGS_SQL}), range({SUBTASKS}) AS r(s) GROUP BY s, k
    """,
)
def broadcast_entries(spark, sf_dir):
    latest = settings(spark, sf_dir).groupBy("k").agg(F.max_by("v", "seq").alias("v"))
    # Three settings make one small map, the same on every subtask.
    state = latest.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("state"))
    return o.broadcast_entries(state.select(F.explode(subtasks()).alias("subtask"), "state"))


@query("s8_list_entries", f"SELECT subtask, pos AS partition, value FROM ({BUFFERED_SQL})")
def list_entries(spark, sf_dir):
    lists = e.assemble_lists(buffered(spark, sf_dir), ["subtask"])
    states = lists.select("subtask", F.col("items").alias("state"))
    return o.list_entries(states).withColumn("partition", F.col("partition").cast("bigint"))


@query(
    "u4_first_replica",
    f"SELECT {COLUMNS} FROM ({OPERATOR_ENTRIES_SQL}) WHERE mode = 'BROADCAST' AND subtask = 0",
)
def first_replica(spark, sf_dir):
    rows = operator_entries(spark, sf_dir).filter(F.col("mode") == o.BROADCAST)
    return o.first_replica(rows)


@query(
    "u4_diverging_replicas",
    """
    SELECT 'broadcast-proc' AS operator_uid, concat('totals-', event_type) AS state_name,
           CAST(user_id AS VARCHAR) AS key, count(*) AS n_replicas,
           min(n) AS min_value, max(n) AS max_value
    FROM (SELECT user_id, event_type, event_id % 4 AS subtask, count(*) AS n
          FROM events GROUP BY 1, 2, 3)
    GROUP BY user_id, event_type
    HAVING count(*) <> 4 OR min(n) <> max(n)
    """,
)
def diverging_replicas(spark, sf_dir):
    by = ("user_id", "event_type", "subtask")
    counts = subtask_events(spark, sf_dir).groupBy(*by).agg(F.count("*").alias("value"))
    return o.diverging_replicas(
        counts.select(
            F.lit("broadcast-proc").alias("operator_uid"),
            F.concat(F.lit("totals-"), "event_type").alias("state_name"),
            "subtask",
            F.col("user_id").cast("string").alias("key"),
            "value",
        )
    )


@query("u5_union_entries", f"SELECT {COLUMNS} FROM ({OPERATOR_ENTRIES_SQL}) WHERE mode = 'UNION'")
def union_entries(spark, sf_dir):
    return o.union_entries(operator_entries(spark, sf_dir))


@query(
    "a12_state_names",
    f"""
    SELECT operator_uid, string_agg(DISTINCT state_name, ',' ORDER BY state_name) AS state_names
    FROM ({OPERATOR_ENTRIES_SQL}) GROUP BY operator_uid
    """,
)
def state_names(spark, sf_dir):
    names = e.state_names(operator_entries(spark, sf_dir))
    return names.withColumn("state_names", F.array_join("state_names", ","))


SUBTASK_SQL = f"""
    SELECT event_id % {SUBTASKS} AS subtask, count(*) AS n_records, max(ts) AS last_time
    FROM events GROUP BY event_id % {SUBTASKS}
"""


@query("a13_subtask_summary", SUBTASK_SQL)
def subtask_summary(spark, sf_dir):
    return o.subtask_summary(subtask_events(spark, sf_dir))


ENRICHED_SQL = f"""
    SELECT event_id, user_id,
           (SELECT arg_max(v, seq) FROM ({SETTINGS_SQL}) WHERE k = 'threshold') AS threshold,
           (SELECT arg_max(v, seq) FROM ({SETTINGS_SQL}) WHERE k = 'mode') AS mode,
           coalesce((SELECT arg_max(v, seq) FROM ({SETTINGS_SQL}) WHERE k = 'version'),
                    'unset') AS version
    FROM events
"""


@query("j7_config_enrichment", ENRICHED_SQL)
def config_enrichment(spark, sf_dir):
    current = o.current_config(settings(spark, sf_dir), SETTINGS)
    records = load(spark, sf_dir, "events").select("event_id", "user_id")
    return o.with_config(records, current, SETTINGS)
