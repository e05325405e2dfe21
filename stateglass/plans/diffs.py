"""Snapshot comparison over keyed states cut from ``events``."""

from pyspark.sql import functions as F

from stateglass.operators import diff as d
from stateglass.operators.entries import of_operator
from stateglass.plans.registry import query
from stateglass.plans.tables import (
    AFTER,
    BEFORE,
    ORDER_CUTS,
    entries_at,
    entries_sql,
    key_text,
    load,
    state_at,
    state_sql,
    texts,
)

PAGE_OFFSET, PAGE_LIMIT = 5, 40


def cuts(spark, sf_dir):
    return state_at(spark, sf_dir, BEFORE), state_at(spark, sf_dir, AFTER)


JOINED_SQL = f"""
    SELECT coalesce(l.key, r.key) AS key,
           CASE WHEN l.key IS NULL THEN 'ADDED' WHEN r.key IS NULL THEN 'REMOVED'
                WHEN l.event_count IS NOT DISTINCT FROM r.event_count
                 AND l.average IS NOT DISTINCT FROM r.average THEN 'UNCHANGED'
                ELSE 'MODIFIED' END AS status,
           l.event_count AS old_count, r.event_count AS new_count,
           l.average AS old_average, r.average AS new_average
    FROM ({state_sql(BEFORE)}) l FULL OUTER JOIN ({state_sql(AFTER)}) r ON l.key = r.key
"""

SUMMARY_SQL = """
    count(*) FILTER (status = 'ADDED') AS total_added,
    count(*) FILTER (status = 'REMOVED') AS total_removed,
    count(*) FILTER (status = 'MODIFIED') AS total_modified,
    count(*) FILTER (status = 'UNCHANGED') AS unchanged_count,
    count(*) AS total_keys
"""


@query("j1_snapshot_diff", JOINED_SQL)
def snapshot_diff(spark, sf_dir):
    return d.diff_snapshots(*cuts(spark, sf_dir)).select(
        key_text(),
        "status",
        F.col("left.event_count").alias("old_count"),
        F.col("right.event_count").alias("new_count"),
        F.col("left.average").alias("old_average"),
        F.col("right.average").alias("new_average"),
    )


@query(
    "j1_keys_only_diff",
    f"SELECT key, CASE status WHEN 'MODIFIED' THEN 'UNCHANGED' ELSE status END AS status "
    f"FROM ({JOINED_SQL})",
)
def keys_only_diff(spark, sf_dir):
    return d.diff_snapshots(*cuts(spark, sf_dir), keys_only=True).select(key_text(), "status")


@query(
    "j2_added_removed_keys",
    f"SELECT key, status FROM ({JOINED_SQL}) WHERE status IN ('ADDED', 'REMOVED')",
)
def added_removed_keys(spark, sf_dir):
    left, right = cuts(spark, sf_dir)
    added = d.added_keys(left, right).select(key_text(), F.lit("ADDED").alias("status"))
    removed = d.removed_keys(left, right).select(key_text(), F.lit("REMOVED").alias("status"))
    return added.unionByName(removed)


@query("j3_unchanged_keys", f"SELECT key FROM ({JOINED_SQL}) WHERE status = 'UNCHANGED'")
def unchanged_keys(spark, sf_dir):
    return d.unchanged_keys(*cuts(spark, sf_dir)).select(key_text())


FIELDS_SQL = f"""
    SELECT key, 'event_count' AS field_name, CAST(old_count AS VARCHAR) AS old_value,
           CAST(new_count AS VARCHAR) AS new_value
    FROM ({JOINED_SQL}) WHERE status = 'MODIFIED' AND old_count IS DISTINCT FROM new_count
    UNION ALL
    SELECT key, 'average', CAST(old_average AS VARCHAR), CAST(new_average AS VARCHAR)
    FROM ({JOINED_SQL}) WHERE status = 'MODIFIED' AND old_average IS DISTINCT FROM new_average
"""


def writes(spark, sf_dir, cut):
    """Events up to a cut as writes of a value per user and type."""
    events = load(spark, sf_dir, "events").filter(F.col("ts") < F.lit(cut).cast("timestamp_ntz"))
    return events.select(F.struct("user_id", "event_type").alias("key"), "value", "event_id")


def last_write_sql(cut):
    return f"""
        SELECT concat(user_id, ':', event_type) AS key, arg_max(value, event_id) AS value
        FROM events WHERE ts < TIMESTAMP '{cut}' GROUP BY user_id, event_type
    """


@query(
    "j1_diff_of_writes",
    f"""
    SELECT coalesce(l.key, r.key) AS key,
           CASE WHEN l.key IS NULL THEN 'ADDED' WHEN r.key IS NULL THEN 'REMOVED'
                WHEN l.value = r.value THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status,
           l.value AS old_value, r.value AS new_value
    FROM ({last_write_sql(BEFORE)}) l FULL OUTER JOIN ({last_write_sql(AFTER)}) r ON l.key = r.key
    """,
)
def diff_of_writes(spark, sf_dir):
    sides = writes(spark, sf_dir, BEFORE), writes(spark, sf_dir, AFTER)
    return d.diff_snapshots(*sides, seq="event_id").select(
        key_text(),
        "status",
        F.col("left.value").alias("old_value"),
        F.col("right.value").alias("new_value"),
    )


@query("j4_field_changes", FIELDS_SQL)
def field_changes(spark, sf_dir):
    changes = d.field_changes(d.diff_snapshots(*cuts(spark, sf_dir)))
    return changes.withColumn("key", key_text())


ALL_JOINED_SQL = f"""
    SELECT coalesce(l.operator_uid, r.operator_uid) AS operator_uid,
           coalesce(l.state_name, r.state_name) AS state_name, coalesce(l.key, r.key) AS key,
           CASE WHEN l.key IS NULL THEN 'ADDED' WHEN r.key IS NULL THEN 'REMOVED'
                WHEN l.value IS NOT DISTINCT FROM r.value THEN 'UNCHANGED'
                ELSE 'MODIFIED' END AS status,
           coalesce(l.value, '') AS left_value, coalesce(r.value, '') AS right_value
    FROM ({entries_sql(BEFORE)}) l FULL OUTER JOIN ({entries_sql(AFTER)}) r
      ON l.operator_uid = r.operator_uid AND l.state_name = r.state_name AND l.key = r.key
"""


def all_operators(spark, sf_dir):
    keys = F.struct("operator_uid", "state_name", "key")
    sides = [
        entries_at(spark, sf_dir, cut).select(keys.alias("key"), "value") for cut in (BEFORE, AFTER)
    ]
    return d.diff_snapshots(*sides)


@query("j6_all_operators_diff", ALL_JOINED_SQL)
def all_operators_diff(spark, sf_dir):
    return all_operators(spark, sf_dir).select(
        "key.*",
        "status",
        F.coalesce("left.value", F.lit("")).alias("left_value"),
        F.coalesce("right.value", F.lit("")).alias("right_value"),
    )


def operators_at(spark, sf_dir, cut):
    """Two operators whose keys and states have types of their own."""
    orders = load(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit(ORDER_CUTS[cut]).cast("timestamp_ntz"))
    totals = orders.groupBy(F.col("o_custkey").alias("key")).agg(
        F.count("*").alias("order_count"), F.max("o_orderdate").cast("date").alias("last_day")
    )
    return {"event-counter": state_at(spark, sf_dir, cut), "order-totals": totals}


def order_totals_sql(cut):
    return f"""
        SELECT o_custkey AS key, count(*) AS order_count, CAST(max(o_orderdate) AS DATE) AS last_day
        FROM orders WHERE o_orderdate < TIMESTAMP '{ORDER_CUTS[cut]}' GROUP BY 1
    """


ORDERS_JOINED_SQL = f"""
    SELECT coalesce(l.key, r.key) AS key, l.key IS NULL AS added, r.key IS NULL AS removed,
           l.order_count AS old_count, r.order_count AS new_count, l.last_day AS old_day, r.last_day AS new_day
    FROM ({order_totals_sql(BEFORE)}) l FULL OUTER JOIN ({order_totals_sql(AFTER)}) r ON l.key = r.key
"""


@query(
    "j6_typed_field_changes",
    f"""
    SELECT 'event-counter' AS operator_uid, * FROM ({FIELDS_SQL})
    UNION ALL
    SELECT 'order-totals', CAST(key AS VARCHAR), 'order_count', CAST(old_count AS VARCHAR), CAST(new_count AS VARCHAR)
    FROM ({ORDERS_JOINED_SQL}) WHERE NOT added AND NOT removed AND old_count <> new_count
    UNION ALL
    SELECT 'order-totals', CAST(key AS VARCHAR), 'last_day', concat('"', old_day, '"'), concat('"', new_day, '"')
    FROM ({ORDERS_JOINED_SQL}) WHERE NOT added AND NOT removed AND old_day <> new_day
    """,
)
def typed_field_changes(spark, sf_dir):
    """Changed fields of all operators from one typed join."""
    sides = (operators_at(spark, sf_dir, cut) for cut in (BEFORE, AFTER))
    changes = d.field_changes(d.diff_operators(*sides), ["operator_uid", "key"])
    event = F.concat("key.key_0.user_id", F.lit(":"), "key.key_0.event_type")
    key = F.coalesce(event, F.col("key.key_1").cast("string"))
    return changes.select("operator_uid", key.alias("key"), "field_name", "old_value", "new_value")


@query("a1_diff_summary", f"SELECT {SUMMARY_SQL} FROM ({JOINED_SQL})")
def diff_summary(spark, sf_dir):
    return d.diff_summary(d.diff_status(*cuts(spark, sf_dir)))


@query(
    "a1_summary_per_operator",
    f"SELECT operator_uid, state_name, {SUMMARY_SQL} FROM ({ALL_JOINED_SQL}) GROUP BY 1, 2",
)
def summary_per_operator(spark, sf_dir):
    rows = all_operators(spark, sf_dir).select("key.operator_uid", "key.state_name", "status")
    return d.diff_summary(rows, by=["operator_uid", "state_name"])


@query("a11_change_counts", f"SELECT key, count(*) AS n_changes FROM ({FIELDS_SQL}) GROUP BY key")
def change_counts(spark, sf_dir):
    counts = d.change_counts(d.diff_snapshots(*cuts(spark, sf_dir)))
    return counts.withColumn("key", key_text())


@query(
    "o4_page_per_status",
    f"""
    SELECT key, status, pos FROM (
        SELECT key, status, row_number() OVER (PARTITION BY status ORDER BY key) AS pos
        FROM ({JOINED_SQL}) WHERE status <> 'UNCHANGED')
    WHERE pos > {PAGE_OFFSET} AND pos <= {PAGE_OFFSET + PAGE_LIMIT}
    """,
)
def page_per_status(spark, sf_dir):
    rows = d.diff_status(*cuts(spark, sf_dir)).withColumn("key", key_text())
    paged = d.page_per_status(rows, PAGE_OFFSET, PAGE_LIMIT)
    return paged.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "o4_page_totals",
    f"""
    SELECT status, count(*) AS total,
           greatest(least(count(*) - {PAGE_OFFSET}, {PAGE_LIMIT}), 0) AS entry_count,
           count(*) > {PAGE_OFFSET + PAGE_LIMIT} AS has_more
    FROM ({JOINED_SQL}) WHERE status <> 'UNCHANGED' GROUP BY status
    """,
)
def page_totals(spark, sf_dir):
    """What the page of each status holds and whether more follows."""
    return d.page_totals(d.diff_status(*cuts(spark, sf_dir)), PAGE_OFFSET, PAGE_LIMIT)


@query(
    "u1_all_keys",
    f"SELECT key FROM ({state_sql(BEFORE)}) UNION SELECT key FROM ({state_sql(AFTER)})",
)
def all_keys(spark, sf_dir):
    return d.all_keys(*cuts(spark, sf_dir)).select(key_text())


@query(
    "u2_combined_fields",
    f"""
    SELECT key, event_count, CAST(NULL AS DOUBLE) AS average FROM ({state_sql(BEFORE)})
    UNION ALL SELECT key, NULL, average FROM ({state_sql(AFTER)})
    """,
)
def combined_fields(spark, sf_dir):
    left, right = cuts(spark, sf_dir)
    return texts(d.combined_fields(left.drop("average"), right.drop("event_count")))
