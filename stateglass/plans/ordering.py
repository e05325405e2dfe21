"""Running values per key."""

from pyspark.sql import functions as F

from stateglass.operators import order
from stateglass.plans.registry import query
from stateglass.plans.tables import (
    BUFFERED_SQL,
    LISTING_SQL,
    RECENT_SQL,
    buffered,
    listing,
    load,
    recent_values,
)
from stateglass.streaming.summaries import ALPHA


@query(
    "w1_snapshot_index",
    f"""
    SELECT path, row_number() OVER (ORDER BY modification_time DESC, path) AS index
    FROM ({LISTING_SQL})
    """,
)
def snapshot_index(spark, sf_dir):
    """Snapshots numbered newest first, by path where times are equal."""
    rows = listing(spark, sf_dir).select("path", "modification_time")
    found = order.global_index(rows, [F.col("modification_time").desc(), "path"])
    return found.drop("modification_time")


@query(
    "w3_running_count",
    """
    SELECT event_id, user_id,
           count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS running_count
    FROM events
    """,
)
def running_count(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", "user_id")
    return order.running_count(rows, ["user_id"], "event_id")


@query(
    "w4_last_category",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
)
def last_category(spark, sf_dir):
    return order.last_value_per_key(
        load(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type"
    )


@query("w5_recent_values", f"SELECT user_id, pos, value FROM ({RECENT_SQL})")
def recent(spark, sf_dir):
    return recent_values(spark, sf_dir)


@query("w6_recent_per_subtask", f"SELECT subtask, pos, value FROM ({BUFFERED_SQL})")
def recent_per_subtask(spark, sf_dir):
    return buffered(spark, sf_dir)


AVERAGE_SQL = f"""
    SELECT user_id, round(list_reduce(list(value ORDER BY event_id),
           lambda a, v: {ALPHA}::DOUBLE * v + {1 - ALPHA}::DOUBLE * a), 6) AS running_average
    FROM events GROUP BY user_id
"""


@query("w7_running_average", AVERAGE_SQL)
def running_average(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    return order.exponential_average(rows, ["user_id"], "event_id", "value", ALPHA).select(
        "user_id", F.round("running_average", 6).alias("running_average")
    )
