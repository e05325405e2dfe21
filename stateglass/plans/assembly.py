"""Putting states together from parts."""

from pyspark.sql import functions as F

from stateglass.functions.text import map_text
from stateglass.operators import entries as e, order
from stateglass.plans.registry import query
from stateglass.plans.tables import (
    AFTER,
    RECENT_SQL,
    entries_at,
    entries_sql,
    load,
    recent_values,
)


@query(
    "j5_assemble_states",
    f"""
    SELECT key, max(value) FILTER (state_name = 'order_count') AS order_count,
           max(value) FILTER (state_name = 'total_cents') AS total_cents
    FROM ({entries_sql(AFTER)}) WHERE operator_uid = 'order-totals' GROUP BY key
    """,
)
def assemble_states(spark, sf_dir):
    rows = e.of_operator(entries_at(spark, sf_dir, AFTER), "order-totals")
    return e.to_wide(rows, ["order_count", "total_cents"])


@query(
    "j5_combine_states",
    """
    SELECT coalesce(c.user_id, p.user_id) AS user_id, n_clicks, last_purchase
    FROM (SELECT user_id, count(*) AS n_clicks FROM events WHERE event_type = 'click' GROUP BY 1) c
    FULL OUTER JOIN (SELECT user_id, max(event_id) AS last_purchase FROM events
                     WHERE event_type = 'purchase' GROUP BY 1) p ON c.user_id = p.user_id
    """,
)
def combine_states(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("value"))
    bought = (
        events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("value"))
    )
    return e.combine_states({"n_clicks": clicks, "last_purchase": bought}, ["user_id"])


@query(
    "a6_assemble_lists",
    f"""
    SELECT user_id, count(*) AS n_items,
           string_agg(value, ',' ORDER BY pos) AS items
    FROM ({RECENT_SQL}) GROUP BY user_id
    """,
)
def assemble_lists(spark, sf_dir):
    return e.assemble_lists(recent_values(spark, sf_dir), ["user_id"]).select(
        "user_id",
        F.size("items").cast("bigint").alias("n_items"),
        F.array_join("items", ",").alias("items"),
    )


CATEGORY_SQL = """
    SELECT user_id, event_type AS map_key, count(*) AS value FROM events GROUP BY 1, 2
"""


@query(
    "a7_assemble_maps",
    f"""
    SELECT user_id,
           string_agg(concat(map_key, '=', value), ',' ORDER BY concat(map_key, '=', value)) AS items
    FROM ({CATEGORY_SQL}) GROUP BY user_id
    """,
)
def assemble_maps(spark, sf_dir):
    counts = order.category_counts(load(spark, sf_dir, "events"), ["user_id"], "event_type")
    return e.assemble_maps(counts, ["user_id"]).withColumn("items", map_text(F.col("items")))


@query("a14_category_counts", CATEGORY_SQL)
def category_counts(spark, sf_dir):
    return order.category_counts(load(spark, sf_dir, "events"), ["user_id"], "event_type")


@query(
    "a8_last_write_wins",
    "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
)
def last_write_wins(spark, sf_dir):
    return e.last_write_wins(load(spark, sf_dir, "events"), "event_id", ["user_id", "event_type"])
