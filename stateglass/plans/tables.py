"""Snapshots, listings and states derived from the test tables.

Each builder has its SQL beside it, for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stateglass.functions.naming import snapshot_type
from stateglass.functions.text import entry_text, timed_value
from stateglass.operators.entries import one_result, to_long
from stateglass.operators.order import recent_rows
from stateglass.sources.custom import as_entries
from stateglass.streaming.summaries import BUFFER_SIZE, RECENT_VALUES, SUBTASKS, epoch_millis

BEFORE, AFTER = "2024-01-15", "2024-01-18"
ORDER_CUTS = {BEFORE: "1998-06-01", AFTER: "1998-09-01"}
SETTINGS = ("threshold", "mode", "version")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(value="value"):
    return F.round(F.col(value) * 100).cast("bigint")


# Keyed state at a cut: live if the last event is not over seven days old.


def state_at(spark: SparkSession, sf_dir: str, cut: str) -> DataFrame:
    at = F.lit(cut).cast("timestamp_ntz")
    return (
        load(spark, sf_dir, "events")
        .filter(F.col("ts") < at)
        .groupBy(F.struct("user_id", "event_type").alias("key"))
        .agg(
            F.count("*").alias("event_count"),
            (F.sum(cents()).cast("double") / (F.count("*") * 100)).alias("average"),
            F.max("ts").alias("last_time"),
        )
        .filter(F.col("last_time") >= at - F.expr("interval 7 days"))
        .drop("last_time")
    )


def state_sql(cut: str) -> str:
    return f"""
        SELECT user_id, event_type, concat(user_id, ':', event_type) AS key,
               count(*) AS event_count,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS average
        FROM events WHERE ts < TIMESTAMP '{cut}'
        GROUP BY user_id, event_type
        HAVING max(ts) >= TIMESTAMP '{cut}' - INTERVAL 7 DAY
    """


def key_text():
    return F.concat(F.col("key.user_id"), F.lit(":"), F.col("key.event_type")).alias("key")


def texts(state: DataFrame) -> DataFrame:
    """The state with its key as text."""
    return state.select(key_text(), *[c for c in state.columns if c != "key"])


# Settings: threshold, mode and version, the latest event with each wins.


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = F.col("event_id") % 3
    return load(spark, sf_dir, "events").select(
        F.when(which == 0, "threshold").when(which == 1, "mode").otherwise("version").alias("k"),
        F.when(which == 0, F.format_string("%.2f", "value"))
        .when(which == 1, F.col("event_type"))
        .otherwise(F.concat(F.lit("v"), F.col("event_id")))
        .alias("v"),
        F.col("event_id").alias("seq"),
        "ts",
    )


SETTINGS_SQL = """
    SELECT CASE event_id % 3 WHEN 0 THEN 'threshold' WHEN 1 THEN 'mode' ELSE 'version' END AS k,
           CASE event_id % 3 WHEN 0 THEN printf('%.2f', value) WHEN 1 THEN event_type
                ELSE concat('v', event_id) END AS v,
           event_id AS seq, ts
    FROM events
"""


# Long entries of three operators at a cut.


def entries_at(spark: SparkSession, sf_dir: str, cut: str) -> DataFrame:
    counters = to_long(
        texts(state_at(spark, sf_dir, cut)).select(
            "key", "event_count", F.col("average").alias("average")
        ),
        ["event_count", "average"],
    )
    totals = to_long(
        load(spark, sf_dir, "orders")
        .filter(F.col("o_orderdate") < F.lit(ORDER_CUTS[cut]).cast("timestamp_ntz"))
        .groupBy(F.col("o_custkey").cast("string").alias("key"))
        .agg(
            F.count("*").alias("order_count"),
            F.sum(cents("o_totalprice")).alias("total_cents"),
        ),
        ["order_count", "total_cents"],
    )
    config = (
        settings(spark, sf_dir)
        .filter(F.col("ts") < F.lit(cut).cast("timestamp_ntz"))
        .groupBy("k")
        .agg(F.max_by("v", "seq").alias("v"))
    )
    name, key, value = F.col("state_name"), F.col("key"), F.col("value")
    return one_result(
        [
            as_entries(counters, "event-counter", name, key, value),
            as_entries(totals, "order-totals", name, key, value),
            as_entries(
                config, "broadcast-proc", "config-state", F.col("k"), F.col("v"), "operator"
            ),
        ]
    )


def entries_sql(cut: str) -> str:
    return f"""
        SELECT 'event-counter' AS operator_uid, 'keyed' AS state_kind,
               'event_count' AS state_name, key, CAST(event_count AS VARCHAR) AS value
        FROM ({state_sql(cut)})
        UNION ALL
        SELECT 'event-counter', 'keyed', 'average', key, CAST(average AS VARCHAR)
        FROM ({state_sql(cut)})
        UNION ALL
        SELECT 'order-totals', 'keyed', 'order_count', CAST(o_custkey AS VARCHAR),
               CAST(count(*) AS VARCHAR)
        FROM orders WHERE o_orderdate < TIMESTAMP '{ORDER_CUTS[cut]}' GROUP BY o_custkey
        UNION ALL
        SELECT 'order-totals', 'keyed', 'total_cents', CAST(o_custkey AS VARCHAR),
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS VARCHAR)
        FROM orders WHERE o_orderdate < TIMESTAMP '{ORDER_CUTS[cut]}' GROUP BY o_custkey
        UNION ALL
        SELECT 'broadcast-proc', 'operator', 'config-state', k, arg_max(v, seq)
        FROM ({SETTINGS_SQL}) WHERE ts < TIMESTAMP '{cut}' GROUP BY k
    """


# A listing with a snapshot per event.


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    number = F.col("event_id").cast("string")
    job = F.md5(F.col("user_id").cast("string"))
    name = F.when(
        F.col("event_id") % 5 == 0, F.concat(F.lit("savepoint-"), F.substring(F.md5(number), 1, 6))
    ).otherwise(F.concat(F.lit("chk-"), number))
    return (
        e.select(job.alias("job_id"), name.alias("snapshot"), "ts", "event_id")
        .withColumn("path", F.concat(F.lit("s3://state/"), "job_id", F.lit("/"), "snapshot"))
        .select(
            "path",
            "job_id",
            "snapshot",
            snapshot_type(F.col("snapshot")).alias("type"),
            F.col("ts").alias("modification_time"),
            (F.col("event_id") % 7 != 0).alias("valid"),
            F.col("event_id").alias("number"),
        )
    )


LISTING_SQL = """
    SELECT concat('s3://state/', job_id, '/', snapshot) AS path, job_id, snapshot, type,
           modification_time, valid, number
    FROM (SELECT md5(CAST(user_id AS VARCHAR)) AS job_id,
                 CASE WHEN event_id % 5 = 0
                      THEN concat('savepoint-', substr(md5(CAST(event_id AS VARCHAR)), 1, 6))
                      ELSE concat('chk-', event_id) END AS snapshot,
                 CASE WHEN event_id % 5 = 0 THEN 'savepoint' ELSE 'checkpoint' END AS type,
                 ts AS modification_time, event_id % 7 <> 0 AS valid, event_id AS number
          FROM events)
"""


# Declared operators: a job per user, an operator per event type.


def operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    none = F.expr("cast(array() as array<string>)")
    return (
        load(spark, sf_dir, "events")
        .groupBy("user_id", "event_type")
        .agg(F.count("*").alias("n"))
        .select(
            F.concat(F.lit("s3://state/job-"), "user_id").alias("path"),
            F.col("event_type").alias("uid"),
            F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("op-"), "event_type")).alias("name"),
            F.when(n % 3 == 0, none).otherwise(F.array(F.lit("keyed-state"))).alias("keyed_states"),
            F.when(n % 2 == 0, F.array(F.lit("buffer"), F.lit("union")))
            .otherwise(none)
            .alias("operator_states"),
            n.alias("n_entries"),
        )
    )


OPERATORS_SQL = """
    SELECT concat('s3://state/job-', user_id) AS path, event_type AS uid,
           CASE WHEN n % 4 = 0 THEN '' ELSE concat('op-', event_type) END AS name,
           n % 3 <> 0 AS keyed, n % 2 = 0 AS operator, n AS n_entries
    FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
"""


# Operator state on four subtasks.


def subtask_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("subtask", F.col("event_id") % SUBTASKS)


def subtasks():
    return F.sequence(F.lit(0).cast("bigint"), F.lit(SUBTASKS - 1).cast("bigint"))


def buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entries of each subtask: ``subtask, pos, value``."""
    rows = subtask_events(spark, sf_dir).drop("ts", "props")
    # Texts are made for the rows that are kept only.
    kept = recent_rows(rows, ["subtask"], "event_id", BUFFER_SIZE)
    text = entry_text(F.col("user_id"), F.col("event_type"), F.col("value"))
    return kept.select("subtask", "pos", text.alias("value"))


BUFFERED_SQL = f"""
    SELECT subtask, value, count(*) OVER (PARTITION BY subtask) - rank AS pos
    FROM (SELECT event_id % {SUBTASKS} AS subtask,
                 concat(user_id, ':', event_type, '=', printf('%.2f', value)) AS value,
                 row_number() OVER (PARTITION BY event_id % {SUBTASKS} ORDER BY event_id DESC) AS rank
          FROM events)
    WHERE rank <= {BUFFER_SIZE}
"""


def recent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest values of each user: ``user_id, pos, value``."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts")
    kept = recent_rows(rows, ["user_id"], "event_id", RECENT_VALUES)
    text = timed_value(F.col("value"), epoch_millis(F.col("ts")))
    return kept.select("user_id", "pos", text.alias("value"))


RECENT_SQL = f"""
    SELECT user_id, value, count(*) OVER (PARTITION BY user_id) - rank AS pos
    FROM (SELECT user_id, concat(printf('%.2f', value), '@', (epoch_us(ts) // 1000)) AS value,
                 row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank
          FROM events)
    WHERE rank <= {RECENT_VALUES}
"""


def operator_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``operator_uid, subtask, state_name, mode, pos, key, value`` of four states."""
    e = subtask_events(spark, sf_dir)
    replicas = F.explode(subtasks())
    nothing = F.lit(None)

    def rows(df, uid, state, mode, subtask, pos, key, value):
        return df.select(
            F.lit(uid).alias("operator_uid"),
            subtask.alias("subtask"),
            F.lit(state).alias("state_name"),
            F.lit(mode).alias("mode"),
            pos.cast("bigint").alias("pos"),
            key.cast("string").alias("key"),
            value.cast("string").alias("value"),
        )

    last_types = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("v"))
    config = settings(spark, sf_dir).groupBy("k").agg(F.max_by("v", "seq").alias("v"))
    summary = e.groupBy("subtask").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    text = F.format_string("subtask-%d: %d records, last at %d", "subtask", "n", "last")
    return one_result(
        [
            rows(
                last_types.select("*", replicas.alias("s")),
                "broadcast-proc", "user-modes", "BROADCAST",
                F.col("s"), nothing, F.col("user_id"), F.col("v"),
            ),
            rows(
                config.select("*", replicas.alias("s")),
                "broadcast-proc", "config-state", "BROADCAST",
                F.col("s"), nothing, F.col("k"), F.col("v"),
            ),
            rows(
                buffered(spark, sf_dir),
                "partitioned-list", "partitioned-records", "SPLIT",
                F.col("subtask"), F.col("pos"), nothing, F.col("value"),
            ),
            rows(
                summary, "union-state", "union-records", "UNION",
                F.col("subtask"), F.lit(0), nothing, text,
            ),
        ]
    )


OPERATOR_ENTRIES_SQL = f"""
    SELECT 'broadcast-proc' AS operator_uid, s AS subtask, 'user-modes' AS state_name,
           'BROADCAST' AS mode, CAST(NULL AS BIGINT) AS pos,
           CAST(user_id AS VARCHAR) AS key, v AS value
    FROM (SELECT user_id, arg_max(event_type, event_id) AS v FROM events GROUP BY 1),
         range({SUBTASKS}) AS r(s)
    UNION ALL
    SELECT 'broadcast-proc', s, 'config-state', 'BROADCAST', NULL, k, v
    FROM (SELECT k, arg_max(v, seq) AS v FROM ({SETTINGS_SQL}) GROUP BY k),
         range({SUBTASKS}) AS r(s)
    UNION ALL
    SELECT 'partitioned-list', subtask, 'partitioned-records', 'SPLIT', pos, NULL, value
    FROM ({BUFFERED_SQL})
    UNION ALL
    SELECT 'union-state', event_id % {SUBTASKS}, 'union-records', 'UNION', 0, NULL,
           concat('subtask-', event_id % {SUBTASKS}, ': ', count(*), ' records, last at ',
                  max(event_id))
    FROM events GROUP BY event_id % {SUBTASKS}
"""


# Pins: one per order.


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        F.format_string("%08d", key).alias("id"),
        F.concat(
            F.lit("s3://state/job-"), F.col("o_custkey"), F.lit("/chk-"), key % 10
        ).alias("source_path"),
        F.concat(F.lit("/pins/"), key).alias("pin_path"),
        F.col("o_orderdate").alias("cached_at"),
        cents("o_totalprice").alias("size_bytes"),
    )


PINS_SQL = """
    SELECT printf('%08d', o_orderkey) AS id,
           concat('s3://state/job-', o_custkey, '/chk-', o_orderkey % 10) AS source_path,
           concat('/pins/', o_orderkey) AS pin_path, o_orderdate AS cached_at,
           CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes
    FROM orders
"""
