"""Streams over ``events`` and the state they leave behind.

The table is fed in two slices, all events before the first cut and then the
rest, so that batch 0 and batch 1 of every checkpoint are known states.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stateglass import views
from stateglass.functions.text import map_text
from stateglass.operators.diff import diff_summary, field_changes
from stateglass.operators import reports
from stateglass.plans.assembly import CATEGORY_SQL
from stateglass.plans.diffs import SUMMARY_SQL
from stateglass.plans.memo import once
from stateglass.plans.operator_state import ENRICHED_SQL, SUBTASK_SQL
from stateglass.plans.ordering import AVERAGE_SQL
from stateglass.plans.registry import query
from stateglass.plans.tables import (
    BEFORE,
    BUFFERED_SQL,
    RECENT_SQL,
    SETTINGS,
    SETTINGS_SQL,
    load,
    settings,
)
from stateglass.session import streaming_session, work_dir
from stateglass.sources import catalog, snapshots as s, state as st
from stateglass.streaming import changes, jobs
from stateglass.streaming.enrich import enrich_into


def few_partitions(spark):
    """State partitions for streams over the test tables: no more than there are cores."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(wanted, spark.sparkContext.defaultParallelism)


def slices(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    at = F.lit(BEFORE).cast("timestamp_ntz")
    early = F.coalesce(F.col("ts") < at, F.lit(False))
    return events.filter(early), events.filter(~early)


def run_slices(spark, sf_dir, label, run, parts=None, **options):
    """A checkpoint over the slices, one batch each.

    ``run`` takes the stream, a folder to work in and the checkpoint.
    """

    def build():
        session = streaming_session(spark, few_partitions(spark))
        for name, value in options.items():
            session.conf.set(f"spark.sql.streaming.{name}", str(value))
        base = work_dir(spark, "streams")
        source, checkpoint = f"{base}/input", f"{base}/jobs/{label}"
        for part in parts or slices(spark, sf_dir):
            part.write.mode("append").parquet(source)
            run(session.readStream.schema(part.schema).parquet(source), f"{base}/work", checkpoint)
        return checkpoint

    return once(spark, sf_dir, label, build)


def single(frame):
    """A runner for a job that is one frame."""
    return lambda stream, _, checkpoint: jobs.run_available(frame(stream), checkpoint)


def keyed(spark, sf_dir):
    return run_slices(spark, sf_dir, "keyed", jobs.keyed_state)


def buffer(spark, sf_dir):
    return run_slices(spark, sf_dir, "buffer", jobs.recent_buffer)


def union(spark, sf_dir):
    return run_slices(spark, sf_dir, "union", single(jobs.union_summary))


def aggregates(spark, sf_dir):
    return run_slices(spark, sf_dir, "aggregates", single(jobs.value_aggregates))


def config(spark, sf_dir):
    early = F.coalesce(F.col("ts") < F.lit(BEFORE).cast("timestamp_ntz"), F.lit(False))
    entry = F.concat("k", F.lit("="), "v").alias("entry")
    rows = settings(spark, sf_dir)
    parts = [rows.filter(cut).select(entry, "seq") for cut in (early, ~early)]
    return run_slices(spark, sf_dir, "config", single(jobs.config_upserts), parts)


def user_state(spark, sf_dir, name, batch_id=None, flatten=False):
    rows = st.read_keyed_state(spark, keyed(spark, sf_dir), name, batch_id, flatten=flatten)
    return rows.select("key.user_id", *[c for c in rows.columns if c != "key"])


# Catalog of the checkpoints.


STATES = ("category_counts", "event_count", "last_category", "recent_values", "running_average")


@query(
    "s3_operator_catalog",
    f"""
    SELECT '0' AS uid, '{",".join(STATES)}' AS keyed_states, count(*) AS n_keys
    FROM (SELECT DISTINCT user_id FROM events)
    """,
)
def operator_catalog(spark, sf_dir):
    """The operator of the keyed stream, its states and the keys it holds."""
    found = st.operators_with_counts(spark, keyed(spark, sf_dir))
    return found.select("uid", F.array_join("keyed_states", ",").alias("keyed_states"), "n_keys")


@query(
    "s3_state_variables",
    """
    SELECT state_name, state_type, (SELECT count(DISTINCT user_id) FROM events) AS n_keys
    FROM (VALUES
        ('category_counts', 'MapState'), ('event_count', 'ValueState'),
        ('last_category', 'ValueState'), ('recent_values', 'ListState'),
        ('running_average', 'ValueState')
    ) AS t(state_name, state_type)
    """,
)
def state_variables(spark, sf_dir):
    """The states of the keyed stream and the keys each holds."""
    checkpoint = keyed(spark, sf_dir)
    entries = views.snapshot_entries(spark, checkpoint).groupBy("state_name").agg(F.count_distinct("key").alias("n_keys"))
    found = catalog.state_variables(spark, checkpoint).select("state_name", "state_type")
    return found.join(entries, "state_name", "left")


@query(
    "a4_stream_operators",
    """
    SELECT 'keyed' AS path, '0(keyed)' AS operators, count(DISTINCT user_id) AS n_entries FROM events
    """,
)
def stream_operators(spark, sf_dir):
    """The operators of a stream as text, and the keys they hold."""
    found = st.operators_with_counts(spark, keyed(spark, sf_dir)).withColumn("path", F.lit("keyed"))
    total = found.agg(F.sum("n_keys").alias("n"))
    return reports.operator_summary(found.drop("n_keys")).withColumn("n_entries", total.scalar())


# Keyed state of the stateful processor.


@query("s4_value_state", "SELECT user_id, count(*) AS value FROM events GROUP BY user_id")
def value_state(spark, sf_dir):
    return user_state(spark, sf_dir, "event_count")


@query(
    "s4_value_state_at_batch",
    f"SELECT user_id, count(*) AS value FROM events WHERE ts < TIMESTAMP '{BEFORE}' GROUP BY 1",
)
def value_state_at_batch(spark, sf_dir):
    return user_state(spark, sf_dir, "event_count", batch_id=0)


@query("s4_list_state", f"SELECT user_id, pos, value FROM ({RECENT_SQL})")
def list_state(spark, sf_dir):
    lists = user_state(spark, sf_dir, "recent_values")
    return lists.select("user_id", F.posexplode("value").alias("pos", "value")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query("s4_map_state", CATEGORY_SQL)
def map_state(spark, sf_dir):
    return user_state(spark, sf_dir, "category_counts", flatten=True)


@query(
    "s4_map_state_whole",
    f"""
    SELECT user_id, string_agg(concat(map_key, '=', value), ',' ORDER BY map_key) AS counts
    FROM ({CATEGORY_SQL}) GROUP BY user_id
    """,
)
def map_state_whole(spark, sf_dir):
    maps = user_state(spark, sf_dir, "category_counts")
    return maps.select("user_id", map_text(F.col("value")).alias("counts"))


@query(
    "t1_keyed_processor",
    f"""
    SELECT s.user_id, s.event_count, s.last_category, a.running_average, r.recent_values,
           c.category_counts
    FROM (SELECT user_id, count(*) AS event_count, arg_max(event_type, event_id) AS last_category
          FROM events GROUP BY user_id) s
    JOIN ({AVERAGE_SQL}) a ON s.user_id = a.user_id
    JOIN (SELECT user_id, string_agg(value, ',' ORDER BY pos) AS recent_values
          FROM ({RECENT_SQL}) GROUP BY user_id) r ON s.user_id = r.user_id
    JOIN (SELECT user_id,
                 string_agg(concat(map_key, '=', value), ',' ORDER BY map_key) AS category_counts
          FROM ({CATEGORY_SQL}) GROUP BY user_id) c ON s.user_id = c.user_id
    """,
)
def keyed_processor(spark, sf_dir):
    """All five states of the processor in one row per user."""
    return st.read_all_states(spark, keyed(spark, sf_dir)).select(
        "key.user_id",
        "event_count",
        "last_category",
        F.round("running_average", 6).alias("running_average"),
        F.array_join("recent_values", ",").alias("recent_values"),
        map_text(F.col("category_counts")).alias("category_counts"),
    )


@query("t2_buffer_processor", f"SELECT subtask, pos, value FROM ({BUFFERED_SQL})")
def buffer_processor(spark, sf_dir):
    lists = st.read_keyed_state(spark, buffer(spark, sf_dir), "partitioned_records")
    return lists.select("key.subtask", F.posexplode("value").alias("pos", "value")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query("t3_union_summary", SUBTASK_SQL)
def union_summary(spark, sf_dir):
    fields = ["n_records", "last_time"]
    return st.read_aggregation_state(spark, union(spark, sf_dir), fields).select("key.*", *fields)


@query("t4_config_upserts", f"SELECT k, arg_max(v, seq) AS v FROM ({SETTINGS_SQL}) GROUP BY k")
def config_upserts(spark, sf_dir):
    stored = st.read_aggregation_state(spark, config(spark, sf_dir), ["v", "seq"])
    return stored.select("key.k", "v")


CENTS = "CAST(round(value * 100) AS BIGINT)"


@query(
    "t5_aggregating_state",
    f"""
    SELECT user_id, CAST(sum({CENTS}) AS BIGINT) AS total_cents,
           CAST(sum({CENTS}) AS DOUBLE) AS average_sum, count(*) AS average_count
    FROM events GROUP BY user_id
    """,
)
def aggregating_state(spark, sf_dir):
    fields = ["total_cents", "average_sum", "average_count"]
    return st.read_aggregation_state(spark, aggregates(spark, sf_dir), fields).select("key.*", *fields)


@query(
    "s5_reduced_values",
    f"""
    SELECT user_id, CAST(sum({CENTS}) AS DOUBLE) / count(*) AS average_cents
    FROM events WHERE ts < TIMESTAMP '{BEFORE}' GROUP BY user_id
    """,
)
def reduced_values(spark, sf_dir):
    """The result of an aggregation from its accumulator, at the first batch."""
    fields = ["total_cents", "average_sum", "average_count"]
    stored = st.read_aggregation_state(spark, aggregates(spark, sf_dir), fields, batch_id=0)
    return stored.select(
        "key.user_id", (F.col("average_sum") / F.col("average_count")).alias("average_cents")
    )


@query("t6_stream_enrichment", ENRICHED_SQL)
def stream_enrichment(spark, sf_dir):
    def run():
        session = streaming_session(spark, few_partitions(spark))
        base = work_dir(spark, "enrich")
        settled = config(spark, sf_dir)
        for part in slices(spark, sf_dir):
            part.write.mode("append").parquet(f"{base}/input")
            stream = session.readStream.schema(part.schema).parquet(f"{base}/input")
            write = enrich_into(settled, f"{base}/output", SETTINGS)
            records = stream.select("event_id", "user_id")
            jobs.run_available(records, f"{base}/checkpoint", "append", write)
        return f"{base}/output"

    return spark.read.parquet(once(spark, sf_dir, "enrich", run)).drop("batch")


@query(
    "t7_batch_changes",
    f"""
    SELECT user_id, CASE WHEN old_count IS NULL THEN 'ADDED' ELSE 'MODIFIED' END AS status,
           old_count, new_count
    FROM (SELECT user_id, nullif(count(*) FILTER (ts < TIMESTAMP '{BEFORE}'), 0) AS old_count,
                 count(*) AS new_count, count(*) FILTER (ts >= TIMESTAMP '{BEFORE}') AS n_later
          FROM events GROUP BY 1)
    WHERE n_later > 0
    """,
)
def batch_changes(spark, sf_dir):
    found = changes.batch_changes(spark, keyed(spark, sf_dir), "event_count", 0, 1)
    return found.select(
        "key.user_id",
        "status",
        F.col("left.value").alias("old_count"),
        F.col("right.value").alias("new_count"),
    )


def changed_sql(state: str) -> str:
    """Totals of a state: it changes with any new event, the category with some."""
    same = "last_before = last_after" if state == "last_category" else "n_later = 0"
    return f"""
    SELECT '{state}' AS state_name, {SUMMARY_SQL} FROM (
        SELECT CASE WHEN n_before = 0 THEN 'ADDED' WHEN {same} THEN 'UNCHANGED'
                    ELSE 'MODIFIED' END AS status
        FROM (SELECT count(*) FILTER (ts < TIMESTAMP '{BEFORE}') AS n_before,
                     count(*) FILTER (ts >= TIMESTAMP '{BEFORE}') AS n_later,
                     arg_max(event_type, event_id) FILTER (ts < TIMESTAMP '{BEFORE}') AS last_before,
                     arg_max(event_type, event_id) AS last_after
              FROM events GROUP BY user_id))
    """


@query(
    "j6_checkpoint_diff",
    " UNION ALL ".join(changed_sql(state) for state in STATES),
)
def checkpoint_diff(spark, sf_dir):
    """All states of the stream at batch 0 against batch 1, totals per state."""
    checkpoint = keyed(spark, sf_dir)
    found = views.compare(spark, f"{checkpoint}/offsets/0", f"{checkpoint}/offsets/1")
    return diff_summary(found, ["state_name"])


@query(
    "j6_checkpoint_field_changes",
    f"""
    WITH states AS (
        SELECT user_id, count(*) FILTER (ts < TIMESTAMP '{BEFORE}') AS n_before, count(*) AS n_after,
               arg_max(event_type, event_id) FILTER (ts < TIMESTAMP '{BEFORE}') AS last_before,
               arg_max(event_type, event_id) AS last_after
        FROM events GROUP BY user_id)
    SELECT user_id, 'event_count' AS field_name, CAST(n_before AS VARCHAR) AS old_value,
           CAST(n_after AS VARCHAR) AS new_value
    FROM states WHERE n_before > 0 AND n_before <> n_after
    UNION ALL
    SELECT user_id, 'last_category', concat('"', last_before, '"'), concat('"', last_after, '"')
    FROM states WHERE n_before > 0 AND last_before <> last_after
    """,
)
def checkpoint_field_changes(spark, sf_dir):
    """Changed fields per key between two batches, of the states that hold one value."""
    checkpoint = keyed(spark, sf_dir)
    found = views.compare_operator(spark, f"{checkpoint}/offsets/0", f"{checkpoint}/offsets/1")
    changes = field_changes(found).filter(F.col("field_name").isin("event_count", "last_category"))
    return changes.select("key.user_id", "field_name", "old_value", "new_value")


@query(
    "s4_inspect_page",
    """
    SELECT 'event_count' AS state_name, concat('{"user_id":', user_id, '}') AS key,
           CAST(count(*) AS VARCHAR) AS value
    FROM events WHERE starts_with(CAST(user_id AS VARCHAR), '1')
    GROUP BY user_id ORDER BY key LIMIT 100000
    """,
)
def inspect_page(spark, sf_dir):
    """Entries whose key text contains a filter, as one page."""
    rows = views.inspect(
        spark, keyed(spark, sf_dir), "0", "event_count", '"user_id":1', limit=100_000
    )
    return rows.select("state_name", "key", "value")


@query(
    "t8_retained_snapshots",
    """
    SELECT concat('chk-', n) AS snapshot, true AS valid,
           CAST((SELECT count(*) FROM events WHERE coalesce(dayofmonth(ts) % 6, 0) <= n) AS BIGINT) AS n_records
    FROM range(3, 6) AS t(n)
    """,
)
def retained_snapshots(spark, sf_dir):
    """Six batches of which two are to be kept before the last: what is still found, and its state."""
    events = load(spark, sf_dir, "events")
    parts = [events.filter(F.coalesce(F.dayofmonth("ts") % 6, F.lit(0)) == i) for i in range(6)]
    checkpoint = run_slices(
        spark, sf_dir, "retained", single(jobs.union_summary), parts, minBatchesToRetain=2
    )
    base = checkpoint.rsplit("/", 1)[0]
    found = s.discover_snapshots(spark, base, "streaming").filter("job_id = 'retained'").select("snapshot", "valid")
    states = []
    for row in found.collect():  # as many as are retained
        batch = int(row["snapshot"].removeprefix("chk-"))
        stored = st.read_aggregation_state(spark, checkpoint, ["n_records", "last_time"], batch_id=batch)
        states.append(stored.groupBy().agg(F.sum("n_records").alias("n_records")).withColumn("snapshot", F.lit(row["snapshot"])))
    return found.join(reduce(DataFrame.unionByName, states), "snapshot")
