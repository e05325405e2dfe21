"""Filters, projections and pages over long entries."""

from pyspark.sql import functions as F

from stateglass.operators import entries as e, paging
from stateglass.plans.registry import query
from stateglass.plans.tables import (
    AFTER,
    BEFORE,
    entries_at,
    entries_sql,
    load,
    state_at,
    state_sql,
    texts,
)
from stateglass.sources.custom import read_entries, register_sources
from stateglass.sources.storage import hadoop_path, hadoop_path_column, setting_rows, storage_options

ENTRIES = entries_sql(AFTER)
COLUMNS = "operator_uid, state_kind, state_name, key, value"
ORDER = ["operator_uid", "state_name", "key"]
OFFSET, LIMIT = 100, 200
# '%' and '_' in a filter stand for themselves.
KEY_FILTER = "1:p"


def entries(spark, sf_dir):
    return entries_at(spark, sf_dir, AFTER)


@query("p1_operator_filter", f"SELECT {COLUMNS} FROM ({ENTRIES}) WHERE operator_uid = 'order-totals'")
def operator_filter(spark, sf_dir):
    return e.of_operator(entries(spark, sf_dir), "order-totals")


@query("p2_state_filter", f"SELECT {COLUMNS} FROM ({ENTRIES}) WHERE state_name = 'event_count'")
def state_filter(spark, sf_dir):
    return e.of_state(entries(spark, sf_dir), "event_count")


@query("p3_key_filter", f"SELECT {COLUMNS} FROM ({ENTRIES}) WHERE contains(key, '{KEY_FILTER}')")
def key_filter(spark, sf_dir):
    return e.with_key_text(entries(spark, sf_dir), KEY_FILTER)


@query("p4_keys_only", f"SELECT DISTINCT operator_uid, key FROM ({ENTRIES})")
def keys_only(spark, sf_dir):
    return e.keys_only(entries(spark, sf_dir), ["operator_uid", "key"])


@query("p7_keyed_only", f"SELECT {COLUMNS} FROM ({ENTRIES}) WHERE state_kind = 'keyed'")
def keyed_only(spark, sf_dir):
    return e.keyed_only(entries(spark, sf_dir))


@query(
    "p9_wide_to_long",
    f"""
    SELECT key, 'event_count' AS state_name, coalesce(CAST(event_count AS VARCHAR), '') AS value
    FROM (SELECT coalesce(l.key, r.key) AS key, l.event_count
          FROM ({state_sql(BEFORE)}) l FULL OUTER JOIN ({state_sql(AFTER)}) r ON l.key = r.key)
    UNION ALL
    SELECT key, 'average', coalesce(CAST(average AS VARCHAR), '')
    FROM (SELECT coalesce(l.key, r.key) AS key, r.average
          FROM ({state_sql(BEFORE)}) l FULL OUTER JOIN ({state_sql(AFTER)}) r ON l.key = r.key)
    """,
)
def wide_to_long(spark, sf_dir):
    count = state_at(spark, sf_dir, BEFORE).drop("average")
    average = state_at(spark, sf_dir, AFTER).drop("event_count")
    wide = texts(count.join(average, "key", "full_outer"))
    return e.to_long(wide, ["event_count", "average"])


@query(
    "p10_tagged",
    f"SELECT key, event_count, average, 'event-counter' AS operator_uid, 'keyed' AS state_kind "
    f"FROM ({state_sql(AFTER)})",
)
def tagged(spark, sf_dir):
    return e.tagged(texts(state_at(spark, sf_dir, AFTER)), "event-counter", "keyed")


@query(
    "u6_one_result",
    f"""
    SELECT 'before' AS snapshot, {COLUMNS} FROM ({entries_sql(BEFORE)})
    UNION ALL SELECT 'after', {COLUMNS} FROM ({ENTRIES})
    """,
)
def one_result(spark, sf_dir):
    return e.one_result(
        [
            entries_at(spark, sf_dir, cut).withColumn("snapshot", F.lit(name))
            for name, cut in (("before", BEFORE), ("after", AFTER))
        ]
    )


@query(
    "a3_entry_counts",
    f"SELECT operator_uid, state_name, count(*) AS n_entries FROM ({ENTRIES}) GROUP BY 1, 2",
)
def entry_counts(spark, sf_dir):
    return e.entry_counts(entries(spark, sf_dir))


@query(
    "o2_page",
    f"""
    SELECT {COLUMNS}, pos, (SELECT count(*) FROM ({ENTRIES})) > {OFFSET + LIMIT} AS has_more
    FROM (SELECT *, row_number() OVER (ORDER BY {', '.join(ORDER)}) AS pos FROM ({ENTRIES}))
    WHERE pos > {OFFSET} AND pos <= {OFFSET + LIMIT}
    """,
)
def page(spark, sf_dir):
    return paging.page(entries(spark, sf_dir), ORDER, OFFSET, LIMIT)


@query(
    "o2_page_report",
    f"""
    SELECT greatest(least(n - {OFFSET}, {LIMIT}), 0) AS entry_count,
           n > {OFFSET + LIMIT} AS has_more, CAST({OFFSET} AS BIGINT) AS "offset"
    FROM (SELECT count(*) AS n FROM ({ENTRIES}))
    """,
)
def page_report(spark, sf_dir):
    return paging.page_report(paging.page(entries(spark, sf_dir), ORDER, OFFSET, LIMIT), OFFSET)


@query(
    "o6_numeric_sort",
    """
    SELECT regexp_replace(key, '[0-9]+$', '') AS stem,
           TRY_CAST(regexp_extract(key, '[0-9]+$', 0) AS BIGINT) AS number, key
    FROM (SELECT DISTINCT concat('user-', user_id) AS key FROM events) ORDER BY 1, 2, 3
    """,
)
def numeric_sort(spark, sf_dir):
    """All keys in order; the order itself is checked by the unit tests."""
    users = load(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), "user_id").alias("key")
    ).distinct()
    stem, number, key = paging.numeric_aware(F.col("key"))
    return users.select(stem.alias("stem"), number.alias("number"), key).orderBy("stem", "number", "key")


@query(
    "o8_bounded_read",
    f"""
    SELECT key, event_count, pos, (SELECT count(*) FROM ({state_sql(AFTER)})) > {LIMIT} AS truncated
    FROM (SELECT key, event_count, row_number() OVER (ORDER BY key) AS pos
          FROM ({state_sql(AFTER)}))
    WHERE pos <= {LIMIT}
    """,
)
def bounded_read(spark, sf_dir):
    rows = texts(state_at(spark, sf_dir, AFTER)).drop("average")
    return paging.bounded_read(rows, ["key"], LIMIT)


@query(
    "s11_storage_options",
    """
    SELECT lower(r_name) AS region, setting, CASE WHEN setting = 'path' THEN concat('s3a://bucket-', r_regionkey, '/k')
           WHEN setting = 'fs.s3a.path.style.access' THEN 'true' ELSE lower(r_name) END AS value, n_nations
    FROM (SELECT r_regionkey, r_name, count(*) AS n_nations FROM region JOIN nation ON r_regionkey = n_regionkey
          GROUP BY 1, 2),
         (VALUES ('path'), ('fs.s3a.path.style.access'), ('fs.s3a.endpoint.region')) AS t(setting)
    """,
)
def read_with_options(spark, sf_dir):
    """The settings of each region of a table, made by columns, and a read that carries some."""
    regions = load(spark, sf_dir, "region").select("r_regionkey", F.lower("r_name").alias("region"))
    made = setting_rows(regions, {"aws.region": F.col("region"), "aws.path-style-access": F.lit("true")})
    uri = F.concat(F.lit("s3://bucket-"), "r_regionkey", F.lit("/k"))
    paths = regions.withColumns({"setting": F.lit("path"), "value": hadoop_path_column(uri)})
    carried = storage_options({"aws.region": "eu-west-1", "aws.path-style-access": "true"})
    nations = spark.read.options(**carried).parquet(hadoop_path(f"{sf_dir}/nation.parquet"))
    counts = nations.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n_nations"))
    return made.unionByName(paths).join(counts, "r_regionkey").select("region", "setting", "value", "n_nations")


@query(
    "x3_custom_source",
    """
    SELECT operator_uid, state_kind, state_name, key, arg_max(value, turn) AS value
    FROM (SELECT 'chat' AS operator_uid, 'keyed' AS state_kind, role AS state_name,
                 CAST(conv_id AS VARCHAR) AS key, text AS value, turn
          FROM conversations WHERE role IN ('user', 'assistant'))
    GROUP BY 1, 2, 3, 4
    """,
)
def custom_source(spark, sf_dir):
    """A table read by a registered format; the states are chosen inside the source."""
    register_sources(spark)
    options = {"operator": "chat", "state": "role", "key": "conv_id", "value": "text", "seq": "turn"}
    chats = read_entries(spark, "stateglass-table", f"{sf_dir}/conversations.parquet", **options)
    chosen = chats.filter((F.col("operator_uid") == "chat") & F.col("state_name").isin("user", "assistant"))
    latest = e.last_write_wins(chosen, "seq", ["operator_uid", "state_kind", "state_name", "key"])
    return latest.select("operator_uid", "state_kind", "state_name", "key", "value")
