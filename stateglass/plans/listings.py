"""Snapshot listings and operator catalogs."""

from pyspark.sql import functions as F

from stateglass.functions.naming import operator_label
from stateglass.operators import order, paging, reports
from stateglass.operators.selection import desc
from stateglass.plans.registry import query
from stateglass.plans.tables import LISTING_SQL, OPERATORS_SQL, listing, operators
from stateglass.sources import catalog, snapshots as s

COLUMNS = "path, job_id, snapshot, type, modification_time, valid"
NEWEST, PER_JOB = 20, 3


def shown(rows):
    return rows.drop("number")


@query(
    "o1_newest_first",
    f"SELECT {COLUMNS} FROM ({LISTING_SQL}) ORDER BY modification_time DESC, path LIMIT {NEWEST}",
)
def newest_first(spark, sf_dir):
    return paging.newest_first(shown(listing(spark, sf_dir)), "modification_time", "path", NEWEST)


@query(
    "o3_top_per_job",
    f"""
    SELECT {COLUMNS}, pos FROM (
        SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY modification_time DESC) AS pos
        FROM ({LISTING_SQL}))
    WHERE pos <= {PER_JOB}
    """,
)
def top_per_job(spark, sf_dir):
    newest = [desc("modification_time"), "path"]
    rows = paging.top_per_group(shown(listing(spark, sf_dir)), ["job_id"], newest, PER_JOB)
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


SORTS = {
    "type": "type",
    "job": "job_id",
    "snapshot": "snapshot",
    "time": "modification_time",
}


def _sort_sql(field: str, column: str, direction: str) -> str:
    return f"""
    SELECT '{field}' AS field, '{direction}' AS direction, path,
           row_number() OVER (ORDER BY {column} {direction}, path) AS pos
    FROM ({LISTING_SQL})
    """


@query(
    "o5_snapshot_sorts",
    " UNION ALL ".join(
        _sort_sql(f, c, d) for f, c in SORTS.items() for d in ("ASC", "DESC")
    ),
)
def snapshot_sorts(spark, sf_dir):
    """Every snapshot in each of the eight orders, by one scan and one range partitioning."""
    rows = listing(spark, sf_dir).select("path", *SORTS.values())
    orders = {}
    for field, column in SORTS.items():
        orders[f"{field} ASC"] = [column, "path"]
        orders[f"{field} DESC"] = [desc(column), "path"]
    name = F.split("order", " ")
    return order.index_in_orders(rows, orders, columns=["path"]).select(
        name[0].alias("field"), name[1].alias("direction"), "path", "pos"
    )


@query(
    "a2_snapshot_stats",
    f"""
    SELECT count(*) FILTER (type <> 'savepoint') AS n_checkpoints,
           count(*) FILTER (type = 'savepoint') AS n_savepoints,
           count(DISTINCT job_id) AS n_jobs
    FROM ({LISTING_SQL})
    """,
)
def snapshot_stats(spark, sf_dir):
    return reports.snapshot_stats(listing(spark, sf_dir))


@query("u3_merge_listings", f"SELECT {COLUMNS} FROM ({LISTING_SQL})")
def merge_listings(spark, sf_dir):
    """Checkpoints once more beside all snapshots: each path must come out once."""
    rows = shown(listing(spark, sf_dir))
    return s.merge_listings(rows, s.of_type(rows, "checkpoint"))


@query(
    "p5_snapshot_names",
    """
    SELECT name FROM (
        SELECT CASE event_id % 3 WHEN 0 THEN concat('chk-', event_id)
                    WHEN 1 THEN concat('savepoint-', event_id)
                    ELSE concat('shared-', event_id) END AS name FROM events)
    WHERE starts_with(name, 'chk-') OR starts_with(name, 'savepoint-')
    """,
)
def snapshot_names(spark, sf_dir):
    number = F.col("number")
    prefix = F.when(number % 3 == 0, "chk-").when(number % 3 == 1, "savepoint-").otherwise("shared-")
    names = listing(spark, sf_dir).select(F.concat(prefix, number).alias("name"))
    return s.snapshot_names_only(names, "name")


@query(
    "p6_stateful_only",
    f"SELECT path, uid, name FROM ({OPERATORS_SQL}) WHERE keyed OR operator",
)
def stateful_only(spark, sf_dir):
    return catalog.stateful_only(operators(spark, sf_dir)).select("path", "uid", "name")


@query(
    "p8_operator_kinds",
    f"""
    SELECT path, uid, 'keyed' AS kind FROM ({OPERATORS_SQL}) WHERE keyed
    UNION ALL SELECT path, uid, 'operator' FROM ({OPERATORS_SQL}) WHERE operator
    """,
)
def operator_kinds(spark, sf_dir):
    rows = operators(spark, sf_dir)
    keyed = catalog.with_keyed_state(rows).select("path", "uid", F.lit("keyed").alias("kind"))
    other = catalog.with_operator_state(rows).select("path", "uid", F.lit("operator").alias("kind"))
    return keyed.unionByName(other)


KINDS_SQL = """CASE WHEN keyed AND operator THEN '(keyed,operator[2])' WHEN keyed THEN '(keyed)'
               WHEN operator THEN '(operator[2])' ELSE '' END"""


@query(
    "a4_operator_summary",
    f"""
    SELECT path, string_agg(concat(uid, {KINDS_SQL}), ', ' ORDER BY concat(uid, {KINDS_SQL}))
           AS operators
    FROM ({OPERATORS_SQL}) GROUP BY path
    """,
)
def operator_summary(spark, sf_dir):
    return reports.operator_summary(operators(spark, sf_dir))


@query(
    "a5_operator_details",
    f"""
    SELECT path, count(*) AS n_operators,
           string_agg(concat(uid, '|', name, '|', CASE WHEN keyed THEN 'keyed-state' ELSE '' END,
                             '|', CASE WHEN operator THEN 'buffer,union' ELSE '' END), ';'
                      ORDER BY uid) AS operators
    FROM ({OPERATORS_SQL}) GROUP BY path
    """,
)
def operator_details(spark, sf_dir):
    text = F.transform(
        "operators",
        lambda o: F.concat_ws(
            "|",
            o["uid"],
            o["name"],
            F.array_join(o["keyed_states"], ","),
            F.array_join(o["operator_states"], ","),
        ),
    )
    return reports.operator_details(operators(spark, sf_dir)).select(
        "path",
        F.size("operators").cast("bigint").alias("n_operators"),
        F.array_join(text, ";").alias("operators"),
    )


@query(
    "f17_operator_label",
    f"""
    SELECT path, concat(CASE WHEN name <> '' THEN name ELSE concat(substr(uid, 1, 12), '...') END,
           CASE WHEN keyed AND operator THEN ' (has data + buffer, union)'
                WHEN keyed THEN ' (has data)' WHEN operator THEN ' (buffer, union)'
                ELSE '' END) AS label
    FROM ({OPERATORS_SQL})
    """,
)
def label(spark, sf_dir):
    parts = [F.col(c) for c in ("name", "uid", "keyed_states", "operator_states", "n_entries")]
    return operators(spark, sf_dir).select("path", operator_label(*parts).alias("label"))
