"""Scalar functions over whole columns."""

from pyspark.sql import functions as F, types as T

from stateglass.functions import naming as n, payload as p, text as t
from stateglass.plans.registry import query
from stateglass.plans.tables import LISTING_SQL, SETTINGS_SQL, listing, load, settings
from stateglass.streaming.summaries import epoch_millis


@query("f1_short_job_id", f"SELECT path, substr(job_id, 1, 8) AS short_id FROM ({LISTING_SQL})")
def short_job_id(spark, sf_dir):
    return listing(spark, sf_dir).select("path", n.short_job_id(F.col("job_id")).alias("short_id"))


@query(
    "f2_display_name",
    f"SELECT path, concat(substr(job_id, 1, 8), '/', snapshot) AS display_name FROM ({LISTING_SQL})",
)
def display_name(spark, sf_dir):
    name = n.display_name(F.col("path"), F.col("job_id"))
    return listing(spark, sf_dir).select("path", name.alias("display_name"))


@query(
    "f3_iso_time",
    """
    SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'),
           CASE WHEN (epoch_us(ts) // 1000) % 1000 = 0 THEN '' ELSE printf('.%03d', (epoch_us(ts) // 1000) % 1000) END,
           'Z') AS iso_time
    FROM events
    """,
)
def iso_time(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        "event_id", n.iso_time(epoch_millis(F.col("ts"))).alias("iso_time")
    )


@query("f4_snapshot_type", f"SELECT path, type FROM ({LISTING_SQL})")
def snapshot_type(spark, sf_dir):
    return listing(spark, sf_dir).select("path", n.snapshot_type(F.col("snapshot")).alias("type"))


@query(
    "f5_last_segment",
    """
    SELECT page_id, string_split(replace(url, '\\', '/'), '/')[-1] AS segment FROM pages
    """,
)
def last_segment(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", n.last_segment(F.col("url")).alias("segment"))


@query(
    "f6_snapshot_label",
    f"""
    SELECT path, snapshot AS label FROM ({LISTING_SQL})
    UNION ALL
    SELECT url, CASE WHEN string_split(url, '/')[-1] = '' THEN url
                ELSE string_split(url, '/')[-1] END
    FROM pages
    """,
)
def snapshot_label(spark, sf_dir):
    paths = listing(spark, sf_dir).select("path")
    urls = load(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    return paths.unionAll(urls).select("path", n.snapshot_label(F.col("path")).alias("label"))


@query(
    "f7_checkpoint_number",
    f"SELECT path, CASE WHEN type = 'checkpoint' THEN number END AS number FROM ({LISTING_SQL})",
)
def checkpoint_number(spark, sf_dir):
    number = n.checkpoint_number(F.col("snapshot")).alias("number")
    return listing(spark, sf_dir).select("path", number)


@query(
    "f8_uri_parts",
    """
    SELECT url, split_part(rest, '/', 1) AS bucket,
           regexp_replace(CASE WHEN contains(rest, '/')
                               THEN substr(rest, position('/' IN rest) + 1) ELSE '' END,
                          '/$', '') AS key
    FROM (SELECT url, regexp_replace(url, '^https?://', '') AS rest FROM pages)
    """,
)
def uri_parts(spark, sf_dir):
    url = F.col("url")
    return load(spark, sf_dir, "pages").select(
        url, n.uri_bucket(url).alias("bucket"), n.uri_key(url).alias("key")
    )


def documents(spark, sf_dir):
    return load(spark, sf_dir, "documents").withColumn("data", F.col("text").cast("binary"))


HEX_SQL = """
    CASE WHEN octet_length(encode(text)) > 256
         THEN concat(substr(lower(hex(encode(text))), 1, 512), '...')
         ELSE lower(hex(encode(text))) END
"""
BASE64_SQL = "CASE WHEN octet_length(encode(text)) <= 1024 THEN base64(encode(text)) END"


@query("f9_hex_preview", f"SELECT doc_id, {HEX_SQL} AS hex FROM documents")
def hex_preview(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", p.hex_preview(F.col("data")).alias("hex"))


@query("f10_base64_small", f"SELECT doc_id, {BASE64_SQL} AS base64 FROM documents")
def base64_small(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", p.base64_small(F.col("data")).alias("base64"))


@query(
    "f11_raw_envelope",
    f"""
    SELECT doc_id, true AS _raw, concat('not decoded: ', lang) AS _reason,
           CAST(octet_length(encode(text)) AS BIGINT) AS _bytes, {HEX_SQL} AS _hex,
           {BASE64_SQL} AS _base64
    FROM documents
    """,
)
def raw_envelope(spark, sf_dir):
    reason = F.concat(F.lit("not decoded: "), "lang")
    rows = documents(spark, sf_dir).select(
        "doc_id", p.raw_envelope(F.col("data"), reason).alias("raw")
    )
    return rows.select("doc_id", "raw.*").withColumn("_bytes", F.col("_bytes").cast("bigint"))


@query(
    "f12_json_text",
    """
    SELECT event_id, CAST(user_id AS VARCHAR) AS user_json,
           concat('"', event_type, '"') AS type_json,
           concat('{"', event_type, '":', user_id, '}') AS map_json,
           concat('{"user_id":', user_id, ',"event_type":"', event_type, '"}') AS struct_json
    FROM events
    """,
)
def json_text(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    rows = events.select(
        "event_id",
        F.col("user_id").alias("user_json"),
        F.col("event_type").alias("type_json"),
        F.create_map("event_type", "user_id").alias("map_json"),
        F.struct("user_id", "event_type").alias("struct_json"),
    )
    texts = [
        t.json_text(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema if f.name != "event_id"
    ]
    return rows.select("event_id", *texts)


@query(
    "f13_preview",
    """
    SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...')
                   ELSE text END AS preview
    FROM documents
    """,
)
def preview(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", t.preview(F.col("text")).alias("preview"))


@query(
    "f14_truncate",
    """
    SELECT doc_id, CASE WHEN length(text) > 60 THEN concat(substr(text, 1, 57), '...')
                   ELSE text END AS wide,
           substr(text, 1, 3) AS narrow
    FROM documents
    """,
)
def truncate(spark, sf_dir):
    text = F.col("text")
    return load(spark, sf_dir, "documents").select(
        "doc_id", t.truncate(text, 60).alias("wide"), t.truncate(text, 3).alias("narrow")
    )


@query(
    "f15_is_numeric",
    """
    SELECT event_id, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) IS NOT NULL AS value_numeric,
           TRY_CAST(event_type AS DOUBLE) IS NOT NULL AS type_numeric,
           TRY_CAST(concat('-', user_id, '.5e2') AS DOUBLE) IS NOT NULL AS text_numeric
    FROM events
    """,
)
def is_numeric(spark, sf_dir):
    text = F.concat(F.lit("-"), "user_id", F.lit(".5e2"))
    return load(spark, sf_dir, "events").select(
        "event_id",
        t.is_numeric_text(F.col("value").cast("string")).alias("value_numeric"),
        t.is_numeric_text(F.col("event_type")).alias("type_numeric"),
        t.is_numeric_text(text).alias("text_numeric"),
    )


@query(
    "f16_human_bytes",
    """
    SELECT doc_id, size, CASE WHEN size < 1024 THEN concat(size, ' B')
           WHEN size < 1048576 THEN printf('%.1f KB', round(size / 1024.0::DOUBLE, 1))
           ELSE printf('%.1f MB', round(size / 1048576.0::DOUBLE, 1)) END AS shown
    FROM (SELECT doc_id, n_chars * doc_id AS size FROM documents)
    """,
)
def human_bytes(spark, sf_dir):
    sizes = load(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * F.col("doc_id")).alias("size"))
    return sizes.withColumn("shown", t.human_bytes(F.col("size")))


@query(
    "f18_config_entry",
    f"SELECT seq, k, v FROM ({SETTINGS_SQL}) WHERE k <> 'mode'",
)
def config_entry(spark, sf_dir):
    """Texts ``k=v``; those of ``mode`` are written without ``=`` and drop out."""
    sep = F.when(F.col("k") == "mode", " ").otherwise("=")
    entry = settings(spark, sf_dir).select("seq", F.concat("k", sep, "v").alias("entry"))
    rows = entry.select(
        "seq", t.config_key(F.col("entry")).alias("k"), t.config_value(F.col("entry")).alias("v")
    )
    return rows.filter(F.col("k").isNotNull())


@query(
    "f19_entry_text",
    """
    SELECT event_id, concat(user_id, ':', event_type, '=', printf('%.2f', value)) AS entry FROM events
    """,
)
def entry_text(spark, sf_dir):
    entry = t.entry_text(F.col("user_id"), F.col("event_type"), F.col("value"))
    return load(spark, sf_dir, "events").select("event_id", entry.alias("entry"))


@query(
    "f20_string_keys",
    "SELECT event_id, concat(user_id, '=', event_type) AS entries FROM events",
)
def string_keys(spark, sf_dir):
    mapping = t.string_keys(F.create_map("user_id", "event_type"))
    return load(spark, sf_dir, "events").select("event_id", t.map_text(mapping).alias("entries"))


@query(
    "f21_cell_text",
    """
    SELECT event_id, coalesce(CAST(CASE WHEN event_id % 3 > 0 THEN user_id END AS VARCHAR), '') AS plain,
           CASE WHEN event_id % 2 = 0 THEN concat('{"u":', user_id, ',"t":"', event_type, '"}')
                ELSE '' END AS nested
    FROM events
    """,
)
def cell_text(spark, sf_dir):
    pair = F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t"))
    rows = load(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 > 0, F.col("user_id")).alias("plain"),
        F.when(F.col("event_id") % 2 == 0, pair).alias("nested"),
    )
    nested = rows.schema["nested"].dataType
    return rows.select(
        "event_id",
        t.cell_text(F.col("plain"), T.LongType()).alias("plain"),
        t.cell_text(F.col("nested"), nested).alias("nested"),
    )
