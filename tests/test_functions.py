from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F, types as T

from stateglass.functions import naming as n, payload as p, text as t


def one(spark, value, build, dtype="string"):
    return spark.createDataFrame([(value,)], f"c {dtype}").select(build(F.col("c"))).first()[0]


@pytest.mark.parametrize("value, expected", [("abcdef1234567890", "abcdef12"), ("abc", "abc"), (None, None)])
def test_short_job_id(spark, value, expected):
    assert one(spark, value, n.short_job_id) == expected


@pytest.mark.parametrize(
    "path, job, expected",
    [("/s/abc/chk-42", "abcdef1234567890", "abcdef12/chk-42"), ("/s/chk-1", None, "chk-1"),
     ("C:\\s\\chk-7", "j", "j/chk-7")],
)
def test_display_name(spark, path, job, expected):
    row = spark.createDataFrame([(path, job)], "p string, j string")
    assert row.select(n.display_name(F.col("p"), F.col("j"))).first()[0] == expected


@pytest.mark.parametrize("millis", [1718000000000, 1718000000120, 0, -1, 253402300799999, -62135596800000])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_iso_time(spark, millis, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = one(spark, millis, n.iso_time, "bigint")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    moment = datetime.fromtimestamp(millis // 1000, timezone.utc)
    fraction = f".{millis % 1000:03d}" if millis % 1000 else ""
    assert found == f"{moment.year:04d}{moment.strftime('-%m-%dT%H:%M:%S')}{fraction}Z"


@pytest.mark.parametrize(
    "path, expected", [("a/b/c", "c"), ("a\\b", "b"), ("c", "c"), ("a/", ""), (None, "unknown")]
)
def test_last_segment(spark, path, expected):
    assert one(spark, path, n.last_segment) == expected


@pytest.mark.parametrize(
    "path, expected",
    [("s3://b/job/chk-12/x", "chk-12"), ("/x/savepoint-a1b/", "savepoint-a1b"), ("/x/other", "other"), ("/x/", "/x/")],
)
def test_snapshot_label(spark, path, expected):
    assert one(spark, path, n.snapshot_label) == expected


@pytest.mark.parametrize("name, expected", [("chk-42", 42), ("savepoint-1", None), ("chk-", None)])
def test_checkpoint_number(spark, name, expected):
    assert one(spark, name, n.checkpoint_number) == expected


@pytest.mark.parametrize(
    "uri, bucket, key",
    [("s3://b/k/x/", "b", "k/x"), ("s3a://b/k", "b", "k"), ("gs://b", "b", ""), ("gs://b/", "b", "")],
)
def test_uri_parts(spark, uri, bucket, key):
    assert (one(spark, uri, n.uri_bucket), one(spark, uri, n.uri_key)) == (bucket, key)


@pytest.mark.parametrize("name, kind", [("savepoint-x", "savepoint"), ("chk-1", "checkpoint")])
def test_snapshot_type(spark, name, kind):
    assert one(spark, name, n.snapshot_type) == kind


@pytest.mark.parametrize(
    "name, keyed, operator, entries, expected",
    [("n", ["k"], [], 5, "n (has data)"), ("n", ["k"], ["a", "b"], 0, "n (empty + a, b)"),
     ("", ["k"], [], -1, "0123456789ab... (keyed)"), ("n", [], [], -1, "n")],
)
def test_operator_label(spark, name, keyed, operator, entries, expected):
    schema = "n string, u string, k array<string>, o array<string>, e bigint"
    row = spark.createDataFrame([(name, "0123456789abcdef", keyed, operator, entries)], schema)
    label = n.operator_label(*[F.col(c) for c in "nukoe"])
    assert row.select(label).first()[0] == expected


def test_hex_is_cut(spark):
    found = one(spark, bytearray.fromhex("0102030405"), lambda c: p.hex_preview(c, 3), "binary")
    assert found == "010203..."
    assert one(spark, bytearray.fromhex("CAFE"), p.hex_preview, "binary") == "cafe"


def test_envelope(spark):
    build = lambda c: p.raw_envelope(c, F.lit("why"))
    small = one(spark, bytearray.fromhex("cafebabe"), build, "binary")
    assert tuple(small) == (True, "why", 4, "cafebabe", "yv66vg==")
    large = one(spark, bytearray(2048), build, "binary")
    assert large["_base64"] is None and large["_hex"] == "00" * 256 + "..." and large["_bytes"] == 2048
    assert one(spark, None, build, "binary") is None
    long = one(spark, bytearray(100), p.base64_small, "binary")
    assert "\n" not in long and "\r" not in long


@pytest.mark.parametrize(
    "value, dtype, expected",
    [("a\"b", "string", '"a\\"b"'), (None, "string", None), (1.5, "double", "1.5"), (True, "boolean", "true"),
     ([1, 2], "array<int>", "[1,2]"), ((1, None), "struct<a:int,b:string>", '{"a":1,"b":null}'),
     ({"b": 1, "a": 2}, "map<string,int>", '{"a":2,"b":1}'), (None, "map<string,int>", None)],
)
def test_json_text(spark, value, dtype, expected):
    data_type = T._parse_datatype_string(dtype)
    assert one(spark, value, lambda c: t.json_text(c, data_type), dtype) == expected


def test_cell_text(spark):
    assert one(spark, None, lambda c: t.cell_text(c, T.StringType())) == ""
    assert one(spark, "x", lambda c: t.cell_text(c, T.StringType())) == "x"
    array = T.ArrayType(T.IntegerType())
    assert one(spark, [1], lambda c: t.cell_text(c, array), "array<int>") == "[1]"


@pytest.mark.parametrize(
    "width, expected", [(10, "abcdefgh"), (8, "abcdefgh"), (7, "abcd..."), (3, "abc"), (2, "ab")]
)
def test_truncate(spark, width, expected):
    assert one(spark, "abcdefgh", lambda c: t.truncate(c, width)) == expected


def test_preview(spark):
    assert one(spark, "x" * 200, t.preview) == "x" * 200
    assert one(spark, "x" * 201, t.preview) == "x" * 200 + "..."


@pytest.mark.parametrize(
    "text, expected",
    [("1", True), ("-2.5e3", True), ("abc", False), ("", False), ("inf", False), ("NaN", True), (None, False)],
)
def test_is_numeric(spark, text, expected):
    assert bool(one(spark, text, t.is_numeric_text)) is expected


@pytest.mark.parametrize(
    "size, expected",
    [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1048576, "1.0 MB"), (5 * 2**30, "5120.0 MB")],
)
def test_human_bytes(spark, size, expected):
    assert one(spark, size, t.human_bytes, "bigint") == expected


@pytest.mark.parametrize("entry, k, v", [("a=b=c", "a", "b=c"), ("a", None, None), ("a=", "a", ""), ("=x", "", "x")])
def test_config_entry(spark, entry, k, v):
    assert (one(spark, entry, t.config_key), one(spark, entry, t.config_value)) == (k, v)


def test_string_keys(spark):
    found = one(spark, {1: "a"}, t.string_keys, "map<int,string>")
    assert found == {"1": "a"}


def test_maps_are_sorted_at_every_depth(spark):
    frame = spark.sql(
        "SELECT named_struct('m', map('b', 2, 'a', 1), 'n', array(map('z', 1, 'y', 2))) AS a, "
        "named_struct('m', map('a', 1, 'b', 2), 'n', array(map('y', 2, 'z', 1))) AS b, "
        "map(named_struct('k', 2), 'x', named_struct('k', 1), 'y') AS c"
    )
    kinds = {f.name: f.dataType for f in frame.schema}
    row = frame.select(*[t.json_text(F.col(c), kinds[c]).alias(c) for c in "abc"]).first()
    assert row["a"] == row["b"] == '{"m":{"a":1,"b":2},"n":[{"y":2,"z":1}]}'
    assert row["c"] == '[{"key":{"k":1},"value":"y"},{"key":{"k":2},"value":"x"}]'
