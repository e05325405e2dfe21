import time

import pytest
from pyspark.sql import functions as F

from stateglass.operators.diff import diff_snapshots
from stateglass.sinks import pins as k
from stateglass.sinks.export import export_json
from stateglass.sources.snapshots import discover_snapshots


@pytest.fixture()
def store(spark, tmp_path):
    return k.PinStore(spark, str(tmp_path / "base"))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(30).select(
        F.concat(F.lit("op"), F.col("id") % 2).alias("operator_id"),
        F.concat(F.lit("st"), F.col("id") % 3).alias("state_name"),
        F.col("id").cast("string").alias("key"),
        (F.col("id") * 2).alias("value"),
    )


def test_pin_and_read(spark, store, rows):
    pin = store.pin_snapshot(rows, "job", "chk-1", "s3://x/chk-1")
    path = store.lookup("s3://x/chk-1")
    back = k.read_pin(spark, path)
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    listed = store.pins().first()
    assert listed["id"] == pin and listed["size_bytes"] > 0
    assert "pin_path" not in k.newest_pins_first(store.pins()).columns
    with pytest.raises(ValueError, match="there is a snapshot"):
        store.pin_snapshot(rows, "job", "chk-1")
    plan = back.filter("operator_id = 'op1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(operator_id" in plan


def test_broken_copy_is_replaced(spark, store, rows):
    path = k.pin_path(store.base, "job", "chk-9")
    rows.limit(3).write.parquet(f"{path}/data")
    assert not discover_snapshots(spark, store.base).first()["valid"]
    with pytest.raises(ValueError, match="no whole snapshot"):
        k.read_pin(spark, path)
    store.pin_snapshot(rows, "job", "chk-9")
    assert k.read_pin(spark, path).count() == 30


def test_lookup_finds_the_newest(store, rows):
    store.pin_snapshot(rows, "job", "chk-1", "src")
    store.pin_snapshot(rows, "job", "chk-2", "src")
    assert store.lookup("src").endswith("/chk-2")
    assert store.lookup("other") is None
    assert k.newest_pins(store.pins()).count() == 1


def test_delete_and_clear(spark, store, rows):
    ids = [store.pin_snapshot(rows, "job", f"chk-{i}") for i in range(3)]
    assert store.delete(ids[1]) is True
    assert store.delete(ids[1]) is False
    assert {r["id"] for r in store.pins().collect()} == {ids[0], ids[2]}
    assert {r["snapshot"] for r in discover_snapshots(spark, store.base).collect()} == {"chk-0", "chk-2"}
    assert store.clear() == 2
    assert store.pins().count() == 0 and discover_snapshots(spark, store.base).count() == 0


def test_oldest_are_evicted(spark, store, rows):
    for i in range(4):
        store.pin_snapshot(rows, "job", f"chk-{i}", max_pins=2)
        time.sleep(0.01)
    assert {r["snapshot"] for r in discover_snapshots(spark, store.base).collect()} == {"chk-2", "chk-3"}
    assert store.pins().count() == 2
    assert k.pin_totals(store.pins()).first()["n_pins"] == 2


def test_export_keeps_nulls(spark, tmp_path):
    path = str(tmp_path / "out")
    export_json(spark.createDataFrame([("a", None)], "key string, value int"), path)
    assert [r[0] for r in spark.read.text(path).collect()] == ['{"key":"a","value":null}']


def test_bucketed_pins_join_without_shuffle(spark, tmp_path):
    left = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("v"))
    right = left.filter("v % 10 <> 0").withColumn("v", F.when(F.col("v") % 7 == 0, 0).otherwise(F.col("v")))
    before = k.pin_to_table(left, "pin_before", str(tmp_path / "b"), buckets=4)
    after = k.pin_to_table(right, "pin_after", str(tmp_path / "a"), buckets=4)
    diff = diff_snapshots(before, after, null_keys=False)
    assert "Exchange" not in diff._jdf.queryExecution().executedPlan().toString()
    direct = diff_snapshots(left, right)
    assert sorted(map(tuple, diff.select("key", "status").collect())) == sorted(
        map(tuple, direct.select("key", "status").collect())
    )
    with pytest.raises(Exception, match="null key"):
        nulls = spark.createDataFrame([(None, 1)], "key string, v int")
        k.pin_to_table(nulls, "pin_nulls", str(tmp_path / "n"), buckets=2)


def test_jobs_may_share_a_snapshot_name_and_no_pin_goes_unasked(spark, tmp_path):
    store = k.PinStore(spark, str(tmp_path))
    for job, n in (("a", 3), ("b", 5)):
        rows = spark.range(n).selectExpr(
            "'op' AS operator_uid", "'keyed' AS state_kind", "'s' AS state_name",
            "string(id) AS key", "'v' AS value", "'op' AS operator_id",
        )
        store.pin_snapshot(rows, job, "chk-1")
    assert store.pins().count() == 2
    found = discover_snapshots(spark, str(tmp_path))
    counts = k.read_snapshots(spark, found).groupBy("job_id", "snapshot").count().collect()
    assert {tuple(r) for r in counts} == {("a", "chk-1", 3), ("b", "chk-1", 5)}
    store.pin_snapshot(rows, "c", "chk-1", max_pins=1)
    assert store.pins().count() == 1


def entries(spark, n, value="v"):
    return spark.range(n).selectExpr(
        "'op' AS operator_uid", "'keyed' AS state_kind", "string(id % 2 + 1) AS state_name",
        "string(id) AS key", f"'{value}' AS value", "'0' AS operator_id",
    )


def test_many_pins_are_one_scan(spark, tmp_path):
    store = k.PinStore(spark, str(tmp_path / "data" / "a b%+é"))
    for i in range(3):
        store.pin_snapshot(entries(spark, i + 1, f"v{i}"), f"job {i}%+", f"chk-{i}")
    entries(spark, 9).write.parquet(str(tmp_path / "data" / "a b%+é" / "job" / "chk-9" / "data"))
    found = discover_snapshots(spark, store.base)
    assert found.count() == 4
    rows = k.read_snapshots(spark, found)
    assert {tuple(r) for r in rows.groupBy("path", "job_id", "snapshot", "value").count().select("job_id", "snapshot", "value", "count").collect()} == {
        (f"job {i}%+", f"chk-{i}", f"v{i}", i + 1) for i in range(3)
    }
    assert rows.schema["state_name"].dataType.typeName() == rows.schema["operator_id"].dataType.typeName() == "string"
    plan = rows.filter("state_name = '1'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan
    newest = k.read_snapshots(spark, found, limit=1)
    assert newest.select("snapshot").distinct().count() == 1


def test_no_whole_snapshot_gives_no_rows(spark, tmp_path):
    found = discover_snapshots(spark, str(tmp_path))
    rows = k.read_snapshots(spark, found)
    assert rows.count() == 0 and {"path", "job_id", "snapshot", "key", "value"} <= set(rows.columns)


def test_names_of_states_stay_text(spark, store):
    rows = entries(spark, 4).withColumn("state_name", F.concat(F.lit("0"), "state_name"))
    store.pin_snapshot(rows, "job", "chk-1", "src")
    back = k.read_pin(spark, store.lookup("src"))
    assert {r["state_name"] for r in back.collect()} == {"01", "02"}


def test_two_writers_lose_no_pin(spark, tmp_path, monkeypatch):
    """Both read the same list; the slower one makes its change again on the newer."""
    first, second = (k.PinStore(spark, str(tmp_path)) for _ in range(2))
    first.pin_snapshot(entries(spark, 1), "job", "chk-0")
    make, raced = k.create_new, []

    def slow(session, path, text):
        if path.endswith("v1.done") and not raced:
            raced.append(path)
            second.pin_snapshot(entries(spark, 2), "job", "chk-2")
        return make(session, path, text)

    monkeypatch.setattr(k, "create_new", slow)
    first.pin_snapshot(entries(spark, 1), "job", "chk-1")
    assert raced and first.pins().count() == second.pins().count() == 3
    assert k.read_snapshots(spark, discover_snapshots(spark, str(tmp_path))).count() == 4


def test_writers_at_the_same_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def pin(i):
        return k.PinStore(spark, str(tmp_path)).pin_snapshot(entries(spark, 1), "job", f"chk-{i}")

    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(pin, range(4)))
    assert {r["id"] for r in k.PinStore(spark, str(tmp_path)).pins().collect()} == set(ids)


def test_report_of_what_could_not_be_read(spark, tmp_path):
    from stateglass import views

    typed = {
        "plain": spark.range(3).selectExpr("id AS key", "id * 2 AS n"),
        "opaque": spark.createDataFrame(
            [(1, b"\x00\x00\x00\x05hello\x00\x00\x00\x03abc", 1), (2, b"\xff", None), (3, None, 2)], "key long, p binary, n int"
        ),
    }
    store = k.PinStore(spark, str(tmp_path))
    store.pin_snapshot(entries(spark, 3), "job", "chk-1", "src", typed=typed)
    found = {r["operator_uid"]: tuple(r)[1:] for r in views.inspect_report(spark, store.lookup("src")).collect()}
    assert found["plain"] == (3, 0, "", False)
    assert found["opaque"][0] == 4 and found["opaque"][1] == 1 and found["opaque"][3] is True
    assert views.inspect_report(spark, store.lookup("src"), "none").count() == 0
