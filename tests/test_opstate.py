import pytest
from pyspark.sql import functions as F

from stateglass.operators import opstate as o

SCHEMA = "operator_uid string, subtask bigint, state_name string, mode string, pos bigint, key string, value string"


@pytest.fixture(scope="module")
def entries(spark):
    rows = []
    for subtask in (1, 2, 3):
        rows += [("p", subtask, "config", "BROADCAST", None, k, v) for k, v in (("a", "1"), ("b", "2"))]
        rows += [("u", subtask, "union", "UNION", 0, None, f"s{subtask}")]
        rows += [("l", subtask, "list", "SPLIT", i, None, f"{subtask}-{i}") for i in range(2)]
    return spark.createDataFrame(rows, SCHEMA)


def test_broadcast_entries(spark):
    state = spark.sql("select map('configKey1', 100, 'configKey2', 200) as state")
    found = [tuple(r) for r in o.broadcast_entries(state).orderBy("key").collect()]
    assert found == [("configKey1", 100), ("configKey2", 200)]


def test_list_entries(spark):
    state = spark.sql("select array('partition-zero', 'partition-one') as state")
    found = [tuple(r) for r in o.list_entries(state).collect()]
    assert found == [(0, "partition-zero"), (1, "partition-one")]


def test_broadcast_is_read_once(entries):
    found = o.read_operator_state(entries, "config", o.BROADCAST).collect()
    assert sorted((r["subtask"], r["key"]) for r in found) == [(1, "a"), (1, "b")]


def test_union_and_split_keep_every_subtask(entries):
    union = o.read_operator_state(entries, "union", o.UNION)
    assert sorted(r["value"] for r in union.collect()) == ["s1", "s2", "s3"]
    split = o.read_operator_state(entries, "list", o.SPLIT)
    assert split.select("subtask", "pos").distinct().count() == 6
    assert o.union_entries(entries).count() == 3


def test_unknown_mode(entries):
    with pytest.raises(ValueError, match="unknown mode"):
        o.read_operator_state(entries, "config", "REPLICATED")


def test_diverging_replicas(entries):
    broadcast = entries.filter("mode = 'BROADCAST'")
    assert o.diverging_replicas(broadcast).count() == 0
    changed = broadcast.withColumn(
        "value", F.when((F.col("subtask") == 2) & (F.col("key") == "a"), "9").otherwise(F.col("value"))
    ).filter("not (subtask = 3 and key = 'b')")
    assert sorted(r["key"] for r in o.diverging_replicas(changed).collect()) == ["a", "b"]


def test_settings_reach_every_record(spark):
    config = spark.createDataFrame(
        [("mode", "slow", 1), ("mode", "fast", 2), ("threshold", "7", 3)], "k string, v string, seq int"
    )
    names = ["threshold", "mode", "version"]
    found = o.with_config(spark.range(3), o.current_config(config, names), names).collect()
    assert {tuple(r)[1:] for r in found} == {("7", "fast", "unset")} and len(found) == 3
    none = o.with_config(spark.range(2), o.current_config(config.limit(0), names), names).collect()
    assert {tuple(r)[1:] for r in none} == {("unset", "unset", "unset")}
