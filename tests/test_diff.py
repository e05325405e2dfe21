import pytest
from pyspark.sql import functions as F

from stateglass.operators import diff as d
from stateglass.plans.tables import AFTER, BEFORE, state_at

SCHEMA = "key string, value double"


def frames(spark, left, right, schema=SCHEMA):
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


def statuses(diff):
    return {r["key"]: r["status"] for r in diff.collect()}


def totals(diff):
    return d.diff_summary(diff).first().asDict()


@pytest.mark.parametrize(
    "left, right, expected",
    [
        ([("s0", 100.0)], [("s0", 100.0), ("s1", 200.0)], {"s0": "UNCHANGED", "s1": "ADDED"}),
        ([("s0", 100.0), ("s1", 200.0)], [("s0", 100.0)], {"s0": "UNCHANGED", "s1": "REMOVED"}),
        ([("s0", 100.0)], [("s0", 150.0)], {"s0": "MODIFIED"}),
        (
            [("s0", 100.0), ("s1", 200.0)],
            [("s0", 100.0), ("s2", 300.0)],
            {"s0": "UNCHANGED", "s1": "REMOVED", "s2": "ADDED"},
        ),
        ([("s0", None)], [("s0", 0.0)], {"s0": "MODIFIED"}),
        ([("s0", None)], [("s0", None)], {"s0": "UNCHANGED"}),
        ([], [("s0", None)], {"s0": "ADDED"}),
    ],
)
def test_status(spark, left, right, expected):
    sides = frames(spark, left, right)
    assert statuses(d.diff_snapshots(*sides)) == expected
    assert statuses(d.diff_status(*sides)) == expected
    unchanged = {r["key"] for r in d.unchanged_keys(*sides).collect()}
    assert unchanged == {k for k, s in expected.items() if s == "UNCHANGED"}
    assert {r["key"] for r in d.added_keys(*sides).collect()} == {
        k for k, s in expected.items() if s == "ADDED"
    }
    assert {r["key"] for r in d.removed_keys(*sides).collect()} == {
        k for k, s in expected.items() if s == "REMOVED"
    }


def test_unchanged_totals(spark):
    rows = [("s0", 100.0), ("s1", 200.0)]
    found = totals(d.diff_snapshots(*frames(spark, rows, rows)))
    assert found["unchanged_count"] == 2 and found["total_keys"] == 2


def test_field_changes(spark):
    schema = "key string, running_average double, event_count bigint"
    diff = d.diff_snapshots(*frames(spark, [("s0", 85.0, 100)], [("s0", 90.0, 130)], schema))
    changes = [tuple(r) for r in d.field_changes(diff).orderBy("field_name").collect()]
    assert changes == [
        ("s0", "event_count", "100", "130"),
        ("s0", "running_average", "85.0", "90.0"),
    ]
    assert [tuple(r) for r in d.change_counts(diff).collect()] == [("s0", 2)]


def test_fields_of_one_side_and_other_types(spark):
    left = spark.createDataFrame([("a", 1, "x")], "key string, n int, only_left string")
    right = spark.createDataFrame([("a", 1, 5)], "key string, n bigint, only_right int")
    row = d.diff_snapshots(left, right).first()
    # An int and a bigint with one text are no change.
    assert row["status"] == "MODIFIED"
    assert [tuple(c) for c in row["field_changes"]] == [
        ("only_left", '"x"', None),
        ("only_right", None, "5"),
    ]


def test_same_text_of_other_type_is_unchanged(spark):
    left = spark.createDataFrame([("a", 1)], "key string, n int")
    right = spark.createDataFrame([("a", 1)], "key string, n bigint")
    row = d.diff_snapshots(left, right).first()
    assert row["status"] == "UNCHANGED" and row["field_changes"] == []


def test_maps_compare_by_content(spark):
    left = spark.sql("select 'a' as key, map('x', 1, 'y', 2) as m")
    right = spark.sql("select 'a' as key, map('y', 2, 'x', 1) as m")
    assert statuses(d.diff_snapshots(left, right)) == {"a": "UNCHANGED"}
    right = spark.sql("select 'a' as key, map('y', 3, 'x', 1) as m")
    change = d.diff_snapshots(left, right).first()["field_changes"][0]
    assert tuple(change) == ("m", '{"x":1,"y":2}', '{"x":1,"y":3}')


def test_text_is_json(spark):
    diff = d.diff_snapshots(*frames(spark, [("a", 'q"t')], [("a", "z")], "key string, value string"))
    assert diff.first()["field_changes"][0]["old_value"] == '"q\\"t"'


def test_null_key_is_a_key(spark):
    sides = frames(spark, [(None, 1.0), ("a", 1.0)], [(None, 2.0)])
    found = statuses(d.diff_snapshots(*sides))
    assert found == {None: "MODIFIED", "a": "REMOVED"}
    with pytest.raises(Exception, match="null in key column key"):
        d.diff_snapshots(*sides, null_keys=False).collect()


def test_null_part_of_struct_key(spark):
    rows = frames(spark, [(1, None, 5)], [(1, None, 6), (None, None, 7)], "a int, b string, v int")
    left, right = [df.select(F.struct("a", "b").alias("key"), "v") for df in rows]
    found = {tuple(r["key"]): r["status"] for r in d.diff_snapshots(left, right).collect()}
    assert found == {(1, None): "MODIFIED", (None, None): "ADDED"}


def test_typed_keys_do_not_merge(spark):
    left = spark.createDataFrame([(1, "a")], "k1 int, k2 string")
    right = spark.createDataFrame([(1, "b")], "k1 int, k2 string")
    found = [tuple(r) for r in d.diff_snapshots(left, right, ["k1", "k2"]).select("k1", "k2", "status").collect()]
    assert sorted(found) == [(1, "a", "REMOVED"), (1, "b", "ADDED")]


def test_keys_only_has_no_modified(spark):
    diff = d.diff_snapshots(*frames(spark, [("a", 1.0)], [("a", 2.0)]), keys_only=True)
    assert diff.columns == ["key", "status"] and statuses(diff) == {"a": "UNCHANGED"}


def test_pages(spark):
    added = [("s0", 1.0), ("s1", 2.0), ("s2", 3.0)]
    diff = d.diff_snapshots(*frames(spark, [], added))
    page = d.page_per_status(diff, offset=1, limit=2)
    assert sorted(r["key"] for r in page.collect()) == ["s1", "s2"]
    assert totals(diff)["total_added"] == 3


def test_page_beyond_the_end(spark):
    diff = d.diff_snapshots(*frames(spark, [("s0", 100.0)], [("s0", 200.0)]))
    assert d.page_per_status(diff, offset=10).count() == 0
    assert totals(diff)["total_modified"] == 1


def test_page_arguments(spark):
    diff = d.diff_snapshots(*frames(spark, [], []))
    for offset, limit in ((-1, 5), (0, 0), (0, 100_001), (100_001, 5)):
        with pytest.raises(ValueError):
            d.page_per_status(diff, offset, limit)


@pytest.mark.parametrize(
    "sf, expected", [("0.001", (3, 0, 56, 14)), ("0.01", (22, 26, 527, 169))]
)
def test_laws(spark, sf, expected):
    path = f"/root/testdata/sf{sf}"
    left, right = state_at(spark, path, BEFORE), state_at(spark, path, AFTER)
    there, back = totals(d.diff_snapshots(left, right)), totals(d.diff_snapshots(right, left))
    names = ("total_added", "total_removed", "total_modified", "unchanged_count")
    assert tuple(there[n] for n in names) == expected
    assert sum(there[n] for n in names) == there["total_keys"]
    mirrored = ("total_removed", "total_added", "total_modified", "unchanged_count")
    assert [back[n] for n in mirrored] == [there[n] for n in names]
    same = totals(d.diff_snapshots(left, left.alias("again")))
    assert same["unchanged_count"] == same["total_keys"]


def test_sides_that_are_writes(spark):
    schema = "key string, seq int, value double, note string"
    left = [("a", 1, 1.0, "x"), ("a", 2, 2.0, None), ("b", 1, 5.0, "y")]
    right = [("a", 9, 2.0, None), ("a", 3, 7.0, "z"), ("c", 1, None, None)]
    diff = d.diff_snapshots(*frames(spark, left, right, schema), seq="seq")
    assert statuses(diff) == {"a": "UNCHANGED", "b": "REMOVED", "c": "ADDED"}
    assert diff.count() == 3


def test_all_keys(spark):
    found = d.all_keys(*frames(spark, [("a", 1.0)], [("a", 2.0), ("b", 1.0)])).collect()
    assert sorted(r["key"] for r in found) == ["a", "b"]


def test_keys_with_dots_and_keys_that_occur_twice(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "`k.x` string, v int")
    right = spark.createDataFrame([("a", 1), ("c", 2)], "`k.x` string, v int")
    found = d.diff_snapshots(left, right, ["k.x"], check_keys=True).collect()
    assert {(r[0], r["status"]) for r in found} == {("a", "UNCHANGED"), ("b", "REMOVED"), ("c", "ADDED")}
    twice = left.union(left)
    with pytest.raises(Exception, match="occurs more than once"):
        d.diff_snapshots(twice, right, ["k.x"], check_keys=True).collect()


def test_all_operators_meet_in_one_typed_join(spark):
    def side(counts, names, lists):
        return {
            "a": spark.createDataFrame(counts, "key struct<u:long,t:string>, n long, v double"),
            "b.x": spark.createDataFrame(names, "key string, n string"),
            "c": spark.createDataFrame(lists, "key int, `l.s` array<int>"),
        }

    left = side([((1, None), 5, 1.0), ((2, "x"), 6, 2.0)], [("1", "p"), ("2", None)], [(1, [1, 2]), (None, [3])])
    right = side([((1, None), 5, 1.5), ((3, "x"), 6, 2.0)], [("1", "p"), ("2", "q")], [(1, [2, 1]), (None, [3])])
    right["d"] = spark.createDataFrame([(1, 1)], "key int, n int")
    left["e"] = spark.createDataFrame([(b"1", 1)], "key binary, n int")
    right["e"] = spark.createDataFrame([("1", 1)], "key string, n int")
    diff = d.diff_operators(left, right)
    found = {}
    for r in diff.collect():
        key = next((v for v in list(r["key"])[1:] if v is not None), None)
        key = tuple(key) if isinstance(key, tuple) else bytes(key) if isinstance(key, bytearray) else key
        found[r["operator_uid"], key] = (r["status"], [tuple(c) for c in r["field_changes"]])
    assert found == {
        ("a", (1, None)): ("MODIFIED", [("v", "1.0", "1.5")]),
        ("a", (2, "x")): ("REMOVED", []),
        ("a", (3, "x")): ("ADDED", []),
        ("b.x", "1"): ("UNCHANGED", []),
        ("b.x", "2"): ("MODIFIED", [("n", None, '"q"')]),
        ("c", 1): ("MODIFIED", [("l.s", "[1,2]", "[2,1]")]),
        ("c", None): ("UNCHANGED", []),
        ("d", 1): ("ADDED", []),
        ("e", b"1"): ("REMOVED", []),
        ("e", "1"): ("ADDED", []),
    }
    text = d.diff_operators(left, right)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Join") == 1 and "to_json" not in text.split("Join")[1]
    only = d.diff_operators({}, right, keys_only=True)
    assert {r["status"] for r in only.collect()} == {"ADDED"} and only.columns == ["operator_uid", "key", "status"]
    with pytest.raises(ValueError, match="no operator"):
        d.diff_operators({}, {})


def test_pages_of_changes_after_a_key(spark):
    rows = [(f"s{i:03}", float(i)) for i in range(30)]
    diff = d.diff_snapshots(*frames(spark, rows[:20], [(k, v + 1) for k, v in rows[5:]]))
    first = d.page_per_status(diff, limit=4).collect()
    assert len(first) == 12
    after = d.page_per_status(diff, limit=4, after=["s007"]).collect()
    assert {s: sorted((r["key"], r["pos"]) for r in after if r["status"] == s) for s in ("ADDED", "MODIFIED", "REMOVED")} == {
        "ADDED": [(f"s{20 + i:03}", i + 1) for i in range(4)],
        "MODIFIED": [(f"s{8 + i:03}", i + 1) for i in range(4)],
        "REMOVED": [],
    }
