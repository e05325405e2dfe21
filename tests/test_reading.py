import pytest
from pyspark.sql import functions as F

from stateglass.operators import entries as e, paging
from stateglass.operators.selection import desc
from stateglass.plans import reading


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(10).select(F.format_string("k%d", "id").alias("key"), "id")


def test_page_and_more(spark, rows):
    page = paging.page(rows, ["id"], 2, 3).collect()
    assert [(r["id"], r["pos"], r["has_more"]) for r in page] == [(2, 3, True), (3, 4, True), (4, 5, True)]


def test_exact_end_has_no_more(spark, rows):
    page = paging.page(rows, ["id"], 5, 5)
    assert {r["has_more"] for r in page.collect()} == {False} and page.count() == 5
    report = paging.page_report(page, 5).first()
    assert tuple(report) == (5, False, 5)


def test_empty_page_report(spark, rows):
    report = paging.page_report(paging.page(rows, ["id"], 50, 5), 50).first()
    assert report["entry_count"] == 0 and report["has_more"] is False


@pytest.mark.parametrize("offset, limit", [(-1, 1), (100_001, 1), (0, 0), (0, 100_001)])
def test_page_bounds(rows, offset, limit):
    with pytest.raises(ValueError, match="must be between"):
        paging.page(rows, ["id"], offset, limit)


def test_bounded_read(rows):
    cut = paging.bounded_read(rows, ["id"], 4).collect()
    assert len(cut) == 4 and all(r["truncated"] for r in cut)
    assert not any(r["truncated"] for r in paging.bounded_read(rows, ["id"], 10).collect())


def test_numeric_aware(spark):
    keys = spark.createDataFrame([("k10",), ("k2",), ("a",), ("k1",)], "key string")
    found = [r["key"] for r in keys.orderBy(*paging.numeric_aware(F.col("key"))).collect()]
    assert found == ["a", "k1", "k2", "k10"]


def test_newest_first(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "path string, t int")
    assert [r["path"] for r in paging.newest_first(rows, "t", "path", 2).collect()] == ["b", "c"]


@pytest.mark.parametrize(
    "text, expected",
    [("alpha", ["alpha", "alphabeta"]), ("", ["a%b", "alpha", "alphabeta", "beta"]),
     (None, ["a%b", "alpha", "alphabeta", "beta"]), ("%", ["a%b"]), ("ALPHA", []), ("l.h", [])],
)
def test_key_filter(spark, text, expected):
    rows = spark.createDataFrame([(k,) for k in ("alpha", "beta", "alphabeta", "a%b")], "key string")
    assert sorted(r["key"] for r in e.with_key_text(rows, text).collect()) == expected


def test_long_and_wide(spark):
    wide = spark.createDataFrame([("a", 1, None), ("b", None, 2.5)], "key string, n int, x double")
    long = e.to_long(wide, ["n", "x"])
    found = {(r["key"], r["state_name"]): r["value"] for r in long.collect()}
    assert found == {("a", "n"): "1", ("a", "x"): "", ("b", "n"): "", ("b", "x"): "2.5"}
    back = {r["key"]: (r["n"], r["x"]) for r in e.to_wide(long, ["n", "x"]).collect()}
    assert back == {"a": ("1", ""), "b": ("", "2.5")}


def test_combine_states(spark):
    counts = spark.createDataFrame([(1, 10), (2, 20), (None, 5)], "key int, value int")
    lists = spark.createDataFrame([(2, ["x"]), (3, ["y"]), (None, [])], "key int, value array<string>")
    maps = spark.sql("select 3 as key, map('a', 1) as value")
    found = {tuple(r)[0]: tuple(r)[1:] for r in e.combine_states({"n": counts, "l": lists, "m": maps}).collect()}
    assert found == {
        1: (10, None, None), 2: (20, ["x"], None), 3: (None, ["y"], {"a": 1}), None: (5, [], None)
    }


def test_last_write_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y")], "key string, seq int, value string")
    assert [tuple(r) for r in e.last_write_wins(rows, "seq").collect()] == [("a", "z")]


def test_long_lists_span_segments(spark):
    rows = spark.range(25).select(F.lit("k").alias("key"), F.col("id").alias("pos"), F.col("id").alias("value"))
    found = e.assemble_lists(rows, ["key"], segment_size=10).orderBy("segment").collect()
    assert [r["segment"] for r in found] == [0, 1, 2]
    assert [v for r in found for v in r["items"]] == list(range(25))


def test_large_maps_span_segments(spark):
    hot = spark.range(1000).select(F.lit("hot").alias("key"), F.col("id").alias("map_key"), F.col("id").alias("value"))
    small = spark.range(3).select(F.lit("small").alias("key"), F.col("id").alias("map_key"), F.col("id").alias("value"))
    found = e.assemble_maps(hot.unionAll(small), ["key"], segments=10).collect()
    for key, size in (("hot", 1000), ("small", 3)):
        parts = [r["items"] for r in found if r["key"] == key]
        assert len(parts) <= 10 and max(map(len, parts)) < 200
        assert {k: v for part in parts for k, v in part.items()} == {i: i for i in range(size)}
    whole = {r["key"]: r["items"] for r in e.assemble_maps(hot.unionAll(small), ["key"]).collect()}
    assert whole == {"hot": {i: i for i in range(1000)}, "small": {0: 0, 1: 1, 2: 2}}


def test_long_lists_are_one_row_unless_asked(spark):
    rows = spark.range(30_000).select(F.lit("k").alias("key"), F.col("id").alias("pos"), F.col("id").alias("value"))
    found = e.assemble_lists(rows, ["key"]).collect()
    assert len(found) == 1 and found[0]["items"] == list(range(30_000))


def test_pages_after_a_row(spark):
    rows = [(a, b) for a in (None, "x", "y") for b in (None, 1, 2)]
    frame = spark.createDataFrame(rows, "a string, b int")
    order, seen, after = ["a", "b"], [], None
    while True:
        found = sorted(paging.page(frame, order, limit=2, after=after).collect(), key=lambda r: r["pos"])
        seen += [(r["a"], r["b"]) for r in found]
        if not found[-1]["has_more"]:
            break
        after = seen[-1]
    assert seen == rows


def test_top_per_group_of_any_size(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).alias("g"), "id")
    found = paging.top_per_group(rows, ["g"], ["id"], 1500)
    assert found.groupBy("g").agg(F.count("*").alias("n"), F.max("pos").alias("p")).select("n", "p").distinct().collect() == [(1500, 1500)]
    assert found.where("pos != id DIV 2 + 1").count() == 0


def test_numeric_sort_gives_every_key_in_order(spark, sf_dir):
    keys = [r["key"] for r in reading.numeric_sort(spark, sf_dir).collect()]
    assert keys == sorted(keys, key=lambda k: int(k.removeprefix("user-")))


def test_counts_and_names(spark):
    rows = spark.createDataFrame(
        [("op", "s2", "a"), ("op", "s1", "a"), ("op", "s1", "b"), ("q", "s", "a")],
        "operator_uid string, state_name string, key string",
    )
    counts = {tuple(r)[:2]: r["n_entries"] for r in e.entry_counts(rows).collect()}
    assert counts == {("op", "s1"): 2, ("op", "s2"): 1, ("q", "s"): 1}
    assert {r["operator_uid"]: r["state_names"] for r in e.state_names(rows).collect()} == {
        "op": ["s1", "s2"], "q": ["s"]
    }


def test_deep_pages_of_rows_with_maps(spark):
    rows = spark.range(30_000).withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    found = paging.page(rows, [desc("id")], 9_000, 3_000).collect()
    assert [r["id"] for r in sorted(found, key=lambda r: r["pos"])] == list(range(20_999, 17_999, -1))
    assert {r["has_more"] for r in found} == {True}
    bounded = paging.bounded_read(rows, ["id"], 5_000)
    assert bounded.count() == 5_000 and bounded.where("truncated").count() == 5_000
