"""Running values by segments against plain loops, one key holding most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stateglass.functions.sorting import sort_bytes
from stateglass.operators import order
from stateglass.operators.selection import desc, sorting


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    made = []
    for seq in rng.sample(range(5000), 1200):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}"
        made.append((None if rng.random() < 0.05 else key, seq, round(rng.uniform(0, 100), 2)))
    return made


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, seq bigint, value double").repartition(6)


def per_key(rows):
    groups = {}
    for key, seq, value in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(key, []).append((seq, value))
    return groups


@pytest.mark.parametrize("ranges", [None, 1, 7, 40])
def test_running_count(frame, rows, ranges):
    found = order.running_count(frame, ["key"], "seq", ranges=ranges).collect()
    expected = {
        (key, seq): n for key, group in per_key(rows).items() for n, (seq, _) in enumerate(group, 1)
    }
    assert {(r["key"], r["seq"]): r["running_count"] for r in found} == expected
    assert len(found) == len(rows)


@pytest.mark.parametrize("ranges", [None, 13])
def test_index_of_whole_table(frame, rows, ranges):
    found = order.running_count(frame, [], "seq", "index", True, ranges).collect()
    newest = sorted((r[1] for r in rows), reverse=True)
    assert {r["seq"]: r["index"] for r in found} == {s: i for i, s in enumerate(newest, 1)}


@pytest.mark.parametrize("ranges", [None, 1, 9, 50])
def test_exponential_average(frame, rows, ranges):
    found = order.exponential_average(frame, ["key"], "seq", "value", 0.1, ranges).collect()
    expected = {}
    for key, group in per_key(rows).items():
        average = group[0][1]
        for _, value in group[1:]:
            average = 0.1 * value + 0.9 * average
        expected[key] = average
    assert {r["key"] for r in found} == set(expected)
    for r in found:
        assert r["running_average"] == pytest.approx(expected[r["key"]], abs=1e-9)


def test_recent_rows(frame, rows):
    found = order.recent_rows(frame, ["key"], "seq", 20).collect()
    expected = {
        (key, pos): seq
        for key, group in per_key(rows).items()
        for pos, (seq, _) in enumerate(group[-20:])
    }
    assert {(r["key"], r["pos"]): r["seq"] for r in found} == expected


@pytest.fixture(scope="module")
def sparse(spark):
    """20,000 rows of one key at minute steps in microseconds, and a few of others."""
    hot = spark.range(20_000).select(F.lit("hot").alias("key"), (F.col("id") * 60_000_000).alias("seq"))
    few = spark.range(100).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") * -3).alias("seq"))
    return hot.unionAll(few).withColumn("value", F.pmod("seq", F.lit(101)).cast("double")).repartition(6)


def test_a_hot_key_of_sparse_numbers_takes_several_ranges(sparse):
    placed = order._segmented(sparse, ["key"], [F.col("seq").asc()], 8)
    segments = order._segments(placed).select("__segment.key.key", "__segment.range", "__n").collect()
    hot = [r["__n"] for r in segments if r["key"] == "hot"]
    assert len(hot) >= 6 and max(hot) < 20_000 / 4
    assert len(segments) <= 101 + 8
    counted = order.running_count(sparse, ["key"], "seq", ranges=8)
    assert counted.filter("key = 'hot' and running_count != seq / 60000000 + 1").count() == 0
    average = order.exponential_average(sparse, ["key"], "seq", "value", 0.1, 8).filter("key = 'hot'").first()
    want = None
    for i in range(20_000):
        value = float(i * 60_000_000 % 101)
        want = value if want is None else 0.1 * value + 0.9 * want
    assert average["running_average"] == pytest.approx(want, abs=1e-9)


def test_equal_numbers_are_told_apart_for_good(spark):
    rows = spark.range(1000).select(F.lit(None).cast("string").alias("k.1"), (F.col("id") % 10).alias("seq"), "id")
    counted = order.running_count(rows, ["k.1"], "seq", ranges=4)
    first, again = (sorted(map(tuple, counted.collect())) for _ in range(2))
    assert first == again and sorted(r[-1] for r in first) == list(range(1, 1001))
    assert counted.filter("(running_count - 1) DIV 100 != seq").count() == 0


ORDERED = {
    "a": ["a", "n"], "a down": [desc("a"), "n"], "b": ["b", "n"], "b down": [desc("b"), desc("n")],
    "t": ["t", "n"], "t down": [desc("t"), "n"], "d": ["d", desc("b"), "n"], "f": ["f", "n"], "y down": [desc("y"), "n"],
}


def test_all_orders_at_once(spark):
    rng = random.Random(1)
    made = [
        (
            rng.choice([None, -(2**31), -1, 0, 1, 2**31 - 1]),
            rng.choice([None, "", "a", "a\x00", "ab", "b", "é"]),
            rng.choice([None, dt.datetime(1969, 12, 31, 23, 59, 59, 5), dt.datetime(2024, 3, 10, 2, 30, 0, n)]),
            rng.choice([None, dt.date(1960, 1, 1), dt.date(2024, 1, 1)]),
            rng.choice([None, True, False]),
            rng.choice([None, b"", b"\x00", b"\xff"]),
            n,
        )
        for n in range(300)
    ]
    rows = spark.createDataFrame(made, "a int, b string, t timestamp_ntz, d date, f boolean, y binary, n long").repartition(3)
    found = order.index_in_orders(rows, ORDERED).collect()
    assert len(found) == 300 * len(ORDERED)
    for name, by in ORDERED.items():
        got = [r["n"] for r in sorted((r for r in found if r["order"] == name), key=lambda r: r["pos"])]
        assert got == [r["n"] for r in rows.orderBy(*sorting(by)).collect()]
        assert {r["pos"] for r in found if r["order"] == name} == set(range(1, 301))
    assert order.index_in_orders(rows.limit(0), ORDERED).count() == 0


def test_index_in_any_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("id"), (F.col("id") % 3).alias("t"))
    found = order.global_index(rows.repartition(7), [F.col("t").desc(), "id"]).collect()
    want = sorted(((r["id"], r["t"]) for r in rows.collect()), key=lambda r: (-r[1], r[0]))
    assert [(r["id"], r["t"]) for r in sorted(found, key=lambda r: r["index"])] == want
    assert sorted(r["index"] for r in found) == list(range(1, 5001))
    assert order.global_index(rows.limit(0), ["id"]).count() == 0


def test_sort_bytes_sort_like_the_values(spark):
    texts = [None, "", "\0", "\0\0", "\0\u0001", "a", "a\0", "a\0b", "a\u0001", "ab", "b", "ÿ", "é", "€", "😀"]
    rows = spark.createDataFrame([(t, n) for t in texts for n in (None, -5, 0, 7)], "t string, n bigint")
    kinds = [f.dataType for f in rows.schema]
    for down in (False, True):
        own = F.concat(*[sort_bytes(F.col(c), k, d) for c, k, d in zip(rows.columns, kinds, (down, not down))])
        order = [F.col("t").desc(), F.col("n").asc()] if down else [F.col("t").asc(), F.col("n").desc()]
        got = [tuple(r) for r in rows.orderBy(own).collect()]
        assert got == [tuple(r) for r in rows.orderBy(*order).collect()]


def test_positions_shuffle_rows_once_and_only_the_wanted_columns(spark):
    rows = spark.range(40).select(F.col("id").cast("string").alias("t"), "id", F.repeat(F.lit("x"), 99).alias("wide"))
    found = order.index_in_orders(rows, {"up": ["id"], "down": [desc("id")]}, columns=["t"])
    assert found.columns == ["t", "order", "pos"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "wide" not in plan and "rightHint=(strategy=broadcast)" in plan
    got = {(r["t"], r["order"]): r["pos"] for r in found.collect()}
    assert got == {(str(i), o): i + 1 if o == "up" else 40 - i for i in range(40) for o in ("up", "down")}
