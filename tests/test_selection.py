"""Cuts to a rank against sorted lists: nulls, both directions, ties, many types."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stateglass.operators import paging, selection
from stateglass.operators.selection import cut_groups, cut_to_rank, desc, sorting

SCHEMA = "a int, b string, t timestamp_ntz, d double, s struct<x:int,y:string>, n long"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = []
    for n in range(4000):
        made.append(
            (
                rng.choice([None, *range(-20, 20)]),
                rng.choice([None, "", "a", "ab", "é", "z\x00", f"k{rng.randrange(50)}"]),
                None if rng.random() < 0.1 else dt.datetime(2024, 3, 10, 2, 30, 0, rng.randrange(10**6)),
                rng.choice([None, float("nan"), float("-inf"), rng.uniform(-1, 1)]),
                None if rng.random() < 0.1 else (rng.choice([None, 1, 2]), rng.choice([None, "p", "q"])),
                n,
            )
        )
    return spark.createDataFrame(made, SCHEMA).repartition(5).cache()


ORDERS = [
    ["a", "n"],
    [desc("a"), "n"],
    ["b", desc("n")],
    [desc("b"), desc("a"), "n"],
    ["t", "n"],
    [desc("t"), "n"],
    ["d", "n"],
    [desc("d"), "n"],
    ["s", "n"],
    [desc("s"), "n"],
]


@pytest.mark.parametrize("order", ORDERS, ids=str)
@pytest.mark.parametrize("rank", [1, 37, 3990])
def test_cut_holds_the_first_rows(rows, monkeypatch, order, rank):
    monkeypatch.setattr(selection, "SAMPLED", 300)
    want = [r["n"] for r in rows.orderBy(*sorting(order)).limit(rank).collect()]
    cut = cut_to_rank(rows, order, rank, slack=100)
    assert cut.count() <= rank + 100
    assert [r["n"] for r in cut.orderBy(*sorting(order)).limit(rank).collect()] == want


@pytest.mark.parametrize("order", [["a", "n"], [desc("b"), desc("n")], [desc("t"), "n"]], ids=str)
def test_groups_hold_their_first_rows(spark, rows, monkeypatch, order):
    monkeypatch.setattr(selection, "SAMPLED", 200)
    grouped = rows.withColumn("g", F.when(F.col("n") % 3 > 0, "hot").when(F.col("n") % 7 > 0, F.lit(None)).otherwise("few"))
    cut = cut_groups(grouped, ["g"], order, 50, slack=60)
    assert cut.columns == grouped.columns
    assert {r["g"]: r["count"] <= 110 or r["g"] == "few" for r in cut.groupBy("g").count().collect()} == dict.fromkeys(
        ("hot", None, "few"), True
    )
    for g in ("hot", None, "few"):
        of = F.col("g").eqNullSafe(F.lit(g))
        found, want = (
            [r["n"] for r in f.filter(of).orderBy(*sorting(order)).limit(50).collect()] for f in (cut, grouped)
        )
        assert found == want


def test_expressions_are_orders_too(rows):
    order = [desc(F.length("b")), F.col("n") % 100, "n"]
    want = [r["n"] for r in rows.orderBy(*sorting(order)).limit(20).collect()]
    found = cut_to_rank(rows, order, 20, slack=50).orderBy(*sorting(order)).limit(20).collect()
    assert [r["n"] for r in found] == want


def test_ties_and_empty(spark):
    same = spark.range(500).select(F.lit(1).alias("k"))
    assert cut_to_rank(same, ["k"], 10, slack=20).count() >= 10
    assert cut_to_rank(same.limit(0), ["k"], 10, slack=0).count() == 0
    assert cut_groups(same, ["k"], ["k"], 10, slack=20).count() >= 10
    with pytest.raises(ValueError, match="selection.desc"):
        cut_to_rank(same, [F.col("k").desc()], 10)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sel") / "t")
    spark.range(0, 400_000, 1, 4).select((F.col("id") * 7919 % 400_000).alias("id"), F.lit("x").alias("v")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("limit", [999, 1_000, 1_001, 10_000, 100_000])
def test_pages_of_any_size_shuffle_nothing_but_the_page(stored, limit):
    page = paging.page(stored, ["id"], 5, limit)
    text = plan(page)
    assert "rangepartitioning" not in text and "hashpartitioning(__salt" not in text
    # The bound of the page reaches the scan; only what is left is ordered.
    assert "LessThanOrEqual(id," in text and "Exchange" not in text and "TakeOrderedAndProject" in text
    found = page.agg(F.count("*"), F.min("id"), F.max("id"), F.min("pos"), F.max("pos"), F.bool_and("has_more")).first()
    assert tuple(found) == (limit, 5, limit + 4, 6, limit + 5, True)


def test_more_is_exact_at_the_end(stored):
    assert paging.page(stored, ["id"], 100_000, 100_000, after=[199_999]).agg(F.bool_or("has_more")).first()[0] is False
    assert paging.page(stored, ["id"], 99_999, 100_000, after=[199_999]).agg(F.bool_and("has_more")).first()[0] is True


def test_descending_pages_after_a_row(stored):
    page = paging.page(stored, [desc("id")], 2, 3, after=[350_000]).orderBy("pos").collect()
    assert [r["id"] for r in page] == [349_997, 349_996, 349_995]


@pytest.mark.parametrize("limit", [1_000, 1_001])
def test_groups_are_cut_by_bounds(stored, limit, monkeypatch):
    monkeypatch.setattr(selection, "SLACK", 1_000)
    grouped = stored.withColumn("g", F.col("id") % 2)
    bounded = cut_groups(grouped, ["g"], ["id"], limit, slack=1_000)
    assert bounded.count() <= 2 * (limit + 1_000)
    top = paging.top_per_group(grouped, ["g"], ["id"], limit)
    assert top.count() == 2 * limit and top.where("pos != id DIV 2 + 1").count() == 0
