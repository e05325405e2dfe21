"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from stateglass.operators import order, paging
from stateglass.operators.diff import diff_snapshots
from stateglass.plans import QUERIES
from stateglass.plans.tables import AFTER, BEFORE, state_at

# Each builds folders of its own on every call.
WRITES = {"k4_delete_pin", "k5_clear_pins"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_cross_join(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_diff_takes_over_partitioning(spark, sf_dir, no_broadcast):
    """One shuffle per side, for the aggregation that makes the snapshot."""
    text = plan(diff_snapshots(state_at(spark, sf_dir, BEFORE), state_at(spark, sf_dir, AFTER)))
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("partial_count") == 2
    assert "SortMergeJoin" in text


def test_cut_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(state_at(spark, sf_dir, BEFORE))
    assert re.search(r"PushedFilters: \[[^]]*LessThan\(ts,", text)
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text


def test_keys_only_reads_no_values(spark, sf_dir):
    text = plan(QUERIES["j1_keys_only_diff"](spark, sf_dir))
    assert "value" not in text.split("ReadSchema")[1].split(">")[0]


def test_running_count_needs_no_window_over_rows(spark, events, no_broadcast):
    text = plan(order.running_count(events.select("event_id", "user_id"), ["user_id"], "event_id"))
    # Rows by segment; counts by segment, by key, and back.
    assert text.count("Exchange hashpartitioning") == 4 and text.count("Window [") == 1


@pytest.mark.parametrize("name", ["o3_top_per_job", "o4_page_per_status", "w5_recent_values", "w6_recent_per_subtask"])
def test_groups_are_cut_before_the_shuffle(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    partial, exchange = text.index("Partial"), text.rindex("Exchange")
    assert "WindowGroupLimit" in text
    assert partial > text.index("Exchange hashpartitioning"), "the cut lies below the exchange"
    assert exchange > 0


@pytest.mark.parametrize("name", ["o1_newest_first", "o2_page", "w2_pins_to_evict"])
def test_pages_are_top_k(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_page_with_offset_is_top_k(spark, events):
    text = plan(paging.page(events, ["event_id"], 10, 5))
    assert "TakeOrderedAndProject" in text


def test_settings_need_no_join(spark, sf_dir):
    text = plan(QUERIES["j7_config_enrichment"](spark, sf_dir))
    assert "Join" not in text and "Subquery" in text


def test_pinned_states_are_pruned(spark, sf_dir):
    text = plan(QUERIES["k2_read_pruned"](spark, sf_dir))
    assert "PartitionFilters: [" in text and "state_name" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "ReadSchema: struct<key:string,value:string>" in text


@pytest.mark.parametrize("name", [q for q in QUERIES if q.startswith("f") or q.startswith("p1_")])
def test_functions_stay_in_the_jvm(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "MapInArrow" not in text
