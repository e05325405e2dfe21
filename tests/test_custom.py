"""Registered sources: entries by format, with filters pushed into the source."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stateglass.operators import entries as e
from stateglass.sinks.pins import PinStore
from stateglass.sources.custom import EntrySource, PinSource, Slice, read_entries, register_sources


class Shelf(EntrySource):
    """A made-up store: one slice per operator and state, which notes what it reads."""

    @classmethod
    def name(cls):
        return "shelf"

    def slices(self):
        return [Slice(f"op{o}", f"s{s}", f"{o}/{s}") for o in range(3) for s in range(2)]

    def read_slice(self, slice):
        if self.options.get("only") not in (None, slice.place):
            raise ValueError(f"{slice.place} must not be read")
        n = int(self.options.get("rows", "5"))
        yield pa.RecordBatch.from_pydict(
            {
                "operator_uid": [slice.operator_uid] * n,
                "state_name": [slice.state_name] * n,
                "key": [f"k{i}" for i in range(n)],
                "value": pa.array(range(n), pa.int32()),
            }
        )


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    register_sources(spark)
    register_sources(spark, Shelf)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_operator_takes_a_registered_source(spark):
    rows = read_entries(spark, "shelf")
    assert rows.count() == 30 and rows.columns == ["operator_uid", "state_kind", "state_name", "key", "value", "seq"]
    assert e.entry_counts(rows).filter("n_entries <> 5").count() == 0
    assert {r["value"] for r in e.with_key_text(e.of_operator(rows, "op1"), "k3").collect()} == {"3"}


def test_filters_choose_slices(spark):
    rows = read_entries(spark, "shelf", only="1/0")
    with pytest.raises(Exception, match="must not be read"):
        rows.count()
    chosen = rows.filter("operator_uid = 'op1' AND state_name IN ('s0', 'sx') AND key <> 'k1'")
    assert sorted(r["key"] for r in chosen.collect()) == ["k0", "k2", "k3", "k4"]
    assert chosen.rdd.getNumPartitions() == 1
    # What the source has taken over is no filter of Spark any more.
    kept = re.search(r"Filter (.*)", plan(chosen)).group(1)
    assert "key" in kept and "state_name" not in kept and "operator_uid = op1" not in kept


def test_a_frame_is_filtered_in_several_ways(spark):
    rows = read_entries(spark, "shelf")
    assert rows.filter("state_name = 'none'").count() == 0
    assert rows.count() == 30
    assert rows.filter("key = 'k1'").count() == 6 and rows.filter("value = '1'").count() == 6


def test_filters_on_keys_and_contradictions(spark):
    rows = read_entries(spark, "shelf", rows="30")
    assert rows.filter(F.col("key").contains("k2") & F.col("key").startswith("k")).count() == 6 * 11
    assert rows.filter("key = 'k7' AND value = '7'").count() == 6
    assert rows.filter("operator_uid = 'op1' AND operator_uid = 'op2'").count() == 0
    assert rows.filter("state_name = 'none'").count() == 0
    assert rows.filter("state_name IS NULL OR state_name = 's1'").count() == 90


def test_a_pin_by_format(spark, tmp_path):
    entries = spark.range(40).selectExpr(
        "concat('op', id % 2) AS operator_uid", "'keyed' AS state_kind", "concat('0', id % 3, '/ä') AS state_name",
        "string(id) AS key", "string(id * 2) AS value", "concat('op', id % 2) AS operator_id",
    )
    store = PinStore(spark, str(tmp_path))
    store.pin_snapshot(entries, "job", "chk-1", "src")
    rows = read_entries(spark, "stateglass-pin", store.lookup("src"))
    columns = ["operator_uid", "state_kind", "state_name", "key", "value"]
    assert sorted(map(tuple, rows.select(columns).collect())) == sorted(map(tuple, entries.select(columns).collect()))
    one = rows.filter("state_name = '01/ä'")
    assert one.count() == 13 and one.rdd.getNumPartitions() < rows.rdd.getNumPartitions()
    assert PinSource.name() == "stateglass-pin"


def test_a_table_by_format(spark, sf_dir):
    options = {"operator": "chat", "state": "role", "key": "conv_id", "value": "text", "seq": "turn"}
    rows = read_entries(spark, "stateglass-table", f"{sf_dir}/conversations.parquet", **options)
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert rows.count() == table.count()
    assert rows.filter("operator_uid = 'other'").count() == 0
    assert rows.filter("state_name = 'user'").agg(F.sum("seq")).first() == table.filter("role = 'user'").agg(F.sum("turn")).first()
