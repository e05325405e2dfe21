"""Streams in several slices, one key hot, read back and compared with loops."""

from collections import Counter
from functools import partial

import pytest
from pyspark.sql import functions as F

from stateglass import views
from stateglass.session import streaming_session, work_dir
from stateglass.sinks.pins import PinStore
from stateglass.sources import catalog, snapshots as s, state as st
from stateglass.streaming import changes, jobs, summaries as sm
from stateglass.streaming.enrich import enrich_into
from stateglass.streaming.processors import KeyedStateProcessor

RANGES = 5
CUTS = (0, 300, 650, 1000)


def feed(spark, events, run, label):
    session = streaming_session(spark)
    base = work_dir(spark, "test")
    checkpoint = f"{base}/jobs/{label}"
    for low, high in zip(CUTS, CUTS[1:]):
        part = events.filter((F.col("event_id") >= low) & (F.col("event_id") < high))
        # Three files per slice: rows of a key come from several tasks.
        part.repartition(3).write.mode("append").parquet(f"{base}/input")
        stream = session.readStream.schema(events.schema).parquet(f"{base}/input")
        run(stream, f"{base}/work", checkpoint)
    return checkpoint


def single(frame):
    return lambda stream, _, checkpoint: jobs.run_available(frame(stream), checkpoint)


@pytest.fixture(scope="module")
def few(events):
    """Six users, one of them with over a third of the events."""
    user = F.when(F.col("event_id") % 5 < 2, -1).otherwise(F.col("user_id") % 5)
    return events.filter(F.col("event_id") < CUTS[-1]).withColumn("user_id", user)


@pytest.fixture(scope="module")
def by_user(few):
    groups = {}
    for r in few.orderBy("event_id").collect():
        groups.setdefault(r["user_id"], []).append(r)
    return groups


@pytest.fixture(scope="module")
def keyed(spark, few):
    return feed(spark, few, partial(jobs.keyed_state, ranges=RANGES), "keyed")


def read(spark, checkpoint, name, **options):
    rows = st.read_keyed_state(spark, checkpoint, name, **options)
    return rows.select("key.user_id", *[c for c in rows.columns if c != "key"])


def as_dict(rows):
    return {r[0]: r[1] for r in rows.collect()}


@pytest.mark.parametrize("batch", [0, 1, 2, None])
def test_counts_at_every_batch(spark, keyed, few, batch):
    end = CUTS[-1] if batch is None else CUTS[batch + 1]
    expected = as_dict(few.filter(F.col("event_id") < end).groupBy("user_id").count())
    assert as_dict(read(spark, keyed, "event_count", batch_id=batch)) == expected


def test_average_is_folded_in_order(spark, keyed, by_user):
    found = as_dict(read(spark, keyed, "running_average"))
    assert set(found) == set(by_user)
    for user, rows in by_user.items():
        average = rows[0]["value"]
        for row in rows[1:]:
            average = sm.ALPHA * row["value"] + (1 - sm.ALPHA) * average
        assert found[user] == pytest.approx(average, abs=1e-9)


def test_recent_values_in_order(spark, keyed, by_user):
    found = as_dict(read(spark, keyed, "recent_values"))
    for user, rows in by_user.items():
        last = rows[-sm.RECENT_VALUES :]
        assert [t.split("@")[0] for t in found[user]] == [f"{r['value']:.2f}" for r in last]
    flat = read(spark, keyed, "recent_values", flatten=True)
    assert flat.count() == sum(len(v) for v in found.values())


def test_map_and_last_category(spark, keyed, few, by_user):
    flat = {tuple(r) for r in read(spark, keyed, "category_counts", flatten=True).collect()}
    assert flat == {tuple(r) for r in few.groupBy("user_id", "event_type").count().collect()}
    whole = as_dict(read(spark, keyed, "category_counts"))
    assert {(u, c, n) for u, counts in whole.items() for c, n in counts.items()} == flat
    last = as_dict(read(spark, keyed, "last_category"))
    assert last == {u: rows[-1]["event_type"] for u, rows in by_user.items()}


def test_a_batch_brings_few_rows_per_key(few):
    """However many events a key has in a batch, its summary is short."""
    sizes = sm.keyed_summary(few, RANGES).groupBy("user_id").count()
    categories = few.select("event_type").distinct().count()
    assert sizes.agg(F.max("count")).first()[0] <= 1 + sm.RECENT_VALUES + categories


def test_a_batch_brings_three_rows_per_key(few, by_user):
    found = {}
    for row in sm.keyed_summary(few, RANGES).collect():
        assert row["kind"] not in found.setdefault(row["user_id"], {})
        found[row["user_id"]][row["kind"]] = row
    for user, rows in by_user.items():
        assert found[user]["step"]["n"] == len(rows)
        newest = rows[-sm.RECENT_VALUES :]
        texts = found[user]["recent"]["texts"]
        assert [text.split("@")[0] for text in texts] == [f"{r['value']:.2f}" for r in newest]
        assert found[user]["recent"]["category"] == rows[-1]["event_type"]
        counts = found[user]["category"]
        assert dict(zip(counts["texts"], counts["counts"])) == Counter(r["event_type"] for r in rows)


class CountedMap:
    """A map state in memory that counts the calls."""

    def __init__(self, entries):
        self.entries, self.calls = dict(entries), Counter()

    def iterator(self):
        self.calls["iterator"] += 1
        return iter([((k,), (v,)) for k, v in self.entries.items()])

    def getValue(self, key):
        self.calls["getValue"] += 1
        return (self.entries[key[0]],) if key[0] in self.entries else None


@pytest.mark.parametrize("held", [0, 3, 500])
def test_a_short_map_is_read_by_one_call(held):
    """A long one is read by key, as much of it as a batch brings."""
    processor = KeyedStateProcessor(sm.ALPHA, sm.RECENT_VALUES)
    processor.categories = CountedMap({f"c{i}": i + 1 for i in range(held)})
    names = ["c0", "c2", "other", None]
    before = processor._counts_before(names, held)
    want = {0: {}, 3: {"c0": 1, "c2": 3}, 500: {"c0": 1, "c2": 3}}
    assert {k: v for k, v in before.items() if k in names} == want[held]
    assert processor.categories.calls == {0: {}, 3: {"iterator": 1}, 500: {"getValue": 4}}[held]


def test_all_states_in_one_row(spark, keyed, by_user):
    rows = st.read_all_states(spark, keyed)
    assert set(rows.columns) == {
        "key", "category_counts", "event_count", "last_category", "recent_values", "running_average"
    }
    assert rows.filter("event_count is null or running_average is null").count() == 0
    assert rows.count() == len(by_user)


def test_buffer(spark, few):
    checkpoint = feed(spark, few, jobs.recent_buffer, "buffer")
    held = st.read_keyed_state(spark, checkpoint, "partitioned_records").select("key.subtask", "value")
    rows = few.orderBy("event_id").collect()
    for subtask, entries in as_dict(held).items():
        last = [r for r in rows if r["event_id"] % sm.SUBTASKS == subtask][-sm.BUFFER_SIZE :]
        assert entries == [f"{r['user_id']}:{r['event_type']}={r['value']:.2f}" for r in last]
    assert held.count() == sm.SUBTASKS


def test_broken_off_summaries_are_rewritten(spark, few, tmp_path):
    write = sm.summaries_into(str(tmp_path), sm.buffer_summary)
    write(few.limit(10), 0)
    write(few, 0)
    found = spark.read.schema(sm.BUFFER_SCHEMA).parquet(f"{tmp_path}/*")
    assert found.count() == sm.SUBTASKS * sm.BUFFER_SIZE


def test_changes_between_batches(spark, keyed, few):
    found = changes.batch_changes(spark, keyed, "event_count", 0, 2)
    got = {
        r["key"]["user_id"]: (r["status"], r["left"] and r["left"]["value"], r["right"]["value"])
        for r in found.collect()
    }
    before, after = [
        as_dict(few.filter(F.col("event_id") < end).groupBy("user_id").count())
        for end in (CUTS[1], CUTS[3])
    ]
    assert got == {
        k: ("MODIFIED" if k in before else "ADDED", before.get(k), n)
        for k, n in after.items()
        if before.get(k) != n
    }


def test_catalog_and_errors(spark, keyed):
    operators = catalog.discover_operators(spark, keyed).collect()
    assert len(operators) == 1 and len(operators[0]["keyed_states"]) == 5
    with pytest.raises(ValueError, match="no such state"):
        read(spark, keyed, "nothing").collect()
    with pytest.raises(ValueError, match="no such state"):
        read(spark, keyed, "event_count", batch_id=99).collect()
    kinds = {r["state_name"]: r["state_type"] for r in catalog.state_variables(spark, keyed).collect()}
    assert kinds["recent_values"] == "ListState" and kinds["category_counts"] == "MapState"


def test_offsets(spark, keyed):
    rows = st.read_source_offsets(spark, keyed).orderBy("batch_id").collect()
    assert [(r["job_id"], r["batch_id"], r["source"], r["committed"]) for r in rows] == [("keyed", i, 0, True) for i in range(3)]
    assert all(r["position"].startswith("{") and r["planned_ms"] > 0 for r in rows)


def test_views_of_a_stream(spark, keyed, tmp_path):
    base = keyed.rsplit("/", 1)[0]
    listed = views.list_snapshots(spark, base).collect()
    assert [r["snapshot"] for r in listed] == ["chk-2", "chk-1", "chk-0"]
    assert [r["snapshot"] for r in views.list_snapshots(spark, base, per_job=1).collect()] == ["chk-2"]
    browsed = views.browse(spark, base).orderBy("index").collect()
    assert [r["index"] for r in browsed] == [1, 2, 3]
    assert {r["operators"] for r in browsed} == {"0(keyed)"}

    store = PinStore(spark, str(tmp_path / "pins"))
    views.pin_checkpoint(spark, store, listed[1]["path"], "keyed", "savepoint-one")
    pin = store.lookup(listed[1]["path"])
    same = views.compare(spark, listed[1]["path"], pin)
    assert {r["status"] for r in same.select("status").distinct().collect()} == {"UNCHANGED"}
    typed = views.compare_operator(spark, pin, listed[1]["path"])
    assert {r["status"] for r in typed.select("status").distinct().collect()} == {"UNCHANGED"}
    assert typed.schema["left"].dataType["event_count"].dataType.typeName() == "long"
    changed = views.compare_operator(spark, pin, keyed).filter("status = 'MODIFIED'")
    names = {c["field_name"] for r in changed.collect() for c in r["field_changes"]}
    assert {"event_count", "running_average"} <= names
    every = views.compare_operators(spark, pin, keyed)
    assert {(r["operator_uid"], c["field_name"]) for r in every.collect() for c in r["field_changes"]} == {("0", n) for n in names}
    later = views.compare(spark, pin, keyed, state_name="event_count")
    assert {r["status"] for r in later.select("status").distinct().collect()} == {"MODIFIED"}
    found = views.browse(spark, str(tmp_path / "pins")).first()
    assert (found["type"], found["operators"]) == ("savepoint", "0(keyed)")


def test_inspect_filters(spark, keyed):
    rows = views.inspect(spark, keyed, "0", key_filter='"user_id":3', limit=2)
    found = rows.collect()
    assert len(found) == 2 and all('"user_id":3' in r["key"] and r["has_more"] for r in found)
    keys = views.inspect(spark, keyed, keys_only=True, limit=100_000)
    assert keys.count() == read(spark, keyed, "event_count").count()
    assert views.inspect(spark, keyed, "7").count() == 0
    with pytest.raises(ValueError, match="limit must be"):
        views.inspect(spark, keyed, limit=0)


def test_aggregation_accumulators(spark, few):
    checkpoint = feed(spark, few, single(jobs.value_aggregates), "aggregates")
    fields = ["total", "sum", "n"]
    found = st.read_aggregation_state(spark, checkpoint, fields, batch_id=1).select("key.user_id", *fields)
    expected = few.filter(F.col("event_id") < CUTS[2]).groupBy("user_id").agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("t"), F.count("*").alias("n")
    )
    assert {tuple(r) for r in found.collect()} == {
        (r["user_id"], r["t"], float(r["t"]), r["n"]) for r in expected.collect()
    }
    with pytest.raises(ValueError, match="the accumulator has 3 fields"):
        st.read_aggregation_state(spark, checkpoint, ["one"])
    entries = views.snapshot_entries(spark, checkpoint)
    assert entries.filter("operator_uid = '0' and state_kind = 'keyed'").count() == 6


def test_old_batches_go(spark, few):
    session = streaming_session(spark)
    session.conf.set("spark.sql.streaming.minBatchesToRetain", "1")
    base = work_dir(spark, "retain")
    for i in range(5):
        few.filter(F.col("event_id") % 5 == i).write.mode("append").parquet(f"{base}/input")
        stream = session.readStream.schema(few.schema).parquet(f"{base}/input")
        jobs.run_available(jobs.union_summary(stream), f"{base}/jobs/union")
    found = s.discover_snapshots(spark, f"{base}/jobs", "streaming")
    names = sorted(r["snapshot"] for r in found.collect())
    assert "chk-4" in names and "chk-0" not in names


def test_a_repeated_batch_meets_the_same_settings(spark, tmp_path):
    session = streaming_session(spark, 2)
    base, checkpoint = f"{tmp_path}/config", f"{tmp_path}/jobs/config"

    def settle(n, *entries):
        rows = spark.createDataFrame([(e, n) for e in entries], "entry string, seq long")
        rows.write.mode("append").parquet(base)
        stream = session.readStream.schema(rows.schema).parquet(base)
        jobs.run_available(jobs.config_upserts(stream), checkpoint)

    batch = spark.createDataFrame([(1, 7)], "event_id long, user_id long")
    output = f"{tmp_path}/output"
    write = enrich_into(checkpoint, output, ["threshold", "mode"])

    def found(n):
        row = spark.read.parquet(f"{output}/batch={n}").first()
        return row["threshold"], row["mode"]

    write(batch, 0)
    assert found(0) == ("unset", "unset")
    settle(0, "threshold=1", "mode=a")
    write(batch, 1)
    settle(1, "threshold=2")
    write(batch, 1)
    write(batch, 0)
    write(batch, 2)
    assert [found(n) for n in range(3)] == [("unset", "unset"), ("1", "a"), ("2", "a")]
    assert spark.read.parquet(output).count() == 3


def test_restart_from_a_pin(spark, few, keyed, by_user, tmp_path):
    """A pin of batch 1 starts a new checkpoint, which then folds in the rest of the events."""
    store = PinStore(spark, str(tmp_path / "pins"))
    views.pin_checkpoint(spark, store, f"{keyed}/offsets/1", "keyed", "savepoint-1")
    session = streaming_session(spark)
    states = views.typed_states(session, store.lookup(f"{keyed}/offsets/1"))
    few.filter(F.col("event_id") >= CUTS[2]).write.parquet(str(tmp_path / "input"))
    stream = session.readStream.schema(few.schema).parquet(str(tmp_path / "input"))
    checkpoint = str(tmp_path / "jobs" / "again")
    jobs.keyed_state(stream, str(tmp_path / "work"), checkpoint, RANGES, states)
    again, straight = (
        {r["key"]["user_id"]: r for r in st.read_all_states(spark, c).collect()} for c in (checkpoint, keyed)
    )
    assert again.keys() == straight.keys() == by_user.keys()
    for user, row in straight.items():
        assert again[user]["running_average"] == pytest.approx(row["running_average"], abs=1e-9)
        for name in ("event_count", "last_category", "recent_values", "category_counts"):
            assert again[user][name] == row[name]
