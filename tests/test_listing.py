"""Folders listed in tasks."""

import os

import pytest
from pyspark.sql import functions as F

from stateglass.sources import listing, snapshots as s


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """200 jobs with 20 snapshots each, every third without its marker."""
    base = tmp_path_factory.mktemp("many")
    for job in range(200):
        for n in range(20):
            folder = base / f"job {job}%" / (f"chk-{n}" if n % 2 else f"savepoint-{n}")
            os.makedirs(folder / "data")
            if (job + n) % 3:
                (folder / listing.MARKER).write_text("{}")
    return str(base)


def test_thousands_of_folders(spark, many):
    found = s.discover_snapshots(spark, many)
    assert found.count() == 4000 and found.filter("valid").count() == sum((j + n) % 3 > 0 for j in range(200) for n in range(20))
    assert found.groupBy("type").count().select("count").distinct().collect() == [(2000,)]
    one = found.filter("job_id = 'job 7%' and snapshot = 'chk-3'").first()
    assert one["path"] == f"file:{many}/job 7%/chk-3" and one["valid"]


def test_tasks_list(spark, many):
    """The names come from tasks: none of them is in the plan, and many tasks list."""
    found = listing.listed_pins(spark, [many])
    plan = found._jdf.queryExecution().toString()
    assert "chk-" not in plan and "job 7" not in plan
    assert found.groupBy(F.spark_partition_id()).count().count() > 1


def test_sources_are_a_column(spark, many):
    sources = [f"{many}/job {i}%" for i in range(50)] + [f"{many}/none", "nosuch://a/b", "hdfs://nowhere:1/x", many]
    found = {r["source"]: r["n_snapshots"] for r in s.probe_sources(spark, sources).collect()}
    assert found == {**{x: 20 for x in sources[:50]}, f"{many}/none": 0, "nosuch://a/b": 0, "hdfs://nowhere:1/x": 0, many: 4000}


def test_other_stores_are_listed_by_the_driver(spark, many, monkeypatch):
    here = sorted(map(tuple, s.discover_snapshots(spark, f"{many}/job 1%").collect()))
    sizes = sorted(map(tuple, s.snapshot_sizes(spark, f"{many}/job 1%").collect()))
    monkeypatch.setattr(listing, "_TASK_SCHEMES", set())
    assert sorted(map(tuple, s.discover_snapshots(spark, f"{many}/job 1%").collect())) == here
    assert sorted(map(tuple, s.snapshot_sizes(spark, f"{many}/job 1%").collect())) == sizes and len(sizes) == 20


def test_paths_of_stores():
    store = listing.Store({"fs.s3a.endpoint": "http://host:9", "fs.s3a.endpoint.region": "r", "fs.s3a.access.key": "a", "fs.s3a.secret.key": "b"})
    assert store.open("s3a://bucket/a/b")[1] == "bucket/a/b"
    assert store.open("file:///a/b c")[1] == "/a/b c" == store.open("file:/a/b c")[1] == store.open("/a/b c")[1]


def test_files_are_written_by_tasks(spark, tmp_path):
    rows = spark.range(50).select(F.format_string(f"file:{tmp_path}/d%d/f", "id").alias("path"), F.col("id").cast("string").alias("text"))
    assert listing.write_files(rows) == 50
    assert (tmp_path / "d49" / "f").read_text() == "49"
