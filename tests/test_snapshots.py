import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stateglass.sources import snapshots as s, storage


def touch(path: Path, text: str = "x", at: int | None = None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if at is not None:
        os.utime(path, (at, at))


@pytest.fixture()
def pinned(tmp_path):
    for job, name, whole, at in (
        ("job-abc123", "chk-1", True, 1000),
        ("job-abc123", "chk-2", False, 3000),
        ("job-xyz", "savepoint-abc", True, 2000),
        ("job-xyz", "shared", True, 9000),
        ("", "savepoint-top", True, 4000),
    ):
        folder = tmp_path / job / name
        touch(folder / "data" / "part-0.parquet", "12345", at)
        if whole:
            touch(folder / s.MARKER, "{}", at)
    return str(tmp_path)


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
@pytest.mark.parametrize("suffix", ["", "/"])
def test_pinned_layout(spark, pinned, prefix, suffix):
    found = {r["snapshot"]: r for r in s.discover_snapshots(spark, prefix + pinned + suffix).collect()}
    assert {n: (r["job_id"], r["type"], r["valid"]) for n, r in found.items()} == {
        "chk-1": ("job-abc123", "checkpoint", True),
        "chk-2": ("job-abc123", "checkpoint", False),
        "savepoint-abc": ("job-xyz", "savepoint", True),
        "savepoint-top": (None, "savepoint", True),
    }
    assert found["chk-1"]["path"].endswith("/job-abc123/chk-1")
    assert found["chk-1"]["modification_time"].timestamp() == 1000


def test_sizes_and_children(spark, pinned):
    sizes = {r["snapshot"]: (r["size_bytes"], r["n_files"]) for r in s.snapshot_sizes(spark, pinned).collect()}
    assert sizes["chk-1"] == (7, 2) and sizes["chk-2"] == (5, 1)
    children = s.list_children(s.discover_snapshots(spark, pinned))
    assert {r["name"] for r in children.collect()} == {"job-abc123", "job-xyz", Path(pinned).name}


def test_nothing_there(spark, tmp_path):
    assert s.discover_snapshots(spark, str(tmp_path / "nowhere")).count() == 0
    assert s.discover_snapshots(spark, str(tmp_path), "streaming").count() == 0
    with pytest.raises(ValueError, match="unknown layout"):
        s.discover_snapshots(spark, str(tmp_path), "other")


def test_streaming_layout(spark, tmp_path):
    for batch in range(3):
        touch(tmp_path / "job" / "offsets" / str(batch))
    for batch in range(2):
        touch(tmp_path / "job" / "commits" / str(batch))
    touch(tmp_path / "job" / "state" / "0" / "0" / "1.zip")
    found = {r["snapshot"]: r for r in s.discover_snapshots(spark, str(tmp_path), "streaming").collect()}
    assert {n: r["valid"] for n, r in found.items()} == {"chk-0": True, "chk-1": True, "chk-2": False}
    assert found["chk-2"]["path"].endswith("/job/offsets/2") and found["chk-2"]["job_id"] == "job"


def test_probe(spark, pinned, tmp_path):
    found = s.probe_sources(spark, f"{pinned}, {tmp_path}/none,,nosuchscheme://x/y").collect()
    assert {r["source"]: r["n_snapshots"] for r in found} == {
        pinned: 4, f"{tmp_path}/none": 0, "nosuchscheme://x/y": 0
    }
    assert s.probe_sources(spark, "").count() == 0


def test_merged_once(spark, pinned):
    found = s.discover_snapshots(spark, pinned)
    both = s.merge_listings(s.of_type(found, "checkpoint"), found)
    assert both.count() == 4


def test_storage_options():
    found = storage.storage_options(
        {
            "aws.region": "eu-west-1",
            "aws.endpoint": "http://localhost:1",
            "aws.path-style-access": "true",
            "aws.access-key-id": "a",
            "aws.secret-access-key": "b",
        }
    )
    assert found == {
        "fs.s3a.endpoint.region": "eu-west-1",
        "fs.s3a.endpoint": "http://localhost:1",
        "fs.s3a.path.style.access": "true",
        "fs.s3a.access.key": "a",
        "fs.s3a.secret.key": "b",
    }
    with pytest.raises(ValueError, match="given together"):
        storage.storage_options({"aws.access-key-id": "a"}, {"AWS_DEFAULT_REGION": "x"})
    with pytest.raises(ValueError, match="set AWS_PROFILE=p"):
        storage.storage_options({"aws.profile": "p"})
    assert storage.storage_options({"aws.profile": "p"}, {"AWS_PROFILE": "p", "AWS_DEFAULT_REGION": "x"}) == {
        "fs.s3a.aws.credentials.provider": storage.PROFILE_PROVIDER,
        "fs.s3a.endpoint.region": "x",
    }
    assert storage.storage_options({"aws.profile": "default"})["fs.s3a.endpoint.region"] == storage.DEFAULT_REGION
    assert storage.hadoop_conf({"gcs.project": "p"}) == {"spark.hadoop.fs.gs.project.id": "p"}
    with pytest.raises(ValueError, match="unknown storage options: x"):
        storage.storage_options({"x": "1"})
    assert storage.hadoop_path("s3://b/k") == "s3a://b/k"
    assert storage.hadoop_path("gs://b/k") == "gs://b/k"


def test_positions_of_any_json(spark):
    from stateglass.sources.state import source_positions

    lines = {
        0: '{"logOffset":4}', 1: '{"t":{"0":10,"1":-5},"u":{"0":"77"}}', 2: "12", 3: "-", 4: "[1,{\"a\":2}]",
        5: '{"x":true,"y":1.5,"z":null}', 6: "", 7: None,
    }
    rows = [("j", b, 1, s, p, True) for b in (0, 1) for s, p in lines.items()]
    frame = spark.createDataFrame(rows, "job_id string, batch_id long, planned_ms long, source int, position string, committed boolean")
    found = {(r["batch_id"], r["source"], r["partition"]): (r["position"], r["advance"]) for r in source_positions(frame).collect()}
    want = {(0, "logOffset"): 4, (1, "t/0"): 10, (1, "t/1"): -5, (1, "u/0"): 77, (2, ""): 12, (4, "0"): 1, (4, "1/a"): 2}
    assert found == {**{(0, *k): (v, None) for k, v in want.items()}, **{(1, *k): (v, 0) for k, v in want.items()}}


def test_settings_by_columns(spark):
    rows = spark.createDataFrame([("a", "s3://b/k"), (None, "gs://b")], "region string, uri string")
    made = storage.setting_rows(rows, {"aws.region": F.col("region"), "aws.endpoint": F.lit("http://h")})
    found = {(r["region"], r["setting"]): r["value"] for r in made.collect()}
    for region in ("a", None):
        options = storage.storage_options({"aws.endpoint": "http://h", **({"aws.region": region} if region else {})}, {})
        assert {s: v for (r, s), v in found.items() if r == region} == options
    assert [r[0] for r in rows.select(storage.hadoop_path_column(F.col("uri"))).collect()] == ["s3a://b/k", "gs://b"]
    with pytest.raises(ValueError, match="unknown storage options: x"):
        storage.setting_rows(rows, {"x": F.lit("1")})
