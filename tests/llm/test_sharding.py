"""Shards against a plain schedule of all groups."""

import random
import zlib
from collections import defaultdict

import pytest

from stateglass.llm import sharding
from stateglass.llm.sharding import schedule, shard_rows, write_shards

SCHEMA = "doc_id long, text string"


def plain_shards(rows, shards):
    """Loads of the plain method: every group by itself, a scan for the least load."""
    groups = defaultdict(int)
    for _, text in rows:
        groups[text or ""] += len((text or "").encode()) + 8
    loads = [0] * shards
    for size in sorted(groups.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    return loads


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = [(i, "w" * rng.randrange(0, 300) + rng.choice("aé")) for i in range(n)]
    rows += [(rng.randrange(n), "hot text") for _ in range(n // 2)]
    rows += [(None, None), (5, None), (6, ""), (6, ""), (None, "x" * 5000)]
    rng.shuffle(rows)
    return rows


def check(spark, rows, shards):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = shard_rows(frame, shards=shards).collect()
    assert sorted((r.id, r.size, r.text_crc32) for r in got if r.id is not None) == sorted(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows if i is not None
    )
    assert len(got) == len(rows)
    loads, slots = defaultdict(int), defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    together = defaultdict(set)
    for r in got:
        together[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in together.values())
    return [loads[s] for s in range(shards)]


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_every_group_by_itself_is_the_plain_schedule(spark, monkeypatch, shards):
    monkeypatch.setattr(sharding, "LARGE", 100_000)
    rows = random_rows(shards, 300)
    assert sorted(check(spark, rows, shards)) == sorted(plain_shards(rows, shards))


@pytest.mark.parametrize("large", [2, 20])
def test_bundles_level_shards(spark, monkeypatch, large):
    monkeypatch.setattr(sharding, "LARGE", large)
    monkeypatch.setattr(sharding, "BUNDLES", 4)
    rows = [(i, f"{i} " + "w" * (i % 40)) for i in range(6000)] + [(i, "hot") for i in range(900)]
    loads = check(spark, rows, 5)
    # The last jobs are of the size of a text, so the loads are almost level.
    assert max(loads) - min(loads) <= 100


def test_schedule_takes_largest_first():
    assert schedule([(2, "a"), (9, "b"), (4, "c"), (4, "d"), (1, "e")], 2) == [1, 0, 1, 1, 0]
    assert schedule([], 3) == []


def test_written_shards_read_back(spark, tmp_path):
    rows = random_rows(1, 50)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS digest", "2 AS bundle", "'x' AS `a.b`")
    write_shards(frame, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [*frame.columns, "shard"]
    assert sorted(map(repr, back.drop("shard").collect())) == sorted(map(repr, frame.collect()))
    empty = spark.createDataFrame([], SCHEMA)
    assert shard_rows(empty).count() == 0
