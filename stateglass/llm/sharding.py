"""Shards of near equal size by longest processing time first.

Rows of equal text stay together. Groups go from the largest to the smallest to the shard
with the least load, which a heap gives.

As a Spark job: rows are counted and sized by digest of their text (map-side partial
sums, so a text that a third of all rows have costs one row per task). Groups of at least
1/``LARGE`` of a shard are scheduled one by one; there are fewer than shards times
``LARGE``. All smaller groups are bundled by hash: half of their mass into
``BUNDLES`` bundles per shard, a quarter into as many bundles of half the size, and so on
for ``TIERS`` tiers, so that the last jobs are small enough to level the shards. So the
heap works on a number of jobs that depends on the shards and not on the rows. Slots come
from measured ranges (``global_index``), less the rows of the shards before.

Defined cases: a null text has no bytes and is a group with the empty texts; null and
repeated ids are rows like others; an empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stateglass.llm.common import written
from stateglass.operators.order import global_index

SHARDS = 24
LARGE = 512
BUNDLES = 16
TIERS = 11
# Bytes that a row costs beside its text.
ROW_BYTES = 8


def schedule(sizes: Sequence[tuple[int, int]], shards: int) -> list[int]:
    """The shard of each (bytes, tie-breaker) job: largest first, to the least loaded."""
    loads = [(0, s) for s in range(shards)]
    chosen = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k][0], sizes[k][1])):
        load, shard = loads[0]
        heapq.heapreplace(loads, (load + sizes[k][0], shard))
        chosen[k] = shard
    return chosen


@dataclass
class ShardPlan:
    """The shard of each large group and of each bundle, with rows and bytes by shard."""

    large: DataFrame
    bundles: DataFrame
    rows: list[int]
    loads: list[int]
    shards: int


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _bundle(digest: Column, shards: int) -> Column:
    """The bundle of a small group: a tier by leading zeros of one hash, a place by another."""
    bits = F.xxhash64(digest, F.lit(1)).bitwiseAND(F.lit((1 << TIERS) - 1))
    tier = F.lit(TIERS) - F.length(F.bin(bits))
    return tier.cast("long") * (BUNDLES * shards) + F.pmod(F.xxhash64(digest), F.lit(BUNDLES * shards))


def plan_shards(sized: DataFrame, shards: int = SHARDS) -> ShardPlan:
    """The schedule of ``sized`` rows (``size``, ``digest``)."""
    spark = sized.sparkSession
    groups = sized.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = written(groups, "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least = max(total / (shards * LARGE), 1)
    # Fewer than shards * LARGE rows can be that large, as they add up to the total.
    large = groups.where(F.col("bytes") >= least).select(F.hex("digest").alias("key"), "bytes", "n")
    small = (
        groups.where(F.col("bytes") < least)
        .groupBy(_bundle(F.col("digest"), shards).alias("bundle"))
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        .select(F.format_string("%d", "bundle").alias("key"), "bytes", "n")
    )
    found = small.collect() + large.collect()
    chosen = schedule([(r.bytes, r.key) for r in found], shards)
    rows, loads = [0] * shards, [0] * shards
    for job, shard in zip(found, chosen):
        rows[shard] += job.n
        loads[shard] += job.bytes
    # Digests have more digits than the number of any bundle.
    big = [(bytearray.fromhex(j.key), s) for j, s in zip(found, chosen) if len(j.key) == 64]
    bundles = [(j.key, s) for j, s in zip(found, chosen) if len(j.key) < 64]
    return ShardPlan(
        spark.createDataFrame(big, "digest binary, large_shard int"),
        spark.createDataFrame(bundles, "bundle string, bundle_shard int"),
        rows,
        loads,
        shards,
    )


def assign_shards(rows: DataFrame, plan: ShardPlan) -> DataFrame:
    """``rows`` (with ``digest``) with their ``shard``: two lookups in tables of bounded size."""
    bundle = F.format_string("%d", _bundle(F.col("digest"), plan.shards))
    return (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(plan.large), "digest", "left")
        .join(F.broadcast(plan.bundles), "bundle", "left")
        .withColumn("shard", F.coalesce("large_shard", "bundle_shard"))
        .drop("bundle", "large_shard", "bundle_shard")
    )


def shard_rows(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: ``id, size, text_crc32, shard, slot``; slots are gapless by shard."""
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    sized = docs.select(
        F.col(f"`{id}`").alias("id"),
        (F.octet_length(value) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        text_digest(F.col(f"`{text}`")).alias("digest"),
        # Only tells rows apart that are equal in all else.
        F.monotonically_increasing_id().alias("row"),
    )
    sized = written(sized, "shard-sizes")
    plan = plan_shards(sized, shards)
    placed = global_index(assign_shards(sized, plan), ["shard", "id", "digest", "row"], "at")
    before = [sum(plan.rows[:s]) for s in range(shards)]
    first = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("shard") + 1)
    return placed.select("id", "size", "text_crc32", "shard", (F.col("at") - 1 - first).alias("slot"))


def write_shards(docs: DataFrame, target: str, id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """Documents as Parquet folders ``shard=N``, in order of id; several files per shard if large.

    A column of the documents called ``shard`` is left out.
    """
    digest = text_digest(F.col(f"`{text}`"))
    sized = docs.select(
        (F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        digest.alias("digest"),
    )
    plan = plan_shards(sized, shards)
    names = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    placed = assign_shards(docs.select(F.struct(*names).alias("row"), digest.alias("digest")), plan)
    key = F.col("row")[f"c{docs.columns.index(id)}"]
    columns = [F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns) if c != "shard"]
    ordered = placed.repartitionByRange("shard", key, "digest").sortWithinPartitions("shard", key, "digest")
    ordered.select(*columns, "shard").write.partitionBy("shard").parquet(target)
