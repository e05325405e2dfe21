"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a value between them
that each reaches with about half of the flips. So every distinct fingerprint
emits all variants within half the radius, equal variants meet in one part, and
the pairs that meet are verified and deduplicated. For radius 3 the halves are 1
and 2: a distance of 3 changes the parity of the bit count, so fingerprints of
even parity take the 2 and the others the 1. Of three differing bits two lie in
the same half of the word, so the even side flips two bits of one half only: 1057
variants on that side and 65 on the other, and no pair within the radius is missed.

Members of one variant are linked to one of them that needed at most one flip, not
to each other: its distance to all others is within the radius, which gives the
same components with one link per member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from stateglass.llm.common import by_part, from_planes, mix, part_count, part_of, planes, written
from stateglass.llm.components import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
# Fingerprints whose variants a task makes at once.
BALLS = 4000
# Texts are hashed in groups of about this many shingles.
GROUP_SHINGLES = 500_000

# Spreads the bits of a byte over the bytes of a word, bit 0 lowest.
_SPREAD = (
    ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1))
    << (np.arange(8, dtype=np.uint64) * np.uint64(8))
).sum(axis=1, dtype=np.uint64)


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> list[int]:
    """XXH64 of every shingle of a text, lower-cased in A-Z; repeats are kept."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist())]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per group of consecutive hashes, the bits set in over half of them; 0 for none.

    Bits are counted eight at a time in the bytes of a word, which holds up to 255.
    """
    result = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return result
    sizes = counts[full]
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    begin = np.repeat(np.cumsum(sizes) - sizes, pieces)
    begin += 255 * (np.arange(len(begin)) - np.repeat(first, pieces))
    bits = np.zeros(len(full), np.uint64)
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[by_byte[:, k]], begin)
        totals = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for i in range(8):
            bits |= (2 * totals[:, i] > sizes).astype(np.uint64) << np.uint64(8 * k + i)
    result[full] = bits
    return result


def fingerprints(texts: list[bytes | None], shingle: int) -> np.ndarray:
    """The SimHash of each text; zero for texts without words."""
    out, hashes, counts, total = [], [], [], 0
    for text in texts:
        found = shingle_hashes(text or b"", shingle)
        hashes.append(np.array(found, np.uint64))
        counts.append(len(found))
        total += len(found)
        if total > GROUP_SHINGLES:
            out.append(majority_bits(np.concatenate(hashes), np.array(counts)))
            hashes, counts, total = [], [], 0
    if counts:
        out.append(majority_bits(np.concatenate(hashes), np.array(counts)))
    return np.concatenate([np.zeros(0, np.uint64), *out])


def with_fingerprint(docs: DataFrame, text_col: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """All columns and the SimHash of the text as a signed long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints(texts.to_pylist(), shingle).view(np.int64))

    return docs.withColumn(name, simhash(F.col(f"`{text_col}`").cast("string").cast("binary")))


def ball_masks(radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Flips of even and of odd fingerprints, and how many of them are of the inner half.

    Flips are ordered by their number of bits; those of the inner half come first.
    """
    if not 0 <= radius <= 3:
        raise ValueError("balls are made for a radius of 0 to 3")
    one = [1 << i for i in range(64)]
    two = [1 << i | 1 << j for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]
    inner = [0] + (one if radius >= 2 else [])
    outer = inner + {1: one, 3: two}.get(radius, [])
    return np.array(outer, np.uint64), np.array(inner, np.uint64), len(inner)


def _emit(radius: int, parts: int):
    even_masks, odd_masks, _ = ball_masks(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(prints), BALLS):
                some = prints[at : at + BALLS]
                odd = (np.bitwise_count(some) & 1).astype(bool)
                variants, codes = [], []
                for own, masks in ((some[~odd], even_masks), (some[odd], odd_masks)):
                    variants.append((masks[:, None] ^ own[None, :]).ravel())
                    codes.append(np.repeat(np.arange(len(masks), dtype=np.uint16), len(own)))
                variants, codes = np.concatenate(variants), np.concatenate(codes)
                part, keys, flips = [], [], []
                for p, where in by_part(part_of(mix(variants), parts), parts):
                    part.append(p)
                    keys.append(variants[where].tobytes())
                    flips.append(zstandard.compress(planes(np.diff(codes[where], prepend=np.uint16(0))), 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(flips, pa.binary())],
                    names=["part", "keys", "flips"],
                )

    return run


def _meet(radius: int):
    masks, _, inner = ball_masks(radius)

    def run(group: pa.Table) -> pa.Table:
        keys, codes = [], []
        for packed, flips in zip(group.column("keys").to_pylist(), group.column("flips").to_pylist()):
            own = np.frombuffer(packed, np.uint64)
            diffs = from_planes(zstandard.decompress(flips), np.uint16, len(own))
            keys.append(own)
            codes.append(np.cumsum(diffs, dtype=np.uint16))
        keys, codes = np.concatenate(keys), np.concatenate(codes)
        order = np.argsort(keys)
        keys, codes = keys[order], codes[order]
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[1:] == keys[:-1]
        met = same[:-1] | same[1:]
        keys, codes = keys[met], codes[met]
        order = np.lexsort((codes, keys))
        keys, codes = keys[order], codes[order]
        prints = keys ^ masks[codes]
        head = np.ones(len(keys), bool)
        head[1:] = keys[1:] != keys[:-1]
        leader = np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))
        linked = ~head & (codes[leader] < inner)
        a, b = prints[leader][linked], prints[linked]
        near = np.bitwise_count(a ^ b) <= radius
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[near], axis=0)
        return pa.table({"a": pa.array(pairs[:, 0].view(np.int64)), "b": pa.array(pairs[:, 1].view(np.int64))})

    return run


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints ``fp`` that join all within the radius.

    Each link is a verified pair, once; pairs within the radius that have no link
    of their own are joined by links through a third fingerprint.
    """
    spark = prints.sparkSession
    parts = part_count(spark)
    # Few bytes become many variants: keep the tasks that adaptive execution would merge.
    spread = prints.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    sent = spread.mapInArrow(_emit(radius, parts), "part int, keys binary, flips binary")
    return sent.groupBy("part").applyInArrow(_meet(radius), "a long, b long").distinct()


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """``id``, ``fingerprint`` (long) and ``component``, one row per input row.

    A shingle is ``shingle`` consecutive words of the text, lower-cased in A-Z and
    joined by a space, repeats included; a shorter text is one shingle. A bit of
    the fingerprint is set if over half of the shingle hashes have it. Documents
    are linked if their fingerprints differ in at most ``radius`` bits, and
    ``component`` is the smallest id that links lead to.

    Texts that are null, empty or white space have fingerprint zero and are linked
    like any other. Null ids never name a component that has another id; a
    component of null ids only has none. Rows that share an id are separate rows.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    prints = written(with_fingerprint(rows, "text", "fp", shingle).select("id", "fp"), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    roots = connected_components(near_links(classes, radius))
    linked = classes.join(roots, F.col("fp") == F.col("node"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("lowest"))
    lowest = roots.join(lowest, "root").select(F.col("node").alias("fp"), "lowest")
    named = classes.join(lowest, "fp", "left").select("fp", F.least("low", "lowest").alias("component"))
    return prints.join(written(named, "named"), "fp").select("id", F.col("fp").alias("fingerprint"), "component")
