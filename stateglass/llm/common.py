"""What the operators share: words as arrays, blobs for shuffles, written tables.

Large sets of small records (every window, every variant) are shuffled as blobs:
a task sorts what it has by target part and sends one row per part with packed
arrays, so that a record costs about its own information and no row header.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from stateglass.session import work_dir

# Parts per shuffle partition: several, so that hashing parts to partitions is even.
PARTS_PER_PARTITION = 3
# Words a task works on at once; a single longer text is still taken whole.
CHUNK_WORDS = 1_000_000
CHUNK_BYTES = 6_000_000
# Entries a worker keeps in a word cache. Only speed depends on it.
CACHED_WORDS = 300_000

_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut of the lineage."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def part_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions")) * PARTS_PER_PARTITION


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    holder = sys.modules.setdefault("_stateglass_worker_caches", types.ModuleType("caches"))
    return holder.__dict__.setdefault(name, {})


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = values ^ (values >> np.uint64(30))
    x = x * _MIX_1
    x ^= x >> np.uint64(27)
    x *= _MIX_2
    return x ^ (x >> np.uint64(31))


def part_of(hashed: np.ndarray, parts: int) -> np.ndarray:
    """The part of each well-mixed 64-bit hash, by its upper half."""
    return ((hashed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, positions in ascending order) for every part that occurs."""
    small = part.astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(small, kind="stable")
    bounds = np.searchsorted(small[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), order[bounds[p] : bounds[p + 1]]


def planes(values: np.ndarray) -> bytes:
    """Bytes by significance, so that small numbers leave long runs of zeros."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, n).T.copy().view(dtype).ravel()


def pack_places(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """Sorted (document, position) pairs as differences, compressed."""
    ids = ids.astype(np.int64, copy=False)
    raw = planes(np.diff(ids, prepend=np.int64(0))) + planes(starts.astype(np.uint32))
    return len(ids).to_bytes(4, "little") + zstandard.compress(raw, 1)


def unpack_places(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    raw = zstandard.decompress(blob[4:])
    ids = np.cumsum(from_planes(raw[: 8 * n], np.int64, n))
    return ids, from_planes(raw[8 * n :], np.uint32, n).astype(np.int64)


def give_back() -> None:
    """Returns memory that a worker has freed to the machine.

    Workers wait for their next task, and what they only keep in reserve counts
    against the executor meanwhile.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES):
    """Slices of the batches with about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        yield from _slices(batch, text, limit)
    give_back()


def _slices(batch: pa.RecordBatch, text: str, limit: int):
    if batch.num_rows:
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes.astype(np.int64)) // limit
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class WordHashes(dict):
    """XXH64 by word, worked out once per word as long as there is room."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


def hash_words(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
