"""Token ids on disk as Re-Pair grammars, one per shard, with random access.

Documents are laid out in ascending id order by range partitions, and a partition
is cut into shards of whole documents. In a shard the most frequent pairs of
adjacent symbols are replaced by new symbols, round after round, until no pair is
frequent (``LEAST_COUNT``). A shard stores its rules, the number of ids each new symbol expands to,
what is left of the sequence, and its documents' ids and lengths; it is a row of a
Parquet table, so any store that Spark can write holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stateglass.llm.common import chunks, mix
from stateglass.llm.tokens import WordEncoder

# Ids of a shard; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
# Text encoded at once: each new word of it is looked up once.
ENCODED_BYTES = 10_000_000
# A pair is replaced while it occurs this often in the shard.
LEAST_COUNT = 12
# New symbols per round.
PAIRS_PER_ROUND = 4096

SHARD_SCHEMA = (
    "part int, seq int, n_ids long, base long, docs array<long>, lengths array<long>, "
    "rules binary, expansions binary, symbols binary"
)


def _frequent_pairs(codes: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair codes that occur ``least`` times or more, most frequent first.

    Equal counts are in no order of their codes, so that chains of equally frequent
    pairs have many that rank better than their neighbours.
    """
    ordered = np.sort(codes)
    edges = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    begins = np.concatenate([[0], edges])
    counts = np.diff(np.concatenate([begins, [len(ordered)]]))
    often = np.flatnonzero(counts >= least)
    scattered = mix(ordered[begins[often]].astype(np.uint64))
    order = often[np.lexsort((scattered, -counts[often]))][:most]
    return ordered[begins[order]], counts[order]


def _without_overlap(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which occurrences (places in ascending order, better ranks lower) are replaced.

    Of places that share a symbol only one that ranks better than its neighbours is
    taken, and in a run of one pair every second place; the rest wait for a later round.
    """
    taken = np.ones(len(at), bool)
    touching = np.diff(at) == 1
    key = rank
    if (touching & (rank[1:] == rank[:-1])).any():
        run = np.ones(len(at), bool)
        run[1:] = ~touching | (rank[1:] != rank[:-1])
        first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        key = 2 * rank + (np.arange(len(at)) - first) % 2
    taken[1:] &= ~touching | (key[1:] < key[:-1])
    taken[:-1] &= ~touching | (key[:-1] < key[1:])
    return taken


def compress(ids: np.ndarray, base: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, expansion lengths, symbols) of ids below ``base``; rule k makes symbol base + k."""
    sequence = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    lengths = np.ones(base, np.int64)
    symbols = base
    while len(sequence) > 1:
        # Codes of 32 bits sort fastest, as long as symbols fit.
        small = symbols <= 1 << 16
        if small:
            codes = (sequence[:-1] << np.uint32(16)) | sequence[1:]
        else:
            codes = (sequence[:-1].astype(np.uint64) << np.uint64(32)) | sequence[1:]
        shift = codes.dtype.type(16 if small else 32)
        pairs, _ = _frequent_pairs(codes, least, PAIRS_PER_ROUND)
        if not len(pairs):
            break
        lefts = (pairs >> shift).astype(np.int64)
        rights = (pairs & codes.dtype.type((1 << int(shift)) - 1)).astype(np.int64)
        # Ranks by (number among the left symbols, number among the right ones).
        (own_lefts, i), (own_rights, j) = (np.unique(x, return_inverse=True) for x in (lefts, rights))
        ranks = np.full((len(own_lefts) + 1, len(own_rights) + 1), -1, np.int16)
        ranks[i + 1, j + 1] = np.arange(len(pairs))
        left_number, right_number = np.zeros(symbols, np.int32), np.zeros(symbols, np.int32)
        left_number[own_lefts] = np.arange(1, len(own_lefts) + 1) * ranks.shape[1]
        right_number[own_rights] = np.arange(1, len(own_rights) + 1)
        rank = ranks.ravel()[left_number[sequence[:-1]] + right_number[sequence[1:]]]
        at = np.flatnonzero(rank >= 0)
        rank = rank[at].astype(np.int32)
        taken = _without_overlap(at, rank)
        at, rank = at[taken], rank[taken]
        sequence[at] = (symbols + rank).astype(np.uint32)
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        sequence = sequence[keep]
        rules.append(np.stack([lefts, rights], axis=1))
        lengths = np.concatenate([lengths, lengths[lefts] + lengths[rights]])
        symbols += len(pairs)
    all_rules = np.concatenate([np.zeros((0, 2), np.int64), *rules])
    return all_rules.astype(np.uint32), lengths[base:], sequence


class Grammar:
    """A stored shard, for reading ids from any place."""

    def __init__(self, base: int, rules: bytes, expansions: bytes, symbols: bytes):
        press = zstandard.ZstdDecompressor()
        self.base = base
        self.rules = np.frombuffer(press.decompress(rules), np.uint32).reshape(-1, 2)
        sizes = np.frombuffer(press.decompress(expansions), np.uint32).astype(np.int64)
        raw = press.decompress(symbols)
        width = np.uint16 if base + len(self.rules) <= 1 << 16 else np.uint32
        self.symbols = np.frombuffer(raw, width)
        new = self.symbols >= base
        lengths = np.ones(len(self.symbols), np.int64)
        lengths[new] = sizes[self.symbols[new].astype(np.int64) - base]
        #: Where the expansion of each symbol begins, and the end of the last.
        self.begins = np.concatenate([[0], np.cumsum(lengths)])
        self.lengths = lengths

    def _needed(self, symbols: np.ndarray) -> np.ndarray:
        """The rules that the symbols lead to, in order; a rule only uses symbols before its own."""
        needed = np.zeros(len(self.rules), bool)
        some = np.unique(symbols)
        while len(some := some[some >= self.base].astype(np.int64) - self.base):
            some = some[~needed[some]]
            needed[some] = True
            some = np.unique(self.rules[some])
        return np.flatnonzero(needed)

    def _expansions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids below ``base`` and those that the symbols stand for, and where each begins."""
        base, needed = self.base, self._needed(symbols)
        texts: dict[int, bytes] = {}
        for k, (a, b) in zip(needed.tolist(), self.rules[needed].tolist()):
            left = a.to_bytes(4, "little") if a < base else texts[a - base]
            texts[k] = left + (b.to_bytes(4, "little") if b < base else texts[b - base])
        sizes = np.zeros(len(self.rules), np.int64)
        sizes[needed] = np.fromiter(map(len, texts.values()), np.int64, len(texts)) // 4
        ids = np.concatenate([np.arange(base, dtype=np.uint32), np.frombuffer(b"".join(texts.values()), np.uint32)])
        return ids, np.concatenate([np.arange(base), base + np.cumsum(sizes) - sizes])

    def read(self, start: int, end: int) -> bytes:
        """Ids start to end - 1; only the rules that the symbols around them need are expanded."""
        if end <= start:
            return b""
        first = int(np.searchsorted(self.begins, start, "right")) - 1
        last = int(np.searchsorted(self.begins, end, "left"))
        ids, begins = self._expansions(self.symbols[first:last])
        lengths = self.lengths[first:last]
        shift = begins[self.symbols[first:last]] - (self.begins[first:last] - self.begins[first])
        found = ids[np.arange(int(lengths.sum())) + np.repeat(shift, lengths)]
        skip = start - int(self.begins[first])
        return found[skip : skip + end - start].tobytes()


def _shards(path: str, end_id: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        base = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        part, seq = TaskContext.get().partitionId(), 0
        docs: list = []
        held: list[bytes] = []
        size = 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), np.uint32)
            rules, expansions, symbols = compress(ids, base, least)
            width = np.uint16 if base + len(rules) <= 1 << 16 else np.uint32
            press = zstandard.ZstdCompressor(1)
            blobs = [rules.tobytes(), expansions.astype(np.uint32).tobytes(), symbols.astype(width).tobytes()]
            columns = [
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                pa.array([len(ids)], pa.int64()), pa.array([base], pa.int64()),
                pa.array([docs], pa.list_(pa.int64())), pa.array([[len(h) // 4 for h in held]], pa.list_(pa.int64())),
                *(pa.array([press.compress(b)], pa.binary()) for b in blobs),
            ]
            names = ["part", "seq", "n_ids", "base", "docs", "lengths", "rules", "expansions", "symbols"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for chunk in chunks(batches, limit=ENCODED_BYTES):
            coded = encoder.encode(chunk.column("text").to_pylist(), end_id)
            for doc, ids in zip(chunk.column("id").to_pylist(), coded):
                if held and size + len(ids) // 4 > SHARD_IDS:
                    yield shard()
                    docs, held, size, seq = [], [], 0, seq + 1
                docs.append(doc)
                held.append(ids)
                size += len(ids) // 4
        if held:
            yield shard()

    return run


def write_token_shards(
    docs: DataFrame,
    target: str,
    vocabulary: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_count: int = LEAST_COUNT,
) -> None:
    """Writes the ids of every text, and ``end_id`` behind each, to the folder ``target``.

    ``vocabulary`` is the path of a ``tokenizers`` file that workers can open. The
    order is by id, null ids first, and by text among rows that share an id; every
    row is a document. A null or empty text has the end id only. Other columns are
    not read. Without rows the table is empty. Pairs that occur less often than
    ``least_count`` in a shard stay as they are.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")
    )
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    ordered = ordered.sortWithinPartitions("id", "text")
    ordered.mapInArrow(_shards(vocabulary, end_id, least_count), SHARD_SCHEMA).write.parquet(target)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            first, n_ids, base, rules, expansions, symbols = (
                row.column(c)[0].as_py() for c in ("first", "n_ids", "base", "rules", "expansions", "symbols")
            )
            lengths = row.column("lengths").flatten()
            ends = np.cumsum(lengths.to_numpy())
            begins = ends - lengths.to_numpy()
            ids = Grammar(base, rules, expansions, symbols).read(0, n_ids)
            edges = pa.array(np.append(0, 4 * ends), pa.int32()).buffers()[1]
            column = pa.Array.from_buffers(pa.binary(), len(lengths), [None, edges, pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [row.column("docs").flatten(), pa.array(first + begins), lengths, column],
                names=["id", "start", "n_tokens", "ids"],
            )


def read_token_shards(spark: SparkSession, source: str) -> DataFrame:
    """``id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``.

    ``ids`` are little-endian unsigned 32-bit numbers. Starts come from the totals
    of range partitions, and from the shards before within one.
    """
    table = spark.read.parquet(source)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    in_part = F.sum("n_ids").over(before.partitionBy("part").orderBy("seq"))
    shards = table.select("part", "seq", "n_ids").withColumn("inner", F.coalesce(in_part, F.lit(0)))
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("total"))
    parts = parts.select("part", F.coalesce(F.sum("total").over(before.orderBy("part")), F.lit(0)).alias("outer"))
    bases = shards.join(parts, "part").select("part", "seq", (F.col("inner") + F.col("outer")).alias("first"))
    placed = table.join(bases, ["part", "seq"])
    return placed.mapInArrow(_documents, "id long, start long, n_tokens long, ids binary")
