"""Packing token sequences by minimum bin slack.

Each text becomes ids; what fills whole sequences is cut off first and the rest goes
to the pool of its task. A sequence then takes the longest piece of the pool and the
multiset of other lengths that comes closest to its capacity: a subset-sum over the
distinct lengths, as bits of one integer, backtracked to a count of each length. The
pool is only as large as a slice of texts plus a small carry, so no task holds more;
its last ids are cut into pieces whose totals are powers of two, which need no padding.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stateglass.llm.common import chunks
from stateglass.llm.tokens import WordEncoder

CAPACITY = 2048
END_ID = 1
# Pieces that wait for the next slice, so that its pool can still fill exactly.
CARRY = 512
# Words a worker remembers besides its pool.
REMEMBERED = 200_000
# Sequences a task can number.
_PER_TASK = 1 << 36

PIECE_SCHEMA = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def best_fill(counts, lengths: list[int], room: int) -> dict[int, int]:
    """How many pieces of each length fill ``room`` closest without exceeding it.

    ``lengths`` are the distinct lengths in descending order, ``counts`` how many
    pieces there are of each. Longer pieces are preferred among equal fills.
    """
    reach, full, steps = 1, (1 << room + 1) - 1, []
    for length in lengths:
        for _ in range(min(counts[length], room // length) if length <= room else 0):
            more = reach | (reach << length & full)
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach >> room:
            break
    left, taken = reach.bit_length() - 1, defaultdict(int)
    for length, before in reversed(steps):
        if not before >> left & 1:
            taken[length] += 1
            left -= length
    return taken


class Counts:
    """How many pieces of a length there are, without a copy of the pool."""

    def __init__(self, pieces: dict[int, deque]):
        self.pieces = pieces

    def __getitem__(self, length: int) -> int:
        return len(self.pieces.get(length, ()))


class Pool:
    """Pieces by length, first come first taken among equals."""

    def __init__(self):
        self.pieces: dict[int, deque] = {}
        self.size = 0

    def add(self, length: int, piece) -> None:
        self.pieces.setdefault(length, deque()).append(piece)
        self.size += 1

    def take(self, length: int):
        queue = self.pieces[length]
        piece = queue.popleft()
        if not queue:
            del self.pieces[length]
        self.size -= 1
        return piece

    def sequences(self, capacity: int, keep: int) -> Iterator[list]:
        """Fills until at most ``keep`` pieces are left, or a sequence cannot be filled."""
        lengths = sorted(self.pieces, reverse=True)
        total = sum(length * len(queue) for length, queue in self.pieces.items())
        while self.size > keep and total >= capacity:
            while lengths and lengths[0] not in self.pieces:
                lengths.pop(0)
            if len(lengths) > 2 * len(self.pieces) + 16:
                lengths = [x for x in lengths if x in self.pieces]
            longest = lengths[0]
            sequence = [(longest, self.take(longest))]
            for length, n in best_fill(Counts(self.pieces), lengths, capacity - longest).items():
                sequence.extend((length, self.take(length)) for _ in range(n))
            total -= sum(length for length, _ in sequence)
            yield sequence


def _pack(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path, REMEMBERED)
        pool = Pool()
        number = TaskContext.get().partitionId() * _PER_TASK
        out: list[tuple] = []

        def place(sequence: list[tuple[int, tuple]]) -> None:
            """A piece is (id, its document's start, ids, tokens of the document)."""
            nonlocal number
            offset = 0
            for length, (doc, start, ids, tokens) in sequence:
                out.append((doc, start, length, tokens, number, offset, ids))
                offset += length
            number += 1

        def batch() -> pa.RecordBatch:
            names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]
            kinds = [pa.int64()] * 6 + [pa.binary()]
            columns = zip(*out) if out else [[]] * 7
            made = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        for chunk in chunks(batches):
            coded = encoder.encode(chunk.column("text").to_pylist(), end_id)
            for doc, ids in zip(chunk.column("id").to_pylist(), coded):
                tokens = len(ids) // 4
                for start in range(0, tokens, capacity):
                    piece = (doc, start, ids[4 * start : 4 * (start + capacity)], tokens)
                    length = min(capacity, tokens - start)
                    if length == capacity:
                        place([(length, piece)])
                    else:
                        pool.add(length, piece)
            for sequence in pool.sequences(capacity, CARRY):
                place(sequence)
            yield batch()
        for sequence in pool.sequences(capacity, 0):
            place(sequence)
        for sequence in power_sequences(pool, capacity):
            place(sequence)
        yield batch()

    return run


def power_sequences(pool: Pool, capacity: int) -> Iterator[list]:
    """The rest of a pool in sequences whose lengths are powers of two; pieces are cut."""
    rest = deque((length, pool.take(length)) for length in sorted(pool.pieces, reverse=True) for _ in range(len(pool.pieces[length])))
    total = sum(length for length, _ in rest)
    while total:
        size = min(1 << total.bit_length() - 1, 1 << capacity.bit_length() - 1)
        total -= size
        sequence = []
        while size:
            length, piece = rest.popleft()
            part = min(length, size)
            doc, start, ids, tokens = piece
            sequence.append((part, (doc, start, ids[: 4 * part], tokens)))
            if part < length:
                rest.appendleft((length - part, (doc, start + part, ids[4 * part :], tokens)))
            size -= part
        yield sequence


def pack_texts(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: where it comes from, where it goes, and its ids.

    Columns: ``id``; ``start``, its document's ids before it; ``length``;
    ``doc_tokens``, the document's ids with ``end_id``; ``sequence_id`` and
    ``offset``, its place; ``ids``, little-endian unsigned 32-bit numbers. The
    pieces of a sequence follow each other without gaps. A sequence below
    ``capacity`` is to be padded, unless its length is a power of two.

    ``vocabulary`` is the path of a ``tokenizers`` file that workers can open. A
    null, empty or blank text is its end id alone. Every row is a document, also if
    it has a null id or shares one. Other columns are not read. Without rows there
    are no pieces. A sequence holds texts of one task only: nothing is shuffled.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")
    )
    return rows.mapInArrow(_pack(vocabulary, end_id, capacity), PIECE_SCHEMA)


def padded_length(length, capacity: int = CAPACITY):
    """The length a sequence of ``length`` ids takes, as a column."""
    power = F.bit_count(length) == 1
    return F.when(power, length).otherwise(F.lit(capacity).cast("long"))
