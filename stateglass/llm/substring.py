"""Substring dedup: repeated windows of words, by Rabin-Karp hashes counted in Spark.

Every window of ``window`` consecutive words of a text gets a rolling polynomial
hash of 72 bits. A task keeps the first place of each hash it meets, marks the
other places at once, and sends (hash, place) of the first ones to the part of
the hash, where all places but the globally first are marked. Marked windows go
to the part of their document, merge there into maximal intervals, and the words
they cover are cut out. A passage that a third of all documents share is one
record per task, never one per document.

Two different windows are taken for equal with probability 2**-72 per pair: an
expected 1e-5 windows in a corpus of 30 GB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from stateglass.llm.common import (
    WordHashes,
    by_part,
    chunks,
    give_back,
    hash_words,
    mix,
    pack_places,
    part_count,
    part_of,
    unpack_places,
)

WINDOW = 20
# Text whose windows a task sorts at once.
SCANNED_BYTES = 4_000_000

# Odd bases, so that they have inverses modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_SECOND_BASE = 0xD1342543DE82EF95

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")

_SENT = "part int, kind int, keys binary, places binary"
_MARKED = "part int, places binary"
_RESULT = T.StructType().add("start", "long").add("end", "long")


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    inverse = pow(base, -1, 1 << 64)
    ups = np.full(n, base, np.uint64)
    downs = np.full(n, inverse, np.uint64)
    ups[0] = downs[0] = 1
    return np.multiply.accumulate(ups), np.multiply.accumulate(downs)


class RollingHash:
    """Polynomial hashes of all windows of a sequence of word hashes."""

    def __init__(self, base: int, window: int):
        self.base, self.window, self.size = base, window, 0

    def __call__(self, words: np.ndarray) -> np.ndarray:
        n = len(words)
        if n > self.size:
            self.size = max(n, 1 << 16)
            self.ups, self.downs = _powers(self.base, self.size)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.ups[:n], out=sums[1:])
        count = n - self.window + 1
        return mix((sums[self.window :] - sums[:count]) * self.downs[:count])


def _firsts(keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, starts: np.ndarray):
    """Masks by window: first of its hash, and not first (a later place of it).

    The windows come in ascending order of (id, start). Equal places, from rows
    that share an id, are neither.
    """
    n = len(keys)
    first, later = np.ones(n, bool), np.zeros(n, bool)
    order = np.argsort(keys)
    same = np.zeros(n + 1, bool)
    ordered = keys[order]
    same[1:n] = ordered[1:] == ordered[:-1]
    some = order[same[:-1] | same[1:]]
    if len(some):
        some = some[np.lexsort((some, checks[some], keys[some]))]
        head = np.ones(len(some), bool)
        head[1:] = (keys[some][1:] != keys[some][:-1]) | (checks[some][1:] != checks[some][:-1])
        leader = some[np.maximum.accumulate(np.where(head, np.arange(len(some)), 0))]
        first[some] = head
        later[some] = (ids[some] != ids[leader]) | (starts[some] != starts[leader])
    return first, later


def _marked_rows(ids: np.ndarray, starts: np.ndarray, parts: int):
    """(part, blob) of places by the part of their document."""
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    for part, at in by_part(part_of(mix(ids.view(np.uint64)), parts), parts):
        yield part, pack_places(ids[at], starts[at])


def _scan(window: int, parts: int, doc_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        roll, second = RollingHash(_BASE, window), RollingHash(_SECOND_BASE, window)
        for chunk in chunks(batches, limit=SCANNED_BYTES):
            chunk = chunk.filter(pc.and_(chunk.column("id").is_valid(), chunk.column("text").is_valid()))
            chunk = chunk.take(pc.sort_indices(chunk.column("id")))
            ids = chunk.column("id").to_numpy()
            lists = [text.split() for text in chunk.column("text").to_pylist()]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            words = np.concatenate([hash_words(x, known) for x in lists]) if lists else np.zeros(0, np.uint64)
            del lists
            if len(words) < window:
                continue
            ends = np.cumsum(lengths)
            count = len(words) - window + 1
            whole = np.arange(count) + window <= np.repeat(ends, lengths)[:count]
            keys = roll(words)[whole]
            checks = second(mix(words))[whole].astype(np.uint8)
            at = np.arange(len(words)) - np.repeat(ends - lengths, lengths)
            starts = at[:count][whole]
            owner = np.repeat(ids, lengths)[:count][whole]
            del words, at, whole
            first, later = _firsts(keys, checks, owner, starts)
            rows = []
            sent = np.flatnonzero(first)
            for part, some in by_part(part_of(keys[sent], parts), parts):
                some = sent[some]
                packed = keys[some].tobytes() + checks[some].tobytes()
                rows.append((part, 0, packed, pack_places(owner[some], starts[some])))
            for part, blob in _marked_rows(owner[later], starts[later], doc_parts):
                rows.append((part, 1, b"", blob))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.binary()),
                    pa.array([r[3] for r in rows], pa.binary()),
                ],
                names=["part", "kind", "keys", "places"],
            )

    return run


def _mark(doc_parts: int):
    """Marks all places of a hash but the first; marked places pass through."""

    def run(group: pa.Table) -> pa.Table:
        out, keys, checks, ids, starts = [], [], [], [], []
        columns = (group.column(c).to_pylist() for c in ("part", "kind", "keys", "places"))
        for part, kind, packed, places in zip(*columns):
            if kind == 1:
                out.append((part, places))
                continue
            owner, start = unpack_places(places)
            n = len(owner)
            keys.append(np.frombuffer(packed, np.uint64, n))
            checks.append(np.frombuffer(packed, np.uint8, n, 8 * n))
            ids.append(owner)
            starts.append(start)
        if keys:
            ids, starts = np.concatenate(ids), np.concatenate(starts)
            order = np.lexsort((starts, ids))
            ids, starts = ids[order], starts[order]
            keys, checks = np.concatenate(keys)[order], np.concatenate(checks)[order]
            _, later = _firsts(keys, checks, ids, starts)
            out.extend(_marked_rows(ids[later], starts[later], doc_parts))
            del keys, checks, ids, starts, order, later
            give_back()
        return pa.table(
            {
                "part": pa.array([p for p, _ in out], pa.int32()),
                "places": pa.array([b for _, b in out], pa.binary()),
            }
        )

    return run


def _pack(parts: int):
    """Texts compressed, each with the part of its id; rows without id are spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1)
        spread = 0
        for chunk in chunks(batches):
            ids = chunk.column("id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            part = part_of(mix(ids.fill_null(0).to_numpy().view(np.uint64)), parts).astype(np.int32)
            part[missing] = (np.arange(spread, spread + missing.sum()) * 7919) % parts
            spread += int(missing.sum())
            texts = [None if t is None else press.compress(t) for t in chunk.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), ids, pa.array(texts, pa.binary()), chunk.column("row")],
                names=["part", "id", "text", "row"],
            )

    return run


def _cover(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [start, end) that windows at the sorted starts cover."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window) + 1
    return list(zip(starts[np.r_[0, breaks]].tolist(), (starts[np.r_[breaks - 1, len(starts) - 1]] + window).tolist()))


def _without(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """The text without the words of the cuts and the white space behind each of them."""
    begins = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    edges = [0, *(begins[p] for cut in cuts for p in cut), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _cut(window: int, layout: bool):
    def run(docs: pa.Table, marked: pa.Table) -> pa.Table:
        found = [unpack_places(b) for b in marked.column("places").to_pylist()]
        owner = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])
        start = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        counts, spans, kept = [], [], []
        for doc, packed in zip(docs.column("id").to_pylist(), docs.column("text").to_pylist()):
            text = None if packed is None else zstandard.decompress(packed)
            words = (text or b"").split()
            cuts = []
            if doc is not None:
                a, b = np.searchsorted(owner, doc), np.searchsorted(owner, doc, "right")
                # Rows that share an id may be shorter than the one that was marked.
                cuts = [(s, min(e, len(words))) for s, e in _cover(np.unique(start[a:b]), window) if s < len(words)]
            counts.append(len(words))
            spans.append([{"start": s, "end": e} for s, e in cuts])
            if layout:
                kept.append(_without(text, cuts) if cuts else text)
                continue
            for s, e in reversed(cuts):
                del words[s:e]
            kept.append(b" ".join(words))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "id": docs.column("id"),
                "n_words": pa.array(counts, pa.int64()),
                "spans": pa.array(spans, span),
                "kept": pa.array(kept, pa.binary()),
                "row": docs.column("row"),
            }
        )

    return run


def remove_repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, layout: bool = False
) -> DataFrame:
    """One row per input row, without the words of windows that occur earlier.

    Words are runs of other characters than ASCII white space. A window is
    ``window`` consecutive words of one text; its words are removed if the same
    words also start at an earlier place (smaller id, or same id and earlier
    start). All windows are judged on the input.

    Columns: ``id``; ``n_words``; ``spans``, the maximal removed intervals of word
    positions as (start, end); ``kept``, the other words joined by one space; and
    ``row``, a struct of the other columns as they came, whatever their names. With
    ``layout``, ``kept`` is the text itself without the removed words and the white
    space behind each of them, and a null text stays null.

    A null text has no words and an empty one neither. A row with a null id is
    compared with nothing and kept whole. Rows that share an id count as one
    document: a place marked in one of them is removed in all, and equal places
    do not make each other later. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = part_count(spark)
    # Every part of hashes may answer to every part of documents, so these are fewer.
    doc_parts = -(-parts // 2)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"),
        F.struct(*others).alias("row"),
    )
    sent = rows.select("id", "text").mapInArrow(_scan(window, parts, doc_parts), _SENT)
    marked = sent.groupBy("part").applyInArrow(_mark(doc_parts), _MARKED)
    packed_schema = T.StructType().add("part", "integer").add("id", "long").add("text", "binary").add("row", rows.schema["row"].dataType)
    packed = rows.mapInArrow(_pack(doc_parts), packed_schema)
    result = (
        T.StructType().add("id", "long").add("n_words", "long").add("spans", T.ArrayType(_RESULT))
        .add("kept", "binary").add("row", rows.schema["row"].dataType)
    )
    cut = packed.groupBy("part").cogroup(marked.groupBy("part")).applyInArrow(_cut(window, layout), result)
    return cut.withColumn("kept", F.col("kept").cast("string"))
