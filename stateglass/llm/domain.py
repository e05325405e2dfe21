"""Cross-entropy difference: how much closer a text is to a target than to the corpus.

Two bigram models of one form and one vocabulary, all words of the corpus, are counted
over the whole corpus: one on the target rows, one on all rows. A text's score is the
mean over its tokens of the loss under the target model less that under the background
model, so a lower score is closer to the target.

The counts never leave the cluster, and there is no list of words. Texts are coded once
as batches with the 64-bit hashes of their distinct words. A batch asks each part of the
hashes for the words it has, once each, with its own counts; the part adds up all counts
and answers every batch in the order of the question. Bigrams are asked for in the same
way, and the batch puts both together on its tokens. A word or bigram that a third of
all tokens are is one number per batch.

Two of n words or bigrams are taken for one with probability n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from stateglass.llm.common import (
    WordHashes, chunks, from_planes, give_back, hash_words, mix, part_count, part_of, planes, written,
)
from stateglass.llm.contamination import normal_words

# Weight of the word probabilities in the smoothing of the bigrams.
PRIOR_COUNT = 20.0
# Stand for the place before a text and for its end among the hashes of words.
BEGIN_HASH, END_HASH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FACTOR = np.uint64(0xD1342543DE82EF95)

_BATCHES = (
    "batch long, docs array<long>, missing array<boolean>, lengths array<long>, targets array<boolean>, "
    "words binary, tokens binary, n_words long, n_words_target long, n_texts long, n_texts_target long"
)
_QUESTIONS = "part int, batch long, question binary"
_ANSWERS = "batch long, part int, answer binary, n_distinct long"


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as batches of numbers of their own distinct words."""
    known = WordHashes()
    number = TaskContext.get().partitionId() << 32
    for chunk in chunks(batches):
        lists = [normal_words(t) for t in chunk.column("text").to_pylist()]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        hashes = np.concatenate([np.zeros(0, np.uint64), *(hash_words(x, known) for x in lists)])
        del lists
        words, tokens = np.unique(hashes, return_inverse=True)
        inside = chunk.column("target").to_numpy(zero_copy_only=False).astype(bool)
        ids = chunk.column("id")
        row = [
            number,
            ids.fill_null(0).to_pylist(),
            ids.is_null().to_pylist(),
            lengths.tolist(),
            inside.tolist(),
            words.tobytes(),
            zstandard.compress(planes(tokens.astype(np.uint32)), 1),
            int(lengths.sum()),
            int(lengths[inside].sum()),
            int((lengths > 0).sum()),
            int((lengths[inside] > 0).sum()),
        ]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
        kinds += [pa.binary(), pa.binary()] + [pa.int64()] * 4
        names = [c.split()[0] for c in _BATCHES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)
        number += 1


def _by_key(keys: np.ndarray, parts: int) -> dict[int, np.ndarray]:
    """Positions by part of their hash, in ascending order of the hashes.

    Hashes of a part lie close together, so their differences are short.
    """
    order = np.argsort(keys)
    bounds = np.searchsorted(part_of(keys[order], parts), np.arange(parts + 1))
    return {int(p): order[bounds[p] : bounds[p + 1]] for p in np.flatnonzero(np.diff(bounds))}


class Batch:
    """A batch of texts: its words and bigrams by token, and which part has the distinct ones."""

    def __init__(self, row: dict, parts: int):
        self.words = np.frombuffer(row["words"], np.uint64)
        raw = zstandard.decompress(row["tokens"])
        self.tokens = from_planes(raw, np.uint32, len(raw) // 4).astype(np.int64)
        self.lengths, self.parts = np.array(row["lengths"], np.int64), parts
        self.inside = np.array(row["targets"], bool)

    def word_parts(self) -> dict[int, np.ndarray]:
        return _by_key(self.words, self.parts)

    def word_counts(self) -> tuple[np.ndarray, np.ndarray]:
        inside = np.repeat(self.inside, self.lengths)
        size = len(self.words)
        return np.bincount(self.tokens, minlength=size), np.bincount(self.tokens[inside], minlength=size)

    def pair(self) -> None:
        """Finds the bigrams; the end of a text is a word, the place before it may come before one."""
        n = len(self.words)
        self.full = np.flatnonzero(self.lengths)
        self.sizes = self.lengths[self.full] + 1  # with the end
        ends = np.cumsum(self.sizes)
        self.begins = ends - self.sizes
        following = np.full(int(self.sizes.sum()), n, np.int64)
        inner = np.ones(len(following), bool)
        inner[ends - 1] = False
        following[inner] = self.tokens
        before = np.empty_like(following)
        before[1:] = following[:-1]
        before[self.begins] = n + 1
        codes, self.place = np.unique(before * (n + 2) + following, return_inverse=True)
        self.before, self.following = np.divmod(codes, n + 2)
        hashes = np.concatenate([self.words, [END_HASH, BEGIN_HASH]])
        self.keys = mix(mix(hashes[self.before]) * _FACTOR + hashes[self.following])

    def pair_parts(self) -> dict[int, np.ndarray]:
        return _by_key(self.keys, self.parts)

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        inside = np.repeat(self.inside[self.full], self.sizes)
        size = len(self.keys)
        return np.bincount(self.place, minlength=size), np.bincount(self.place[inside], minlength=size)


def _ask(parts: int, bigrams: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                own = Batch(row, parts)
                if bigrams:
                    own.pair()
                keys, by = (own.keys, own.pair_parts()) if bigrams else (own.words, own.word_parts())
                everywhere, target = own.pair_counts() if bigrams else own.word_counts()
                questions = []
                for some in by.values():
                    counts = planes(everywhere[some].astype(np.uint32)) + planes(target[some].astype(np.uint32))
                    questions.append(zstandard.compress(planes(np.diff(keys[some], prepend=np.uint64(0))) + counts, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(by), pa.int32()), pa.array([row["batch"]] * len(by), pa.int64()), pa.array(questions, pa.binary())],
                    names=["part", "batch", "question"],
                )
                give_back()

    return run


def _answer(group: pa.Table) -> pa.Table:
    """The counts of all batches together, for each question in its order."""
    keys, counts = [], []
    for question in group.column("question").to_pylist():
        raw = zstandard.decompress(question)
        n = len(raw) // 16
        keys.append(np.cumsum(from_planes(raw[: 8 * n], np.uint64, n), dtype=np.uint64))
        counts.append(np.stack([from_planes(raw[4 * n * i : 4 * n * (i + 1)], np.uint32, n) for i in (2, 3)]))
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(place, c, len(distinct)).astype(np.uint64) for c in np.concatenate(counts, axis=1)]
    edges = np.cumsum([0, *map(len, keys)]).tolist()
    answers = []
    for a, b in zip(edges, edges[1:]):
        some = place[a:b]
        answers.append(zstandard.compress(planes(sums[0][some]) + planes(sums[1][some]), 1))
    return pa.table(
        {
            "batch": group.column("batch"),
            "part": group.column("part"),
            "answer": pa.array(answers, pa.binary()),
            "n_distinct": pa.array([len(distinct)] * len(answers), pa.int64()),
        }
    )


def _filled(size: int, by: dict[int, np.ndarray], answers: list[tuple[int, bytes]]) -> np.ndarray:
    """Counts by model, target first, from the answers of the parts."""
    found = np.zeros((2, size))
    for part, answer in answers:
        some, raw = by[part], zstandard.decompress(answer)
        n = len(some)
        found[1, some], found[0, some] = (from_planes(raw[8 * n * i : 8 * n * (i + 1)], np.uint64, n) for i in (0, 1))
    return found


def _score(parts: int, classes: int, totals: tuple[int, int], texts: tuple[int, int]):
    """``classes`` of words; tokens and texts of the target and of all rows."""

    def differences(own: Batch, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        losses = []
        for model in (0, 1):
            counts = np.concatenate([words[model], [texts[model], texts[model]]])
            single = (counts[own.following] + 1) / (totals[model] + texts[model] + classes)
            losses.append(-np.log((pairs[model] + PRIOR_COUNT * single) / (counts[own.before] + PRIOR_COUNT)))
        return losses[0] - losses[1]

    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        ids, missing, scores, sizes = [], [], [], []
        rows = list(zip(*(answers.column(c).to_pylist() for c in ("part", "answer", "bigrams"))))
        for row in batch.to_pylist():
            own = Batch(row, parts)
            own.pair()
            words = _filled(len(own.words), own.word_parts(), [r[:2] for r in rows if not r[2]])
            pairs = _filled(len(own.keys), own.pair_parts(), [r[:2] for r in rows if r[2]])
            score = np.full(len(own.lengths), np.nan)
            if len(own.full):
                values = differences(own, words, pairs)
                score[own.full] = np.add.reduceat(values[own.place], own.begins) / own.sizes
            ids += row["docs"]
            missing += row["missing"]
            scores.append(score)
            sizes.append(own.lengths)
        score = np.concatenate([np.zeros(0), *scores])
        give_back()
        return pa.table(
            {
                "id": pa.array(np.array(ids, np.int64), pa.int64(), mask=np.array(missing, bool)),
                "n_words": pa.array(np.concatenate([np.zeros(0, np.int64), *sizes])),
                "difference": pa.array(score, pa.float64(), mask=np.isnan(score)),
            }
        )

    return run


def domain_scores(docs: DataFrame, target: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_words`` and ``difference``, one row per input row.

    ``target`` is a condition on the columns of ``docs``; a null condition is false.
    Words are runs of ASCII letters and digits, lower-cased, and of all characters
    beyond ASCII. The models share all words of all rows. With N tokens, each text's end
    included, p(w) is (count + 1) / (N + words + 2), and a bigram's probability is
    (count + PRIOR_COUNT * p(w)) / (count of the first + PRIOR_COUNT).

    ``difference`` is the mean of target loss less background loss over the words and
    the end of the whole text, in nats. Texts that are null or without words have
    none. Rows may share an id or have none; each is scored by itself. Without target
    rows the target model is uniform; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"),
        F.coalesce(target, F.lit(False)).alias("target"),
    )
    parts = part_count(spark)
    batches = written(rows.mapInArrow(_code, _BATCHES), "batches")

    def answers(bigrams: bool) -> DataFrame:
        asked = batches.mapInArrow(_ask(parts, bigrams), _QUESTIONS)
        return asked.groupBy("part").applyInArrow(_answer, _ANSWERS).withColumn("bigrams", F.lit(bigrams))

    words = written(answers(False), "word-counts")
    # One number per part.
    distinct = words.groupBy("part").agg(F.max("n_distinct").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    names = ("n_words_target", "n_words", "n_texts_target", "n_texts")
    sums = batches.agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in names]).first()
    score = _score(parts, distinct + 2, tuple(sums[:2]), tuple(sums[2:]))
    pairs = batches.groupBy("batch").cogroup(words.unionByName(answers(True)).groupBy("batch"))
    return pairs.applyInArrow(score, "id long, n_words long, difference double")
