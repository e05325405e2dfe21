"""Toxicity by a convolutional text classifier, trained and run in tasks with numpy.

A word is the sum of the embeddings of its hashed character n-grams and of the whole
word. Filters over one, two and three neighbouring words slide along the whole text,
the maximum of each over all places is kept, and a logistic layer scores it. The
first embedding dimension starts from how much more often than chance a feature is in
toxic texts; all parameters are then trained, on all labelled rows in rounds. On rows
left out of the training the score is calibrated: 0.3 is where it divides best, and each language gets the
threshold that divides best for it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from stateglass.llm.common import chunks, from_planes, mix, planes, written
from stateglass.llm.contamination import normal_words
from stateglass.operators.order import running_count
from stateglass.session import work_dir

BUCKETS = 1 << 17
DIMENSIONS = 12
FILTERS = 6
WIDTHS = (1, 2, 3)
GRAMS = (4, 5)
# Rounds of training; the table moves once in each.
EPOCHS = 8
BATCH = 64
# More labelled rows than this per turn take more turns, so that each row is in EPOCHS / turns rounds.
ROWS_A_TURN = 6000
TURNS = (1, 2, 4)
# Text a task trains on in a round. Each task sends a gradient as large as the table.
TRAINED_BYTES = 16_000_000
SLICES = 16
# Bits that stand for the labelled ids, 4 MB: at 5 million ids one in seven other texts is taken along.
LABEL_BITS = 1 << 25
# Bits in a row of Spark's bitmaps.
BITMAP_BITS = 32768
# Digits of the logits that thresholds are chosen from.
LOGIT_DIGITS = 3
# Text a task scores at once.
SCORED_BYTES = 1_000_000
# The score at which a text is taken for toxic when no language is given.
DIVIDE = 0.3
# Toxic rows of a language that its own threshold needs.
LEAST_TOXIC = 8
_PARTIAL = "slice int, blob binary"


class WordFeatures:
    """Hashed n-grams of distinct words, by kind, for sums of table rows per word."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(data))  # bytes up to the end of the word
        self.count = len(words)
        #: (words with features, where theirs begin, buckets)
        self.kinds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        powers = np.power(np.uint64(0x100000001B3), np.arange(int(sizes.max(initial=1)), dtype=np.uint64))
        if len(data):
            place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
            whole = np.add.reduceat((data + np.uint64(1)) * powers[place], ends - sizes)
            self._add(np.arange(len(words)), np.ones(len(words), np.int64), whole)
        for n in GRAMS:
            if len(data) < n:
                continue
            some = np.flatnonzero(left[: len(data) - n + 1] >= n)
            code = np.full(len(some), n, np.uint64)
            for k in range(n):
                code = code * np.uint64(257) + data[some + k]
            counts = np.maximum(sizes - n + 1, 0)
            own = np.flatnonzero(counts)
            self._add(own, counts[own], code)

    def _add(self, own: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> None:
        if len(own):
            begins = np.cumsum(counts) - counts
            self.kinds.append((own, begins, (mix(codes) % np.uint64(BUCKETS)).astype(np.int64)))

    def sums(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((self.count, table.shape[1]), np.float32)
        for own, begins, buckets in self.kinds:
            out[own] += np.add.reduceat(table[buckets], begins, axis=0)
        return out

    def spread(self, values: np.ndarray, table: np.ndarray) -> None:
        """Adds each word's row of ``values`` to the table rows of its features."""
        touched = values.any(axis=1)
        for own, begins, buckets in self.kinds:
            word = np.repeat(own, np.diff(np.append(begins, len(buckets))))
            some = touched[word]
            add_rows(table, buckets[some], values[word[some]])


def add_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """table[rows] += values, where rows may repeat."""
    width = table.shape[1]
    np.add.at(table.reshape(-1), (rows[:, None] * width + np.arange(width)).ravel(), values.ravel())


def numbered(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, word numbers of all texts, words per text)."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids, counts = [], []
    for text in texts:
        words = normal_words((text or b"").decode("utf-8", "replace").lower().encode())
        ids.extend(map(number.__getitem__, words))
        counts.append(len(words))
    return list(number), np.array(ids, np.int64), np.array(counts, np.int64)


def padded(ids: np.ndarray, counts: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with blanks behind each text for the widest filter, and where texts begin."""
    extra = max(WIDTHS)
    sizes = counts + extra
    begins = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), blank, np.int64)
    inner = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    out[np.repeat(begins, counts) + inner] = ids
    return out, begins


def side_by_side(filters: list[np.ndarray]) -> np.ndarray:
    """What a word adds to each filter at each place within it, as one matrix."""
    return np.concatenate([w[j] for w in filters for j in range(len(w))], axis=1).astype(np.float32)


def filter_responses(rows: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """All filters of all widths at every place; ``rows`` are words times ``side_by_side``."""
    size = len(tokens) - max(WIDTHS) + 1
    out = np.empty((size, FILTERS * len(WIDTHS)), np.float32)
    column = 0
    for k, width in enumerate(WIDTHS):
        total = out[:, k * FILTERS : (k + 1) * FILTERS]
        for j in range(width):
            part = rows[:, column : column + FILTERS].take(tokens[j : j + size], axis=0)
            if j:
                total += part
            else:
                total[:] = part
            column += FILTERS
    return out


@dataclass
class Model:
    table: np.ndarray  # embeddings by bucket
    filters: list[np.ndarray]  # by width: (width, DIMENSIONS, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    divide: float = DIVIDE
    by_language: dict | None = None

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        words, ids, counts = numbered(texts)
        if not len(counts):
            return np.zeros(0)
        rows = WordFeatures(words).sums(self.table) @ side_by_side(self.filters)
        rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)])
        tokens, begins = padded(ids, counts, len(words))
        responses = filter_responses(rows, tokens)
        # Filters that start in the last blanks of a text would see words of the next one.
        for k in range(1, max(WIDTHS)):
            responses[begins[1:] - k] = -np.inf
        pooled = np.maximum(np.maximum.reduceat(responses, begins, axis=0) + self.bias, 0)
        return pooled.astype(np.float64) @ self.out + self.offset

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        raw = self.scale * self.logits(texts) + self.shift
        return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def buckets_seen(texts: "Coded", toxic: np.ndarray, seen: np.ndarray) -> None:
    """Adds to ``seen`` how many texts of each class have a feature of each bucket."""
    features = texts.features
    if not features.kinds:
        return
    # Buckets of each word, by word.
    owners = np.concatenate([np.repeat(own, np.diff(np.append(b, len(k)))) for own, b, k in features.kinds])
    buckets = np.concatenate([k for _, _, k in features.kinds])
    order = np.argsort(owners, kind="stable")
    buckets = buckets[order]
    begins = np.searchsorted(owners[order], np.arange(features.count + 1))
    for text in range(len(texts.counts)):
        own = [buckets[begins[w] : begins[w + 1]] for w in np.unique(texts.of(text)).tolist()]
        if own:
            seen[int(toxic[text])][np.unique(np.concatenate(own))] += 1


def _unusual(seen: np.ndarray, share: float) -> np.ndarray:
    """Per bucket, by how many deviations it is in more toxic texts than by chance, squashed."""
    total = seen.sum(axis=0)
    deviation = (seen[1] - share * total) / np.sqrt(total * share * (1 - share) + 1)
    return np.tanh(np.sign(deviation) * np.maximum(np.abs(deviation) - 2.5, 0) / 3)


class Coded:
    """Texts as numbers of their distinct words."""

    def __init__(self, texts: list[bytes | None]):
        self.words, self.ids, self.counts = numbered(texts)
        self.features = WordFeatures(self.words)
        self.offsets = np.cumsum(self.counts) - self.counts

    def of(self, text: int) -> np.ndarray:
        return self.ids[self.offsets[text] : self.offsets[text] + self.counts[text]]


@dataclass
class Training:
    """A model on its way, with what Adam and Adagrad remember."""

    model: Model
    squares: np.ndarray  # of the gradients of the table
    moments: np.ndarray  # two rows, of the parameters but for the table
    step: int = 0

    def small(self) -> np.ndarray:
        """All parameters but for the table, in one row."""
        m = self.model
        return np.concatenate([*[w.ravel() for w in m.filters], m.out, m.bias, [m.offset]])

    def set_small(self, values: np.ndarray) -> None:
        m, at = self.model, 0
        for k, w in enumerate(m.filters):
            m.filters[k] = values[at : at + w.size].reshape(w.shape)
            at += w.size
        n = len(m.out)
        m.out, m.bias, m.offset = values[at : at + n], values[at + n : at + 2 * n], float(values[-1])

    def adam(self, gradient: np.ndarray, rate: float = 0.01) -> None:
        self.step += 1
        first, second = self.moments
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient**2 - second)
        moved = rate * (first / (1 - 0.9**self.step)) / (np.sqrt(second / (1 - 0.999**self.step)) + 1e-8)
        self.set_small(self.small() - moved)

    def move_table(self, gradient: np.ndarray) -> None:
        self.squares += gradient**2
        self.model.table -= 0.05 * gradient / np.sqrt(self.squares)


def started(seed: int) -> Training:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.02, (BUCKETS, DIMENSIONS)).astype(np.float32)
    filters = [rng.normal(0, 0.15, (w, DIMENSIONS, FILTERS)) for w in WIDTHS]
    for w in filters:
        w[0, 0, : FILTERS // 2] = rng.uniform(0.2, 0.6, FILTERS // 2)
    bias = np.zeros(FILTERS * len(WIDTHS))
    out = np.concatenate([np.where(np.arange(FILTERS) < FILTERS // 2, 0.3, 0.05)] * len(WIDTHS))
    training = Training(Model(table, filters, bias, out, -1.0), np.full(table.shape, 1e-2, np.float32), np.zeros(0))
    training.moments = np.zeros((2, len(training.small())))
    return training


def train_on(training: Training, texts: Coded, toxic: np.ndarray, balance: np.ndarray, rng, gradient: np.ndarray) -> None:
    """One pass: moves all but the table, whose gradient is added to ``gradient``."""
    model = training.model
    if not texts.words:
        return
    vectors = np.concatenate([texts.features.sums(model.table), np.zeros((1, DIMENSIONS), np.float32)])
    change = np.zeros_like(vectors)
    order = rng.permutation(len(toxic))
    for at in range(0, len(order), BATCH):
        some = order[at : at + BATCH]
        own = np.concatenate([texts.of(i) for i in some])
        tokens, begins = padded(own, texts.counts[some], len(texts.words))
        stop = np.append(begins[1:], len(tokens)) - max(WIDTHS) + 1
        x = vectors[tokens]
        z = filter_responses(x @ side_by_side(model.filters), np.arange(len(tokens)))
        top = np.array([b + z[b:e].argmax(axis=0) for b, e in zip(begins, stop)])
        pooled = np.maximum(z[top, np.arange(z.shape[1])] + model.bias, 0)
        logits = pooled @ model.out + model.offset
        slope = (1 / (1 + np.exp(-np.clip(logits, -35, 35))) - toxic[some]) * balance[some] / len(some)
        inner = slope[:, None] * model.out * (pooled > 0)
        gradients = []
        for k, (width, w) in enumerate(zip(WIDTHS, model.filters)):
            part = inner[:, k * FILTERS : (k + 1) * FILTERS]
            own_gradient = np.zeros_like(w)
            for j in range(width):
                place = top[:, k * FILTERS : (k + 1) * FILTERS] + j
                own_gradient[j] = np.einsum("nf,nfd->df", part, x[place])
                add_rows(change, tokens[place].ravel(), (part[:, :, None] * w[j].T).reshape(-1, DIMENSIONS))
            gradients.append((own_gradient + 1e-4 * w).ravel())
        training.adam(np.concatenate([*gradients, slope @ pooled + 1e-3 * model.out, inner.sum(axis=0), [slope.sum()]]))
    texts.features.spread(change[:-1], gradient)


def fit(texts: list[bytes], toxic: np.ndarray, weights: np.ndarray, seed: int = 7) -> Model:
    """Trains on whole texts of one task; both classes weigh the same in the loss."""
    training, rng = started(seed), np.random.default_rng(seed)
    coded = Coded(texts)
    if coded.words:
        seen = np.zeros((2, BUCKETS))
        buckets_seen(coded, toxic, seen)
        training.model.table[:, 0] = _unusual(seen, toxic.mean())
    balance = np.where(toxic, 0.5 / max(weights[toxic].sum(), 1e-9), 0.5 / max(weights[~toxic].sum(), 1e-9)) * weights * len(toxic)
    for _ in range(EPOCHS if coded.words else 0):
        gradient = np.zeros_like(training.model.table)
        train_on(training, coded, toxic, balance, rng, gradient)
        training.move_table(gradient)
    return training.model


def best_divide(scores: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> float:
    """The threshold with the best F1, in the middle between the scores beside it."""
    order = np.argsort(-scores, kind="stable")
    s, y, w = scores[order], toxic[order].astype(float), weights[order]
    hits, taken = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hits / (taken + (w * y).sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores are not divided
    at = int(f1.argmax())
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at])


def calibrate(model: Model, logits: np.ndarray, toxic: np.ndarray, counts: np.ndarray, languages: list) -> None:
    """Sets the scale and shift of the score and the thresholds by language.

    Each logit stands for ``counts`` rows of a class and a language.
    """
    if not toxic.any() or toxic.all():
        model.by_language = {}
        return
    a, b = 1.0, 0.0
    for _ in range(50):  # a logistic fit of two parameters, by Newton's method
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -35, 35)))
        g = np.array([((p - toxic) * counts * logits).sum() + 0.01 * (a - 1), ((p - toxic) * counts).sum() + 0.01 * b])
        v = p * (1 - p) * counts
        h = np.array([[(v * logits**2).sum() + 0.01, (v * logits).sum()], [(v * logits).sum(), v.sum() + 0.01]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    model.scale = max(a, 1e-3)
    divide = best_divide(logits, toxic, counts)
    # The score is moved so that it divides best at DIVIDE.
    model.shift = float(np.log(DIVIDE / (1 - DIVIDE)) - model.scale * divide)
    scores = 1 / (1 + np.exp(-np.clip(model.scale * logits + model.shift, -35, 35)))
    names = np.array([str(x) for x in languages])
    model.by_language = {}
    for name in sorted(set(names.tolist())):
        own = names == name
        if counts[own & toxic].sum() >= LEAST_TOXIC and counts[own & ~toxic].sum() >= LEAST_TOXIC:
            model.by_language[name] = best_divide(scores[own], toxic[own], counts[own])


def maybe_labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``docs`` with an id of ``known``, and few others, without a shuffle.

    Hashed ids are looked up in a bitmap of a fixed size, so that a join on ``id`` need
    not shuffle every text. Ids of unlike types are left to the join.
    """
    if docs.schema["id"].dataType != known.schema["id"].dataType:
        return docs
    names = [f"`{c}`" for c in docs.columns]
    code = F.pmod(F.xxhash64("id"), F.lit(LABEL_BITS))
    bucket, place = F.floor(code / BITMAP_BITS).alias("__bucket"), (code % BITMAP_BITS).alias("__place")
    bits = known.select(bucket, place).groupBy("__bucket").agg(F.bitmap_construct_agg("__place").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.expr("int(__place div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    found = docs.select(*names, bucket, place).join(F.broadcast(bits), "__bucket")
    return found.where(byte.bitwiseAND(F.expr("shiftleft(1, int(__place % 8))")) != 0).select(*names)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Every document with a label of 0 or 1: ``text, lang, label, turn``, written once.

    Ids with several labels keep the largest. Every fourth id of a class, in the order of
    a hash, has turn -1 and is left out of the training; the others take ``turns`` in it.
    ``docs`` has ``id``, ``text`` and ``lang``, ``labels`` has ``id`` and ``label``.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.max(label).cast("int").alias("label"))
    known = known.join(docs.select("id"), "id", "left_semi").withColumn("k", F.xxhash64("id", F.lit(1)))
    placed = written(running_count(known, ["label"], "k", "place").drop("k"), "labels")
    n = placed.count()
    turns = next(t for t in TURNS if n <= t * ROWS_A_TURN or t == TURNS[-1])
    turn = F.when(F.col("place") % 4 == 0, F.lit(-1)).otherwise(F.floor(F.col("place") / 4) % turns)
    own = placed.select("id", "label", turn.cast("int").alias("turn"))
    columns = [F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"), "label", "turn"]
    numbered_docs = docs.select("id", "text", "lang", F.monotonically_increasing_id().alias("row"))
    # A plan that is the same at any size: labels may be too many to broadcast.
    rows = maybe_labelled(numbered_docs, placed).join(own.hint("merge"), "id").select(*columns, "row")
    path = work_dir(spark, "labelled")
    rows = rows.sortWithinPartitions("turn", "row").drop("row")
    rows.write.partitionBy("turn").parquet(path, compression="zstd")
    return spark.read.schema(rows.schema).parquet(path)


def packed(values: np.ndarray) -> bytes:
    """The size of a float and all floats, compressed."""
    return str(values.itemsize).encode() + zstandard.compress(planes(values), 1)


def unpacked(blob: bytes) -> np.ndarray:
    """Floats of 4 or 8 bytes, as the first byte says, as those of 8."""
    data, size = zstandard.decompress(blob[1:]), int(blob[:1])
    return from_planes(data, f"f{size}", len(data) // size).astype(np.float64)


def sliced(values: np.ndarray) -> list[bytes]:
    return [packed(x) for x in np.array_split(values.ravel(), SLICES)]


def _sums(parts: DataFrame) -> dict[int, np.ndarray]:
    """Arrays of all tasks, added up slice by slice; what comes to the driver is of a fixed size."""

    def added(group: pa.Table) -> pa.Table:
        total = 0
        for blob in group.column("blob"):
            total = total + unpacked(blob.as_py())
        return pa.table({"slice": group.column("slice")[:1], "blob": pa.array([packed(total)], pa.binary())})

    rows = parts.groupBy("slice").applyInArrow(added, _PARTIAL).toArrow().to_pylist()
    return {r["slice"]: unpacked(r["blob"]) for r in rows}


def _partial(first: int, blobs: list[bytes]) -> pa.RecordBatch:
    numbers = pa.array(range(first, first + len(blobs)), pa.int32())
    return pa.RecordBatch.from_arrays([numbers, pa.array(blobs, pa.binary())], names=["slice", "blob"])


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, BUCKETS))
    for chunk in chunks(batches, limit=SCORED_BYTES):
        toxic = chunk.column("label").to_numpy(zero_copy_only=False) == 1
        buckets_seen(Coded(chunk.column("text").to_pylist()), toxic, seen)
    yield _partial(0, sliced(seen.astype(np.float32)))


def _round(shared, balance: tuple[float, float], seed: int):
    """A task's share of a round: what it adds to the gradient, and where it got, by its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        training = Training(replace(given.model, filters=list(given.model.filters)), given.squares, given.moments.copy(), given.step)
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        gradient, n = np.zeros_like(given.model.table), 0
        for chunk in chunks(batches, limit=SCORED_BYTES):
            toxic = chunk.column("label").to_numpy(zero_copy_only=False) == 1
            coded = Coded(chunk.column("text").to_pylist())
            train_on(training, coded, toxic, np.where(toxic, *balance), rng, gradient)
            n += len(toxic)
        if n:
            yield _partial(0, sliced(gradient))
            reached = np.concatenate([training.small(), training.moments.ravel(), [training.step, 1.0]])
            yield _partial(SLICES, [packed(n * reached)])

    return run


def train(docs: DataFrame, labels: DataFrame, seed: int = 7) -> Model:
    """A calibrated model from all labelled documents.

    ``docs`` has ``id``, ``text`` and ``lang``; ``labels`` has ``id`` and ``toxic``.
    Three in four labelled ids train and the fourth calibrates. In a round tasks train
    side by side from the same model; the gradients of the table are added up, the other
    parameters averaged. Many rows take turns in the rounds, each as often as any other.
    Without labels of both classes every score is the share of toxic rows.
    """
    spark = docs.sparkSession
    rows = labelled_rows(docs.where("text IS NOT NULL"), labels, "toxic")
    size = F.sum(F.octet_length("text")).alias("size")
    found = rows.groupBy("turn", "label").agg(F.count("*").alias("n"), size).collect()
    sizes = [sum(r["n"] for r in found if r["label"] == value) for value in (0, 1)]
    learnt = [sum(r["n"] for r in found if r["label"] == value and r["turn"] >= 0) for value in (0, 1)]
    training = started(seed)
    model = training.model
    if not all(learnt):
        share = sizes[1] / max(sum(sizes), 1) * 0.98 + 0.01
        model.out, model.offset, model.by_language = np.zeros_like(model.out), float(np.log(share / (1 - share))), {}
        return model

    def of_turn(turn: int | None) -> DataFrame:
        own = [r for r in found if r["turn"] >= 0 and turn in (None, r["turn"])]
        tasks = sum(r["size"] for r in own) // TRAINED_BYTES + 1
        some = rows.where("turn >= 0") if turn is None else rows.where(F.col("turn") == turn)
        return some.select("text", "label").coalesce(tasks)

    sums = _sums(of_turn(None).mapInArrow(_count_buckets, _PARTIAL))
    seen = np.concatenate([sums[i] for i in range(SLICES)]).reshape(2, BUCKETS)
    model.table[:, 0] = _unusual(seen, learnt[1] / sum(learnt))
    balance = (0.5 * sum(learnt) / learnt[1], 0.5 * sum(learnt) / learnt[0])
    turns = sorted({r["turn"] for r in found if r["turn"] >= 0})
    for number in range(EPOCHS):
        shared = spark.sparkContext.broadcast(training)
        parts = of_turn(turns[number % len(turns)]).mapInArrow(_round(shared, balance, seed + number), _PARTIAL)
        sums = _sums(parts)
        shared.destroy()
        reached = sums[SLICES][:-1] / sums[SLICES][-1]
        n = len(training.small())
        training.set_small(reached[:n])
        training.moments, training.step = reached[n:-1].reshape(2, n), round(reached[-1])
        training.move_table(np.concatenate([sums[i] for i in range(SLICES)]).astype(np.float32).reshape(model.table.shape))
    logit = F.round(_applied(spark, model, Model.logits)(F.col("text")), LOGIT_DIGITS)
    # Equal logits, to the digits kept, are one row, so this has a bound at any size.
    held = rows.where("turn = -1").select("lang", "label", logit.alias("logit")).groupBy("lang", "label", "logit").count()
    held = held.toArrow().sort_by([("logit", "ascending"), ("label", "ascending"), ("lang", "ascending")])
    values = {c: held.column(c).to_numpy() for c in ("logit", "label", "count")}
    calibrate(model, values["logit"], values["label"] == 1, values["count"].astype(float), held.column("lang").to_pylist())
    return model


def _applied(spark: SparkSession, model: Model, method):
    """A function of a text column: ``method`` of the model, which is of a fixed size."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for part in parts:
            batch = pa.RecordBatch.from_arrays([part], names=["text"])
            made = [method(own, c.column("text").to_pylist()) for c in chunks([batch], limit=SCORED_BYTES)]
            yield pa.array(np.concatenate([np.zeros(0), *made]), pa.float64())

    return run


def score_toxicity(docs: DataFrame, model: Model, result: str = "toxicity", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """All columns and a struct ``result`` with ``score``, ``threshold`` and ``toxic``.

    The score is from 0 to 1 and depends on the whole text only; a null text counts
    as empty and is scored too. ``threshold`` is that of the language in ``lang_col``,
    or the common one for languages that are null, unknown or rare in the labels, and
    ``toxic`` says that the score reaches it. A column called like ``result`` is
    replaced.
    """
    threshold = F.lit(model.divide)
    if lang_col and model.by_language:
        for name, value in model.by_language.items():
            threshold = F.when(F.col(f"`{lang_col}`") == name, F.lit(value)).otherwise(threshold)
    scored = docs.withColumn(result, _applied(docs.sparkSession, model, Model.scores)(F.col(f"`{text_col}`").cast("string").cast("binary")))
    value = F.col(f"`{result}`")
    return scored.withColumn(result, F.struct(value.alias("score"), threshold.alias("threshold"), (value >= threshold).alias("toxic")))
