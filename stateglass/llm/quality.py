"""Quality by positive-unlabelled learning.

Trusted good texts are the positives; the other side is unlabelled web text, which is
a mixture of good and bad. With the class prior known, the risk of a classifier on
good and bad texts can be written with these two samples alone, and its estimate of
the part due to bad texts is kept from going negative. Samples train it; the prior and
the threshold rest on the scores of all unlabelled texts, counted in Spark: no region of scores can hold a smaller share of the unlabelled
than the prior times its share of the positives. The classifier is a small network
over figures of style: which characters, what words, which repeats.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stateglass.llm.common import chunks, written

# The model is fitted on at most so many rows of each kind.
POSITIVE_ROWS = 3000
UNLABELLED_ROWS = 5000
HIDDEN = 16
EPOCHS = 40
BATCH = 250
RATE = 0.005
# The score that divides good from bad.
DIVIDE = 0.3
DECAY = 1e-4
# Bounds of the bins that logits are counted in, and the share of rows on either side of
# the prior's quantile among which the dividing place is sought.
EDGES = np.linspace(-35, 35, 8193)
REACH = 0.04

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = np.zeros(256, np.int64)  # 0: control and others
for _i, _ranges in enumerate(((97, 123), (65, 91), (48, 58), (32, 33), (10, 11), (128, 256)), 1):
    _CLASSES[_ranges[0] : _ranges[1]] = _i
_N_CLASSES = 7


def features(text: bytes | None) -> np.ndarray:
    """Figures of the whole text; all zero for one without words."""
    words = (text or b"").split()
    if not words:
        return np.zeros(_N_CLASSES + len(_PUNCTUATION) + 14)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, n = len(text), len(words)
    classes = np.bincount(_CLASSES, counts, _N_CLASSES) / size
    marks = counts[np.frombuffer(_PUNCTUATION, np.uint8)] / n
    letters = max(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum(), 1)
    upper = sum(map(bytes.isupper, words))
    alpha = sum(map(bytes.isalpha, words))
    repeated = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_counts = Counter(lines)
    ends = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines)
    pairs = Counter(zip(words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, n)
    rest = [
        np.log1p(n), np.log1p(len(lines)), lengths.mean(), np.log1p(lengths.max()), (lengths == 1).mean(),
        upper / n, alpha / n, len(repeated) / n, max(repeated.values()) / n,
        1 - len(line_counts) / len(lines), max(line_counts.values()) / len(lines), ends / len(lines),
        1 - len(pairs) / max(n - 1, 1), counts[65:91].sum() / letters,
    ]
    return np.concatenate([classes, np.log1p(20 * marks), rest])


def feature_rows(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t) for t in texts]) if texts else np.zeros((0, _N_CLASSES + len(_PUNCTUATION) + 14))


@dataclass
class Network:
    mean: np.ndarray
    spread: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    prior: float = 0.5

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.spread, -6, 6)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.scaled(rows) @ self.inner + self.inner_bias, 0) @ self.outer + self.outer_bias

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(rows))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _new_network(rows: np.ndarray, rng: np.random.Generator) -> Network:
    spread = rows.std(axis=0)
    inner = rng.normal(0, 1 / np.sqrt(rows.shape[1]), (rows.shape[1], HIDDEN))
    return Network(rows.mean(axis=0), np.where(spread > 1e-9, spread, 1), inner, np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0)


def non_negative_slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the non-negative unbiased risk at the logits of both samples.

    The risk under the logistic loss is prior * E+[l(g)] + max(0, Eu[l(-g)] - prior * E+[l(-g)]).
    Where the second part is negative, only it is stepped back.
    """
    loss = lambda x: np.logaddexp(0, -x)
    as_negative = loss(-unlabelled).mean() - prior * loss(-positive).mean()
    on_unlabelled = _sigmoid(unlabelled) / len(unlabelled)
    on_positive = -prior * _sigmoid(positive) / len(positive)
    if as_negative < 0:
        return -on_positive, -on_unlabelled
    return on_positive - prior * _sigmoid(-positive) / len(positive), on_unlabelled


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 3) -> Network:
    """A network of least non-negative risk on rows of features."""
    rng = np.random.default_rng(seed)
    net = _new_network(np.concatenate([positive, unlabelled]), rng)
    net.prior = prior
    p, u = net.scaled(positive), net.scaled(unlabelled)
    values = [net.inner, net.inner_bias, net.outer, np.array([net.outer_bias])]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    steps = max(1, -(-len(u) // BATCH))
    for _ in range(EPOCHS):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        for some_p, some_u in zip(np.array_split(order_p, steps), np.array_split(order_u, steps)):
            if not len(some_p) or not len(some_u):
                continue
            x = np.concatenate([p[some_p], u[some_u]])
            hidden = np.maximum(x @ values[0] + values[1], 0)
            logits = hidden @ values[2] + values[3]
            slope = np.concatenate(non_negative_slopes(logits[: len(some_p)], logits[len(some_p) :], prior))
            back = slope[:, None] * values[2] * (hidden > 0)
            gradients = [x.T @ back + DECAY * values[0], back.sum(axis=0), hidden.T @ slope + DECAY * values[2], np.array([slope.sum()])]
            step += 1
            for k, g in enumerate(gradients):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                values[k] = values[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.inner, net.inner_bias, net.outer, net.outer_bias = *values[:3], float(values[3][0])
    return net


# Gives the counts of all unlabelled logits by the edges that divide them.
Counted = Callable[[Network, np.ndarray], np.ndarray]


def histogram(logits: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many are below the first edge, from the first to below the second, and so on."""
    return np.bincount(np.searchsorted(edges, logits, "right"), minlength=len(edges) + 1)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that the scores of all unlabelled rows allow.

    ``unlabelled`` is their histogram by the distinct values of ``positive``. For every
    threshold the share of unlabelled rows above it, less what the counts leave
    uncertain, is at least the prior times the share of positives above it.
    """
    cuts = np.unique(positive)
    total = max(unlabelled.sum(), 1)
    above_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above_u = np.cumsum(unlabelled[::-1])[::-1][1:] / total
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(total))
    # The bound is tightest where it is least uncertain.
    bounds, wide = above_u / above_p, (above_u + slack) / np.maximum(above_p - slack, 1e-9)
    usable = above_p > slack
    if not usable.any():
        return 0.5
    at = np.flatnonzero(usable)[wide[usable].argmin()]
    return float(np.clip(bounds[at], 0.01, 0.99))


def dividing_logit(counts: np.ndarray, edges: np.ndarray, prior: float) -> float:
    """Where the unlabelled rows are thinnest, near the logit above which the prior's share lies.

    ``counts`` is the histogram of all of them by evenly spaced ``edges``. Near are those
    within ``REACH`` of the rows; of equally thin places the middle of the longest is taken.
    """
    below = np.cumsum(counts) / max(counts.sum(), 1)
    low, high = (int(np.searchsorted(below, 1 - prior + r)) for r in (-REACH, REACH))
    low, high = max(low, 1), min(max(high, low + 1), len(edges) - 1)
    width = max(1, (high - low) // 32)
    thin = np.convolve(counts, np.ones(width), "same")[low : high + 1]
    least = np.concatenate([[False], thin == thin.min(), [False]])
    turns = np.flatnonzero(np.diff(least.astype(int)))
    begins, ends = turns[::2], turns[1::2]
    k = int((ends - begins).argmax())
    # Bin i lies between edge i - 1 and edge i.
    return float((edges[low + begins[k] - 1] + edges[min(low + ends[k] - 1, len(edges) - 1)]) / 2)


def train_pu(positive: np.ndarray, unlabelled: np.ndarray, counted: Counted | None = None) -> Network:
    """The prior from a first network on half of the rows, then the network for it.

    The prior and the place that divides come from ``counted``, the scores of all
    unlabelled rows; without it, from the rows given. The scores are moved so that
    ``DIVIDE`` is at that place.
    """
    if counted is None:
        counted = lambda net, edges: histogram(net.logits(unlabelled), edges)
    half_p, half_u = np.arange(len(positive)) % 2 == 0, np.arange(len(unlabelled)) % 2 == 0
    first = fit(positive[half_p], unlabelled[half_u], 0.5)
    held = first.logits(positive[~half_p])
    prior = estimate_prior(held, counted(first, np.unique(held)))
    net = fit(positive, unlabelled, prior)
    net.outer_bias += np.log(DIVIDE / (1 - DIVIDE)) - dividing_logit(counted(net, EDGES), EDGES, prior)
    return net


def train(
    docs: DataFrame, positives: DataFrame, labelled: DataFrame, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS
) -> Network:
    """A network from trusted positives and unlabelled documents.

    ``docs`` has ``id`` and ``text``; ``positives`` has the ``id`` of trusted rows,
    ``labelled`` the ``id`` of all rows that are not to count as unlabelled. The network
    learns from at most ``positive_rows`` and ``unlabelled_rows`` documents, chosen by the
    hash of the id; the class prior and the threshold come from the scores of all
    unlabelled documents. With fewer than four of either kind every score is one half.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            made = [row.tobytes() for row in feature_rows(chunk.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([chunk.column("id"), chunk.column("k"), pa.array(made, pa.binary())], names=["id", "k", "row"])

    # Texts are measured once; after that a document is some hundred bytes.
    rows = docs.where("id IS NOT NULL").select("id", F.xxhash64("id", "text").alias("k"), F.col("text").cast("binary").alias("text"))
    rows = written(rows.mapInArrow(measure, rows.drop("text").schema.add("row", "binary")), "features")
    unlabelled = written(rows.join(labelled.select("id"), "id", "left_anti"), "unlabelled")

    first = lambda ids, n: ids.distinct().orderBy(F.xxhash64("id"), "id").limit(n)
    known = first(positives.where("id IS NOT NULL").select("id"), positive_rows)
    other = first(unlabelled.select("id"), unlabelled_rows)
    chosen = known.withColumn("kind", F.lit(1)).union(other.withColumn("kind", F.lit(0)))
    # The chosen ids are at most as many as the two limits, so a broadcast has a known bound.
    sample = rows.join(F.broadcast(chosen), "id").select("kind", "k", "row").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["k"], r["row"]))
    kinds = [np.array([np.frombuffer(r["row"]) for r in sample if r["kind"] == kind]) for kind in (1, 0)]
    if min(map(len, kinds)) < 4:
        width = len(features(None))
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), 0.0)
    return train_pu(*kinds, lambda net, edges: counted_logits(unlabelled, net, edges))


def counted_logits(rows: DataFrame, net: Network, edges: np.ndarray) -> np.ndarray:
    """The histogram of the logits of all ``rows`` (with ``row``), added up in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            measured = np.frombuffer(b"".join(batch.column("row").to_pylist())).reshape(batch.num_rows, -1)
            if batch.num_rows:
                total += histogram(net.logits(measured), edges)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bin", "n"])

    counts = np.zeros(len(edges) + 1, np.int64)
    counted = rows.select("row").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # as many as there are bins
        counts[r["bin"]] = r["n"]
    return counts


def score_quality(docs: DataFrame, net: Network, result: str = "quality", text_col: str = "text") -> DataFrame:
    """All columns and ``result``, from 0 to 1: how likely the whole text is good.

    A null text counts as empty; texts without words get one score like any other.
    A column called like ``result`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        rows = feature_rows(texts.to_pylist())
        return pa.array(shared.value.scores(rows) if len(rows) else [], pa.float64())

    return docs.withColumn(result, score(F.col(f"`{text_col}`").cast("string").cast("binary")))
