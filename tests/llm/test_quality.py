"""Positive-unlabelled learning: risk, prior, held-out accuracy and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from stateglass.llm import quality
from stateglass.llm.quality import (
    EDGES, dividing_logit, estimate_prior, feature_rows, features, fit, histogram, non_negative_slopes,
    score_quality, train, train_pu,
)
from stateglass.llm.queries import QUERIES


def mixture(rng, n, share):
    good = rng.random(n) < share
    return np.where(good[:, None], rng.normal(1.5, 1, (n, 3)), rng.normal(-1.5, 1, (n, 3))), good


def test_prior_and_classes_without_negatives():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.85):
        positive, _ = mixture(rng, 1500, 1.0)
        unlabelled, _ = mixture(rng, 2500, share)
        net = train_pu(positive, unlabelled)
        assert abs(net.prior - share) < 0.08
        rows, good = mixture(rng, 2000, share)
        assert ((net.scores(rows) >= 0.3) == good).mean() > 0.95


def test_slopes_are_those_of_the_risk():
    rng = np.random.default_rng(1)
    loss = lambda x: np.logaddexp(0, -x)
    for scale in (0.1, 4.0):
        p, u = rng.normal(3, 1, 5) * scale, rng.normal(-1, 1, 7) * scale
        inner = loss(-u).mean() - 0.6 * loss(-p).mean()

        def risk(p, u):
            rest = loss(-u).mean() - 0.6 * loss(-p).mean()
            return -rest if inner < 0 else 0.6 * loss(p).mean() + rest

        slopes = np.concatenate(non_negative_slopes(p, u, 0.6))
        for i in range(12):
            step = np.zeros(12)
            step[i] = 1e-5
            numeric = (risk(p + step[:5], u + step[5:]) - risk(p - step[:5], u - step[5:])) / 2e-5
            assert abs(numeric - slopes[i]) < 1e-6


def test_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = QUERIES["op6_quality"](spark, sf_dir)
    assert got.count() == 1000
    held = got.where("held_out").join(labels, "doc_id")
    assert held.where("predicted = quality").count() >= 0.95 * held.count()


def test_odd_rows(spark):
    assert not features(None).any() and not features(b" \n").any() and np.isfinite(features(b"a")).all()
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7 + 1)) for i in range(40)] + [(None, "x")], "id long, text string")
    odd = [(None, None), (1, ""), (1, ""), (2, "\t"), (3, "A" * 300_000), (4, "☃!")]
    frame = spark.createDataFrame(odd, "doc_id long, text string").withColumn("quality", F.lit("x"))
    for known in (docs.where("id < 15").select("id"), docs.where("id < 0").select("id")):
        net = train(docs, known.union(spark.createDataFrame([(None,)], "id long")), known)
        got = score_quality(frame, net).collect()
        assert len(got) == len(odd) and all(0 <= r.quality <= 1 for r in got)
        assert score_quality(frame.limit(0), net).count() == 0
    assert 0 < estimate_prior(np.ones(4), histogram(np.ones(4), np.ones(1))) < 1
    assert fit(np.ones((4, 2)), np.zeros((4, 2)), 0.5).scores(np.zeros((1, 2))).shape == (1,)


def test_prior_and_threshold_rest_on_all_unlabelled_rows(spark, monkeypatch):
    """A sample of 20 rows trains; what is counted are all rows, as a plain loop finds them."""
    rng = np.random.default_rng(7)
    texts = [(i, ("good words here. " if rng.random() < 0.4 else "$$$ !!! 11 ") * int(rng.integers(2, 9))) for i in range(600)]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(5)
    positives = docs.where("id < 60 AND text LIKE 'good%'").select("id")
    labelled = docs.where("id < 80").select("id")
    seen, kept = [], quality.counted_logits

    def watched(rows, net, edges):
        counts = kept(rows, net, edges)
        plain = histogram(net.logits(feature_rows([t.encode() for i, t in texts if i >= 80])), edges)
        seen.append((counts == plain).all() and counts.sum() == 520)
        return counts

    monkeypatch.setattr(quality, "counted_logits", watched)
    net = train(docs, positives, labelled, unlabelled_rows=40)
    assert seen == [True, True]
    share = np.mean([t.startswith("good") for i, t in texts if i >= 80])
    assert abs(net.prior - share) < 0.2
    got = score_quality(docs, net).collect()
    assert np.mean([(r.quality >= 0.3) == r.text.startswith("good") for r in got]) > 0.95


def test_dividing_place():
    rng = np.random.default_rng(3)
    for n in (60, 200_000):
        logits = np.concatenate([rng.normal(-4, 0.8, int(n * 0.7)), rng.normal(4, 0.8, int(n * 0.3))])
        assert -2.5 < dividing_logit(histogram(logits, EDGES), EDGES, 0.3) < 2.5
    assert np.isfinite(dividing_logit(histogram(np.zeros(3), EDGES), EDGES, 0.99))
