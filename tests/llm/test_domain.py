"""Cross-entropy differences against a plain count of all bigrams."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stateglass.llm import domain
from stateglass.llm.domain import domain_scores
from stateglass.llm.queries import DOMAIN_SOURCE, QUERIES


def plain(rows):
    """``rows`` are (id, text, in target)."""
    split = [(i, re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), inside) for i, t, inside in rows]
    counts = Counter(w for _, words, _ in split for w in words)
    sequences = [(["<", *words, ">"], inside) for _, words, inside in split if words]
    models = []
    for only_target in (True, False):
        own = [s for s, inside in sequences if inside or not only_target]
        single, first, pairs = Counter(), Counter(), Counter()
        for s in own:
            single.update(s[1:])
            first.update(s[:-1])
            pairs.update(zip(s, s[1:]))
        total, classes = sum(single.values()), len(counts) + 2

        def loss(a, b, single=single, first=first, pairs=pairs, total=total):
            p = (single[b] + 1) / (total + classes)
            return -math.log((pairs[a, b] + domain.PRIOR_COUNT * p) / (first[a] + domain.PRIOR_COUNT))

        models.append(loss)
    out = []
    for i, words, _ in split:
        s = ["<", *words, ">"]
        steps = list(zip(s, s[1:]))
        out.append((i, len(words), sum(models[0](a, b) - models[1](a, b) for a, b in steps) / len(steps) if words else None))
    return out


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert g[:2] == w[:2]
        assert g[2] == (w[2] if w[2] is None else pytest.approx(w[2], abs=1e-5))


def test_query_matches_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op2_domain_scores"](spark, sf_dir).select("doc_id", "n_words", "difference").collect()
    same(list(map(tuple, got)), plain([(d.doc_id, d.text, d.source == DOMAIN_SOURCE) for d in docs]))


def test_odd_rows(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["A", "b", "É", "d,", "rare%d" % i], k=rng.randrange(0, 30))), rng.random() < 0.3) for i in range(60)]
    rows += [(100, None, True), (101, "", None), (102, "--", True), (5, "a b a b", True), (5, "a b a b", True), (103, "a b " * 30_000, False)]
    frame = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, mine boolean, n_words int")
    got = domain_scores(frame, F.col("mine"))
    same(list(map(tuple, got.collect())), plain(rows))
    none = domain_scores(spark.createDataFrame([(None, "a")], "doc_id long, text string"), F.lit(None).cast("boolean"))
    assert none.first()[:2] == (None, 1)
    assert domain_scores(frame.limit(0), F.col("mine")).count() == 0


def test_more_words_than_16_bits_count_one_by_one(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(90_000)]
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 900 : (i + 1) * 900] + rng.choices(words, k=100)), i % 3 == 0) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, mine boolean").repartition(4)
    same(list(map(tuple, domain_scores(frame, F.col("mine")).collect())), plain(rows))
