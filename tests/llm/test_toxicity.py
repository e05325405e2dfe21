"""The toxicity classifier by held-out accuracy and on odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from stateglass.llm import toxicity
from stateglass.llm.common import mix
from stateglass.llm.queries import QUERIES
from stateglass.llm.toxicity import Model, WordFeatures, best_divide, fit, score_toxicity, train


def made_up(spark, n=900):
    rng = random.Random(3)
    words = ["".join(rng.choices("aeioustrnl", k=rng.randrange(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        own, toxic = rng.choices(words, k=rng.randrange(5, 80)), rng.random() < 0.25
        if toxic:
            for _ in range(2):
                own.insert(rng.randrange(len(own)), "vexo" + rng.choice(words))
        rows.append((i, " ".join(own), "en", int(toxic)))
    return spark.createDataFrame(rows, "id long, text string, lang string, toxic int").cache()


def test_learns_a_stem_and_is_right_on_other_rows(spark):
    rows = made_up(spark)
    model = train(rows.where("id % 3 != 0"), rows.where("id % 3 != 0").select("id", "toxic"))
    scored = score_toxicity(rows.where("id % 3 = 0"), model)
    wrong = scored.where(F.col("toxicity.toxic") != (F.col("toxic") == 1)).count()
    assert wrong <= 0.03 * scored.count()
    assert scored.where("toxicity.score < 0 OR toxicity.score > 1 OR toxicity.score IS NULL").count() == 0


def test_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = QUERIES["op3_toxicity"](spark, sf_dir)
    assert got.count() == 1000
    held = got.where("held_out").join(labels, "doc_id")
    right = held.where("predicted = toxic").count()
    assert right >= 0.9 * held.count()


def test_odd_rows(spark):
    rows = made_up(spark, 200)
    odd = [(None, None, None), (1, "", "en"), (1, "", "en"), (2, " \n", "xx"), (3, "a", None), (4, "vexo " * 50_000, "de")]
    frame = spark.createDataFrame(odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    labels = rows.select("id", "toxic")
    for known in (labels, labels.where("toxic = 0"), labels.where("id < 0")):
        model = train(rows, known.union(spark.createDataFrame([(None, 1), (1, None)], "id long, toxic int")))
        got = score_toxicity(frame, model).select("doc_id", "score", "toxicity.*").collect()
        assert len(got) == len(odd)
        assert all(0 <= r[2] <= 1 and r.toxic is not None for r in got)
        assert got[1] == got[2]
        assert score_toxicity(frame.limit(0), model).count() == 0


def test_threshold_divides_best():
    scores, toxic = np.array([0.1, 0.2, 0.6, 0.7, 0.9]), np.array([False, False, True, False, True])
    assert abs(best_divide(scores, toxic, np.ones(5)) - 0.4) < 1e-9


def plain_buckets(word):
    """Buckets of the features of a word: the whole of it and its n-grams, one by one."""
    framed, wrap = b"<" + word + b">", (1 << 64) - 1
    codes = [sum((b + 1) * pow(0x100000001B3, i, 1 << 64) for i, b in enumerate(framed)) & wrap]
    for n in toxicity.GRAMS:
        for at in range(len(framed) - n + 1):
            code = n
            for b in framed[at : at + n]:
                code = (code * 257 + b) & wrap
            codes.append(code)
    return [int(mix(np.array([c], np.uint64))[0]) % toxicity.BUCKETS for c in codes]


def plain_logit(model, text):
    """Embeddings, every filter at every place, the maximum, the last layer: all by loops."""
    words = toxicity.normal_words((text or b"").decode().lower().encode())
    blank = np.zeros(toxicity.DIMENSIONS)
    vectors = [sum(model.table[b].astype(float) for b in plain_buckets(w)) for w in words]
    vectors += [blank] * max(toxicity.WIDTHS)
    total = model.offset
    for k, (width, own) in enumerate(zip(toxicity.WIDTHS, model.filters)):
        for f in range(toxicity.FILTERS):
            best = max(
                sum(float(vectors[at + j] @ own[j][:, f]) for j in range(width)) for at in range(len(words) + 1)
            )
            column = k * toxicity.FILTERS + f
            total += max(best + model.bias[column], 0) * model.out[column]
    return total


def random_model(rng):
    filters = [rng.normal(0, 0.5, (w, toxicity.DIMENSIONS, toxicity.FILTERS)) for w in toxicity.WIDTHS]
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    table = rng.normal(0, 0.5, (toxicity.BUCKETS, toxicity.DIMENSIONS)).astype(np.float32)
    return Model(table, filters, rng.normal(0, 0.3, n), rng.normal(0, 1, n), 0.2)


def test_scores_are_those_of_a_plain_network():
    rng = np.random.default_rng(6)
    model = random_model(rng)
    texts = [b"one two three", b"", None, b"One", "Ärger über alles, ja!".encode(), b"a bb ccc dddd " * 9, b"--", b"x " * 40]
    got = model.logits(texts)
    assert np.allclose(got, [plain_logit(model, t) for t in texts], atol=1e-3)
    # No text changes the score of another one in its batch.
    assert np.allclose([model.logits([t])[0] for t in texts], got, atol=1e-5)
    assert np.allclose(model.logits(texts[::-1]), got[::-1], atol=1e-5)
    model.scale, model.shift = 2.0, -0.5
    assert np.allclose(model.scores(texts), 1 / (1 + np.exp(0.5 - 2 * got)))


def test_word_features_are_sums_over_buckets():
    rng = np.random.default_rng(2)
    words = [b"a", b"toxic", "größer".encode(), b"x" * 30]
    table = rng.normal(0, 1, (toxicity.BUCKETS, 3)).astype(np.float32)
    features = WordFeatures(words)
    assert np.allclose(features.sums(table), [sum(table[b] for b in plain_buckets(w)) for w in words], atol=1e-4)
    values, out = rng.normal(0, 1, (len(words), 3)), np.zeros((toxicity.BUCKETS, 3))
    features.spread(values, out)
    want = np.zeros_like(out)
    for word, value in zip(words, values):
        for b in plain_buckets(word):
            want[b] += value
    assert np.allclose(out, want)


def test_training_lowers_the_loss(monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("aeioustrnl", k=5)) for _ in range(60)]
    toxic = np.array([i % 3 == 0 for i in range(150)])
    texts = [" ".join(rng.choices(words, k=12) + (["grumf"] if t else [])).encode() for t in toxic]

    def loss(epochs):
        monkeypatch.setattr(toxicity, "EPOCHS", epochs)
        logits = fit(texts, toxic, np.ones(len(texts))).logits(texts)
        return np.logaddexp(0, np.where(toxic, -logits, logits)).mean()

    losses = [loss(n) for n in (0, 2, 8)]
    assert losses[0] > losses[1] > losses[2]


def test_all_labelled_rows_are_learnt_from(spark, monkeypatch):
    """Rows take turns, and the feature counts are those of every row that trains."""
    monkeypatch.setattr(toxicity, "ROWS_A_TURN", 20)
    rows = made_up(spark, 300)
    seen = []
    unusual = toxicity._unusual
    monkeypatch.setattr(toxicity, "_unusual", lambda counts, share: seen.append((counts, share)) or unusual(counts, share))
    labels = rows.select("id", "toxic")
    train(rows, labels)
    found = toxicity.labelled_rows(rows, labels, "toxic").groupBy("turn").count().collect()
    turns = {r["turn"]: r["count"] for r in found}
    assert set(turns) == {-1, 0, 1, 2, 3} and sum(turns.values()) == 300
    learnt = toxicity.labelled_rows(rows, labels, "toxic").where("turn >= 0").collect()
    want = np.zeros((2, toxicity.BUCKETS))
    for r in learnt:
        words = toxicity.normal_words(bytes(r["text"]))
        want[r["label"]][np.unique([b for w in set(words) for b in plain_buckets(w)])] += 1
    assert np.array_equal(seen[0][0], want)
    assert seen[0][1] == sum(r["label"] for r in learnt) / len(learnt)


def test_only_labelled_texts_meet_the_labels(spark, monkeypatch):
    """A join on the id would shuffle every text; whatever has no label stays where it is."""
    docs = spark.range(-3000, 3000).select("id", F.lit("a b").alias("text"), F.lit("en").alias("lang"))
    docs = docs.union(spark.createDataFrame([(7, "c", None), (None, "d", "en")], "id long, text string, lang string"))
    labels = spark.range(-30, 100).select("id", (F.col("id") % 2 == 0).cast("int").alias("toxic"))
    few = toxicity.maybe_labelled(docs, labels)
    assert few.columns == docs.columns
    assert few.join(labels, "id").count() == 131
    assert few.count() < 140
    # With a bitmap that is full everything is taken along, and the result is the same.
    want = sorted(map(str, toxicity.labelled_rows(docs, labels, "toxic").collect()))
    monkeypatch.setattr(toxicity, "LABEL_BITS", 8)
    assert toxicity.maybe_labelled(docs, labels).count() > 5000
    assert sorted(map(str, toxicity.labelled_rows(docs, labels, "toxic").collect())) == want and len(want) == 131
    other = docs.withColumn("id", F.col("id").cast("string"))
    assert toxicity.maybe_labelled(other, labels).count() == docs.count()


def test_gradients_travel_compressed():
    rng = np.random.default_rng(1)
    for kind in (np.float32, np.float64):
        values = np.where(rng.random(9000) < 0.1, rng.normal(size=9000), 0).astype(kind)
        blob = toxicity.packed(values)
        assert len(blob) < values.nbytes / 2
        assert np.array_equal(toxicity.unpacked(blob), values.astype(np.float64))
