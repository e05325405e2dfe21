"""Repeated passages against a plain version over all windows."""

import random

from pyspark.sql import functions as F

from stateglass.llm.substring import remove_repeated_passages


def plain(rows, window):
    """``rows`` are (id, text) with ids that are not null and not repeated."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            gram = tuple(words[i : i + window])
            if gram in seen:
                gone.update(range(i, i + window))
            seen.add(gram)
        out[doc] = (len(words), sorted(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return out


def test_matches_plain_version(spark):
    rng = random.Random(1)
    passages = [" ".join(rng.choices("abcdefgh", k=rng.randrange(3, 12))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices("abé x", k=5)) for _ in range(rng.randrange(0, 6))]
        rows.append((i * 3 - 50, rng.choice([" ", "\n", "\t \v"]).join(parts)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for window in (1, 2, 5):
        want = plain(rows, window)
        for r in remove_repeated_passages(frame, window=window).collect():
            gone = [p for s in r.spans for p in range(s.start, s.end)]
            assert (r.n_words, gone, r.kept) == want[r.id]
            assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_layout_keeps_the_rest_of_the_text(spark):
    rows = [(1, "a  b\tc d"), (2, "x\n\ny a b c  d z\n"), (3, "  plain\n"), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.kept for r in remove_repeated_passages(frame, window=4, layout=True).collect()}
    assert got == {1: "a  b\tc d", 2: "x\n\ny z\n", 3: "  plain\n", 4: None}


def test_odd_rows(spark):
    long_text = " ".join(f"w{i}" for i in range(40_000))
    rows = [
        (1, None, "r"), (2, "", None), (3, " ", "r"), (None, "a b c", "r"), (None, "a b c", "s"), (5, "a b c", "t"),
        (6, "a b c", "u"), (6, "a b c", "u"), (7, long_text, "v"), (8, long_text, "w"), (9, "c c c c c", "x"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("row", F.lit(1))
    got = remove_repeated_passages(frame, window=3)
    found = sorted(((r.id, r.n_words, sum(s.end - s.start for s in r.spans), r.row.spans) for r in got.collect()), key=repr)
    want = [
        (1, 0, 0, "r"), (2, 0, 0, None), (3, 0, 0, "r"), (None, 3, 0, "r"), (None, 3, 0, "s"), (5, 3, 0, "t"),
        (6, 3, 3, "u"), (6, 3, 3, "u"), (7, 40_000, 0, "v"), (8, 40_000, 40_000, "w"), (9, 5, 4, "x"),
    ]
    assert found == sorted(want, key=repr)
    assert remove_repeated_passages(frame.limit(0)).count() == 0
