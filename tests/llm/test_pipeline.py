"""The pipeline: stages keep columns and clean rows, and their decisions take effect."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline as pipeline
from stateglass.llm.entry import ORACLES, QUERIES
from tests.check import compare, oracle_connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(name, spark, sf_dir):
    assert compare(spark, oracle_connection(sf_dir), sf_dir, QUERIES[name], ORACLES[name]) is None


def planted(spark, tmp_path):
    """Documents with known cases; gives the folder and what should become of them."""
    rng = random.Random(17)
    words = ["".join(rng.choices("aeioustrnlm", k=rng.randrange(3, 8))) for _ in range(2000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs, toxic = {}, {}
    for i in range(400):
        own = text(rng.randrange(30, 200)).split()
        toxic[i] = int(i % 4 == 0)
        if toxic[i]:
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice(["vexo", "grumf", "blorp"]) + rng.choice(words))
        docs[i] = " ".join(own)
    clean = [i for i in docs if not toxic[i]]
    docs[1001] = docs[clean[0]]
    # A long text and a copy with one word changed: within three bits of each other.
    docs[1001 - 2] = text(4000)
    changed = docs[999].split()
    changed[len(changed) // 2] = "other"
    docs[1002] = " ".join(changed)
    shared = text(60)
    docs[1003], docs[1004] = f"{text(50)} {shared} {text(30)}", f"{text(50)} {shared} {text(30)}"
    item = text(25)
    docs[1005], docs[1006] = f"{text(80)} {item} {text(80)}", item
    docs[1007], docs[1008], docs[1009] = None, "", "é " * 30_000
    rows = [(i, t, rng.choice(["en", "de", None]), "s", None if t is None else len(t)) for i, t in docs.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, t) for i, t in toxic.items()]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, toxic, clean, shared, item


def test_stages(spark, tmp_path):
    docs, toxic, clean, shared, item = planted(spark, tmp_path)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        if name != "packing":
            assert out.dtypes == frame.dtypes
        frame = pipeline.written(out, name)
        seen[name] = {r.doc_id: r for r in frame.collect()} if name != "packing" else frame.collect()
    left = seen["toxicity"]
    assert sum(i in left for i, t in toxic.items() if t) <= 5
    assert sum(i not in left for i in clean) <= 3
    near = seen["simhash_near_dedup"]
    assert 1001 not in near and 1002 not in near and {1003, 1004, 1005} <= near.keys()
    assert all(near[i] == left[i] for i in near)
    assert not {i for i in left if i < 1000} - near.keys()
    cut = seen["substring_dedup"]
    assert shared in cut[1003].text and shared not in cut[1004].text
    assert len(cut[1004].text.split()) == 80 and cut[1004].n_chars == len(cut[1004].text)
    assert all(cut[i] == near[i] for i in clean if i in near)
    clear = seen["benchmark_decontamination"]
    assert item not in clear[1005].text and len(clear[1005].text.split()) == 160 and 1006 not in clear
    assert all(clear[i] == cut[i] for i in clean if i in cut)
    lengths = defaultdict(int)
    for piece in seen["packing"]:
        lengths[piece.doc_id] += piece.length
        assert len(piece.ids) == 4 * piece.length
    assert lengths.keys() == clear.keys()


def test_run_gives_the_last_stage(spark, sf_dir):
    got = QUERIES["pipeline"](spark, sf_dir)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)
    assert got.count() > 100


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, toxicity string, gone int, found string, id int"


def odd_tables(spark, tmp_path, rows):
    text = "some plain words that nobody minds at all "
    made = [(d, t, "en", "s", None if t is None else len(t), "x", "y", 1, "z", 2) for d, t in rows]
    spark.createDataFrame(made, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1, 1), (2, 1, 0), (None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, text * 3), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return text


@pytest.mark.parametrize("n", [0, 1, 40])
def test_odd_tables_through_all_stages(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(None, "null id one two three"), (5, "twice five"), (5, "twice five"), (6, None), (7, ""), (None, None)][:n]
    rows += [(i + 10, " ".join(f"w{rng.randrange(500)}" for _ in range(30))) for i in range(n)]
    odd_tables(spark, tmp_path, rows)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.dtypes == frame.dtypes, name
        frame = pipeline.written(out, name)
    ids = [r.doc_id for r in frame.collect()]
    if n == 40:
        # Rows that share an id stay together; a null id is compared with nothing.
        assert ids.count(5) == 2 and None in ids and set(range(10, 50)) <= set(ids)
        extra = frame.select("`a.b`", "toxicity", "gone", "found", "id").distinct().collect()
        assert [tuple(r) for r in extra] == [("x", "y", 1, "z", 2)]
    packed = pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
    assert packed.count() >= len(ids)
