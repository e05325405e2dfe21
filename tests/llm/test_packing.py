"""Packing: fills against a search of all subsets, and whole, gapless sequences."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stateglass.llm.packing import best_fill, pack_texts, padded_length
from stateglass.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_fill_is_the_closest():
    rng = random.Random(8)
    for _ in range(400):
        room = rng.randrange(1, 40)
        pool = [rng.randrange(1, 25) for _ in range(rng.randrange(0, 9))]
        sums = {sum(c) for n in range(len(pool) + 1) for c in combinations(pool, n)}
        counts = Counter(pool)
        taken = best_fill(counts, sorted(counts, reverse=True), room)
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in taken.items())


def plain_ids(text):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, texts, capacity):
    """Every id once, sequences gapless and within capacity; returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, tokens, sequence, offset in pieces:
        by_doc[doc].append((start, length, crc, tokens))
        by_sequence[sequence].append((offset, length))
    assert by_doc.keys() == texts.keys()
    for doc, text in texts.items():
        ids, at = np.array(plain_ids(text), "<u4"), 0
        for start, length, crc, tokens in sorted(by_doc[doc]):
            assert (start, tokens) == (at, len(ids)) and length > 0
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_query_packs_all(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op4_pack_documents"](spark, sf_dir)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = list(map(tuple, got.select(columns).collect()))
    padding = check(pieces, {d.doc_id: d.text for d in docs}, 2048)
    assert padding < 0.01 * sum(p[2] for p in pieces)


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: " ", 4: "some words " * 9, 5: "word " * 400, 6: "a b c", None: "no id", 7: "a <|endoftext|>b <|EndOfText|>☃ end."}
    frame = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, start string")
    got = pack_texts(frame, VOCABULARY, capacity=64)
    rows = got.select("id", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset").collect()
    check(list(map(tuple, rows)), texts, 64)
    twice = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sum(r.length for r in pack_texts(twice, VOCABULARY).collect()) == 6
    assert pack_texts(frame.limit(0), VOCABULARY).count() == 0
    lengths = spark.createDataFrame([(1,), (3,), (64,)], "n long")
    assert [r[0] for r in lengths.select(padded_length(F.col("n"), 64)).collect()] == [1, 64, 64]
