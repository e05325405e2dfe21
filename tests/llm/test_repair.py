"""Token shards: exact round trips and random access."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stateglass.llm import repair
from stateglass.llm.queries import QUERIES
from stateglass.session import work_dir

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def stored(ids, base):
    rules, sizes, symbols = repair.compress(ids, base)
    import zstandard

    width = np.uint16 if base + len(rules) <= 1 << 16 else np.uint32
    blobs = [zstandard.compress(b) for b in (rules.tobytes(), sizes.astype(np.uint32).tobytes(), symbols.astype(width).tobytes())]
    return repair.Grammar(base, *blobs), len(rules), len(symbols)


def test_round_trips_and_random_access():
    rng = np.random.default_rng(4)
    cases = [np.zeros(0, np.uint32), np.array([7]), np.zeros(1000), np.tile([1, 2, 3, 1, 2], 300)]
    cases += [rng.integers(0, 5, 5000), rng.zipf(1.3, 40_000) % 900, rng.integers(0, 1000, 20_000)]
    for base in (1000, 70_000):
        for ids in cases:
            ids = ids.astype(np.uint32)
            grammar, rules, symbols = stored(ids, base)
            assert grammar.read(0, len(ids)) == ids.tobytes()
            for _ in range(20):
                a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
                assert grammar.read(a, b) == ids[a:b].tobytes()
    grammar, rules, symbols = stored(np.tile(np.arange(64, dtype=np.uint32), 500), 1000)
    assert symbols < 1000 and rules >= 63


def plain(texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    start, out = 0, []
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_matches_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(map(tuple, QUERIES["op7_token_shards"](spark, sf_dir).collect()))
    assert got == plain([(d.doc_id, d.text) for d in docs])


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "SHARD_IDS", 40)
    texts = [(None, "null id"), (1, None), (2, ""), (3, " \n"), (4, "Don't <|endoftext|> É² 12 ☃!!"), (4, "a"), (9, "long words " * 3000)]
    frame = spark.createDataFrame([(d, t, "x") for d, t in reversed(texts)], "doc_id long, text string, ids string")
    target = work_dir(spark, "shards")
    repair.write_token_shards(frame, target, VOCABULARY)
    got = repair.read_token_shards(spark, target)
    got = sorted(((r.id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got.collect()), key=lambda r: r[1])
    assert got == plain([texts[0], *texts[1:4], texts[4], texts[5], texts[6]])
    target = work_dir(spark, "shards")
    repair.write_token_shards(frame.limit(0), target, VOCABULARY)
    assert repair.read_token_shards(spark, target).count() == 0


def test_reading_a_part_expands_only_what_it_needs():
    ids = np.concatenate([np.tile([1, 2, 3, 4], 50), np.tile([5, 6, 7, 8, 9], 60)]).astype(np.uint32)
    grammar, rules, _ = stored(ids, 1000)
    some = grammar._needed(grammar.symbols[:1])
    assert 0 < len(some) < rules
    assert grammar.read(0, 4) == ids[:4].tobytes() and grammar.read(200, 210) == ids[200:210].tobytes()


def test_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(6)
    passages = [rng.integers(0, 49_000, 24) for _ in range(1200)]
    ids = np.concatenate([passages[i] for i in rng.integers(0, 1200, 40_000)]).astype(np.uint32)
    for base in (49_408, 70_000):
        grammar, rules, symbols = stored(ids, base)
        assert grammar.read(0, len(ids)) == ids.tobytes()
        left = repair.compress(ids, base)[2].astype(np.uint64)
        pairs, counts = np.unique((left[:-1] << np.uint64(32)) | left[1:], return_counts=True)
        overlapping = (pairs >> np.uint64(32)) == (pairs & np.uint64(0xFFFFFFFF))
        assert counts[~overlapping].max() < repair.LEAST_COUNT
        assert rules > 1 << 14
