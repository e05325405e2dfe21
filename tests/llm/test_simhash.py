"""SimHash groups against a plain version that compares all pairs."""

import random

import numpy as np
import xxhash

from stateglass.llm.queries import QUERIES
from stateglass.llm.simhash import near_links, simhash_groups


def plain_print(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_query_matches_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain_print(d.text) for d in docs]
    groups = plain_groups(prints)
    want = {d.doc_id: (f"{p:016x}", docs[g].doc_id) for d, p, g in zip(docs, prints, groups)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash_groups"](spark, sf_dir).collect()}
    assert got == want


def test_links_join_all_within_radius(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(12):
            flipped = base
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                flipped ^= 1 << bit
            values.add(flipped)
    values = sorted(values)
    for radius in (0, 1, 2, 3):
        frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for row in near_links(frame, radius).collect():
            a, b = (int(np.int64(x).astype(np.uint64)) for x in row)
            assert (a ^ b).bit_count() <= radius
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        assert [find(v) for v in values] == [values[g] for g in plain_groups(values, radius)]


def test_odd_rows(spark):
    long_text = "word " * 60_000
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n", None), (4, "a b c d", "x"), (5, "A b\tc  d", "y"),
        (5, "a b c d", "z"), (None, "a b c d", "z"), (7, long_text, "x"), (8, long_text, "x"), (None, "só único", "q"),
    ]
    frame = spark.createDataFrame(rows, "id long, text string, component string")
    got = sorted(map(tuple, simhash_groups(frame, "id").collect()), key=repr)
    components = {(r[0], r[2]) for r in got}
    assert len(got) == len(rows)
    assert components == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4), (7, 7), (8, 7), (None, None)}
    assert simhash_groups(frame.where("id < 0"), "id").count() == 0
