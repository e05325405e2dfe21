"""Decontamination against a plain search for every window."""

import random

from stateglass.llm.contamination import (
    ItemAutomaton, cut_words, find_contamination, joined_spans, normal_words, remove_contamination,
)


def plain(words, items, window):
    hit, names = set(), set()
    for name, own in items:
        n = min(len(own), window)
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                names.add(name)
    return hit, names


def longest_match(words, items):
    best = 0
    for _, own in items:
        for i in range(len(words)):
            for j in range(len(own)):
                k = 0
                while i + k < len(words) and j + k < len(own) and words[i + k] == own[j + k]:
                    k += 1
                best = max(best, k)
    return best


def test_automaton_matches_plain_search():
    rng = random.Random(2)
    for round in range(150):
        letters = [b"a", b"b", b"c"][: rng.choice([1, 2, 3])]
        items = [(str(i), rng.choices(letters, k=rng.randrange(0, 9))) for i in range(rng.randrange(0, 6))]
        automaton = ItemAutomaton(items, 4)
        for _ in range(4):
            words = rng.choices([*letters, b"z"], k=rng.randrange(0, 14))
            longest, hits, names = automaton.search(words)
            want, named = plain(words, items, 4)
            assert {p for s, e in joined_spans(hits) for p in range(s, e)} == want
            assert names == named
            assert longest == longest_match(words, items)


def test_cut_keeps_the_rest():
    text = "Über,  Déjà-vu! one two".encode()
    assert normal_words(text) == ["Über".encode(), "déjà".encode().replace("d".encode(), b"d"), b"vu", b"one", b"two"]
    assert cut_words(text, [(1, 3)]) == "Über,  ! one two".encode()


def test_rows_and_shards(spark):
    items = [(1, "one two three four"), (2, None), (3, "--"), (None, "five six seven"), (1, "one two three four"), (4, "Two three")]
    docs = [(1, None, 0), (2, "", 0), (3, "ONE two, three FOUR x", 0), (3, "zero two three", 1), (None, "five six seven", 2), (6, "clean", 3)]
    items = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string, n_hit long")
    want = None
    for size in (1 << 20, 16):
        found = find_contamination(docs, items, window=3, shard_bytes=size)
        got = [(r.doc_id, r.found.n_words, r.found.n_hit, r.found.items) for r in found.collect()]
        assert sorted(got, key=repr) == sorted(
            [(1, 0, 0, []), (2, 0, 0, []), (3, 5, 4, ["1", "4"]), (3, 3, 2, ["4"]), (None, 3, 3, []), (6, 1, 0, [])], key=repr
        )
        cleaned = sorted(map(tuple, remove_contamination(docs, items, window=3, shard_bytes=size, max_coverage=0.7).collect()), key=repr)
        assert want is None or want == cleaned
        want = cleaned
    assert want == sorted([(1, None, 0), (2, "", 0), (3, "zero ", 1), (6, "clean", 3)], key=repr)
    assert find_contamination(docs.limit(0), items).count() == 0
    assert find_contamination(docs, items.limit(0)).where("found.n_hit > 0").count() == 0
