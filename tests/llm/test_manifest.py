"""Manifests against a tree that is built level by level."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stateglass.llm import manifest
from stateglass.llm.manifest import OpenTree, fold, height, leaf_digest, merkle_manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def plain_proof(levels, place):
    out = []
    for level in levels[:-1]:
        run = place - place % 3
        out += [x for i, x in enumerate(level[run : run + 3], run) if i != place]
        place //= 3
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 9, 10, 26, 27, 28, 100])
def test_stream_gives_the_tree(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = plain_levels(leaves)
    tree = OpenTree()
    for leaf in leaves:
        tree.append(bytes.fromhex(leaf))
    assert height(n) == len(levels) - 1
    root = tree.close(height(n))
    assert root.hex() == levels[-1][0]
    for place, witness in enumerate(tree.witnesses):
        assert bytes(witness).hex() == "".join(plain_proof(levels, place))
        assert fold(bytes.fromhex(leaves[place]), bytes(witness), [(place, n)]) == root


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows):
    """(doc_id, source, text, claimed text) to (doc_id, leaf, subroot, root, proof, folds to the root)."""
    trees = {}
    for doc, source, text, claim in rows:
        leaf, stated = (h(framed(doc) + framed(source) + framed(t)) for t in (text, claim))
        trees.setdefault(source, []).append((doc is not None, doc or 0, leaf, stated))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: plain_levels([x[2] for x in sorted(trees[s])]) for s in order}
    above = plain_levels([below[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for place, (known, doc, leaf, stated) in enumerate(sorted(trees[s])):
            proof = "".join(plain_proof(below[s], place) + plain_proof(above, k))
            out.append((doc if known else None, leaf, below[s][-1][0], above[-1][0], proof, leaf == stated))
    return sorted(out, key=repr)


def built(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, other string").repartition(5)
    fields = [F.col("doc_id"), F.col("source")]
    return merkle_manifest(
        frame.select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("tree"),
            leaf_digest(*fields, F.col("text")).alias("leaf"),
            leaf_digest(*fields, F.col("other")).alias("claim"),
        )
    )


@pytest.mark.parametrize("levels", [8, 1, 2])
def test_table_matches_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    rng = random.Random(levels)
    rows = []
    for i in range(140):
        text = rng.choice([None, "", "a\nb", "a\nbc", "é \x00 \n", "long text " * 3000, f"t{i}"])
        other = text if text is None or len(text) % 2 else text.replace("\n", "")
        source = rng.choice(["s", "s", "s", None, "é", "z", "", f"one{i}"])
        rows.append((rng.choice([None, i % 50, i]), source, text, other))
    rows += [(7, "s", "same", "same")] * 11
    got = sorted(
        (
            (r.id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.witness.hex(), r.folded == r.root)
            for r in built(spark, rows).collect()
        ),
        key=repr,
    )
    assert got == plain_manifest(rows)


def test_empty_and_single(spark):
    assert built(spark, []).count() == 0
    row = built(spark, [(1, "a", "x", "y")]).collect()[0]
    assert row.leaf == row.subroot == row.root and row.witness == b"" and row.folded != row.root
