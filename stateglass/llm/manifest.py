"""Merkle manifest of a table, one proof per row, by incremental witnesses.

Rows are leaves. Leaves of one tree (a source, say) in order are hashed by runs of three,
the last run of a level being shorter, until one node is left, the subroot; the subroots
in order of their tree give the root in the same way.

Leaves stream into an ``OpenTree``: every open subtree carries the partial witnesses of
its leaves, and each time a run is complete, its nodes extend the witnesses below them by
the digests of their siblings. As a Spark job: leaves get their place by measured ranges
(``global_index``), an aligned block of ``BLOCK`` leaves is one stream in one task, and the
roots of the blocks are appended to the next, much smaller stream, round by round, until
each tree has one root. Witnesses of upper rounds are joined to those of the blocks. No
task holds more than a block, whatever the size of a tree.

Defined cases: a null field counts as ``-``, null trees come first, rows of equal order
go by leaf digest, a repeated row is a leaf each time, an empty table gives no rows, a
single leaf is its own root with an empty witness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stateglass.llm.common import part_count, written
from stateglass.operators.order import global_index

ARITY = 3
BLOCK_LEVELS = 8
BLOCK = ARITY**BLOCK_LEVELS
SIZE = 32


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 over each field as byte count, colon and value, or ``-`` for null."""

    def framed(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(framed, fields)).cast("binary"), 256))


def parent(digests: bytes) -> bytes:
    """The digest of nodes given as joined digests, which are hashed as hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    levels = 0
    while leaves > 1:
        leaves = -(-leaves // ARITY)
        levels += 1
    return levels


class OpenTree:
    """A tree that leaves are appended to, with the witness of each so far."""

    def __init__(self):
        self.witnesses: list[bytearray] = []
        # Per level the nodes of the open run: (digest, first leaf, end of its leaves).
        self.open: list[list[tuple[bytes, int, int]]] = []

    def append(self, digest: bytes) -> None:
        at = len(self.witnesses)
        self.witnesses.append(bytearray())
        self._add(0, (digest, at, at + 1))

    def _add(self, level: int, node: tuple[bytes, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for k, (_, first, end) in enumerate(run):
            siblings = b"".join(node[0] for i, node in enumerate(run) if i != k)
            for at in range(first, end):
                self.witnesses[at] += siblings
        self._add(level + 1, (parent(b"".join(node[0] for node in run)), run[0][1], run[-1][2]))

    def close(self, levels: int) -> bytes:
        """Completes the short runs up to ``levels`` above the leaves; the node there."""
        for level in range(levels):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        return self.open[levels][0][0]


def fold(leaf: bytes, witness: bytes, trees: Sequence[tuple[int, int]]) -> bytes:
    """The root that a leaf and its witness give; ``trees`` are (place, leaves), lowest first."""
    node, at = leaf, 0
    for place, count in trees:
        while count > 1:
            run = place - place % ARITY
            before = (place - run) * SIZE
            others = (min(ARITY, count - run) - 1) * SIZE
            siblings = witness[at : at + others]
            node = parent(siblings[:before] + node + siblings[before:])
            at += others
            place, count = place // ARITY, -(-count // ARITY)
    return node


def _append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted leaves through trees; a tree ends where tree or block changes."""
    held: list[pa.RecordBatch] = []
    open_tree, current, levels = OpenTree(), None, 0

    def done() -> pa.RecordBatch:
        root = open_tree.close(levels)
        rows = pa.Table.from_batches(held)
        n = rows.num_rows
        rows = rows.append_column("witness", pa.array([bytes(w) for w in open_tree.witnesses], pa.binary()))
        # The first leaf of a block carries its root to the next round.
        rows = rows.append_column("block_root", pa.array([root] + [None] * (n - 1), pa.binary()))
        return rows.combine_chunks().to_batches()[0]

    for batch in batches:
        trees, blocks, counts = (batch.column(c).to_pylist() for c in ("tree", "block", "leaves"))
        digests = batch.column("digest").to_pylist()
        begin = 0
        for k, key in enumerate(zip(trees, blocks)):
            if key != current:
                if k > begin:
                    held.append(batch.slice(begin, k - begin))
                if held:
                    yield done()
                held, open_tree, begin, current = [], OpenTree(), k, key
                levels = height(counts[k]) if counts[k] <= BLOCK else BLOCK_LEVELS
            open_tree.append(digests[k])
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
    if held:
        yield done()


def _round(nodes: DataFrame, label: str) -> DataFrame:
    """``nodes`` (tree, place, leaves, digest, ...) with ``block``, ``witness``, ``block_root``."""
    spark = nodes.sparkSession
    nodes = nodes.withColumn("block", F.call_function("div", "place", F.lit(BLOCK).cast("long")))
    ordered = nodes.repartition(part_count(spark), "tree", "block").sortWithinPartitions("tree", "place")
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return written(ordered.mapInArrow(_append, f"{made}, witness binary, block_root binary"), label)


def _forest(nodes: DataFrame, most: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Trees of ``nodes`` by rounds: the nodes with their whole witness, and the roots by tree."""
    rounds = [_round(nodes, label)]
    while most > BLOCK:
        most = -(-most // BLOCK)
        roots = rounds[-1].where("block_root IS NOT NULL").select(
            "tree",
            F.col("block").alias("place"),
            F.ceil(F.col("leaves") / BLOCK).alias("leaves"),
            F.col("block_root").alias("digest"),
        )
        rounds.append(_round(roots, label))
    top = rounds[-1].where("block_root IS NOT NULL").select("tree", F.col("block_root").alias("tree_root"))
    found = rounds.pop()
    while rounds:
        above = found.select("tree", F.col("place").alias("block"), F.col("witness").alias("__above"))
        below = rounds.pop()
        found = below.join(above, ["tree", "block"]).withColumn("witness", F.concat("witness", "__above"))
        found = found.drop("__above")
    return found, top


def merkle_manifest(leaves: DataFrame) -> DataFrame:
    """The manifest of ``leaves``: columns ``id``, ``tree``, ``leaf`` and ``claim`` (digests).

    Leaves of a tree are in order of ``id``. ``claim`` is the digest that somebody states
    for the row. Gives ``id, leaf, subroot, root, witness, trees, folded``: the siblings
    from leaf to root, joined; the (place, leaves) of the row in its tree and of the tree
    among the trees; and the root that the claim leads to, equal to ``root`` if it holds.
    """
    leaves = leaves.select(
        F.struct("tree").alias("name"), "id", "leaf", "claim", F.monotonically_increasing_id().alias("row")
    )
    placed = global_index(leaves, ["name", "id", "leaf", "row"], "at")
    trees = written(placed.groupBy("name").agg(F.min("at").alias("tree"), F.count("*").alias("leaves")), "trees")
    most, count = trees.agg(F.coalesce(F.max("leaves"), F.lit(0)), F.count("*")).first()

    nodes = placed.join(trees, "name").select(
        "tree", (F.col("at") - F.col("tree")).alias("place"), "leaves", F.col("leaf").alias("digest"), "id", "claim"
    )
    found, subroots = _forest(nodes, most, "manifest-leaves")

    # Trees begin where their first leaf is, so their order is that of their names.
    tops = global_index(subroots, ["tree"], "at").select(
        F.lit(0).cast("long").alias("tree"),
        (F.col("at") - 1).alias("place"),
        F.lit(count).cast("long").alias("leaves"),
        F.col("tree_root").alias("digest"),
        F.col("tree").alias("below"),
    )
    upper, roots = _forest(tops, count, "manifest-trees")
    upper = upper.join(roots.withColumnRenamed("tree_root", "root"), "tree").select(
        F.col("below").alias("tree"),
        F.col("digest").alias("subroot"),
        F.col("place").alias("tree_place"),
        F.col("leaves").alias("tree_count"),
        F.col("witness").alias("__above"),
        "root",
    )
    whole = found.join(upper, "tree").select(
        "id",
        F.col("digest").alias("leaf"),
        "claim",
        "subroot",
        "root",
        F.concat("witness", "__above").alias("witness"),
        F.array(F.struct("place", "leaves"), F.struct(F.col("tree_place").alias("place"), F.col("tree_count").alias("leaves"))).alias("trees"),
    )
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)
    return whole.mapInArrow(_fold, f"{made}, folded binary").drop("claim")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("claim", "witness", "trees")]
        folded = [
            None if claim is None else fold(claim, witness, [(t["place"], t["leaves"]) for t in trees])
            for claim, witness, trees in zip(*columns)
        ]
        yield batch.append_column("folded", pa.array(folded, pa.binary()))
