"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors of one label are cut into even blocks, and each pair of blocks is a tile.
A tile multiplies int8 codes; from the measured quantisation error of each vector
follows how far the product can be from the cosine, and only pairs that may reach
the threshold are computed again in double precision. No link is missed and none
is below the threshold. A tile returns a row per linked vector, never per pair:
how many vectors it links to there and the smallest one it is connected to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stateglass.llm.common import written
from stateglass.llm.components import connected_components, local_roots

THRESHOLD = 0.93
# Vectors of a block: a task holds two blocks, and a block is sent once per block of its label.
BLOCK = 1024
# Pairs computed in double precision at once.
EXACT_PAIRS = 1 << 16
# Slack for the rounding of the bound itself.
_ROUNDING = 1e-9

_BLOCK_SCHEMA = (
    "label string, dim int, block long, blocks long, ids binary, copies binary, "
    "vectors binary, codes binary, stats binary"
)


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, and per vector (scale, error, length of the coded one).

    With u the unit vector and c = scale * code, error = |u - c|. For two vectors,
    |u.w - c.d| = |c.(w - d) + (u - c).w| <= |c| * error_w + error_u.
    """
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    coded = codes * scale[:, None]
    error = np.sqrt(np.einsum("ij,ij->i", unit - coded, unit - coded))
    length = np.sqrt(np.einsum("ij,ij->i", coded, coded))
    return codes.astype(np.int8), np.stack([scale, error, length])


def may_reach(codes_a, stats_a, codes_b, stats_b, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) whose cosine may be at or over the threshold."""
    # Sums of products of int8 are exact in single precision below 2**24.
    exact = np.float32 if codes_a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    dots = codes_a.astype(exact) @ codes_b.astype(exact).T
    upper = dots * stats_a[0][:, None] * stats_b[0][None, :]
    upper += stats_a[2][:, None] * stats_b[1][None, :]
    upper += stats_a[1][:, None]
    return np.nonzero(upper >= threshold - _ROUNDING)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    dots = np.einsum("ij,ij->i", a, b)
    return dots / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _block(dtype: str):
    def run(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        own = group.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        own = own.astype(dtype).reshape(-1, dim)
        # Divided by its largest component, a vector has squares that neither overflow nor vanish.
        wide = own.astype(np.float64)
        codes, stats = quantise(wide / np.abs(wide).max(axis=1)[:, None])
        head = [group.column(c)[:1] for c in ("label", "dim", "block", "blocks")]
        blobs = [
            group.column("rep").to_numpy().astype(np.int64),
            group.column("copies").to_numpy().astype(np.int64),
            own,
            codes,
            stats,
        ]
        return pa.table(
            head + [pa.array([b.tobytes()], pa.binary()) for b in blobs],
            names=["label", "dim", "block", "blocks", "ids", "copies", "vectors", "codes", "stats"],
        )

    return run


def _tile(threshold: float, dtype: str):
    def read(group: pa.Table, row: int):
        get = lambda c: group.column(c)[row].as_py()
        ids, copies = np.frombuffer(get("ids"), np.int64), np.frombuffer(get("copies"), np.int64)
        n, dim = len(ids), get("dim")
        vectors = np.frombuffer(get("vectors"), dtype).reshape(n, dim)
        codes = np.frombuffer(get("codes"), np.int8).reshape(n, dim)
        return ids, copies, vectors, codes, np.frombuffer(get("stats"), np.float64).reshape(3, n)

    def run(group: pa.Table) -> pa.Table:
        ids, copies, vectors, codes, stats = read(group, 0)
        own = group.num_rows == 1
        other = (ids, copies, vectors, codes, stats) if own else read(group, 1)
        left, right = may_reach(codes, stats, other[3], other[4], threshold)
        if own:
            left, right = left[left < right], right[left < right]
        near = np.zeros(len(left), bool)
        for at in range(0, len(left), EXACT_PAIRS):
            some = slice(at, at + EXACT_PAIRS)
            a, b = vectors[left[some]].astype(np.float64), other[2][right[some]].astype(np.float64)
            near[some] = cosines(a, b) >= threshold
        left, right = left[near], right[near]
        if not own:
            right = right + len(ids)
            ids, copies = np.concatenate([ids, other[0]]), np.concatenate([copies, other[1]])
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, left, copies[right])
        np.add.at(total, right, copies[left])
        low = local_roots(ids, left, right)
        some = total > 0
        return pa.table({"node": pa.array(ids[some]), "links": pa.array(total[some]), "low": pa.array(low[some])})

    return run


def embedding_links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """``id``, ``n_links``, ``component`` and ``kept``, one row per input row.

    Vectors of equal label and length are linked if their cosine in double
    precision is at least ``threshold`` (above 0). ``n_links`` counts the other
    vectors linked directly, ``component`` is the smallest id that links lead to,
    and ``kept`` says that it is the row's own. Equal vectors are one class with a
    count and are never compared among themselves.

    A row whose vector is null, empty, zero or has null or non-finite components,
    whose label is null or whose id is null has no links and is its own component.
    Rows that share an id are one vector whose links add up. An empty table gives
    an empty result. Other columns are not read.
    """
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{label_col}`").cast("string").alias("label"),
        F.col(f"`{vector_col}`").alias("vec"),
    )
    single = rows.schema["vec"].dataType.elementType == T.FloatType()
    dtype = "float32" if single else "float64"
    rows = rows.withColumn("vec", F.col("vec").cast("array<float>" if single else "array<double>"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("vec", F.when(usable, F.col("vec")))

    classes = rows.where("vec IS NOT NULL").groupBy("label", "vec")
    classes = classes.agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("dim", F.size("vec")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = classes.join(sizes, ["label", "dim"]).withColumn("block", F.expr("pmod(xxhash64(rep), blocks)"))
    blocks = placed.groupBy("label", "dim", "block").applyInArrow(_block(dtype), _BLOCK_SCHEMA)
    blocks = written(blocks, "blocks")
    tiles = blocks.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    tiles = tiles.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    found = tiles.groupBy("label", "dim", "low", "high").applyInArrow(
        _tile(threshold, dtype), "node long, links long, low long"
    )
    found = written(found, "tiles")

    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())
    facts = totals.join(roots, "node", "left").withColumnRenamed("node", "rep")
    facts = classes.select("label", "vec", "rep", "copies").join(facts, "rep", "left").select(
        "label",
        "vec",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("root", "rep").alias("root"),
    )
    facts = written(facts, "facts")
    joined = rows.join(facts, ["label", "vec"], "left")
    component = F.coalesce("root", "id")
    return joined.select(
        "id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
