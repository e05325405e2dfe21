"""Embedding links against all pairs in double precision."""

import numpy as np

from stateglass.llm.embeddings import embedding_links, may_reach, quantise


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for dim in (1, 3, 64, 1100):
        a = rng.normal(size=(80, dim))
        b = np.concatenate([rng.normal(size=(40, dim)), a[:40] + rng.normal(size=(40, dim)) * 0.3])
        cos = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
        for threshold in (0.3, 0.93, 0.999):
            (qa, sa), (qb, sb) = quantise(a), quantise(b)
            mask = np.zeros(cos.shape, bool)
            mask[may_reach(qa, sa, qb, sb, threshold)] = True
            assert mask[cos >= threshold].all()
            if dim > 1:
                assert mask.sum() < cos.size


def plain(rows, threshold=0.93):
    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if usable(v, a) and usable(w, b) and a == b and len(v) == len(w):
                v, w = np.float64(np.float32(v)), np.float64(np.float32(w))
                if v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min(rows[j][0] for j in seen)
        out[rows[i][0]] = (len(links[i]), low, low == rows[i][0])
    return out


def test_all_rows_match_plain(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(400):
        v = base[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.3])
        rows.append((i, np.float32(v).tolist(), int(rng.integers(3)) if i % 17 else None))
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [None] + [1.0] * 7, 1)]
    rows += [(904, [float("nan")] * 8, 1), (905, [float("inf")] * 8, 1), (906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1)]
    rows += [(908, [1e-30] * 8, 1), (909, [1e30] * 8, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame = frame.selectExpr("*", "1 AS rep", "2 AS links", "'x' AS component")
    got = embedding_links(frame, block=50).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.n_links, r.component, r.kept) for r in got} == plain(rows)


def test_no_rows_and_null_ids(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, embedding_links(frame).collect()), key=repr)
    assert got == [(2, 0, 2, True), (None, 0, None, False)]
    assert embedding_links(frame.where("vec_id > 5")).count() == 0
